"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source, given the fractional rank (2k+1)/2n there, put in the
order of that fraction, and the order is cut into shards of equal row counts, so every shard holds the mixture of the
whole. Both rankings are done in two steps (counts of hash ranges, then ranks inside a range), so that no source, however
large, is sorted by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hash ranges a source is ranked in: the first three hexadecimal digits of the MD5.
RANGES = 4096


def interleave_shards(docs: DataFrame, shards: int, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", crc_col: str | None = None) -> DataFrame:
    """Add `shard` (0 to shards-1, row counts at most one apart) and `slot` (gapless from 0 in each shard).

    Null ids, sources and texts are ordinary values: a null source is a source of its own. Repeated rows each get a slot;
    which of two equal rows gets which slot makes no difference to the result. The hash is that of the id and of the
    text's checksum (`crc_col`, where it is known already), so rows without an id are spread by their texts. An empty table gives no rows. Other columns pass through; the columns `shard` and `slot` are
    replaced if the table has them, and the columns used inside start with two underscores.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    kept = docs.drop("shard", "slot")
    crc = F.col(crc_col) if crc_col else F.coalesce(F.crc32(F.col(text_col).cast("string").cast("binary")), F.lit(0))
    rows = kept.select(
        F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("__row"),
        F.col(source_col).alias("__source"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), crc.cast("string")).cast("binary")).alias("__hash"),
        crc.alias("__crc"),
    ).withColumn("__range", F.substring("__hash", 1, 3))

    ranges = rows.groupBy("__source", "__range").agg(F.count(F.lit(1)).alias("__in_range"))
    by_source = Window.partitionBy("__source")
    ranges = ranges.select(
        F.col("__source").alias("__s"),
        F.col("__range").alias("__r"),
        (F.sum("__in_range").over(by_source.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__in_range")).alias("__before"),
        F.sum("__in_range").over(by_source).alias("__n"),
    )
    inside = Window.partitionBy("__source", "__range").orderBy("__hash", "__crc")
    ranked = rows.withColumn("__k", F.row_number().over(inside) - 1).join(ranges, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
    odd = 2 * (F.col("__before") + F.col("__k")) + 1
    ranked = ranked.withColumn("__fraction", odd / (2 * F.col("__n"))).withColumn("__cut", F.expr(f"(2 * (__before + __k) + 1) * {RANGES} div (2 * __n)"))

    # A source with n rows has floor((2nc + R - 1) / 2R) of them before range c of the fractions; small ones are listed row by row.
    before = lambda c: f"(2 * __n * ({c}) + {RANGES - 1}) div {2 * RANGES}"
    totals = ranges.select("__s", "__n").distinct().select("__n", F.explode(F.expr(f"sequence(0L, least(__n, {RANGES}L) - 1)")).alias("__i"))
    few = F.col("__n") < RANGES
    cuts = totals.select(
        F.when(few, F.expr(f"(2 * __i + 1) * {RANGES} div (2 * __n)")).otherwise(F.col("__i")).alias("__c"),
        F.when(few, F.lit(1)).otherwise(F.expr(f"{before('__i + 1')} - {before('__i')}")).alias("__rows"),
    )
    by_cut = Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, 0)
    starts = cuts.groupBy("__c").agg(F.sum("__rows").alias("__rows"))  # RANGES rows at most
    starts = starts.select("__c", (F.sum("__rows").over(by_cut) - F.col("__rows")).alias("__start"), F.sum("__rows").over(Window.partitionBy()).alias("__all"))
    order = Window.partitionBy("__cut").orderBy("__fraction", "__source", "__hash", "__crc")
    placed = ranked.withColumn("__j", F.row_number().over(order) - 1).join(starts, F.col("__cut") == F.col("__c"))
    placed = placed.withColumn("__p", F.col("__start") + F.col("__j"))
    # Shard s holds the places p with floor(p * shards / all) = s, so it begins at ceil(s * all / shards).
    placed = placed.withColumn("shard", F.expr(f"cast(__p * {shards} div __all as int)")).withColumn("slot", F.expr(f"__p - (shard * __all + {shards - 1}) div {shards}"))
    return placed.select("__row.*", "shard", "slot")


def shard_digest(docs: DataFrame, shards: int = 40, seed: int = 17) -> DataFrame:
    """One row per document with its size (UTF-8 bytes plus 16), checksum, law, shard and slot; null texts have no bytes."""
    narrow = docs.select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("bigint").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
    )
    # the checksum stands in for the text, which then stays out of the shuffles
    placed = interleave_shards(narrow, shards, seed, crc_col="text_crc32")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
