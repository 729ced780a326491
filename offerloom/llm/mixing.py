"""Mixing sources to target weights.

Words are summed by source, the weights become target sizes with a ceiling on repetition, and each document is emitted
floor(rate) times plus once more when its seeded hash falls below the fraction of the rate. A source needs only its rate, so
the documents are never ranked or shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import shared_table, unit_hash

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, pattern: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """From (source, size) rows: source, source_size, target and rate of each source.

    Sources in code point order, null last, have the weights of `pattern`, repeated. Targets share the sum of all sizes
    by weight; a target stops at `most` times its source's size and the excess goes to the others by weight until none is
    above. That fixpoint is target = least(most * size, weight * level): the sources are put in the order of the level
    at which they stop, and the level is found with running sums. Sources without words get target and rate 0.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in pattern]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(pattern))) + 1).cast("int"))
    sums = sums.withColumn("weight", weight).withColumn("stop", most * F.col("source_size") / F.col("weight"))
    by_stop = Window.orderBy("stop", F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    after = by_stop.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    sums = sums.withColumn("level", (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after))
    sums = sums.withColumn("level", F.max(F.when(F.col("level") <= F.col("stop"), F.col("level"))).over(everything))
    target = F.least(most * F.col("source_size").cast("double"), F.col("weight") * F.col("level"))
    target = F.coalesce(target, F.lit(0.0))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), target / F.col("source_size"))).otherwise(F.lit(0.0))
    return sums.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def with_copies(docs: DataFrame, targets: DataFrame, seed: int = 29, draw: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add source_size, target, rate and `copies`, how often the mix takes the document.

    The extra copy depends on the seed and the columns of `draw` alone, so reruns agree and rows equal in these are taken
    alike. Columns of the added names in docs are replaced.
    """
    docs = docs.drop("source_size", "target", "rate", "copies")
    joined = docs.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    whole = F.floor("rate")
    return joined.withColumn("copies", (whole + (unit_hash(*draw, seed=seed) < F.col("rate") - whole).cast("int")).cast("int"))


def text_hash(text: str = "text"):
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def numbered(rows: DataFrame, most: int = 1 << 16) -> DataFrame:
    """The rows with `number`, which counts equal rows from 0. They are counted, not ranked: equal rows are one row on their way,
    and come back `most` at a time, in tasks of their own."""
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__n"))
    blocks = counted.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1, F.lit(most).cast("bigint"))))
    # only a row given more than `most` times has several blocks
    many = F.col("__n") > most
    spread = blocks.where(many).repartition(*rows.columns, "__from").unionByName(blocks.where(~many))
    number = F.explode(F.sequence("__from", F.least(F.col("__from") + (most - 1), F.col("__n") - 1)))
    return spread.select(*rows.columns, number.alias("number"))


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def mix(docs: DataFrame, pattern: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 29) -> DataFrame:
    """The mixed documents: each row as often as its rate says, columns unchanged.

    Null texts have no words, null sources are one source, an empty table gives no rows. The draw knows id and text, so rows
    without an id differ by their texts; rows equal in both are taken alike (mix_digest numbers them, as they are all that it
    returns; here that would shuffle the texts).
    """
    # written, so that its size is known when the join is planned: few sources are broadcast then, and no text is shuffled
    targets = shared_table(source_targets(docs.select("source", word_count().alias("size")), pattern, most), "mix-targets")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "source", text_hash().alias("__text"), F.lit(0).alias("__number"))
    taken = with_copies(rows, targets, seed, ("doc_id", "__text", "__number"))
    return taken.withColumn("__copy", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))))).select("__row.*")


def mix_digest(docs: DataFrame) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words that the mix takes of it. Rows equal in id,
    text and source are numbered, and each number draws on its own."""
    sizes = shared_table(docs.select("doc_id", "source", word_count().alias("size"), text_hash().alias("hash")), "mix-sizes")
    taken = with_copies(numbered(sizes), source_targets(sizes), draw=("doc_id", "hash", "number"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
