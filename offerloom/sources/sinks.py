"""Exports, previews and durable snapshots."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of a CSV export, in order.
CSV_COLUMNS = ("external_id", "source", "title", "company", "location", "contract_type", "experience_level", "salary_min", "salary_max", "posted_at", "url")


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines with nulls and characters as they are."""
    rows.write.option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """S14."""
    rows.select(*CSV_COLUMNS).write.option("header", True).csv(path)


def cut(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def preview(rows: DataFrame, n: int = 20) -> DataFrame:
    """The first rows with short texts."""
    return rows.limit(n).select(cut(F.col("title"), 40).alias("title"), cut(F.col("company"), 25).alias("company"), cut(F.col("location"), 20).alias("location"))


def _camel(name: str) -> str:
    return "".join(p if not i else p.capitalize() for i, p in enumerate(name.split("_")))


def _camel_type(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(_camel(f.name), _camel_type(f.dataType), f.nullable) for f in kind])
    return T.ArrayType(_camel_type(kind.elementType), kind.containsNull) if isinstance(kind, T.ArrayType) else kind


def camel(rows: DataFrame) -> DataFrame:
    """Column names in camel case, also inside structs and arrays of them; keys of maps are data and stay."""
    fields = rows.schema.fields
    named = rows.toDF(*[f"c{i}" for i in range(len(fields))])
    return named.select(*[F.col(f"c{i}").cast(_camel_type(f.dataType)).alias(_camel(f.name)) for i, f in enumerate(fields)])


#: What a card shows, in order.
CARD = ("id", "title", "company", "location", "salary_min", "salary_max", "salary_currency", "contract_type", "experience_level", "remote", "posted_at", "viewed_at", "sources", "duplicate_state", "possible_duplicates")


def card_lines(cards: DataFrame) -> DataFrame:
    """One JSON text for each card, nested as search.cards has it and in camel case, absent values as nulls and absent lists as empty ones."""
    lists = {c: F.coalesce(F.col(c), F.array().cast(cards.schema[c].dataType)) for c in ("sources", "possible_duplicates")}
    shown = camel(cards.withColumns(lists).select(*CARD))
    return shown.select("id", F.to_json(F.struct(*shown.columns), {"ignoreNullFields": "false"}).alias("card"))


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    batch: int | None


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def versions(spark: SparkSession, path: str) -> list[Version]:
    """The committed versions under `path`, oldest first."""
    at, fs, jvm = _hadoop(spark, f"{path}/_versions")
    found = []
    for status in fs.listStatus(at) if fs.exists(at) else []:
        stream = fs.open(status.getPath())
        try:
            row = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        found.append(Version(int(status.getPath().getName()), row["folder"], row["batch"]))
    return sorted(found, key=lambda v: v.number)


def current_version(spark: SparkSession, path: str) -> Version | None:
    return next(iter(versions(spark, path)[::-1]), None)


def write_snapshot(rows: DataFrame, path: str, version: str, partition_by: tuple[str, ...] = (), parent: int | None = None, batch: int | None = None) -> Version:
    """A snapshot in a folder of its own under `path`, and then a commit that makes it the current one; readers see the old or the new.

    The commit is a file with the number after the parent's (0: none; null: whichever is current when this begins), which only one writer can create: if another
    one was first, this raises Conflict, its folder goes, and nothing is lost. `batch` is kept with the commit, as the ledger of a stream's batches.
    """
    spark = rows.sparkSession
    if parent is None:
        parent = getattr(current_version(spark, path), "number", 0)
    folder = f"{path}/{version}"
    rows.write.partitionBy(*partition_by).parquet(folder)
    at, fs, _ = _hadoop(spark, f"{path}/_versions/{parent + 1:012d}")
    try:
        if fs.exists(at):
            raise Conflict(f"version {parent + 1} of {path} is taken")
        out = fs.create(at, False)
    except Exception as e:
        gone, fs, _ = _hadoop(spark, folder)
        fs.delete(gone, True)
        raise e if isinstance(e, Conflict) else Conflict(str(e)) from e
    out.write(bytearray(json.dumps({"folder": version, "batch": batch}).encode()))
    out.close()
    return Version(parent + 1, version, batch)


def read_snapshot(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The current snapshot under `path`, or an older version that is still kept."""
    folder = next(v.folder for v in versions(spark, path)[::-1] if number in (None, v.number))
    return spark.read.parquet(f"{path}/{folder}")


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove all versions but the last `keep`: as many as the longest reader may fall behind. The commits stay, so numbers do not come again."""
    gone = 0
    for v in versions(spark, path)[: -keep or None]:
        at, fs, _ = _hadoop(spark, f"{path}/{v.folder}")
        gone += fs.delete(at, True)
    return gone
