"""Tables, the shared folder and small helpers that the operators of this subpackage have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.session import new_folder, shared_dir, shared_table  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(doc_id: str, base: int) -> Column:
    """crc32 of the id as text, modulo base; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(base))


def unit_hash(*parts: Column | str, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts, the same in every engine."""
    texts = [F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts]
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *texts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(2.0**52)
