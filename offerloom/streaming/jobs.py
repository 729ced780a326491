"""Structured Streaming over landed sightings and views."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from offerloom.operators.runs import deactivate_unseen, scan_verdicts
from offerloom.sources import sinks


def landed(spark: SparkSession, path: str, schema: str, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def without_repeats(sightings: DataFrame, delay: str = "1 day") -> DataFrame:
    """R2: the first sighting of a listing in a run."""
    return sightings.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["source", "external_id", "run_id"])


def latest_sightings(sightings: DataFrame) -> DataFrame:
    """Per listing the newest sighting; a late one changes nothing."""
    return sightings.groupBy("source", "external_id").agg(F.max("seen_at").alias("last_seen_at"), F.max_by("title", F.struct("seen_at", "title")).alias("title"))


def first_views(views: DataFrame) -> DataFrame:
    """R4."""
    return views.groupBy("job_id").agg(F.min("viewed_at").alias("viewed_at"))


def progress(sightings: DataFrame, window: str | None = None, delay: str = "1 day") -> DataFrame:
    """Counts per run and source, or per source and window of event time."""
    if window is None:
        return sightings.groupBy("run_id", "source").agg(F.count(F.lit(1)).alias("offers_seen"))
    return sightings.withWatermark("seen_at", delay).groupBy(F.window("seen_at", window), "source").agg(F.count(F.lit(1)).alias("offers_seen"))


def upsert_stream(sightings: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes to `merge` with its number, which makes a repeated batch harmless; ends when all landed files are read."""
    return sightings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exactly_once(path: str, apply: Callable[[DataFrame | None, DataFrame], DataFrame], keep: int = 2) -> Callable[[DataFrame, int], None]:
    """A merge for upsert_stream into the snapshot under `path`. The number of a batch is committed in one step with the snapshot that has it,
    so a batch that comes again after a failure, or after a restart, writes nothing; of two streams that run at once one fails. `apply` gives the next
    snapshot from the current one (none at first) and the batch."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = sinks.current_version(spark, path)
        if now is not None and now.batch is not None and now.batch >= number:
            return
        stored = None if now is None else sinks.read_snapshot(spark, path, now.number)
        sinks.write_snapshot(apply(stored, batch), path, f"batch-{number}-{uuid.uuid4().hex}", parent=now.number if now else 0, batch=number)
        sinks.drop_old_versions(spark, path, keep)

    return merge


def liveness_stream(verdicts: DataFrame, deactivate: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Of the verdicts of ended scans (run_id, source, complete, …) the complete ones go to `deactivate`, micro-batch by micro-batch."""
    return upsert_stream(verdicts.where("complete"), deactivate, checkpoint)


def closed_scans(pages: DataFrame, idle: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """A stream of verdicts (run_id, search, source, started_at, complete, …), one when no page of a scan has come for `idle`, from a stream of pages
    with their time `at`. State is held for open scans alone: the watermark, `delay` behind the newest page, drops what it has closed."""
    keys = ("run_id", "search", "source", "started_at", F.session_window("at", idle))
    return scan_verdicts(pages.withWatermark("at", delay), keys=keys).drop("session_window")


def keep_alive(pages: DataFrame, path: str, attached: DataFrame, verified: DataFrame, checkpoint: str) -> StreamingQuery:
    """Scans that close deactivate in the snapshot under `path` what they did not see, each batch of verdicts once; scans that are not complete change nothing."""

    def apply(stored: DataFrame, verdicts: DataFrame) -> DataFrame:
        return deactivate_unseen(stored, attached, verdicts.select("search", "source", "started_at"), verified)

    return liveness_stream(closed_scans(pages), exactly_once(path, apply), checkpoint)


def drained(rows: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """The table of a stream after all files landed so far; for tests and twins of batch queries."""
    query = rows.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.table(name)
