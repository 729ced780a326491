"""Streaming twins of batch queries: the given `events` as landed files, read until none is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.operators import tables as U
from offerloom.plans import table_queries
from offerloom.plans.bridge import listings, search_listings
from offerloom.session import new_folder, shared_table
from offerloom.sources import sinks
from offerloom.streaming import jobs as J
from offerloom.streaming import state as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
STORED = "source string, external_id string, url string, title string, company string, location string, posted_at timestamp, active boolean, first_seen_at timestamp, last_seen_at timestamp"


def landed_events(spark, sf_dir) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    # a path as a pattern, so that a single file is taken for landed files too
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")


def settled(rows: DataFrame, name: str) -> DataFrame:
    """The state of a stream's aggregate when all landed files are read, from the shared folder."""
    spark = rows.sparkSession
    folder = new_folder(spark, name)
    query = rows.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def r3(spark, sf_dir):
    seen = landed_events(spark, sf_dir).select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("external_id"), F.col("ts").alias("seen_at"), F.col("event_id").cast("string").alias("title"))
    return settled(J.latest_sightings(seen), "r3").select("source", "external_id", "last_seen_at")


def r3_remembered(spark, sf_dir):
    """Each change is written under its batch's number, so a batch that comes again writes the same; the last change of a listing is its state."""
    folder = new_folder(spark, "r3-state")
    seen = landed_events(spark, sf_dir).select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("external_id"), F.col("ts").cast("timestamp").alias("seen_at"), F.col("props").alias("title"))
    J.upsert_stream(S.remembered_sightings(seen, idle_days=2), lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={n}"), f"{folder}/state").awaitTermination()
    changes = spark.read.parquet(f"{folder}/changes")
    newest = changes.groupBy(*S.KEYS).agg(F.max_by(F.struct("last_seen_at", "title", "forgotten"), F.struct("batch", "forgotten")).alias("x"))
    return newest.select(*S.KEYS, "x.*")


def r4(spark, sf_dir):
    views = landed_events(spark, sf_dir).where("event_type = 'view'").select(F.col("user_id").alias("job_id"), F.col("ts").alias("viewed_at"))
    return settled(J.first_views(views), "r4")


def r5(spark, sf_dir):
    seen = landed_events(spark, sf_dir).select(F.col("user_id").alias("run_id"), F.expr("event_id % 6").alias("source"), F.col("ts").alias("seen_at"))
    return settled(J.progress(seen), "r5")


def counted_upsert(stored: DataFrame | None, batch: DataFrame) -> DataFrame:
    """U1 with the number of sightings of each listing, which shows a batch that is applied twice."""
    old = stored if stored is not None else U.upsert_listings(batch.sparkSession.createDataFrame([], STORED), batch.limit(0)).withColumn("sightings", F.lit(0).cast("bigint"))
    seen = old.select(*U.LISTING, "sightings").unionByName(batch.groupBy(*U.LISTING).agg(F.count(F.lit(1)).alias("sightings"))).groupBy(*U.LISTING).agg(F.sum("sightings").alias("sightings"))
    return U.upsert_listings(old.drop("sightings"), batch).join(seen, list(U.LISTING))


def r1(spark, sf_dir):
    """Sightings land in files of their own; each is a batch of the stream, which keeps a snapshot with a ledger. When a listing was first seen depends on
    the order in which files land (U1), so it is not shown."""
    folder = new_folder(spark, "r1")
    seen = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("external_id"), F.col("props").alias("title"), *[F.lit(None).cast("string").alias(c) for c in ("url", "company", "location")], F.lit(None).cast("timestamp").alias("posted_at"), F.col("ts").cast("timestamp").alias("seen_at"), F.col("event_id").alias("tie"))
    seen.repartitionByRange(4, "tie").write.parquet(f"{folder}/landed")
    J.upsert_stream(J.landed(spark, f"{folder}/landed", seen.schema, 1), J.exactly_once(f"{folder}/listings", counted_upsert), f"{folder}/state").awaitTermination()
    return sinks.read_snapshot(spark, f"{folder}/listings").select(*U.LISTING, "active", "last_seen_at", "sightings")


def r6(spark, sf_dir):
    """u8_deactivate_unseen from pages that land: BUILDING's scans end, MACHINERY's lose a card, and the first page of a later run closes them."""
    folder = new_folder(spark, "r6")
    attached = shared_table(search_listings(spark, sf_dir).select(F.col("search_name").alias("search"), "source", "external_id", "ord"), "attached")
    at = lambda day: F.to_timestamp(F.lit(day))
    page = (F.col("ord") % 4 + 1).cast("int")
    seen = attached.where("search in ('BUILDING', 'MACHINERY')").groupBy("search", "source", page.alias("page")).agg(F.count(F.lit(1)).alias("cards"))
    last = seen.select("search", "source").distinct().withColumns({"page": F.lit(5), "cards": F.lit(0).cast("bigint")})
    rows = seen.unionByName(last).withColumns({"run_id": F.lit(1), "started_at": at("2001-01-01")})
    rows = rows.unionByName(last.withColumns({"page": F.lit(1), "run_id": F.lit(2), "started_at": at("2001-02-01")}))
    rows = rows.withColumns({"parsed": F.col("cards") - F.when((F.col("search") == "MACHINERY") & (F.col("page") == 1), 1).otherwise(0), "new_ids": F.col("cards"), "at": F.col("started_at") + F.make_dt_interval(mins=F.col("page"))})
    for run in (1, 2):
        rows.where(F.col("run_id") == run).write.mode("append").parquet(f"{folder}/landed/{run}")
    sinks.write_snapshot(listings(spark, sf_dir).select("source", "external_id", "active", F.col("seen_at").alias("last_seen_at")), f"{folder}/listings", "first")
    proof = attached.select("search", "source").distinct().where("search <> 'MACHINERY'").withColumn("started_at", at("2000-06-01"))
    J.keep_alive(J.landed(spark, f"{folder}/landed/*", rows.schema), f"{folder}/listings", attached.drop("ord"), proof, f"{folder}/state").awaitTermination()
    return sinks.read_snapshot(spark, f"{folder}/listings").select("source", "external_id", "active")


QUERIES |= {"r6_liveness_stream": r6}
ORACLES |= {"r6_liveness_stream": table_queries.ORACLES["u8_deactivate_unseen"]}
QUERIES |= {"r1_upsert_stream": r1}
ORACLES |= {"r1_upsert_stream": "SELECT event_type AS source, user_id::VARCHAR AS external_id, true AS active, max(ts) AS last_seen_at, count(*) AS sightings FROM events GROUP BY ALL"}
QUERIES |= {"r3_remembered_sightings": r3_remembered}
ORACLES |= {
    "r3_remembered_sightings": """SELECT event_type AS source, user_id::VARCHAR AS external_id, max(ts) AS last_seen_at, max_by(props, {'ts': ts, 'props': props}) AS title,
  max(ts) + INTERVAL 2 DAY < (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS forgotten FROM events GROUP BY ALL"""
}
QUERIES |= {"r3_latest_sightings": r3, "r4_first_views": r4, "r5_progress": r5}
ORACLES |= {
    "r3_latest_sightings": "SELECT event_type AS source, user_id::VARCHAR AS external_id, max(ts) AS last_seen_at FROM events GROUP BY ALL",
    "r4_first_views": "SELECT user_id AS job_id, min(ts) AS viewed_at FROM events WHERE event_type = 'view' GROUP BY 1",
    "r5_progress": "SELECT user_id AS run_id, event_id % 6 AS source, count(*) AS offers_seen FROM events GROUP BY ALL",
}
