"""Scan runs: outcomes, completeness, liveness of listings, and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerloom.functions.scalars import schedule_instant, stable_intersection
from offerloom.session import spread


def first_sightings(rows: DataFrame) -> DataFrame:
    """The first sighting of an id in a scan."""
    order = Window.partitionBy("run_id", "source", "external_id").orderBy("page", "pos")
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def capped(rows: DataFrame, most: int) -> DataFrame:
    """The first `most` rows of a scan, in order of arrival."""
    order = Window.partitionBy("run_id", "source").orderBy("page", "pos")
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).drop("rn")


def page_counts(rows: DataFrame) -> DataFrame:
    """Per page, the rows and how many ids no earlier page of the scan had."""
    keys = ("run_id", "source", "external_id")
    rows = spread(rows.select(*keys, "page"), *keys)
    # the first row of an id by page stands for it, so nothing distinct is counted
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("page"))))
    new = F.count_if((F.col("at") == 1) & F.col("external_id").isNotNull() & F.col("page").isNotNull())
    return rows.groupBy("run_id", "source", "page").agg(F.count(F.lit(1)).alias("cards"), new.alias("new_ids"))


def scan_verdicts(pages: DataFrame, most_pages: int | None = None, keys: tuple[Column | str, ...] = ("run_id", "source")) -> DataFrame:
    """Q1: per scan, whether it is complete: nothing is broken and its last page is an end.

    pages: run_id, source, page, cards, parsed, new_ids and, where pages tell them, total (results in all), malformed, and
    last (the page says that it is the last). A scan is broken if a page lost cards, is malformed, is empty although
    the total is positive, or after the first brought no new id; or if it reached `most_pages` with a page that is no end.
    Pages may be a stream; `keys` then have a window of event time, and a verdict comes when the watermark closes it.
    """
    given = lambda name, kind, default: F.coalesce(F.col(name).cast(kind), F.lit(default)) if name in pages.columns else F.lit(default)
    empty = F.col("cards") == 0
    end = empty | given("last", "boolean", False)
    bad = (F.col("parsed") != F.col("cards")) | ((F.col("page") > 1) & ~empty & (F.col("new_ids") == 0)) | given("malformed", "boolean", False)
    bad = bad | ((F.col("page") == 1) & empty & (given("total", "long", 0) > 0))
    if most_pages is not None:
        bad = bad | ((F.col("page") >= most_pages) & ~end)
    rows = pages.groupBy(*keys).agg(F.bool_or(bad).alias("broken"), F.max_by(end, "page").alias("ended"), F.sum("cards").alias("cards"))
    return rows.withColumn("complete", ~F.col("broken") & F.col("ended"))


def source_outcome(error: Column, complete: Column, capped_: Column, persisted: Column) -> Column:
    """An error or an unconfirmed end is partial if anything was stored, else failed; a reached cap is partial."""
    lost = F.when(persisted > 0, "partial").otherwise("failed")
    return F.when(error.isNotNull(), lost).when(capped_, "partial").when(complete, "succeeded").otherwise(lost)


def run_status(results: DataFrame, run: str = "run") -> DataFrame:
    """All succeeded, any succeeded or partial, else failed."""
    ok, some = F.bool_and(F.col("status") == "succeeded"), F.bool_or(F.col("status").isin("succeeded", "partial"))
    return results.groupBy(run).agg(F.when(ok, "succeeded").when(some, "partial").otherwise("failed").alias("status"))


def batch_status(runs: DataFrame, batch: str = "batch") -> DataFrame:
    """Of the runs of a batch all succeeded, all failed, or partial."""
    every = lambda status: F.bool_and(F.col("status") == status)
    return runs.groupBy(batch).agg(F.when(every("succeeded"), "succeeded").when(every("failed"), "failed").otherwise("partial").alias("status"), F.count(F.lit(1)).alias("runs"))


def current_state(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last event of each key; times of an unfinished state are cleared."""
    rest = [c for c in events.columns if c not in keys]
    last = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(*keys, "s.*")
    open_ = F.col("status").isin("pending", "running")
    if "finished_at" in last.columns:
        last = last.withColumn("finished_at", F.when(~open_, F.col("finished_at")))
    if "error_message" in last.columns:
        last = last.withColumn("error_message", F.when(~open_ & (F.col("status") != "succeeded"), F.col("error_message")))
    return last


def filled_results(runs: DataFrame, results: DataFrame) -> DataFrame:
    """A row for each requested source; what has no result is succeeded or failed as its finished run, else pending."""
    asked = runs.select("run", F.col("status").alias("run_status"), F.posexplode("requested_sources").alias("pos", "source"))
    rows = asked.join(results.select("run", "source", F.col("status").alias("own"), "offers_seen"), ["run", "source"], "left")
    fill = F.when(F.col("run_status") == "succeeded", "succeeded").when(F.col("run_status").isin("partial", "failed"), "failed").otherwise("pending")
    return rows.select("run", "pos", "source", F.coalesce("own", fill).alias("status"), F.coalesce("offers_seen", F.lit(0.0)).alias("offers_seen"))


def allowed_sources(requests: DataFrame, configured: list[str]) -> DataFrame:
    """L3: add `unknown` (requested sources that are not configured) and `sources` (those that are, in configured order)."""
    known = F.array(*[F.lit(x) for x in configured])
    asked = F.col("requested_sources")
    return requests.withColumns({"unknown": F.array_except(asked, known), "sources": stable_intersection(known, asked)})


def retryable(filled: DataFrame) -> DataFrame:
    """U16."""
    return filled.where(F.col("status").isin("failed", "partial"))


def active_runs(runs: DataFrame) -> DataFrame:
    """Runs that are pending or running; of a search's all but the newest are to fail."""
    newest = Window.partitionBy("search").orderBy(F.desc("created_at"), F.desc("run"))
    return runs.where(F.col("status").isin("pending", "running")).withColumn("superseded", F.row_number().over(newest) > 1)


def overdue(searches: DataFrame, completions: DataFrame, as_of: Column, hour: int, minute: int, zone: str = "Europe/Paris") -> DataFrame:
    """Active searches whose last useful completion is before today's schedule, which has passed."""
    last = completions.where(F.col("status").isin("succeeded", "partial")).groupBy("search").agg(F.max("finished_at").alias("completed_at"))
    rows = searches.where("active").join(last, "search", "left").withColumn("due_at", schedule_instant(as_of, hour, minute, zone))
    return rows.where((F.col("due_at") <= as_of) & (F.col("completed_at").isNull() | (F.col("completed_at") < F.col("due_at"))))


def any_overdue(due: DataFrame) -> DataFrame:
    """One row, whether any active search is overdue."""
    return due.agg((F.count(F.lit(1)) > 0).alias("is_due"))


def deactivate_unseen(listings: DataFrame, attached: DataFrame, scan: DataFrame, verified: DataFrame, never: tuple[str, ...] = ("linkedin",)) -> DataFrame:
    """`active` after complete scans.

    scan: (search, source, started_at) of complete scans; attached: (search, source, external_id) of active searches; verified:
    (search, source, started_at) of succeeded, finished scans. A listing goes if a scan that it is attached to began after it was last
    seen and every other search of its source that it is attached to has a verified scan begun after that too. Sources in `never` keep all.
    """
    key = ["source", "external_id"]
    scanned = scan.where(~F.col("source").isin(*never)).groupBy("search", "source").agg(F.max("started_at").alias("scan_start"))
    stale = listings.where("active").join(attached, key).join(scanned, ["search", "source"]).where("last_seen_at < scan_start").select(*key, "last_seen_at", "search")
    others = stale.select(*key, "last_seen_at", F.col("search").alias("by")).join(attached, key).where("search <> by")
    proof = verified.groupBy("search", "source").agg(F.max("started_at").alias("verified_at"))
    checked = others.join(proof, ["search", "source"], "left").groupBy(*key, "by").agg(F.bool_and(F.coalesce(F.col("verified_at") > F.col("last_seen_at"), F.lit(False))).alias("all_verified"))
    gone = stale.withColumnRenamed("search", "by").join(checked, [*key, "by"], "left").where(F.coalesce("all_verified", F.lit(True))).select(*key).distinct()
    return listings.join(gone.withColumn("gone", F.lit(True)), key, "left").withColumn("active", F.col("active") & F.col("gone").isNull()).drop("gone")


def error_text(kind: Column) -> Column:
    """U19."""
    return F.when(kind == "timeout", "The source did not answer in time").when(kind == "connection", "The source could not be reached").when(kind == "request", "The source refused the request").otherwise("The scan failed")
