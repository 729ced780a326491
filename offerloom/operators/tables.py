"""Snapshot tables: upserts, merges, first views and detail groups. Every operator takes and gives DataFrames; writing is apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerloom.functions.text import has_text
from offerloom.session import spread

LISTING = ("source", "external_id")
TEXTS = ("url", "title", "company", "location", "posted_at")


def upsert_listings(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The snapshot after a batch of sightings (with seen_at and a tie-breaking `tie`).

    The last sighting of a key in the batch gives the texts; a sighting older than the stored last_seen_at refreshes texts but
    neither moves last_seen_at back nor makes the listing active again. New keys are active, first and last seen then.
    """
    order = F.struct("seen_at", "tie")
    news = batch.groupBy(*LISTING).agg(*[F.max_by(c, order).alias(f"n_{c}") for c in TEXTS], F.min("seen_at").alias("n_first"), F.max("seen_at").alias("n_last"))
    both = stored.join(news, list(LISTING), "full_outer")
    seen, fresh = F.col("n_last").isNotNull(), F.col("last_seen_at").isNull() | (F.col("last_seen_at") <= F.col("n_last"))
    return both.select(
        *LISTING,
        *[F.when(seen, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in TEXTS],
        F.when(seen & fresh, F.lit(True)).otherwise(F.col("active")).alias("active"),
        F.coalesce("first_seen_at", "n_first").alias("first_seen_at"),
        F.greatest("last_seen_at", "n_last").alias("last_seen_at"),
    )


def refresh_job(stored: DataFrame, offer: DataFrame) -> DataFrame:
    """Facts of the newest offer replace the stored ones even when null; description, salary, skills and benefits only if given."""
    always = ("title", "company", "location", "contract_type", "experience_level", "remote", "posted_at")
    new = offer.select("job_id", *[F.col(c).alias(f"n_{c}") for c in (*always, "description", "salary_min", "salary_max", "salary_currency", "skills", "benefits")])
    both = stored.join(new, "job_id", "left")
    has_offer = F.col("n_title").isNotNull()
    bound = F.col("n_salary_min").isNotNull() | F.col("n_salary_max").isNotNull()
    columns = {c: F.when(has_offer, F.col(f"n_{c}")).otherwise(F.col(c)) for c in always}
    columns |= {"description": F.when(has_text(F.col("n_description")), F.col("n_description")).otherwise(F.col("description"))}
    columns |= {c: F.coalesce(F.col(f"n_{c}"), F.col(c)) for c in ("salary_min", "salary_max")}
    columns |= {"salary_currency": F.when(bound & F.col("n_salary_currency").isNotNull(), F.col("n_salary_currency")).otherwise(F.col("salary_currency"))}
    columns |= {c: F.when(F.coalesce(F.size(f"n_{c}"), F.lit(0)) > 0, F.col(f"n_{c}")).otherwise(F.col(c)) for c in ("skills", "benefits")}
    return both.select("job_id", *[v.alias(k) for k, v in columns.items()])


def attach_searches(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The union of links; a link keeps its first created_at."""
    return spread(stored.unionByName(new), "search_id", "job_id").groupBy("search_id", "job_id").agg(F.min("created_at").alias("created_at"))


def mark_viewed(jobs: DataFrame, views: DataFrame) -> DataFrame:
    """The first view wins, the stored one included."""
    first = views.groupBy("job_id").agg(F.min("viewed_at").alias("first_view"))
    return jobs.join(first, "job_id", "left").withColumn("viewed_at", F.least("viewed_at", "first_view")).drop("first_view")


def best_listing(listings: DataFrame, with_details: tuple[str, ...], fallback: str = "linkedin") -> DataFrame:
    """The listing to take details from: active, of a source with details, last seen, of highest ord; else of `fallback`."""
    usable = listings.where(F.col("active") | (F.col("source") == fallback))
    rank = Window.partitionBy("job_id").orderBy(F.desc("active"), F.desc(F.col("source").isin(*with_details)), F.desc("last_seen_at"), F.desc("ord"))
    return usable.withColumn("rn", F.row_number().over(rank)).where("rn = 1").drop("rn")


def first_listing(listings: DataFrame) -> DataFrame:
    """W7."""
    return listings.groupBy("job_id").agg(F.min_by(F.struct("source", "external_id"), "ord").alias("first")).select("job_id", "first.*")


def apply_details(jobs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per job and detail group the newest usable snapshot that is newer than the group's stamp.

    Salary is one group and needs a currency, and must not lose a bound the job has. A job with a detail time but no stamps is read as
    stamped then for the groups it has.
    """
    shot = lambda ok, *c: F.max(F.when(ok, F.struct("fetched_at", *c)))
    salaried = F.col("salary_currency").isNotNull() & (F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull())
    best = snapshots.groupBy("job_id").agg(
        shot(has_text(F.col("description")), "description").alias("d"),
        shot(salaried, "salary_min", "salary_max", "salary_currency").alias("s"),
        shot(F.size("skills") > 0, "skills").alias("k"),
        shot(F.size("benefits") > 0, "benefits").alias("b"),
    )
    rows = jobs.join(best, "job_id", "left")
    groups = F.array_compact(F.array(F.when(has_text(F.col("description")), F.lit("description")), F.when(F.col("salary_currency").isNotNull(), F.lit("salary")), F.when(F.size("skills") > 0, F.lit("skills")), F.when(F.size("benefits") > 0, F.lit("benefits"))))
    spread = F.map_from_arrays(groups, F.transform(groups, lambda g: F.col("details_fetched_at")))
    stamps = F.when((F.coalesce(F.size("provenance"), F.lit(0)) <= 0) & F.col("details_fetched_at").isNotNull(), spread).otherwise(F.coalesce("provenance", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<timestamp>"))))
    rows = rows.withColumn("stamps", stamps)
    newer = lambda g, c: F.col(c).isNotNull() & (F.element_at("stamps", F.lit(g)).isNull() | (F.col(f"{c}.fetched_at") > F.element_at("stamps", F.lit(g))))
    keeps = (F.col("salary_min").isNull() | F.col("s.salary_min").isNotNull()) & (F.col("salary_max").isNull() | F.col("s.salary_max").isNotNull())
    use = {"description": newer("description", "d"), "salary": newer("salary", "s") & keeps, "skills": newer("skills", "k"), "benefits": newer("benefits", "b")}
    pick = lambda g, c, n: F.when(use[g], F.col(f"{c}.{n}")).otherwise(F.col(n)).alias(n)
    times = F.array(*[F.when(use[g], F.struct(F.lit(g).alias("key"), F.col(f"{c}.fetched_at").alias("value"))) for g, c in (("description", "d"), ("salary", "s"), ("skills", "k"), ("benefits", "b"))])
    applied = F.map_from_entries(F.filter(times, lambda x: x.isNotNull()))
    kept = F.map_filter("stamps", lambda k, v: ~F.array_contains(F.map_keys(applied), k))
    others = [c for c in jobs.columns if c not in ("description", "salary_min", "salary_max", "salary_currency", "skills", "benefits", "provenance", "details_fetched_at")]
    return rows.select(
        *others,
        pick("description", "d", "description"),
        *[pick("salary", "s", n) for n in ("salary_min", "salary_max", "salary_currency")],
        pick("skills", "k", "skills"),
        pick("benefits", "b", "benefits"),
        F.map_concat(kept, applied).alias("provenance"),
        F.greatest("details_fetched_at", F.array_max(F.map_values(applied))).alias("details_fetched_at"),
        (F.size(applied) > 0).alias("refreshed"),
    )


def cache_state(fetched_at: Column, refreshed: Column, as_of: Column, days: int = 1) -> Column:
    """Fresh, refreshed, stale or unavailable."""
    return F.when(refreshed, "refreshed").when(fetched_at.isNull(), "unavailable").when(fetched_at >= as_of - F.expr(f"interval {days} days"), "fresh").otherwise("stale")


def update_fields(stored: DataFrame, changes: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Only the fields named in a change row's `set_fields` change, null values included."""
    new = changes.select(key, "set_fields", *[F.col(f).alias(f"n_{f}") for f in fields])
    both = stored.join(new, key, "left")
    return both.select(key, *[F.when(F.coalesce(F.array_contains("set_fields", f), F.lit(False)), F.col(f"n_{f}")).otherwise(F.col(f)).alias(f) for f in fields])


def provenance_at(provenance: Column, group: str) -> Column:
    """When a group of fields was fetched last; null if never."""
    return F.try_element_at(provenance, F.lit(group))


def with_provenance(provenance: Column, group: str, at: Column) -> Column:
    """The map with a group's time, or without the group where the time is null."""
    empty = F.create_map().cast("map<string,timestamp>")
    others = F.map_filter(F.coalesce(provenance, empty), lambda k, v: k != group)
    return F.when(at.isNull(), others).otherwise(F.map_concat(others, F.create_map(F.lit(group), at)))
