"""Search over listings: filters, duplicate states, orders, pages, facets and cards."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.scalars import contains_all, cutoff
from offerloom.functions.text import filter_key
from offerloom.operators.places import near
from offerloom.session import shared_table

SORTS = {"newest": "newest", "date": "newest", "date_desc": "newest", "posted_at_desc": "newest", "oldest": "oldest", "relevance": "relevance", "title": "title"}
STATES = ("confirmed", "possible", "none", "unique", "duplicate")


@dataclass(frozen=True)
class JobQuery:
    """What is asked. Lists are alternatives, except skills, which are all needed; an empty list asks nothing."""

    unseen: bool = False
    period: str = "all"
    text: str = ""
    contracts: tuple[str, ...] = ()
    remote: bool | None = None
    levels: tuple[str, ...] = ()
    salary_min: float | None = None
    companies: tuple[str, ...] = ()
    excluded_companies: tuple[str, ...] = ()
    skills: tuple[str, ...] = ()
    sort: str = "newest"
    limit: int = 24
    offset: int = 0

    def __post_init__(self) -> None:
        if self.limit < 0 or self.offset < 0:
            raise ValueError("limit and offset must not be negative")
        if self.sort not in SORTS:
            raise ValueError(f"unknown sort {self.sort!r}")
        if self.period not in ("24h", "3d", "7d", "all"):
            raise ValueError(f"unknown period {self.period!r}")

    @classmethod
    def from_params(cls, params: dict[str, str | list[str]]) -> JobQuery:
        """from the parameters of a URL: trimmed, empty ones dropped, repeats dropped, unknown values of closed lists ignored."""

        def many(name: str) -> tuple[str, ...]:
            given = params.get(name, [])
            given = given.split(",") if isinstance(given, str) else given
            return tuple(dict.fromkeys(x.strip() for x in given if x.strip()))

        one = lambda name, default="": (many(name) or (default,))[0]
        period, sort = one("period", "3d"), one("sort", "date")
        return cls(
            unseen=one("unseen") == "true",
            period=period if period in ("24h", "3d", "7d", "all") else "3d",
            text=one("query"),
            contracts=many("contract"),
            remote={"true": True, "false": False}.get(one("remote")),
            levels=many("level"),
            salary_min=float(one("salary")) if one("salary").replace(".", "", 1).isdigit() else None,
            companies=many("company"),
            skills=many("skill"),
            sort=sort if sort in SORTS else "date",
        )


def matching(jobs: DataFrame, query: JobQuery, as_of: Column) -> DataFrame:
    """The rows that pass all parts of a query which need one table: F1, F3, F4, F6 to F10, F12, F17."""
    tests: list[Column] = []
    if query.unseen:
        tests.append(F.col("viewed_at").isNull())
    since = cutoff(query.period, as_of)
    if since is not None:
        tests.append(F.col("posted_at") >= since)
    if query.text.strip():
        parts = [F.nullif(F.col(c), F.lit("")) for c in ("title", "company", "description") if c in jobs.columns]
        tests.append(F.contains(filter_key(F.concat_ws(" ", *parts)), filter_key(F.lit(query.text))))
    for name, wanted in (("contract_type", query.contracts), ("experience_level", query.levels)):
        if wanted:
            tests.append(F.col(name).isin(*wanted))
    if query.remote is not None:
        tests.append(F.col("remote") == query.remote)
    if query.salary_min is not None:
        tests.append(F.col("salary_max") >= query.salary_min)
    keys = lambda names: [filter_key(F.lit(n)) for n in names]
    if query.companies:
        tests.append(filter_key(F.col("company")).isin(*keys(query.companies)))
    if query.excluded_companies:
        tests.append(~filter_key(F.col("company")).isin(*keys(query.excluded_companies)))
    if query.skills:
        tests.append(contains_all(F.col("skills"), list(query.skills)))
    for test in tests:
        jobs = jobs.where(test)
    return jobs


def relevance(text: str) -> Column:
    """O3: weighted occurrences of the query in title, company and description."""
    key = filter_key(F.lit(text))
    count = lambda c: F.coalesce((F.length(filter_key(c)) - F.length(F.replace(filter_key(c), key, F.lit("")))) / F.length(key), F.lit(0))
    return (3 * count(F.col("title")) + 2 * count(F.col("company")) + count(F.coalesce(F.col("description"), F.lit("")))).cast("long")


def ordered(jobs: DataFrame, sort: str = "newest", text: str = "") -> DataFrame:
    """Undated rows come last; ties by `ord`."""
    kind = SORTS[sort]
    newest = [F.desc_nulls_last("posted_at"), F.desc("ord")]
    if kind == "oldest":
        return jobs.orderBy(F.asc_nulls_last("posted_at"), F.asc("ord"))
    if kind == "title":
        return jobs.orderBy(filter_key(F.col("title")), "ord")
    if kind == "relevance" and text.strip():
        return jobs.withColumn("score", relevance(text)).orderBy(F.desc("score"), *newest)
    return jobs.orderBy(*newest)


def page(jobs: DataFrame, query: JobQuery) -> DataFrame:
    """One page; sort and limit are one operation, which keeps offset + limit rows of a task."""
    return ordered(jobs, query.sort, query.text).offset(query.offset).limit(query.limit)


def confirmed_jobs(links: DataFrame) -> DataFrame:
    """G1: jobs with more than one listing, active or not."""
    return links.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("job_id")


def possible_jobs(edges: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Jobs on either side of a possible edge that are not confirmed."""
    sides = edges.where("kind = 'possible'").select(F.explode(F.array("left_id", "right_id")).alias("job_id")).distinct()
    return sides.join(confirmed, "job_id", "left_anti")


def shown_jobs(links: DataFrame, *told: str) -> DataFrame:
    """Jobs with what their first listing tells and all their listings in order (sources), by one pass over the listings."""
    rows = links.repartition("job_id").groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("ord", *told, *LISTED))).alias("m"))
    return rows.select("job_id", *[F.col("m")[0][c].alias(c) for c in told], _listed("m").alias("sources"))


LISTED = ("source", "url", "active")


def _listed(c: str) -> Column:
    return F.transform(c, lambda x: F.struct(*[x[f].alias(f) for f in LISTED]))


def with_state(jobs: DataFrame, links: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Add duplicate_state confirmed, possible or none. Without `links`, jobs have their listings already (shown_jobs)."""
    if links is None:
        sides = edges.where("kind = 'possible'").select(F.explode(F.array("left_id", "right_id")).alias("job_id")).distinct()
        flagged = jobs.withColumn("c", F.size("sources") > 1).join(sides.withColumn("p", F.lit(True)), "job_id", "left")
    else:
        confirmed = confirmed_jobs(links)
        possible = possible_jobs(edges, confirmed)
        flagged = jobs.join(confirmed.withColumn("c", F.lit(True)), "job_id", "left").join(possible.withColumn("p", F.lit(True)), "job_id", "left")
    return flagged.withColumn("duplicate_state", F.when(F.col("c"), "confirmed").when(F.col("p"), "possible").otherwise("none")).drop("c", "p")


def in_state(jobs: DataFrame, state: str) -> DataFrame:
    if state not in STATES:
        raise ValueError(f"unknown state {state!r}")
    if state == "duplicate":
        return jobs.where("duplicate_state <> 'none'")
    return jobs.where(F.col("duplicate_state") == ("none" if state == "unique" else state))


def cards(jobs: DataFrame, links: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Jobs with their listings in order and their possible duplicates in both directions. Without `links`, jobs have their
    listings already (shown_jobs)."""
    sides = edges.select(F.col("left_id").alias("job_id"), F.col("right_id").alias("other"), "score", "reasons").unionByName(edges.select(F.col("right_id").alias("job_id"), F.col("left_id").alias("other"), "score", "reasons"))
    shown = jobs.select(F.col("job_id").alias("other"), "title", "company", "location")
    near = sides.join(shown, "other").groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct(F.col("other").alias("id"), "title", "company", "location", "score", "reasons"))).alias("possible_duplicates"))
    near = shared_table(near, "near-jobs")  # what it shuffles is gone before the jobs are joined
    if links is not None:
        listed = links.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("ord", *LISTED))).alias("m"))
        jobs = jobs.join(listed.select("job_id", _listed("m").alias("sources")), "job_id", "left")
    return jobs.join(near, "job_id", "left")


def facets(jobs: DataFrame, names: tuple[str, ...] = ("contract_type", "experience_level", "source")) -> DataFrame:
    """(facet, value, n) in one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(n).alias("facet"), F.col(n).alias("value")) for n in names])
    return jobs.select(F.explode(pairs).alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


def facets_beside(jobs: DataFrame, chosen: dict[str, tuple[str, ...]]) -> DataFrame:
    """(facet, value, n) where each facet is counted under the choices of all other facets, not under its own, so that a reader sees what
    another choice would find. One pass: a row goes to the facets whose other choices it meets, and tasks add up before the shuffle.

    `chosen` has the facets (columns) and the values chosen of each; none chosen is no filter.
    """
    meets = {name: F.coalesce(F.col(name).isin(*values), F.lit(False)) if values else F.lit(True) for name, values in chosen.items()}
    others = lambda name: reduce(lambda a, b: a & b, [m for n, m in meets.items() if n != name], F.lit(True))
    pairs = F.array(*[F.when(others(n), F.struct(F.lit(n).alias("facet"), F.col(n).alias("value"))) for n in chosen])
    return jobs.select(F.explode(F.array_compact(pairs)).alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


#: The days that a search's choice of dates goes back.
AGES = {"past_24h": 1, "past_week": 7, "past_month": 30}


def meets_criteria(offers: DataFrame, as_of: Column, contracts: tuple[str, ...] = (), location: str | None = None, radius_km: float | None = None, date_posted: str | None = None, posted_within_days: int | None = None) -> DataFrame:
    """the offers that a saved search takes. A radius counts from any place but France itself; days count only without a choice of
    dates; where an age counts, undated offers do not pass."""
    if contracts:
        offers = offers.where(F.col("contract_type").isin(*contracts))
    if radius_km and location and location.casefold() != "france":
        offers = near(offers, location, radius_km)
    days = AGES.get(date_posted) if date_posted is not None else posted_within_days
    if days:
        offers = offers.where(F.col("posted_at") >= as_of - F.expr(f"interval {int(days)} days"))
    return offers


def with_active_source(jobs: DataFrame, listings: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    """jobs with any active listing from one of the sources."""
    return jobs.join(listings.where(F.col("active") & F.col("source").isin(*sources)).select("job_id"), "job_id", "left_semi")


def recent(offers: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """F16: undated rows stay."""
    return offers.where(F.col("posted_at").isNull() | (F.col("posted_at") >= as_of - F.expr(f"interval {timedelta(days=days).days} days")))

