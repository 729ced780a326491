"""Queries over snapshots, scans and runs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerloom.functions.values import METROPOLES, METROPOLES_DATE, METROPOLES_LIST, METROPOLES_PAGE, RANK, SENIORITY_WORDS, SOURCES
from offerloom.operators import quality as K
from offerloom.operators import resolve as D
from offerloom.operators import runs as R
from offerloom.operators import tables as U
from offerloom.operators.places import area_keys, evidence
from offerloom.operators.similarity import similar_titles
from offerloom.plans.bridge import AS_OF, WITH_LISTINGS, WITH_OFFERS, WITH_SYNCS, as_of, listings, offers, search_listings, star, sync_events, sync_results
from offerloom.plans.scalar_queries import quoted, sql_key, sql_location, sql_map
from offerloom.session import new_folder, settled, shared_table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SPLIT = "2000-01-01"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def stored(spark, sf_dir):
    """The snapshot of what was seen before SPLIT, sightings of odd parts already gone."""
    old = offers(spark, sf_dir).where(f"seen_at < timestamp '{SPLIT}'")
    order = F.struct("seen_at", "tie")
    return old.groupBy(*U.LISTING).agg(*[F.max_by(c, order).alias(c) for c in U.TEXTS], (F.max_by("tie", order) % 2 == 0).alias("active"), F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"))


_STORED = f"old AS (SELECT source, external_id, arg_max(title, (seen_at, tie)) AS title, arg_max(tie, (seen_at, tie)) % 2 = 0 AS active, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at FROM offers WHERE seen_at < TIMESTAMP '{SPLIT}' GROUP BY ALL), news AS (SELECT source, external_id, arg_max(title, (seen_at, tie)) AS n_title, min(seen_at) AS n_first, max(seen_at) AS n_last FROM offers WHERE seen_at >= TIMESTAMP '{SPLIT}' OR tie % 7 = 0 GROUP BY ALL)"


@query("u1_upsert_listings", WITH_OFFERS.rstrip() + f", {_STORED} SELECT source, external_id, coalesce(n_title, title) AS title, CASE WHEN n_last IS NOT NULL AND (last_seen_at IS NULL OR last_seen_at <= n_last) THEN true ELSE active END AS active, coalesce(first_seen_at, n_first) AS first_seen_at, greatest(last_seen_at, n_last) AS last_seen_at FROM old FULL JOIN news USING (source, external_id)")
def u1(spark, sf_dir):
    batch = offers(spark, sf_dir).where(f"seen_at >= timestamp '{SPLIT}' or tie % 7 = 0")
    rows = U.upsert_listings(stored(spark, sf_dir), batch)
    return rows.select(*U.LISTING, "title", "active", "first_seen_at", "last_seen_at")


def _facts(rows):
    return rows.select(F.expr("concat(source, ':', external_id)").alias("job_id"), "title", "company", "location", "contract_type", "experience_level", "remote", "posted_at", F.lit(None).cast("string").alias("description"), F.when(F.col("tie") % 3 == 0, F.col("salary_min")).alias("salary_min"), F.col("salary_max"), F.when(F.col("tie") % 2 == 0, F.lit("EUR")).alias("salary_currency"), F.array("skill_type", "skill_brand").alias("skills"), F.array().cast("array<string>").alias("benefits"))


@query("u2_refresh_job", WITH_LISTINGS + "SELECT concat(source, ':', external_id) AS job_id, title, remote, CASE WHEN tie % 3 = 0 AND salary_min IS NOT NULL THEN salary_min ELSE 1.0 END AS salary_min, CASE WHEN salary_max IS NOT NULL THEN salary_max ELSE 2.0 END AS salary_max, CASE WHEN tie % 2 = 0 AND ((tie % 3 = 0 AND salary_min IS NOT NULL) OR salary_max IS NOT NULL) THEN 'EUR' ELSE 'GBP' END AS salary_currency FROM listings")
def u2(spark, sf_dir):
    """Jobs with a salary of 1 to 2 GBP, seen again with what each listing tells: a bound that is missing keeps the old one."""
    rows = _facts(listings(spark, sf_dir))
    old = rows.withColumns({"title": F.lit("old"), "salary_min": F.lit(1.0), "salary_max": F.lit(2.0), "salary_currency": F.lit("GBP")})
    return U.refresh_job(old, rows).select("job_id", "title", "remote", "salary_min", "salary_max", "salary_currency")


@query("u3_attach_searches", WITH_OFFERS + "SELECT search_name AS search_id, concat(source, ':', external_id) AS job_id, min(seen_at) AS created_at FROM offers GROUP BY ALL")
def u3(spark, sf_dir):
    rows = offers(spark, sf_dir, searches=True).select(F.col("search_name").alias("search_id"), F.expr("concat(source, ':', external_id)").alias("job_id"), F.col("seen_at").alias("created_at"), "tie")
    return U.attach_searches(rows.where("tie % 2 = 0").drop("tie"), rows.where("tie % 2 = 1").drop("tie"))


@query("u9_mark_viewed", "SELECT user_id AS job_id, min(ts) AS viewed_at FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def u9(spark, sf_dir):
    seen = star(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("ts").alias("viewed_at"), "event_type")
    old = seen.where("event_type = 'click'").groupBy("job_id").agg(F.min("viewed_at").alias("viewed_at"))
    every = seen.where("event_type in ('view', 'click')").select("job_id").distinct().join(old, "job_id", "left")
    return U.mark_viewed(every, seen.where("event_type = 'view'"))


_JOBS = "jobs AS (SELECT *, ord // 10 AS job_id, seen_at AS last_seen_at FROM listings)"


def order_jobs(spark, sf_dir):
    return listings(spark, sf_dir).withColumn("job_id", F.floor(F.col("ord") / 10)).withColumn("last_seen_at", F.col("seen_at"))


@query("w4_best_listing", WITH_LISTINGS.rstrip() + f", {_JOBS} SELECT job_id, source, external_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY active DESC, (source IN ('freework', 'hellowork')) DESC, last_seen_at DESC, ord DESC) AS k FROM jobs WHERE active OR source = 'linkedin') WHERE k = 1")
def w4(spark, sf_dir):
    return U.best_listing(order_jobs(spark, sf_dir), ("freework", "hellowork")).select("job_id", "source", "external_id")


@query("w7_first_listing", WITH_LISTINGS.rstrip() + f", {_JOBS} SELECT job_id, arg_min(source, ord) AS source, arg_min(external_id, ord) AS external_id FROM jobs GROUP BY 1")
def w7(spark, sf_dir):
    return U.first_listing(order_jobs(spark, sf_dir))


@query("u12_cache_state", WITH_LISTINGS + f"SELECT CASE WHEN tie % 13 = 0 THEN 'refreshed' WHEN posted_at IS NULL THEN 'unavailable' WHEN posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY THEN 'fresh' ELSE 'stale' END AS state, count(*) AS n FROM listings GROUP BY 1")
def u12(spark, sf_dir):
    state = U.cache_state(F.col("posted_at"), F.col("tie") % 13 == 0, as_of())
    return listings(spark, sf_dir).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("u10_detail_groups", "SELECT doc_id AS job_id, coalesce(CASE WHEN length(trim(text)) > 0 AND quality IS NOT NULL AND doc_id % 3 <> 1 THEN md5(text) END, 'old') AS description_md5, (length(trim(text)) > 0 AND quality IS NOT NULL AND doc_id % 3 <> 1) AS refreshed FROM documents LEFT JOIN labels USING (doc_id)")
def u10(spark, sf_dir):
    docs, labels = star(spark, sf_dir, "documents"), star(spark, sf_dir, "labels")
    old = F.timestamp_seconds(F.lit(1000000))
    none = F.lit(None)
    jobs = docs.select(F.col("doc_id").alias("job_id"), F.lit("old").alias("description"), none.cast("double").alias("salary_min"), none.cast("double").alias("salary_max"), none.cast("string").alias("salary_currency"), F.array().cast("array<string>").alias("skills"), F.array().cast("array<string>").alias("benefits"), none.cast("map<string,timestamp>").alias("provenance"), F.when(F.col("doc_id") % 3 == 1, F.timestamp_seconds(F.lit(3000000))).otherwise(old).alias("details_fetched_at"))
    shots = docs.join(labels, "doc_id").select(F.col("doc_id").alias("job_id"), F.timestamp_seconds(F.lit(2000000)).alias("fetched_at"), F.col("text").alias("description"), none.cast("double").alias("salary_min"), none.cast("double").alias("salary_max"), none.cast("string").alias("salary_currency"), F.array().cast("array<string>").alias("skills"), F.array().cast("array<string>").alias("benefits"))
    rows = U.apply_details(jobs, shots)
    return rows.select("job_id", F.when(F.col("description") == "old", "old").otherwise(F.md5(F.col("description").cast("binary"))).alias("description_md5"), "refreshed")


@query(
    "u11_legacy_provenance",
    """WITH j AS (SELECT doc_id, doc_id % 3 <> 2 AND doc_id % 7 <> 0 AS legacy, CASE WHEN length(trim(text)) > 0 AND quality IS NOT NULL THEN 1000000 + 1000000 * quality END AS shot FROM documents LEFT JOIN labels USING (doc_id)),
s AS (SELECT *, CASE WHEN legacy AND doc_id % 2 = 0 THEN 1500000 END AS d, CASE WHEN doc_id % 3 = 2 THEN 1200000 WHEN legacy AND doc_id % 5 = 0 THEN 1500000 END AS k FROM j)
SELECT doc_id AS job_id, (CASE WHEN shot > coalesce(d, 0) THEN shot ELSE d END)::BIGINT AS description, k::BIGINT AS skills, coalesce(shot > coalesce(d, 0), false) AS refreshed FROM s""",
)
def u11(spark, sf_dir):
    """Jobs with one time for all details, with stamps, and with neither meet snapshots that are older or newer than that time."""
    at, none, n = lambda s: F.timestamp_seconds(F.lit(s)), F.lit(None), F.col("doc_id")
    stamps = F.create_map(F.lit("skills"), at(1200000))
    texts = F.array().cast("array<string>")
    salary = [none.cast(t).alias(c) for c, t in (("salary_min", "double"), ("salary_max", "double"), ("salary_currency", "string"))]
    docs = star(spark, sf_dir, "documents")
    jobs = docs.select(n.alias("job_id"), F.when(n % 2 == 0, F.lit("old")).alias("description"), *salary, F.when(n % 5 == 0, F.array(F.lit("sql"))).otherwise(texts).alias("skills"), texts.alias("benefits"), F.when(n % 3 == 2, stamps).when(n % 3 == 1, F.map_filter(stamps, lambda k, v: F.lit(False))).alias("provenance"), F.when(n % 7 > 0, at(1500000)).alias("details_fetched_at"))
    shots = docs.join(star(spark, sf_dir, "labels"), "doc_id").select(n.alias("job_id"), F.timestamp_seconds(1000000 + 1000000 * F.col("quality")).alias("fetched_at"), F.col("text").alias("description"), *salary, texts.alias("skills"), texts.alias("benefits"))
    rows = U.apply_details(jobs, shots)
    return rows.select("job_id", *[F.unix_seconds(U.provenance_at(F.col("provenance"), g)).alias(g) for g in ("description", "skills")], "refreshed")


@query("u18_update_fields", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_name END AS name, c_mktsegment AS segment FROM customer")
def u18(spark, sf_dir):
    rows = star(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    changes = rows.where("id % 2 = 0").select("id", F.array(F.lit("name")).alias("set_fields"), F.lit(None).cast("string").alias("name"), F.lit("x").alias("segment"))
    return U.update_fields(rows, changes, "id", ("name", "segment"))


# Duplicates. SQL knows no SequenceMatcher: equal keys (score 1) have a full twin, near titles a rows-only check.
_PLACE = f"CASE WHEN location = 'Paris / télétravail' THEN 'paris' ELSE {sql_location('location')} END"
_WORDS = " UNION ALL ".join(f"SELECT {quoted(w)} AS w, {RANK[v]} AS r" for w, v in SENIORITY_WORDS.items())


@query("u4_exact_duplicates", WITH_LISTINGS + f"SELECT {sql_key('company')} AS company_key, {_PLACE} AS loc_key, {sql_key('title')} AS title_key, count(*) AS listings, count(DISTINCT source) AS sources, min(ord) AS first FROM listings WHERE location IN ('Paris (75)', 'Lyon 7e - 69', 'Villeurbanne', 'Paris / télétravail', 'Marseille, France', 'Boulogne-Billancourt - 92', 'Nantes', 'Lyon') GROUP BY ALL")
def u4(spark, sf_dir):
    return D.exact_blocks(D.prepared(listings(spark, sf_dir)))


_KIND = "CASE WHEN location IN ('Télétravail', 'Non spécifié') THEN 'unknown' WHEN location IN ('Île-de-France', 'France') THEN 'non_city' ELSE 'place' END"
_KEY = f"CASE WHEN location IN ('Télétravail', 'Non spécifié') THEN '' ELSE {_PLACE} END"
_PROFILES = (
    f"told AS (SELECT title, experience_level, greatest(max(r), {sql_map('experience_level', RANK)}) AS r FROM (SELECT title, experience_level, unnest(string_split({sql_key('title')}, ' ')) AS w FROM (SELECT DISTINCT title, experience_level FROM listings)) LEFT JOIN ({_WORDS}) USING (w) GROUP BY title, experience_level), "
    f"k AS (SELECT l.source, ord, {sql_key('company')} AS c, {sql_key('l.title')} AS t, location, {_KIND} AS kind, {_KEY} AS p, r FROM listings l JOIN told t ON l.title = t.title AND l.experience_level IS NOT DISTINCT FROM t.experience_level), "
    "profiles AS (SELECT c, t, r, location, kind, p, min(ord) AS profile, count(*) AS n, list_distinct(list(source)) AS s FROM k GROUP BY ALL)"
)


@query("t11_location_evidence", WITH_LISTINGS + f"SELECT DISTINCT location AS label, {_KIND} AS kind, {_KEY} AS key FROM offers")
def t11(spark, sf_dir):
    return evidence(offers(spark, sf_dir))


@query("u4_profiles", WITH_LISTINGS.rstrip() + f", {_PROFILES} SELECT c AS company_key, t AS title_key, r AS rank, location, kind AS loc_kind, p AS loc_key, profile, n AS listings, array_to_string(list_sort(s), ',') AS sources FROM profiles")
def u4_profiles(spark, sf_dir):
    return D.profiles(D.prepared(listings(spark, sf_dir))).withColumn("sources", F.array_join("sources", ","))


@query("b1_candidates", WITH_LISTINGS.rstrip() + f", {_PROFILES} SELECT a.c AS company_key, count(*) AS pairs, sum(a.n * b.n)::BIGINT AS listing_pairs FROM profiles a JOIN profiles b ON a.c = b.c AND a.profile <= b.profile AND ((a.kind = b.kind AND a.p = b.p) OR (a.kind = 'unknown') <> (b.kind = 'unknown')) AND (a.r IS NULL OR b.r IS NULL OR a.r = b.r) AND len(list_distinct(list_concat(a.s, b.s))) > 1 AND 2 * least(length(a.t), length(b.t)) >= {D.POSSIBLE}::DOUBLE * (length(a.t) + length(b.t)) GROUP BY 1")
def b1(spark, sf_dir):
    pairs = D.candidate_pairs(D.profiles(D.prepared(listings(spark, sf_dir))))
    return pairs.groupBy(F.col("a_company_key").alias("company_key")).agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("a_listings") * F.col("b_listings")).alias("listing_pairs"))


@query("u4_decisions")
def u4_near(spark, sf_dir):
    """Every pair of profiles that is confirmed or possible; SQL has no title similarity."""
    rows = D.decided(settled(spark, lambda: D.profiles(D.prepared(listings(spark, sf_dir))), "profiles"), keep=("listings",))
    return rows.select("left", "right", "kind", "score", "reasons", "a_listings", "b_listings")


@query("u4_equal_titles", WITH_LISTINGS.rstrip() + f", {_PROFILES} SELECT a.profile AS left, b.profile AS right, (a.n * b.n)::BIGINT AS listing_pairs FROM profiles a JOIN profiles b ON a.c = b.c AND a.t = b.t AND a.kind = 'place' AND b.kind = 'place' AND a.p = b.p AND a.profile <= b.profile AND (a.r IS NULL OR b.r IS NULL OR a.r = b.r) AND len(list_distinct(list_concat(a.s, b.s))) > 1")
def u4_equal(spark, sf_dir):
    rows = D.decided(D.profiles(D.prepared(listings(spark, sf_dir))), keep=("listings",)).where("kind = 'confirmed' and score = 1.0")
    return rows.select("left", "right", (F.col("a_listings") * F.col("b_listings")).alias("listing_pairs"))


@query("u6_leader_clusters")
def u6(spark, sf_dir):
    return D.clusters(D.prepared(listings(spark, sf_dir)))


# Jobs to merge: the listings of ten neighbouring ord, the next into the one before, so that merges are chains.
_TOLD = (
    "told AS (SELECT ord AS job_id, title, ord // 10 AS g, CASE WHEN tie % 3 = 0 THEN posted_at END AS viewed_at, CASE WHEN tie % 4 <> 0 THEN concat('about ', ord) END AS description, "
    "CASE WHEN tie % 5 <> 0 THEN salary_min END AS salary_min, CASE WHEN tie % 5 <> 0 THEN salary_max END AS salary_max, CASE WHEN tie % 5 <> 0 THEN 'EUR' END AS salary_currency, "
    "[skill_brand, skill_type] AS skills, CASE WHEN tie % 2 = 0 THEN [contract_type] ELSE [] END AS benefits, posted_at AS fetched FROM listings), "
    "best AS (SELECT g, min(job_id) AS job_id, arg_min(title, job_id) AS title, min(viewed_at) AS viewed_at, count(*) AS merged, "
    "min_by(description, {'t': -coalesce(epoch(fetched), -1e11), 'j': job_id}) FILTER (description IS NOT NULL) AS description, min_by(fetched, {'t': -coalesce(epoch(fetched), -1e11), 'j': job_id}) FILTER (description IS NOT NULL AND fetched IS NOT NULL) AS d_at, "
    "min_by({'a': salary_min, 'b': salary_max, 'c': salary_currency}, {'t': -coalesce(epoch(fetched), -1e11), 'j': job_id}) FILTER (salary_currency IS NOT NULL) AS s, max(fetched) AS fetched FROM told GROUP BY g), "
    "firsts AS (SELECT g, x, min(job_id * 10 + i) AS p FROM (SELECT g, job_id, unnest(skills) AS x, unnest([1, 2]) AS i FROM told) GROUP BY g, x), "
    "also AS (SELECT g, x, min(job_id) AS p FROM (SELECT g, job_id, unnest(benefits) AS x FROM told) GROUP BY g, x)"
)


@query("u7_merge_jobs", WITH_LISTINGS.rstrip() + f", {_TOLD} SELECT job_id, title, viewed_at, description, s.a AS salary_min, s.b AS salary_max, s.c AS salary_currency, (SELECT string_agg(x, ',' ORDER BY p) FROM firsts f WHERE f.g = best.g) AS skills, coalesce((SELECT string_agg(x, ',' ORDER BY p) FROM also f WHERE f.g = best.g), '') AS benefits, d_at AS described_at, fetched AS details_fetched_at, merged FROM best")
def u7(spark, sf_dir):
    rows = shared_table(listings(spark, sf_dir).select("ord", "title", "tie", "posted_at", "salary_min", "salary_max", "skill_brand", "skill_type", "contract_type"), "told")  # read twice
    some = lambda c, test: F.when(F.expr(test), F.col(c))
    paid = "tie % 5 <> 0"
    jobs = rows.select(F.col("ord").alias("job_id"), "title", some("posted_at", "tie % 3 = 0").alias("viewed_at"), F.when(F.expr("tie % 4 <> 0"), F.concat(F.lit("about "), "ord")).alias("description"), some("salary_min", paid).alias("salary_min"), some("salary_max", paid).alias("salary_max"), F.when(F.expr(paid), "EUR").alias("salary_currency"), F.array("skill_brand", "skill_type").alias("skills"), F.when(F.expr("tie % 2 = 0"), F.array("contract_type")).alias("benefits"), F.col("posted_at").alias("details_fetched_at"))
    ids = rows.select(F.col("ord").alias("job_id"), F.lag("ord").over(Window.partitionBy(F.expr("ord div 10")).orderBy("ord")).alias("keep_id")).where("keep_id is not null")
    merged = D.merge_jobs(jobs, ids).withColumns({c: F.array_join(c, ",") for c in ("skills", "benefits")})
    return merged.withColumn("described_at", F.try_element_at("provenance", F.lit("description"))).drop("provenance")


@query("u7_remap_edges", WITH_LISTINGS + "SELECT a AS left_id, b AS right_id, max(s) AS score FROM (SELECT least(ord // 10, tie) AS a, greatest(ord // 10, tie) AS b, salary_min AS s FROM listings) WHERE a < b GROUP BY ALL")
def u7_edges(spark, sf_dir):
    rows = listings(spark, sf_dir)
    edges = rows.select(F.col("ord").alias("left_id"), F.col("tie").alias("right_id"), F.lit("possible").alias("kind"), F.col("salary_min").alias("score"))
    ids = rows.select(F.col("ord").alias("job_id"), F.floor(F.col("ord") / 10).alias("keep_id"))
    # ids of listings have a digit more than ids of parts, so both can stand in one table
    return D.remap_edges(edges.withColumn("left_id", -F.col("left_id")), ids.withColumn("job_id", -F.col("job_id"))).select("left_id", "right_id", "score")


@query("u5_edges")
def u5(spark, sf_dir):
    """The edges among merged jobs: those found before SPLIT, and what the listings seen since change in the companies they touch."""
    rows = settled(spark, lambda: D.prepared(listings(spark, sf_dir), "seen_at"), "keys")
    near = settled(spark, lambda: similar_titles(rows.where("loc_kind <> 'conflict'"), D.POSSIBLE), "near")
    before = shared_table(rows.where(f"seen_at < timestamp '{SPLIT}'"), "before")
    first = F.to_timestamp(F.lit(SPLIT))

    def edges(some):
        merged = settled(spark, lambda: D.merged_jobs(some, shared_table(D.clusters(some, near), "clusters")), "merged")
        return D.possible_edges(merged, near)

    old = settled(spark, lambda: edges(before).withColumns({"created_at": first, "updated_at": first}), "old")
    touched = rows.where(f"seen_at >= timestamp '{SPLIT}'").select("company_key").distinct()
    again = shared_table(rows.join(touched, "company_key", "left_semi"), "again")
    new = settled(spark, lambda: edges(again), "new")
    return D.maintain_edges(old, new, as_of(), again.select(F.col("ord").alias("job_id")))


# Scans: a run is a customer, a source's pages hold ten sightings each.
_SCAN = "scan AS (SELECT o_custkey AS run_id, l_suppkey % 6 AS source, concat(l_partkey % 50) AS external_id, (l_linenumber + 1) // 2 AS page, l_orderkey * 10000000 + l_partkey AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def scan(spark, sf_dir):
    rows = star(spark, sf_dir, "lineitem").join(star(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_custkey").alias("run_id"), (F.col("l_suppkey") % 6).alias("source"), (F.col("l_partkey") % 50).cast("string").alias("external_id"), F.expr("(l_linenumber + 1) div 2").alias("page"), F.expr("l_orderkey * 10000000 + l_partkey").alias("pos"))


@query("w1_first_sightings", f"WITH {_SCAN} SELECT run_id, source, external_id, min((page, pos)).page AS page FROM (SELECT *, {{'page': page, 'pos': pos}} AS s FROM scan) GROUP BY run_id, source, external_id".replace("min((page, pos)).page", "(min(s)).page"))
def w1(spark, sf_dir):
    return R.first_sightings(scan(spark, sf_dir)).select("run_id", "source", "external_id", "page")


@query("w2_cap", f"WITH {_SCAN} SELECT run_id, source, external_id, page, pos FROM (SELECT *, row_number() OVER (PARTITION BY run_id, source ORDER BY page, pos) AS k FROM scan) WHERE k <= 3")
def w2(spark, sf_dir):
    return R.capped(scan(spark, sf_dir), 3)


_PAGES = f"{_SCAN}, pages_ AS (SELECT run_id, source, page, count(*) AS cards, count(DISTINCT CASE WHEN first_page = page THEN external_id END) AS new_ids FROM (SELECT *, min(page) OVER (PARTITION BY run_id, source, external_id) AS first_page FROM scan) GROUP BY ALL)"


@query("w6_new_ids", f"WITH {_PAGES} SELECT * FROM pages_")
def w6(spark, sf_dir):
    return R.page_counts(scan(spark, sf_dir))


_ENDS = "SELECT run_id, source, CASE WHEN page > 4 THEN 9 ELSE page END AS page, CASE WHEN page > 4 THEN 0 ELSE cards END AS cards, CASE WHEN page > 4 THEN 0 ELSE new_ids END AS new_ids FROM pages_ UNION ALL SELECT DISTINCT run_id, source, 8, 0, 0 FROM pages_ WHERE run_id % 3 = 0"


@query("q1_scan_verdicts", f"WITH {_PAGES}, ends AS ({_ENDS}), told AS (SELECT *, cards - CASE WHEN run_id % 7 = 0 AND page = 1 THEN 1 ELSE 0 END AS parsed FROM ends), w AS (SELECT run_id, source, bool_or(parsed <> cards OR (page > 1 AND cards > 0 AND new_ids = 0)) AS broken, arg_max(cards, page) = 0 AS ended, sum(cards)::BIGINT AS cards FROM told GROUP BY ALL) SELECT *, NOT broken AND ended AS complete FROM w")
def q1(spark, sf_dir):
    """Scans whose pages after the fourth are empty ends; some have an empty page more, some lost a card of the first page."""
    pages = w6(spark, sf_dir)
    late = F.col("page") > 4
    ends = pages.withColumns({"cards": F.when(late, 0).otherwise(F.col("cards")), "new_ids": F.when(late, 0).otherwise(F.col("new_ids")), "page": F.when(late, 9).otherwise(F.col("page"))})
    more = pages.where("run_id % 3 = 0").select("run_id", "source").distinct().withColumns({"page": F.lit(8), "cards": F.lit(0), "new_ids": F.lit(0)})
    told = ends.select("run_id", "source", "page", "cards", "new_ids").unionByName(more)
    told = told.withColumn("parsed", F.col("cards") - F.when((F.col("run_id") % 7 == 0) & (F.col("page") == 1), 1).otherwise(0))
    return R.scan_verdicts(told)


@query("g7_run_status", WITH_SYNCS + "SELECT run, CASE WHEN bool_and(status = 'succeeded') THEN 'succeeded' WHEN bool_or(status IN ('succeeded', 'partial')) THEN 'partial' ELSE 'failed' END AS status FROM results GROUP BY 1")
def g7(spark, sf_dir):
    return R.run_status(sync_results(spark, sf_dir))


@query("g8_batch", WITH_SYNCS + ", state AS (SELECT run, CASE WHEN bool_and(status = 'succeeded') THEN 'succeeded' WHEN bool_or(status IN ('succeeded', 'partial')) THEN 'partial' ELSE 'failed' END AS status FROM results GROUP BY 1) SELECT run % 97 AS batch, CASE WHEN bool_and(status = 'succeeded') THEN 'succeeded' WHEN bool_and(status = 'failed') THEN 'failed' ELSE 'partial' END AS status, count(*) AS runs FROM state GROUP BY 1".replace(") , state", "), state"))
def g8(spark, sf_dir):
    return R.batch_status(R.run_status(sync_results(spark, sf_dir)).withColumn("batch", F.col("run") % 97))


@query("g9_source_counts", WITH_SYNCS + "SELECT run, source, count(*) AS seen, count(*) FILTER (status = 'succeeded') AS persisted FROM sync_events GROUP BY ALL")
def g9(spark, sf_dir):
    return sync_events(spark, sf_dir).groupBy("run", "source").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("status") == "succeeded").alias("persisted"))


@query("u13_current_state", WITH_SYNCS + "SELECT run, source, status, CASE WHEN status NOT IN ('pending', 'running') THEN started_at END AS finished_at FROM results")
def u13(spark, sf_dir):
    rows = sync_events(spark, sf_dir).withColumn("finished_at", F.col("started_at"))
    return R.current_state(rows, ["run", "source"], ["started_at", "event_id"]).select("run", "source", "status", "finished_at")


@query("u14_outcomes", WITH_SYNCS + "SELECT run, source, CASE WHEN status = 'failed' THEN (CASE WHEN offers_seen > 50 THEN 'partial' ELSE 'failed' END) WHEN offers_seen > 90 THEN 'partial' WHEN status = 'succeeded' THEN 'succeeded' WHEN offers_seen > 50 THEN 'partial' ELSE 'failed' END AS outcome FROM results")
def u14(spark, sf_dir):
    error = F.when(F.col("status") == "failed", "x")
    out = R.source_outcome(error, F.col("status") == "succeeded", F.col("offers_seen") > 90, F.when(F.col("offers_seen") > 50, 1).otherwise(0))
    return sync_results(spark, sf_dir).select("run", "source", out.alias("outcome"))


_FILLED = "runs AS (SELECT run, CASE WHEN bool_and(status = 'succeeded') THEN 'succeeded' WHEN bool_or(status IN ('succeeded', 'partial')) THEN 'partial' ELSE 'failed' END AS status FROM results GROUP BY 1), asked AS (SELECT run, status AS run_status, unnest(range(6)) AS source FROM runs), filled AS (SELECT a.run, a.source::INT AS pos, a.source, coalesce(r.status, CASE WHEN run_status = 'succeeded' THEN 'succeeded' ELSE 'failed' END) AS status, coalesce(offers_seen, 0) AS offers_seen FROM asked a LEFT JOIN results r ON a.run = r.run AND a.source = r.source)"


@query("b9_filled_results", WITH_SYNCS.rstrip() + f", {_FILLED} SELECT * FROM filled")
def b9(spark, sf_dir):
    results = sync_results(spark, sf_dir)
    runs = R.run_status(results).withColumn("requested_sources", F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")))
    return R.filled_results(runs, results)


@query("u16_retryable", WITH_SYNCS.rstrip() + f", {_FILLED} SELECT run, source, status FROM filled WHERE status IN ('failed', 'partial')")
def u16(spark, sf_dir):
    return R.retryable(b9(spark, sf_dir)).select("run", "source", "status")


_SEARCH_RUNS = "sruns AS (SELECT event_id AS run, user_id % 100 AS search, CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'view' THEN 'partial' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' ELSE 'pending' END AS status, ts AS created_at FROM events)"


def search_runs(spark, sf_dir):
    return sync_events(spark, sf_dir).select(F.col("event_id").alias("run"), (F.col("run") % 100).alias("search"), "status", F.col("started_at").alias("created_at"))


@query("w3_latest_run", f"WITH {_SEARCH_RUNS} SELECT search, arg_max(run, (created_at, run)) AS run FROM sruns GROUP BY 1")
def w3(spark, sf_dir):
    return search_runs(spark, sf_dir).groupBy("search").agg(F.max_by("run", F.struct("created_at", "run")).alias("run"))


@query("w5_active_runs", f"WITH {_SEARCH_RUNS} SELECT run, search, row_number() OVER (PARTITION BY search ORDER BY created_at DESC, run DESC) > 1 AS superseded FROM sruns WHERE status IN ('pending', 'running')")
def w5(spark, sf_dir):
    return R.active_runs(search_runs(spark, sf_dir)).select("run", "search", "superseded")


@query("b11_latest_completed", f"WITH {_SEARCH_RUNS} SELECT search, max(created_at) AS completed_at FROM sruns WHERE status IN ('succeeded', 'partial') GROUP BY 1")
def b11(spark, sf_dir):
    return search_runs(spark, sf_dir).where("status in ('succeeded', 'partial')").groupBy("search").agg(F.max("created_at").alias("completed_at"))


@query("u17_overdue", f"WITH {_SEARCH_RUNS}, done AS (SELECT search, max(created_at) AS completed_at FROM sruns WHERE status IN ('succeeded', 'partial') GROUP BY 1), due AS (SELECT date_trunc('day', max(ts)) + INTERVAL 8 HOUR AS due_at FROM events) SELECT s.search, completed_at FROM (SELECT DISTINCT search FROM sruns WHERE search % 10 <> 0) s LEFT JOIN done USING (search), due WHERE completed_at IS NULL OR completed_at < due_at")
def u17(spark, sf_dir):
    runs = search_runs(spark, sf_dir)
    end = runs.agg(F.date_trunc("day", F.max("created_at")).alias("end"))
    searches = runs.select("search").distinct().withColumn("active", F.col("search") % 10 != 0).join(F.broadcast(end))
    return R.overdue(searches, runs.withColumnRenamed("created_at", "finished_at"), F.col("end") + F.expr("interval 23 hours"), 8, 0, "UTC").select("search", "completed_at")


_LIVE = f"attached AS (SELECT DISTINCT search_name AS search, source, external_id FROM offers), scans AS (SELECT 'BUILDING' AS search, s AS source, TIMESTAMP '2001-01-01' AS started_at FROM (SELECT DISTINCT source AS s FROM offers)), proof AS (SELECT DISTINCT search_name AS search, source, TIMESTAMP '2000-06-01' AS started_at FROM offers WHERE search_name <> 'MACHINERY'), seen AS (SELECT *, seen_at AS last_seen_at FROM listings), stale AS (SELECT s.source, s.external_id, last_seen_at FROM seen s JOIN attached a USING (source, external_id) JOIN scans c ON c.search = a.search AND c.source = s.source WHERE active AND last_seen_at < c.started_at AND s.source <> 'linkedin'), gone AS (SELECT source, external_id FROM stale s WHERE NOT EXISTS (SELECT 1 FROM attached o WHERE o.source = s.source AND o.external_id = s.external_id AND o.search <> 'BUILDING' AND NOT EXISTS (SELECT 1 FROM proof p WHERE p.search = o.search AND p.source = o.source AND p.started_at > s.last_seen_at)))"


@query("u8_deactivate_unseen", WITH_LISTINGS.rstrip() + f", {_LIVE} SELECT source, external_id, active AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.source = seen.source AND g.external_id = seen.external_id) AS active FROM seen")
def u8(spark, sf_dir):
    every = shared_table(search_listings(spark, sf_dir).select(F.col("search_name").alias("search"), "source", "external_id"), "attached")
    sources = every.select("source").distinct()
    scans = sources.select(F.lit("BUILDING").alias("search"), "source", F.to_timestamp(F.lit("2001-01-01")).alias("started_at"))
    proof = every.select("search", "source").distinct().where("search <> 'MACHINERY'").withColumn("started_at", F.to_timestamp(F.lit("2000-06-01")))
    rows = listings(spark, sf_dir).select("source", "external_id", "active", F.col("seen_at").alias("last_seen_at"))
    return R.deactivate_unseen(rows, every, scans, proof).select("source", "external_id", "active")


@query("b12_attached_listings", WITH_LISTINGS + "SELECT source, count(*) AS n FROM listings l WHERE active AND EXISTS (SELECT 1 FROM search_listings s WHERE s.source = l.source AND s.external_id = l.external_id AND search_name = 'MACHINERY') GROUP BY 1")
def b12(spark, sf_dir):
    links = search_listings(spark, sf_dir).where("search_name = 'MACHINERY'")
    return listings(spark, sf_dir).where("active").join(links, ["source", "external_id"], "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("u19_error_text", "SELECT CASE event_id % 4 WHEN 0 THEN 'The source did not answer in time' WHEN 1 THEN 'The source could not be reached' WHEN 2 THEN 'The source refused the request' ELSE 'The scan failed' END AS message, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def u19(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("timeout", "connection", "request", "other")]), (F.col("event_id") % 4 + 1).cast("int"))
    return star(spark, sf_dir, "events").where("event_type = 'error'").groupBy(R.error_text(kind).alias("message")).agg(F.count(F.lit(1)).alias("n"))


@query("q2_offer_checks", WITH_OFFERS + "SELECT source, count(*) FILTER (tie % 5 <> 0 AND tie % 7 <> 0) AS valid, count(*) FILTER (tie % 5 = 0) AS no_title, count(*) FILTER (tie % 7 = 0) AS bad_url FROM offers GROUP BY 1")
def q2(spark, sf_dir):
    rows = offers(spark, sf_dir).withColumns({"title": F.when(F.col("tie") % 5 != 0, F.col("title")), "url": F.when(F.col("tie") % 7 == 0, "ftp:").otherwise(F.col("url"))})
    rows = K.checked_offers(rows)
    broken = lambda name: F.count_if(F.array_contains("reasons", name))
    return rows.groupBy("source").agg(F.count_if("valid").alias("valid"), broken("title").alias("no_title"), broken("url").alias("bad_url"))


@query("q2_observed", WITH_OFFERS + "SELECT unnest(['offers', 'valid', 'title', 'url']) AS metric, unnest([count(*), count(*) FILTER (tie % 5 <> 0 AND tie % 7 <> 0), count(*) FILTER (tie % 5 = 0), count(*) FILTER (tie % 7 = 0)]) AS observed, unnest([count(*), count(*) FILTER (tie % 5 <> 0 AND tie % 7 <> 0), count(*) FILTER (tie % 5 = 0), count(*) FILTER (tie % 7 = 0)]) AS stored FROM offers")
def q2_observed(spark, sf_dir):
    """What was observed while the offers were written, beside what the stored rows say."""
    rows = offers(spark, sf_dir).withColumns({"title": F.when(F.col("tie") % 5 != 0, F.col("title")), "url": F.when(F.col("tie") % 7 == 0, "ftp:").otherwise(F.col("url"))})
    path = new_folder(spark, "checked")
    seen = K.store_checked(K.checked_offers(rows), path, ("title", "url"))
    stored = spark.read.parquet(path)
    counts = {"offers": F.count(F.lit(1)), "valid": F.count_if("valid"), "title": F.count_if(F.array_contains("reasons", "title")), "url": F.count_if(F.array_contains("reasons", "url"))}
    told = stored.agg(*[c.alias(n) for n, c in counts.items()])
    return told.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(seen[n]).cast("bigint").alias("observed"), F.col(n).alias("stored")) for n in counts])).alias("x")).select("x.*")


@query("q3_search_checks", "SELECT c_custkey AS id, c_acctbal >= 0 AND c_custkey % 1500 BETWEEN 1 AND 1000 AS valid FROM customer")
def q3(spark, sf_dir):
    rows = star(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.array("c_mktsegment").alias("keywords"), F.lit(10).alias("radius_km"), F.col("c_acctbal").alias("salary_min"), (F.col("c_custkey") % 1500).alias("max_results"), F.array(F.lit(SOURCES[0]), F.lit(SOURCES[1])).alias("sources"))
    return K.checked_searches(rows).select("id", "valid")


_READ = f"CASE WHEN c_custkey % 4 = 0 THEN ['{SOURCES[0]}', '{SOURCES[0]}'] WHEN c_custkey % 4 = 1 THEN ['{SOURCES[1]}', lower(c_mktsegment)] WHEN c_acctbal < 0 THEN []::VARCHAR[] ELSE ['{SOURCES[0]}', '{SOURCES[2]}'] END"


@query(
    "q4_tolerant_reads",
    f"""WITH r AS (SELECT c_custkey AS id, c_acctbal, {_READ} AS sources FROM customer)
SELECT id, array_to_string(sources, ',') AS sources, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'salary_min' END, CASE WHEN id % 4 < 2 OR len(sources) = 0 THEN 'sources' END) AS reasons FROM r""",
)
def q4(spark, sf_dir):
    """Searches stored before today's rules, with repeated, unknown and no sources: every row is read, with the rules that it breaks."""
    known = [F.lit(s) for s in SOURCES]
    first, second = F.col("c_custkey") % 4 == 0, F.col("c_custkey") % 4 == 1
    sources = F.when(first, F.array(known[0], known[0])).when(second, F.array(known[1], F.lower("c_mktsegment"))).when(F.col("c_acctbal") < 0, F.array().cast("array<string>")).otherwise(F.array(known[0], known[2]))
    rows = star(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.array("c_mktsegment").alias("keywords"), F.lit(None).cast("int").alias("radius_km"), F.col("c_acctbal").alias("salary_min"), F.lit(100).alias("max_results"), sources.alias("sources"))
    return K.checked_searches(rows).select("id", F.array_join("sources", ",").alias("sources"), F.array_join("reasons", ",").alias("reasons"))


@query("q5_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q5(spark, sf_dir):
    return K.repeated_keys(star(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("q6_overlapping_runs", f"WITH {_SEARCH_RUNS} SELECT search, count(*) AS n FROM sruns WHERE status IN ('pending', 'running') GROUP BY 1 HAVING count(*) > 1")
def q6(spark, sf_dir):
    return K.repeated_keys(search_runs(spark, sf_dir).where("status in ('pending', 'running')"), "search")


_KEYS = list(METROPOLES)


def area_groups(spark, sf_dir):
    """Groups of an area file from the nations, one for each, and the bands of 100 that balances of their customers are in (110 at most) as communes; faults
    by the nation: a repeated and unknown keys, a false code, address, date or name, aliases that regions share; and by the bands."""
    band = F.expr("cast(floor(c_acctbal / 100) as int)")
    far = F.abs(band)
    communes = star(spark, sf_dir, "customer").select("c_nationkey", band.alias("band"), far.alias("far")).distinct()
    code = F.when(F.col("band") < 0, F.concat(F.lit("2a"), F.lpad(F.col("far").cast("string"), 3, "0"))).when(F.col("band") > 95, F.concat(F.lit("x"), F.col("far").cast("string"))).otherwise(F.lpad((F.col("far") + 69000).cast("string"), 5, "0"))
    name = F.concat(F.lit("Ville-"), F.char(F.expr("97 + far div 26")), F.char(F.expr("97 + far % 26")))
    communes = communes.groupBy("c_nationkey").agg(F.collect_list(F.struct(code.alias("insee_code"), name.alias("name"))).alias("communes"))
    n, nation, region = F.col("n_nationkey"), F.lower("n_name"), F.lower("r_name")
    key = F.when(n < 8, F.element_at(F.array(*[F.lit(k) for k in _KEYS]), (n + 1).cast("int"))).when(n == 8, F.lit(_KEYS[0])).otherwise(nation)
    epci = F.element_at(F.create_map(*[F.lit(x) for k, (_, c) in METROPOLES.items() for x in (k, c)]), key)
    machine = F.concat(F.lit(METROPOLES_LIST.split("{}")[0]), epci, F.lit(METROPOLES_LIST.split("{}")[1]))
    page = F.when(key == "lyon", F.lit(METROPOLES_PAGE["lyon"])).otherwise(machine)
    aliases = F.array_compact(F.array(F.lit("Ville-AH"), nation, F.when(n % 2 == 1, region), F.when(n == 3, F.upper(nation)), F.when(n == 5, F.lit(" "))))
    rows = star(spark, sf_dir, "nation").join(F.broadcast(star(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).join(communes, n == F.col("c_nationkey"))
    group = F.struct(key.alias("key"), F.when(n != 6, nation).otherwise(" ").alias("official_name"), F.lit("VILLE-AH").alias("city_center"), F.when(n % 3 > 0, epci).otherwise("0").alias("epci_code"), F.when(n % 4 != 1, page).alias("source_url"), F.when(n % 5 != 2, machine).alias("machine_readable_source_url"), F.when(n != 7, aliases).otherwise(F.array().cast("array<string>")).alias("activation_aliases"), "communes")
    return rows.select(F.when(n != 11, METROPOLES_DATE).otherwise("2025-01-01").alias("reference_date"), group.alias("g"))


@query(
    "q7_area_violations",
    f"""
WITH known AS (SELECT unnest({_KEYS}) AS area, unnest({[n for n, _ in METROPOLES.values()]}) AS communes),
bands AS (SELECT DISTINCT c_nationkey AS n, floor(c_acctbal / 100)::INT AS band FROM customer),
b AS (SELECT n, count(*) AS size, count(DISTINCT abs(band)) AS names, count(*) FILTER (band > 95) AS odd, count(*) FILTER (abs(band) = 7) AS centre FROM bands GROUP BY 1),
g AS (SELECT n.n_nationkey AS n, lower(r_name) AS region, CASE WHEN n.n_nationkey < 8 THEN ({_KEYS})[n.n_nationkey + 1] WHEN n.n_nationkey = 8 THEN '{_KEYS[0]}' ELSE lower(n_name) END AS area, b.* EXCLUDE n
  FROM nation n JOIN region ON n_regionkey = r_regionkey JOIN b ON b.n = n.n_nationkey),
r AS (SELECT g.*, k.area IS NOT NULL AS known, k.communes FROM g LEFT JOIN known k USING (area)),
v AS (SELECT area, 'aliases_repeat' AS rule FROM r WHERE n = 3
  UNION ALL SELECT area, 'names_repeat' FROM r WHERE names < size
  UNION ALL SELECT area, 'code_form' FROM r WHERE odd > 0
  UNION ALL SELECT area, 'center_in_aliases' FROM r WHERE n = 7
  UNION ALL SELECT area, 'center_in_communes' FROM r WHERE centre = 0
  UNION ALL SELECT area, 'reference_date' FROM r WHERE n = 11
  UNION ALL SELECT area, 'unknown_area' FROM r WHERE NOT known
  UNION ALL SELECT area, 'official_name' FROM r WHERE n = 6
  UNION ALL SELECT area, 'epci_code' FROM r WHERE known AND n % 3 = 0
  UNION ALL SELECT area, 'source_url' FROM r WHERE known AND n % 4 = 1
  UNION ALL SELECT area, 'machine_url' FROM r WHERE known AND n % 5 = 2
  UNION ALL SELECT area, 'commune_count' FROM r WHERE known AND size <> communes
  UNION ALL SELECT area, 'aliases' FROM r WHERE n IN (5, 7)
  UNION ALL SELECT area, 'area_repeats' FROM r GROUP BY 1 HAVING count(*) > 1
  UNION ALL SELECT area, 'missing' FROM known WHERE area NOT IN (SELECT area FROM r)
  UNION ALL SELECT DISTINCT area, 'alias_of_several' FROM r WHERE n <> 7)
SELECT area, rule, count(*) AS n FROM v GROUP BY ALL""",
)
def q7(spark, sf_dir):
    return K.area_file_violations(area_keys(area_groups(spark, sf_dir))).groupBy("area", "rule").agg(F.count(F.lit(1)).alias("n"))


@query("s9_union_of_sources", WITH_OFFERS + "SELECT source, count(*) AS n, count(remote) AS remotes FROM offers GROUP BY 1")
def s9(spark, sf_dir):
    from offerloom.sources.payloads import union_of_sources

    rows = offers(spark, sf_dir).select("source", "external_id", "remote")
    parts = [rows.where(F.col("source") == s) for s in SOURCES]
    return union_of_sources(parts).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("remote").alias("remotes"))


@query("s10_saved_searches", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment <> 'MACHINERY' ORDER BY c_acctbal DESC, c_custkey DESC")
def s10(spark, sf_dir):
    rows = star(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'")
    return rows.orderBy(F.desc("c_acctbal"), F.desc("c_custkey")).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("s15_preview", WITH_LISTINGS + "SELECT title, CASE WHEN length(company) > 25 THEN concat(company[:25], '...') ELSE company END AS company, CASE WHEN length(location) > 20 THEN concat(location[:20], '...') ELSE location END AS location FROM (SELECT * FROM listings ORDER BY posted_at DESC NULLS LAST, ord DESC LIMIT 20)")
def s15(spark, sf_dir):
    from offerloom.operators.search import ordered
    from offerloom.sources.sinks import preview

    return preview(ordered(listings(spark, sf_dir)))


@query("s17_camel_cards", WITH_LISTINGS + "SELECT external_id AS \"externalId\", contract_type AS \"contractType\" FROM listings WHERE source = 'wttj'")
def s17(spark, sf_dir):
    from offerloom.sources.sinks import camel

    return camel(listings(spark, sf_dir).where("source = 'wttj'").select("external_id", "contract_type"))
