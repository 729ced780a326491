"""Queries over listings: filters, places, orders, states, facets, cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerloom.functions.scalars import EARTH_KM
from offerloom.functions.values import CITIES
from offerloom.operators import places as P
from offerloom.operators import resolve as D
from offerloom.operators import search as Q
from offerloom.plans.bridge import AS_OF, WITH_LISTINGS, WITH_OFFERS, as_of, labels, listings, offers, search_listings, star
from offerloom.plans.scalar_queries import quoted, sql_city, sql_filter_key, sql_key, sql_municipality
from offerloom.session import settled, shared_table
from offerloom.sources.sinks import card_lines

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ROW = "source, external_id, ord, title, company, location, contract_type, posted_at"
COLUMNS = ROW.split(", ")
JOB_ID = "concat(source, ':', external_id)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).withColumns({"job_id": F.expr(JOB_ID), "skills": F.array("skill_type", "skill_brand")})


def _filter(name: str, sql: str, **asked) -> None:
    def run(spark, sf_dir):
        return Q.matching(jobs(spark, sf_dir), Q.JobQuery(**asked), as_of()).select(*COLUMNS)

    QUERIES[name], ORACLES[name] = run, WITH_LISTINGS + f"SELECT {ROW} FROM listings WHERE {sql}"


@query("m0_newest_page", WITH_LISTINGS + f"SELECT {ROW} FROM listings WHERE contract_type = 'cdi' AND {sql_municipality(f'({sql_city('location')})')} = 'paris' ORDER BY posted_at DESC NULLS LAST, ord DESC LIMIT 24")
def m0(spark, sf_dir):
    asked = Q.JobQuery(contracts=("cdi",))
    rows = Q.matching(jobs(spark, sf_dir), asked, as_of())
    return Q.page(P.in_places(rows, ["paris"], labels=labels(spark, sf_dir)), asked).select(*COLUMNS)


_filter("f3_posted_since", f"posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY", period="3d")
_filter("f4_text", f"contains({sql_filter_key("concat_ws(' ', nullif(title, ''), nullif(company, ''))")}, 'senior supplier')", text="  SENIOR  supplier ")
_filter("f6_contract", "contract_type IN ('cdi', 'freelance')", contracts=("cdi", "freelance"))
_filter("f7_remote", "remote = true", remote=True)
_filter("f8_experience", "experience_level IN ('senior', 'lead')", levels=("senior", "lead"))
_filter("f9_salary", "salary_max >= 1450", salary_min=1450.0)
_filter("f10_company", f"{sql_filter_key('company')} IN ('supplier#000000001 sas', 'supplier#000000002')", companies=("Supplier#000000001  SAS", "supplier#000000002"))
_filter("f12_skills", "skill_brand = 'brand#11'", skills=("BRAND#11",))
_filter("f17_excluded_companies", f"{sql_filter_key('company')} NOT IN ('supplier#000000001 sas') AND salary_max >= 1480", excluded_companies=("Supplier#000000001 SAS",), salary_min=1480.0)

_VIEWS = "SELECT DISTINCT user_id AS ord FROM events WHERE event_type = 'view'"


@query("f1_unseen", WITH_LISTINGS + f"SELECT {ROW} FROM listings WHERE ord // 10 NOT IN ({_VIEWS})")
def f1(spark, sf_dir):
    seen = star(spark, sf_dir, "events").where("event_type = 'view'").groupBy("user_id").agg(F.min("ts").alias("viewed_at"))
    rows = jobs(spark, sf_dir).join(seen, F.floor(F.col("ord") / 10) == F.col("user_id"), "left")
    return Q.matching(rows, Q.JobQuery(unseen=True), as_of()).select(*COLUMNS)


@query("f2_saved_search", WITH_LISTINGS + f"SELECT {ROW} FROM listings l WHERE EXISTS (SELECT 1 FROM search_listings s WHERE s.source = l.source AND s.external_id = l.external_id AND search_name = 'BUILDING')")
def f2(spark, sf_dir):
    links = search_listings(spark, sf_dir).where("search_name = 'BUILDING'")
    return jobs(spark, sf_dir).join(links, ["source", "external_id"], "left_semi").select(*COLUMNS)


_IN_PARIS = f"{sql_municipality(f'({sql_city('location')})')} IN ('paris', 'boulogne billancourt')"


@query("f5_locations", WITH_LISTINGS + f"SELECT {ROW} FROM listings WHERE {_IN_PARIS} OR {sql_city('location')} = 'nantes'")
def f5(spark, sf_dir):
    return P.metropole_match(jobs(spark, sf_dir), ["Paris", "Nantes (44)"], P.areas(spark), labels=labels(spark, sf_dir)).select(*COLUMNS)


@query("b5_metropole", WITH_OFFERS + f"SELECT location, count(*) AS n FROM offers WHERE {sql_municipality(f'({sql_city('location')})')} IN ('lyon', 'villeurbanne') GROUP BY 1")
def b5(spark, sf_dir):
    return P.metropole_match(offers(spark, sf_dir), ["Lyon"], P.areas(spark)).groupBy("location").agg(F.count(F.lit(1)).alias("n"))


_CITY = " UNION ALL ".join(f"SELECT {i} AS ord, {quoted(c)} AS city, {lat}::DOUBLE AS lat, {lon}::DOUBLE AS lon" for i, (c, (lat, lon)) in enumerate(CITIES.items()))
_SLUG = "regexp_replace(strip_accents(lower(location)), '[^a-z0-9]+', '-', 'g')"
_LOCATED = f"places AS (SELECT DISTINCT location FROM offers), located AS (SELECT location, min_by(lat, ord) AS lat, min_by(lon, ord) AS lon FROM places JOIN ({_CITY}) ON contains(concat('-', trim({_SLUG}, '-'), '-'), concat('-', replace(strip_accents(city), ' ', '-'), '-')) GROUP BY 1)"
_KM = f"2 * {EARTH_KM} * atan2(sqrt(a), sqrt(1 - a))"


@query("b6_radius", WITH_OFFERS + f", {_LOCATED}, far AS (SELECT location, power(sin(radians(lat - 48.8566) / 2), 2) + cos(radians(48.8566)) * cos(radians(lat)) * power(sin(radians(lon - 2.3522) / 2), 2) AS a FROM located) SELECT o.location, count(*) AS n, round(max({_KM}), 6) AS km FROM offers o JOIN far USING (location) WHERE {_KM} <= 25 GROUP BY 1")
def b6(spark, sf_dir):
    rows = P.within_radius(offers(spark, sf_dir), "paris", 25)
    return rows.groupBy("location").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("km"), 6).alias("km"))


_HELD = f"SELECT location AS label, min_by(lat, ord) AS lat, min_by(lon, ord) AS lon FROM (SELECT DISTINCT location FROM offers) JOIN ({_CITY}) ON contains(lower(trim(location)), city) OR contains(city, lower(trim(location))) GROUP BY 1"


@query("b7_geocode", WITH_OFFERS + _HELD)
def b7(spark, sf_dir):
    return P.geocoded(offers(spark, sf_dir))


@query("m1_haversine", WITH_OFFERS + f", {_LOCATED}, far AS (SELECT location, power(sin(radians(lat - 48.8566) / 2), 2) + cos(radians(48.8566)) * cos(radians(lat)) * power(sin(radians(lon - 2.3522) / 2), 2) AS a FROM located) SELECT source, external_id, round({_KM}, 6) AS km FROM offers JOIN far USING (location)")
def m1(spark, sf_dir):
    rows = offers(spark, sf_dir).select("source", "external_id", "location")
    found = rows.join(P.located(rows), F.col("location") == F.col("label"))
    return found.select("source", "external_id", F.round(P.haversine_km(F.lit(48.8566), F.lit(2.3522), F.col("lat"), F.col("lon")), 6).alias("km"))


@query("f11_active_source", WITH_LISTINGS + "SELECT DISTINCT ord // 10 AS job_id FROM listings l WHERE EXISTS (SELECT 1 FROM listings o WHERE o.ord // 10 = l.ord // 10 AND o.active AND o.source IN ('wttj', 'adzuna'))")
def f11(spark, sf_dir):
    links = listings(spark, sf_dir).select(F.floor(F.col("ord") / 10).alias("job_id"), "source", "active")
    return Q.with_active_source(links.select("job_id").distinct(), links, ("wttj", "adzuna"))


@query("f16_recency", WITH_OFFERS + f"SELECT source, count(*) AS n FROM offers WHERE posted_at IS NULL OR posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1")
def f16(spark, sf_dir):
    return Q.recent(offers(spark, sf_dir), as_of()).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("f19_url_filters", WITH_LISTINGS + f"SELECT {ROW} FROM listings WHERE contract_type IN ('cdi', 'cdd') AND remote = false AND posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY")
def f19(spark, sf_dir):
    asked = Q.JobQuery.from_params({"contract": "cdi, cdd,,cdi", "remote": "false", "period": "unknown", "sort": "?"})
    return Q.matching(jobs(spark, sf_dir), asked, as_of()).select(*COLUMNS)


_SORTED = {"o1_newest": ("newest", "posted_at DESC NULLS LAST, ord DESC"), "o2_oldest": ("oldest", "posted_at ASC NULLS LAST, ord ASC"), "o4_title": ("title", f"{sql_filter_key('title')}, ord")}
for _name, (_sort, _order) in _SORTED.items():
    QUERIES[_name] = lambda spark, sf_dir, sort=_sort: Q.page(jobs(spark, sf_dir), Q.JobQuery(sort=sort, limit=50)).select(*COLUMNS)
    ORACLES[_name] = WITH_LISTINGS + f"SELECT {ROW} FROM listings ORDER BY {_order} LIMIT 50"

_HITS = lambda c: f"(length({sql_filter_key(c)}) - length(replace({sql_filter_key(c)}, 'red', ''))) // 3"


@query("o3_relevance", WITH_LISTINGS + f"SELECT source, external_id, (3 * {_HITS('title')} + 2 * {_HITS('company')})::BIGINT AS score FROM listings ORDER BY score DESC, posted_at DESC NULLS LAST, ord DESC LIMIT 40 OFFSET 5")
def o3(spark, sf_dir):
    rows = jobs(spark, sf_dir).withColumn("description", F.lit(None).cast("string"))
    return Q.page(rows, Q.JobQuery(text="Red", sort="relevance", limit=40, offset=5)).select("source", "external_id", "score")


@query("o5_page", WITH_LISTINGS + f"SELECT {ROW} FROM listings ORDER BY posted_at DESC NULLS LAST, ord DESC LIMIT 24 OFFSET 48")
def o5(spark, sf_dir):
    return Q.page(jobs(spark, sf_dir), Q.JobQuery(offset=48)).select(*COLUMNS)


@query("g6_total", WITH_LISTINGS + "SELECT contract_type, count(*) AS total FROM listings WHERE remote GROUP BY 1")
def g6(spark, sf_dir):
    return Q.matching(jobs(spark, sf_dir), Q.JobQuery(remote=True), as_of()).groupBy("contract_type").agg(F.count(F.lit(1)).alias("total"))


@query("g14_facets", WITH_LISTINGS + "SELECT facet, value, count(*) AS n FROM (SELECT unnest([{'facet': 'contract_type', 'value': contract_type}, {'facet': 'experience_level', 'value': experience_level}, {'facet': 'source', 'value': source}], recursive := true) FROM listings WHERE active) GROUP BY ALL")
def g14(spark, sf_dir):
    return Q.facets(jobs(spark, sf_dir).where("active"))


_CHOSEN = {"contract_type": ("cdi", "cdd"), "experience_level": ("senior", "lead"), "source": ("wttj", "adzuna", "freework")}
_MEETS = {n: f"coalesce({n} IN {v}, false)" for n, v in _CHOSEN.items()}


@query("g14_facets_beside", WITH_LISTINGS + " UNION ALL ".join(f"SELECT '{n}' AS facet, {n} AS value, count(*) AS n FROM listings WHERE {' AND '.join(m for o, m in _MEETS.items() if o != n)} GROUP BY ALL" for n in _CHOSEN))
def g14_beside(spark, sf_dir):
    return Q.facets_beside(jobs(spark, sf_dir), _CHOSEN)


# Canonical jobs: listings of one company, place and title are one job here.
_CANON = f"canon AS (SELECT *, concat({sql_key('company')}, '|', location, '|', {sql_key('title')}) AS job_id FROM listings)"


def canonical(spark, sf_dir):
    """Listings with their job_id, written once: what is asked of jobs reads them several times."""
    columns = ["ord", "source", "url", "active", "title", "company", "location", "experience_level"]

    def made():
        rows = D.keyed(shared_table(listings(spark, sf_dir).select(*columns), "texts"))
        return rows.select(F.concat_ws("|", "company_key", "location", "title_key").alias("job_id"), *columns)

    return settled(spark, made, "jobs")


def possible(links):
    """The possible duplicates among listings' jobs, written once; what leads to them is not kept."""
    return settled(links.sparkSession, lambda: D.possible_edges(D.written_jobs(links)), "edges")


_WITH = WITH_LISTINGS.rstrip() + f", {_CANON} "


@query("g1_confirmed", _WITH + "SELECT job_id FROM canon GROUP BY 1 HAVING count(*) > 1")
def g1(spark, sf_dir):
    return Q.confirmed_jobs(canonical(spark, sf_dir))


# SQL has no title similarity: what rests on possible duplicates is held against brute force in tests.
@query("g2_possible")
def g2(spark, sf_dir):
    rows = canonical(spark, sf_dir)
    return Q.possible_jobs(possible(rows), Q.confirmed_jobs(rows))


@query("g3_sources", _WITH + "SELECT job_id, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM canon WHERE active GROUP BY 1")
def g3(spark, sf_dir):
    return canonical(spark, sf_dir).where("active").groupBy("job_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("g4_duplicate_state")
def g4(spark, sf_dir):
    links = canonical(spark, sf_dir)
    return Q.with_state(links.select("job_id").distinct(), links, possible(links))


@query("f13_state_filter")
def f13(spark, sf_dir):
    return Q.in_state(g4(spark, sf_dir), "duplicate")


@query("g5_cards")
def g5(spark, sf_dir):
    links = canonical(spark, sf_dir)
    edges = possible(links)
    return Q.cards(shared_table(Q.shown_jobs(links, "title", "company", "location"), "shown"), None, edges)


@query("g5_card_sources", _WITH + "SELECT job_id, count(*) AS n_sources, array_to_string(list(source ORDER BY ord), ',') AS sources FROM canon GROUP BY 1")
def g5_sources(spark, sf_dir):
    links = canonical(spark, sf_dir)
    none = spark.createDataFrame([], "left_id string, right_id string, score double, reasons array<string>")
    rows = Q.cards(links.groupBy("job_id").agg(F.min("title").alias("title"), F.min("company").alias("company"), F.min("location").alias("location")), links, none)
    return rows.select("job_id", F.size("sources").cast("bigint").alias("n_sources"), F.array_join(F.transform("sources", lambda s: s["source"]), ",").alias("sources"))


@query("b8_possible_pairs")
def b8(spark, sf_dir):
    e = possible(canonical(spark, sf_dir))
    return e.select(F.col("left_id").alias("job_id"), F.col("right_id").alias("other"), "score").unionByName(e.select(F.col("right_id").alias("job_id"), F.col("left_id").alias("other"), "score"))


@query("b4_listing_jobs", WITH_LISTINGS + "SELECT s.search_name, count(*) AS n, count(*) FILTER (l.active) AS active FROM search_listings s JOIN listings l USING (source, external_id) GROUP BY 1")
def b4(spark, sf_dir):
    rows = search_listings(spark, sf_dir).join(listings(spark, sf_dir).select("source", "external_id", "active"), ["source", "external_id"])
    return rows.groupBy("search_name").agg(F.count(F.lit(1)).alias("n"), F.count_if("active").alias("active"))


_CARD_KEYS = "id,title,company,location,salaryMin,salaryMax,salaryCurrency,contractType,experienceLevel,remote,postedAt,viewedAt,sources,duplicateState,possibleDuplicates"


@query(
    "s17_nested_cards",
    _WITH
    + f""", jobs AS (SELECT job_id, arg_min(title, ord) AS title, arg_min(company, ord) AS company, arg_min(location, ord) AS location, count(*) AS n, list({{'source': source, 'url': url, 'active': active}} ORDER BY ord) AS sources FROM canon GROUP BY 1),
pairs AS (SELECT job_id AS a, title, company, location, lead(job_id) OVER w AS b, lead(location) OVER w AS b_location FROM jobs WHERE title <> '' AND company <> '' WINDOW w AS (PARTITION BY title, company ORDER BY job_id)),
sides AS (SELECT a AS job_id, b AS other, title, company, b_location AS location FROM pairs WHERE b IS NOT NULL UNION ALL SELECT b, a, title, company, location FROM pairs WHERE b IS NOT NULL),
near AS (SELECT job_id, list({{'id': other, 'title': title, 'company': company, 'location': location, 'score': 0.9::DOUBLE, 'reasons': ['title']}} ORDER BY other) AS near FROM sides GROUP BY 1)
SELECT job_id AS id, '{_CARD_KEYS}' AS keys, title, to_json(sources)::VARCHAR AS sources, coalesce(to_json(near)::VARCHAR, '[]') AS possible, CASE WHEN n > 1 THEN 'confirmed' WHEN near IS NOT NULL THEN 'possible' ELSE 'none' END AS state
FROM jobs LEFT JOIN near USING (job_id)""",
)
def s17_nested(spark, sf_dir):
    """Cards as texts and read again; neighbours in order among jobs of one title and company are their possible duplicates here."""
    jobs = shared_table(Q.shown_jobs(canonical(spark, sf_dir), "title", "company", "location"), "shown")
    after = F.lead("job_id").over(Window.partitionBy("title", "company").orderBy("job_id"))
    edges = jobs.where("title <> '' and company <> ''").select(F.col("job_id").alias("left_id"), after.alias("right_id"), F.lit(0.9).alias("score"), F.array(F.lit("title")).alias("reasons")).where("right_id is not null")
    edges = shared_table(edges, "edges")
    absent = {c: F.lit(None).cast(t) for c, t in (("salary_min", "double"), ("salary_max", "double"), ("salary_currency", "string"), ("contract_type", "string"), ("experience_level", "string"), ("remote", "boolean"), ("posted_at", "timestamp"), ("viewed_at", "timestamp"))}
    # what is near is looked up in the written jobs, not in those with a state, which would be joined twice
    stated = Q.with_state(Q.cards(jobs, None, edges), None, edges.withColumn("kind", F.lit("possible"))).withColumns(absent)
    lines = card_lines(stated.withColumnRenamed("job_id", "id"))
    read = lines.select("id", F.from_json("card", "map<string,string>").alias("card"))  # a card is read once for all its parts
    part = lambda name: F.element_at("card", F.lit(name))
    return read.select("id", F.array_join(F.map_keys("card"), ",").alias("keys"), part("title").alias("title"), part("sources").alias("sources"), part("possibleDuplicates").alias("possible"), part("duplicateState").alias("state"))
