"""Queries over landed pages: pages are made of all offers, an order's offers on a page, and read back by the sources' parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions import text as T
from offerloom.functions.values import SOURCE_CODES
from offerloom.operators import quality as K
from offerloom.operators import runs as R
from offerloom.operators import search as Q
from offerloom.operators import tables as U
from offerloom.plans.bridge import AS_OF, WITH_LISTINGS, WITH_OFFERS, as_of, listings, offers, paged_listings, paged_offers, star
from offerloom.plans.scalar_queries import sql_map
from offerloom.sources import cards, payloads

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ROWS = "external_id, title, company, location, contract_type, posted_at"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _pages(rows: DataFrame, each: Column, head: Column | None = None, tail: str = "") -> DataFrame:
    """(page_id, html): the parts of an order's offers in order; an order has seven at most."""
    parts = rows.groupBy(F.col("page").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("ord", each.alias("part")))).alias("parts"))
    body = F.array_join(F.transform("parts", lambda x: x["part"]), "\n")
    return parts.select("page_id", F.concat(F.lit("<html><body>") if head is None else head, body, F.lit(tail + "</body></html>")).alias("html"))


def _when(test: str, a: str | Column, b: str | Column | None = "") -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(F.expr(test), lit(a)).otherwise(lit(b))


def _tag(name: str, attributes: str, *inside: str | Column) -> Column:
    return F.concat(F.lit(f"<{name} {attributes}>"), *[F.col(x) if isinstance(x, str) else x for x in inside], F.lit(f"</{name}>"))


def _iso() -> Column:
    return F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")


@query("s1_board_pages", WITH_OFFERS + "SELECT concat('adzuna_', external_id) AS external_id, title, company, CASE WHEN tie % 7 = 0 THEN 'France' ELSE location END AS location, CASE WHEN contract_type <> 'freelance' THEN contract_type END AS contract_type, CASE WHEN tie % 4 <> 0 THEN posted_at END AS posted_at, salary_min, salary_max FROM offers WHERE tie % 5 <> 0")
def s1(spark, sf_dir):
    rows = paged_offers(spark, sf_dir)
    result = F.struct(
        F.col("external_id").alias("id"),
        F.expr("if(tie % 5 = 0, ' ', title)").alias("title"),
        F.struct(F.col("company").alias("display_name")).alias("company"),
        F.struct(F.expr("if(tie % 7 = 0, '', location)").alias("display_name")).alias("location"),
        F.col("url").alias("redirect_url"),
        F.expr("case contract_type when 'cdi' then 'permanent' when 'cdd' then 'contract' else 'other' end").alias("contract_type"),
        _when("tie % 4 <> 0", _iso(), "soon").alias("created"),
        "salary_min",
        "salary_max",
    )
    pages = rows.groupBy("page").agg(F.to_json(F.struct(F.collect_list(result).alias("results"), F.count(F.lit(1)).alias("count"))).alias("body"))
    return payloads.board_offers(pages).select(*ROWS.split(", "), "salary_min", "salary_max")


@query("s2_index_pages", WITH_OFFERS + "SELECT concat('wttj_', external_id) AS external_id, title, CASE WHEN tie % 3 = 0 THEN 'Non spécifié' ELSE company END AS company, CASE tie % 4 WHEN 0 THEN 'France' WHEN 1 THEN 'FR' ELSE concat(location, ', FR') END AS location, CASE contract_type WHEN 'cdi' THEN 'cdi' WHEN 'cdd' THEN 'alternance' ELSE 'freelance' END AS contract_type, CASE WHEN tie % 6 <= 1 THEN 'junior' WHEN tie % 6 <= 3 THEN 'mid' ELSE 'senior' END AS experience_level, CASE WHEN tie % 2 = 0 THEN salary_min ELSE salary_min * 2 END AS salary_min FROM offers WHERE tie % 5 <> 0")
def s2(spark, sf_dir):
    rows = paged_offers(spark, sf_dir)
    office = F.struct(_when("tie % 4 > 1", F.col("location"), "").alias("city"), _when("tie % 4 > 0", "FR", "").alias("country"))
    hit = F.struct(
        _when("tie % 2 = 0", F.col("external_id"), None).alias("reference"),
        F.col("external_id").alias("objectID"),
        F.col("title").alias("name"),
        F.struct(_when("tie % 3 = 0", "", F.col("company")).alias("name"), F.lit("acme").alias("slug")).alias("organization"),
        F.array(office).alias("offices"),
        _when("tie % 5 = 0", "", F.col("external_id")).alias("slug"),
        F.expr("case contract_type when 'cdi' then 'FULL_TIME' when 'cdd' then 'apprenticeship' else 'freelance' end").alias("contract_type"),
        _when("tie % 2 = 0", F.col("salary_min"), F.lit(0.0)).alias("salary_minimum"),
        (F.col("salary_min") * 2).alias("salary_yearly_minimum"),
        (F.col("tie") % 6).cast("double").alias("experience_level_minimum"),
    )
    pages = rows.groupBy("page").agg(F.to_json(F.struct(F.collect_list(hit).alias("hits"))).alias("body"))
    return payloads.index_offers(pages).select("external_id", "title", "company", "location", "contract_type", "experience_level", "salary_min")


_DATED = f"CASE WHEN tie % 4 <> 0 AND posted_at IS NOT NULL THEN posted_at WHEN tie % 4 = 0 THEN TIMESTAMP '{AS_OF}' - INTERVAL 3 DAY END"


@query("s3_cards_a", WITH_OFFERS + f"SELECT concat('linkedin_', ord) AS external_id, title, company, CASE WHEN tie % 7 = 0 THEN 'France' ELSE location END AS location, contract_type, {_DATED} AS posted_at FROM offers WHERE tie % 9 <> 0")
def s3(spark, sf_dir):
    """Two kinds of pages; some titles are masked, some ids are only in the URN, some dates are relative."""
    rows = paged_offers(spark, sf_dir)
    card = F.when(F.expr("(ord div 10) % 2 = 0"), F.lit('<div class="base-card x"')).otherwise(F.lit('<div class="job-search-card"'))
    title = _when("tie % 9 = 0", "****** x", F.col("title"))
    each = F.concat(
        card,
        F.lit(' data-entity-urn="urn:li:jobPosting:'),
        F.col("ord"),
        F.lit('"><a class="base-card__full-link" href="https://www.linkedin.com/jobs/view/a-job'),
        _when("tie % 2 = 0", F.concat(F.lit("-"), F.col("ord"), F.lit("?x=1")), "/"),
        F.lit('">see</a>'),
        F.when(F.expr("(ord div 10) % 2 = 0"), _tag("h3", 'class="base-search-card__title"', title)).otherwise(_tag("h3", 'class="job-card-title"', title)),
        _tag("h4", 'class="base-search-card__subtitle"', "company"),
        _when("tie % 7 = 0", "", _tag("span", 'class="job-search-card__location"', "location")),
        _tag("span", 'class="job-search-card__employment-type"', F.initcap("contract_type")),
        F.lit('<time class="job-search-card__listdate" datetime="'),
        _when("tie % 4 = 0", "", F.coalesce(_iso(), F.lit(""))),
        F.lit('">'),
        _when("tie % 4 = 0", "il y a 3 jours", ""),
        F.lit("</time></div>"),
    )
    return cards.card_offers_a(_pages(rows, each), as_of()).select(*ROWS.split(", "))


@query("s4_cards_b", WITH_OFFERS + f"SELECT concat('hellowork_', ord) AS external_id, title, CASE WHEN tie % 5 = 0 THEN 'Non spécifié' ELSE company END AS company, CASE tie % 3 WHEN 0 THEN location WHEN 1 THEN 'Nantes 44' ELSE 'France' END AS location, contract_type, {_DATED} AS posted_at FROM offers")
def s4(spark, sf_dir):
    """Hidden fields or visible text, named places and contracts or tags."""
    rows = paged_offers(spark, sf_dir)
    each = F.concat(
        F.lit('<li data-id-storage-item-id="'),
        F.col("ord"),
        F.lit('"><a href="/fr-fr/emplois/x.html">see</a>'),
        F.when(F.expr("tie % 2 = 0"), F.concat(F.lit('<input name="title" value="'), F.col("title"), F.lit('"><input name="company" value="'), _when("tie % 5 = 0", "", F.col("company")), F.lit('">'))).otherwise(
            F.concat(_tag("p", 'class="tw-typo-l"', "title"), _when("tie % 5 = 0", "", _tag("p", 'class="tw-typo-s tw-inline"', "company")))
        ),
        _when("tie % 3 = 0", F.concat(_tag("div", 'data-cy="localisationCard"', "location"), _tag("div", 'data-cy="contractCard"', F.upper("contract_type"))), F.concat(_tag("div", 'class="tw-readonly tw-tag-secondary-s"', _when("tie % 3 = 1", "Nantes 44", "ailleurs")), _tag("div", 'class="tw-tag-secondary-s"', "contract_type"))),
        F.lit('<time datetime="'),
        _when("tie % 4 = 0", "", F.coalesce(_iso(), F.lit(""))),
        F.lit('">'),
        _when("tie % 4 = 0", "il y a 3 jours", ""),
        F.lit("</time></li>"),
    )
    return cards.card_offers_b(_pages(rows, each, F.lit("<html><ul>"), "</ul>"), as_of()).select(*ROWS.split(", "))


@query("s5_cards_c", WITH_OFFERS + f"SELECT concat('francetravail_', ord) AS external_id, title, CASE tie % 3 WHEN 2 THEN 'Entreprise confidentielle' WHEN 1 THEN concat(company, CASE WHEN contains(location, ' - ') THEN concat(' ', split_part(location, ' - ', 1)) ELSE '' END) ELSE company END AS company, CASE tie % 3 WHEN 2 THEN 'France' WHEN 1 THEN split_part(location, ' - ', -1) ELSE location END AS location, CASE contract_type WHEN 'freelance' THEN 'interim' ELSE contract_type END AS contract_type, TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AS posted_at FROM offers")
def s5(spark, sf_dir):
    """Ids as attributes or in links, "company - place" or a span, contracts inside longer labels."""
    rows = paged_offers(spark, sf_dir)
    each = F.concat(
        F.lit('<li class="result"'),
        _when("(ord div 10) % 2 = 0", F.concat(F.lit(' data-id-offre="'), F.col("ord"), F.lit('"')), ""),
        F.lit('><a href="/offres/recherche/detail/'),
        F.col("ord"),
        F.lit('">see</a><h2 class="media-heading">'),
        _when("tie % 2 = 0", _tag("span", 'class="media-heading-title"', "title"), F.col("title")),
        F.lit("</h2>"),
        F.expr("case tie % 3 when 0 then concat('<p class=\"subtext\">', company, ' - ', location, '</p>') when 1 then concat('<p class=\"subtext\">', company, ' <span>', location, '</span></p>') else '' end"),
        _tag("p", 'class="contrat"', F.expr("case contract_type when 'cdi' then 'Contrat CDI 35h' when 'cdd' then 'CDD - 6 mois' else 'Mission MIS' end")),
        F.lit('<p class="date">Publié hier</p></li>'),
    )
    return cards.card_offers_c(_pages(rows, each, F.lit("<html><ul>"), "</ul>"), as_of()).select(*ROWS.split(", "))


@query("s6_cards_d", WITH_LISTINGS + "SELECT concat('freework_', ord) AS external_id, concat((['App ', 'Graph ', 'Card '])[(ord // 10) % 3 + 1], title) AS title, company, location, CASE contract_type WHEN 'freelance' THEN 'freelance' ELSE contract_type END AS contract_type, CASE WHEN tie % 2 = 0 THEN posted_at ELSE date_trunc('day', posted_at) END AS posted_at FROM listings WHERE (ord // 10) % 3 > 0 OR tie % 5 <> 0")
def s6(spark, sf_dir):
    """Each third of the pages has embedded app data (some of it without a valid URL, which nothing else tells) beside the others, JSON-LD beside cards, or cards only."""
    rows = paged_listings(spark, sf_dir)  # a page tells an offer once
    day = _when("tie % 2 = 0", _iso(), F.date_format("posted_at", "dd/MM/yyyy"))
    path = F.concat(F.lit("/fr/tech-it/dev/job-mission/"), F.col("ord"))
    valid = F.expr("page % 3 > 0 or tie % 5 <> 0")
    url = F.concat(F.lit("https://www.free-work.com"), path)
    said = F.expr("case contract_type when 'freelance' then 'Freelance / mission' else upper(contract_type) end")
    name = lambda kind: F.concat(F.lit(kind), F.col("title"))
    app = F.struct(F.col("ord").alias("id"), name("App ").alias("title"), F.when(valid, path).otherwise(F.concat(F.lit("/fr/tech-it/dev/"), F.col("ord"))).alias("path"), F.struct(F.col("company").alias("name")).alias("company"), F.struct(F.col("location").alias("label")).alias("location"), F.array(said).alias("contracts"), said.alias("contract"), day.alias("publishedAt"))
    graph = F.struct(F.array(F.lit("JobPosting"), F.lit("Thing")).alias("@type"), F.struct(F.concat(F.lit("tags-"), F.col("ord")).alias("value")).alias("identifier"), url.alias("url"), name("Graph ").alias("title"), F.struct(F.col("company").alias("name")).alias("hiringOrganization"), F.array(F.struct(F.struct(F.col("location").alias("addressLocality")).alias("address"))).alias("jobLocation"), said.alias("employmentType"), day.alias("datePosted"))
    card = F.concat(F.lit('<article data-job-id="freework_'), F.col("ord"), F.lit('"><a href="'), path, F.lit('">'), name("Card "), F.lit('</a><p class="company">'), F.col("company"), F.lit('</p><p class="location">'), F.col("location"), F.lit('</p><span class="tag">'), said, F.lit('</span><time datetime="'), F.coalesce(day, F.lit("")), F.lit('"></time></article>'))
    parts = rows.groupBy(F.col("page").alias("page_id")).agg(F.to_json(F.collect_list(app)).alias("app"), F.to_json(F.collect_list(F.when(valid, graph))).alias("graph"), F.array_join(F.collect_list(F.when(valid, card)), "").alias("cards"))
    script = lambda kind, body: F.concat(F.lit(f"<script {kind}>"), body, F.lit("</script>"))
    html = F.concat(
        F.when(F.expr("page_id % 3 = 0"), script('id="__NUXT_DATA__" type="application/json"', F.concat(F.lit('{"data":[1,{"x":'), F.col("app"), F.lit("}]}")))).otherwise(script('id="__NUXT_DATA__"', F.lit("not json"))),
        F.when(F.expr("page_id % 3 < 2"), script('type="application/ld+json"', F.concat(F.lit('{"@graph":[{"itemListElement":'), F.col("graph"), F.lit("}]}")))).otherwise(F.lit("")),
        F.col("cards"),
    )
    return cards.card_offers_d(parts.select("page_id", html.alias("html"))).select(*ROWS.split(", "))


@query("s7_json_ld_details", WITH_OFFERS + "SELECT ord AS page_id, title, CASE WHEN tie % 11 NOT IN (3, 5) THEN company END AS company, CASE WHEN tie % 2 = 0 THEN concat(location, ' (75000)') ELSE location END AS location, salary_min, salary_max, CASE WHEN tie % 3 = 0 THEN 2 ELSE 1 END AS skills FROM offers WHERE tie % 5 <> 0 OR salary_min IS NOT NULL")
def s7(spark, sf_dir):
    rows = offers(spark, sf_dir).repartition("ord")  # as in s8
    address = F.struct(F.col("location").alias("addressLocality"), _when("tie % 2 = 0", "75000", None).alias("postalCode"))
    skills = _when("tie % 3 = 0", "sql, spark", "sql")
    posting = F.struct(F.lit("JobPosting").alias("@type"), "title", F.struct(F.col("company").alias("name")).alias("hiringOrganization"), F.struct(address.alias("address")).alias("jobLocation"), _when("tie % 5 = 0", " ", "A job").alias("description"), F.struct(F.lit("EUR").alias("currency"), F.struct(F.col("salary_min").alias("minValue"), F.col("salary_max").alias("maxValue")).alias("value")).alias("baseSalary"), skills.alias("skills"))
    # a title as a list of one; a company as an object, or as a list of two
    odd = F.when(F.expr("tie % 7 = 1"), F.regexp_replace(F.to_json(posting), '"title":("[^"]*")', '"title":[$1]')).otherwise(F.to_json(posting))
    odd = F.when(F.expr("tie % 11 = 3"), F.regexp_replace(odd, '"name":("[^"]*")', '"name":{"legal":$1}')).when(F.expr("tie % 11 = 5"), F.regexp_replace(odd, '"name":("[^"]*")', '"name":[$1,$1]')).otherwise(odd)
    pages = rows.select(F.col("ord").alias("page_id"), F.concat(F.lit('<script type="application/ld+json">{"@graph":['), odd, F.lit("]}</script>")).alias("html"))
    found = payloads.details(payloads.json_ld(pages))
    return found.select("page_id", "title", "company", "location", "salary_min", "salary_max", F.size("skills").alias("skills"))


@query("s8_detail_pages", WITH_OFFERS + "SELECT ord AS page_id, CASE WHEN tie % 5 = 0 THEN 'Unknown' ELSE title END AS title, CASE WHEN tie % 7 = 0 THEN 'Unknown' ELSE company END AS company, location, CASE tie % 3 WHEN 0 THEN 'cdi' WHEN 1 THEN 'cdd' ELSE 'stage' END AS contract_type, CASE tie % 2 WHEN 0 THEN 'senior' ELSE 'junior' END AS experience_level FROM offers")
def s8(spark, sf_dir):
    """Criteria of which a later one overrules an earlier one."""
    rows = offers(spark, sf_dir).repartition("ord")  # a page each: a file's few row groups would be as many tasks
    item = lambda c: F.concat(F.lit('<li class="description__job-criteria-item">'), c, F.lit("</li>"))
    html = F.concat(
        _when("tie % 5 = 0", "", _tag("h1", 'class="top-card-layout__title"', "title")),
        _when("tie % 7 = 0", "", _tag("a", 'class="topcard__org-name-link"', "company")),
        _tag("span", 'class="topcard__flavor--bullet"', "location"),
        item(F.lit("Entry level, internship")),
        item(F.expr("case tie % 3 when 0 then 'Full-time' when 1 then 'Contract' else 'none' end")),
        item(F.expr("if(tie % 2 = 0, 'Senior', 'none')")),
    )
    return cards.detail_pages(rows.select(F.col("ord").alias("page_id"), html.alias("html")), "linkedin").select("page_id", "title", "company", "location", "contract_type", "experience_level")


@query("j2_app_identifier", "SELECT o_orderkey AS page_id, concat('job-', o_orderkey) AS own_id FROM orders WHERE o_orderkey % 3 <> 0")
def j2(spark, sf_dir):
    """App data whose objects name places in its array; a third names another context."""
    body = F.concat(F.lit('<script id="__NUXT_DATA__">[{"@context":1,"id":2},"'), _when("o_orderkey % 3 = 0", "/contexts/Page", "/contexts/JobPosting"), F.lit('","freework_job-'), F.col("o_orderkey"), F.lit('",true]</script>'))
    return cards.app_identifier(star(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), body.alias("html")))


_EXPERIENCE = {"junior": "Junior", "senior": "Senior", "lead": "Lead"}


@query("t23_experience_label", WITH_OFFERS + f"SELECT experience_level, remote, count(*) AS n, max(coalesce({sql_map('experience_level', _EXPERIENCE)}, '-')) AS level, max(CASE WHEN remote THEN 'Télétravail' WHEN NOT remote THEN 'Sur site' ELSE '-' END) AS place FROM offers GROUP BY 1, 2")
def t23(spark, sf_dir):
    rows = offers(spark, sf_dir).groupBy("experience_level", "remote").agg(F.count(F.lit(1)).alias("n"))
    shown = lambda c: F.coalesce(c, F.lit("-"))
    return rows.withColumns({"level": shown(T.experience_label(F.col("experience_level"))), "place": shown(T.workplace_label(F.col("remote").cast("string")))})


@query("t22_description_blocks")
def t22(spark, sf_dir):
    """Blocks of all documents as descriptions; SQL has no such fold, tests hold it against a plain walk."""
    rows = star(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")  # a file's few row groups would be as many tasks
    rows = rows.select("doc_id", T.description_blocks(F.col("text")).alias("blocks"))
    count = lambda kind: F.size(F.filter("blocks", lambda b: b["type"] == kind))
    return rows.select("doc_id", count("heading").alias("headings"), count("paragraph").alias("paragraphs"), count("list").alias("lists"))


@query("f15_criteria", WITH_LISTINGS + f"SELECT source, external_id FROM listings WHERE contract_type IN ('cdi', 'cdd') AND posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND location IN ('Paris (75)', 'Paris / télétravail', 'Boulogne-Billancourt - 92')")
def f15(spark, sf_dir):
    rows = Q.meets_criteria(listings(spark, sf_dir), as_of(), ("cdi", "cdd"), "Paris", 25, "past_month", 3)
    return rows.select("source", "external_id")


@query("f18_scanned_source", WITH_OFFERS + "SELECT source, count(*) FILTER (tie % 4 <> 0 OR source = 'linkedin') AS valid, count(*) AS n FROM offers GROUP BY 1")
def f18(spark, sf_dir):
    rows = K.checked_offers(offers(spark, sf_dir).withColumn("scanned", F.expr("if(tie % 4 = 0, 'linkedin', source)")), "scanned")
    return rows.groupBy("source").agg(F.count_if("valid").alias("valid"), F.count(F.lit(1)).alias("n"))


@query("l3_allowed_sources", "SELECT c_custkey AS id, (['linkedin,adzuna', 'linkedin', 'wttj,freework'])[c_custkey % 3 + 1] AS sources, c_custkey % 3 <> 1 AS allowed FROM customer")
def l3(spark, sf_dir):
    asked = F.expr("element_at(array(array('adzuna', 'linkedin'), array('linkedin', 'monster'), array('freework', 'wttj', 'wttj')), cast(c_custkey % 3 + 1 as int))")
    rows = R.allowed_sources(star(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), asked.alias("requested_sources")), ["linkedin", "hellowork", "francetravail", "wttj", "adzuna", "freework"])
    return rows.select("id", F.array_join("sources", ",").alias("sources"), (F.size("unknown") == 0).alias("allowed"))


@query("l5_remap_links", WITH_OFFERS.rstrip() + " SELECT DISTINCT search_name AS search, (ord // 100) AS job_id FROM offers")
def l5(spark, sf_dir):
    from offerloom.operators.resolve import remap_links

    links = offers(spark, sf_dir, searches=True).select(F.col("search_name").alias("search"), F.col("ord").alias("job_id"))
    ids = links.select("job_id").distinct().withColumn("keep_id", F.floor(F.col("job_id") / 100))
    return remap_links(links, ids).select("search", "job_id")


@query("j4_provenance", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN TIMESTAMP '2024-01-03' END AS salary, TIMESTAMP '2024-01-01' AS description, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS groups FROM part")
def j4(spark, sf_dir):
    day = lambda n: F.to_timestamp(F.lit(f"2024-01-0{n}"))
    old = F.create_map(F.lit("description"), day(1), F.lit("salary"), day(2))
    new = U.with_provenance(old, "salary", F.when(F.col("p_partkey") % 2 == 0, day(3)))
    rows = star(spark, sf_dir, "part").select("p_partkey", new.alias("p"))
    return rows.select("p_partkey", U.provenance_at(F.col("p"), "salary").alias("salary"), U.provenance_at(F.col("p"), "description").alias("description"), F.size("p").alias("groups"))


_CODES = "', '".join(("F", "C", "C"))


@query("x2_source_codes", WITH_OFFERS + f"SELECT contract_type, (['{_CODES}'])[list_position(['cdi', 'cdd', 'freelance'], contract_type)] AS code, count(*) AS n FROM offers GROUP BY 1")
def x2(spark, sf_dir):
    codes = cards.source_codes(spark).where("source = 'linkedin' and kind = 'contract'")
    rows = offers(spark, sf_dir).groupBy("contract_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(F.broadcast(codes), F.col("contract_type") == F.col("value"), "left").select("contract_type", "code", "n")


_EVERY_CODE = ", ".join(str((source, kind, value, code)) for (source, kind), codes in SOURCE_CODES.items() for value, code in codes.items())
_ASKED = {
    "contract": "contract_type",
    "experience": "experience_level",
    "workplace": "CASE WHEN remote THEN 'remote' WHEN remote IS NULL THEN 'hybrid' ELSE 'on_site' END",
    "date": "CASE WHEN posted_at IS NULL THEN 'any_time' WHEN tie % 3 = 0 THEN 'past_24h' WHEN tie % 3 = 1 THEN 'past_week' ELSE 'past_month' END",
    "sort": "CASE WHEN salary_max IS NULL THEN 'date' ELSE 'relevance' END",
}


@query(
    "x2_every_source_code",
    WITH_OFFERS.rstrip()
    + f", codes(source, kind, value, code) AS (VALUES {_EVERY_CODE}), asked AS ({' UNION ALL '.join(f"SELECT '{k}' AS kind, {e} AS value FROM offers" for k, e in _ASKED.items())}) "
    + "SELECT source, kind, value, code, count(*) AS n FROM asked JOIN codes USING (kind, value) GROUP BY ALL",
)
def x2_every(spark, sf_dir):
    """What each source would be asked for to find each offer, by all tables of codes."""
    asked = F.array(*[F.struct(F.lit(k).alias("kind"), F.expr(e).alias("value")) for k, e in _ASKED.items()])
    rows = offers(spark, sf_dir).select(F.explode(asked).alias("a")).groupBy("a.kind", "a.value").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(F.broadcast(cards.source_codes(spark)), ["kind", "value"]).select("source", "kind", "value", "code", "n")


@query("x3_contract_families", "SELECT o_orderkey, (['-', 'permanent,contract', 'contract', ''])[o_orderkey % 4 + 1] AS families FROM orders")
def x3(spark, sf_dir):
    from offerloom.functions.scalars import contract_families

    asked = F.expr("element_at(array(cast(array() as array<string>), array('cdi', 'interim', 'cdd'), array('freelance', 'stage'), array('stage')), cast(o_orderkey % 4 + 1 as int))")
    rows = star(spark, sf_dir, "orders").select("o_orderkey", contract_families(asked, SOURCE_CODES["adzuna", "contract"]).alias("f"))
    return rows.select("o_orderkey", F.array_join("f", ",", "-").alias("families"))


@query("d5_utc", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate::TIMESTAMP - INTERVAL 2 HOUR ELSE o_orderdate::TIMESTAMP END AS at FROM orders")
def d5(spark, sf_dir):
    from offerloom.functions.scalars import utc_instant

    said = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.expr("case o_orderkey % 3 when 0 then '+02:00' when 1 then 'Z' else '' end"))
    return star(spark, sf_dir, "orders").select("o_orderkey", utc_instant(said).alias("at"))


@query("p4_stated_minimum", "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN round(p_retailprice)::DOUBLE END AS low FROM part")
def p4(spark, sf_dir):
    from offerloom.functions.scalars import stated_minimum

    said = F.concat(F.lit("À partir de "), F.replace(F.format_number(F.round("p_retailprice"), 0), F.lit(","), F.lit(" ")), _when("p_partkey % 3 = 0", " dollars", " € brut"))
    return star(spark, sf_dir, "part").select("p_partkey", stated_minimum(said).alias("low"))


@query("a5_stable_intersection", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat(p_brand, '|', p_type) ELSE p_type END AS items FROM part")
def a5(spark, sf_dir):
    from offerloom.functions.scalars import stable_intersection

    items = stable_intersection(F.array("p_brand", "p_type", "p_brand"), F.array(F.col("p_type"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand"))))
    return star(spark, sf_dir, "part").select("p_partkey", F.array_join(items, "|").alias("items"))


@query("g13_any_overdue", "WITH sruns AS (SELECT user_id % 100 AS search, event_type, ts FROM events), done AS (SELECT search, max(ts) AS done_at FROM sruns WHERE event_type IN ('purchase', 'view') GROUP BY 1) SELECT count(*) > 0 AS is_due FROM (SELECT DISTINCT search FROM sruns) LEFT JOIN done USING (search) WHERE done_at IS NULL OR done_at < (SELECT date_trunc('day', max(ts)) + INTERVAL 8 HOUR FROM events)")
def g13(spark, sf_dir):
    from offerloom.plans.table_queries import search_runs

    runs = search_runs(spark, sf_dir)
    end = runs.agg(F.date_trunc("day", F.max("created_at")).alias("end"))
    searches = runs.select("search").distinct().withColumn("active", F.lit(True)).join(F.broadcast(end))
    return R.any_overdue(R.overdue(searches, runs.withColumnRenamed("created_at", "finished_at"), F.col("end") + F.expr("interval 23 hours"), 8, 0, "UTC"))
