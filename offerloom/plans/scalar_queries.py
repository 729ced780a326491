"""Queries over single columns: keys, dates, salaries, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.functions import scalars as S
from offerloom.functions import text as T
from offerloom.functions.values import CONTRACT_LABELS, DEPARTMENTS, LEGAL_FORMS, NOT_A_COMPANY, RANK, SENIORITY_WORDS, SOURCE_LABELS
from offerloom.operators import places as P
from offerloom.plans.bridge import AS_OF, WITH_LISTINGS, WITH_OFFERS, as_of, listings, offers, star
from offerloom.session import settled

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DEPARTMENT = "(?:" + "|".join(DEPARTMENTS) + ")"
DISTRICT = "^(" + "|".join(P.DISTRICTS) + f") ([0-9]{{1,2}})(er|e|eme)?( arrondissement)?( {DEPARTMENT})?$"
FORMS = "|".join(sorted(LEGAL_FORMS, key=len, reverse=True))


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_fold(e: str) -> str:
    return f"replace(replace(strip_accents(lower({e})), 'ß', 'ss'), 'ﬁ', 'fi')"


def sql_squeeze(e: str) -> str:
    return f"trim(regexp_replace({e}, '[^a-z0-9]+', ' ', 'g'))"


def sql_key(e: str) -> str:
    marked = rf"regexp_replace({sql_fold(e)}, '(^|[^a-z0-9])[hf]\s*[/-]\s*[hf]($|[^a-z0-9])', '\1 \2', 'g')"
    bare = rf"regexp_replace(regexp_replace({marked}, '\s*\(\s*{DEPARTMENT}\s*\)\s*$', ''), '\s*[,-]\s*{DEPARTMENT}\s*$', '')"
    return f"regexp_replace({sql_squeeze(bare)}, '((^| )({FORMS}))+$', '')"


def sql_no_country(e: str) -> str:
    return rf"regexp_replace({e}, '(\s*,\s*france|\s+[-–—]\s+france|\s*\(\s*france\s*\))\s*$', '')"


def sql_location(e: str) -> str:
    key = rf"regexp_replace({sql_key(sql_no_country(f'trim({sql_fold(e)})'))}, '((^| ){DEPARTMENT})+$', '')"
    return f"CASE WHEN trim({sql_fold(e)}) = 'france' THEN 'france' ELSE {key} END"


def sql_filter_key(e: str) -> str:
    return rf"lower(trim(regexp_replace({e}, '\s+', ' ', 'g')))"


def sql_city(e: str) -> str:
    plain = sql_squeeze(sql_no_country(sql_fold(e)))
    part = lambda i: f"regexp_extract({plain}, {quoted(DISTRICT)}, {i})"
    own = " OR ".join(f"({part(1)} = '{c}' AND try_cast({part(2)} AS INT) = {d[1]})" for c, d in P.DISTRICTS.items())
    return f"CASE WHEN {part(1)} = '' THEN {sql_location(e)} WHEN {part(3)} = '' AND {part(4)} = '' AND {part(5)} = '' AND ({own}) THEN {part(1)} ELSE concat({part(1)}, ' ', try_cast({part(2)} AS INT)) END"


def sql_municipality(e: str) -> str:
    part = lambda i: f"regexp_extract({e}, {quoted(DISTRICT)}, {i})"
    ok = " OR ".join(f"({part(1)} = '{c}' AND try_cast({part(2)} AS INT) BETWEEN 1 AND {d[0]})" for c, d in P.DISTRICTS.items())
    return f"CASE WHEN {ok} THEN {part(1)} ELSE {e} END"


def sql_map(e: str, values: dict) -> str:
    return f"CASE {e} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v) if isinstance(v, str) else v}" for k, v in values.items()) + " END"


def keyed(column: str, make, sql_make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return offers(spark, sf_dir).groupBy(make(F.col(column)).alias("k")).agg(F.count(F.lit(1)).alias("n"))

    return run, WITH_OFFERS + f"SELECT {sql_make(column)} AS k, count(*) AS n FROM offers GROUP BY 1"


for _name, _column, _make, _sql in (
    ("t01_accent_fold", "location", T.fold, sql_fold),
    ("t02_text_key", "title", T.text_key, sql_key),
    ("t03_title_key", "title", T.title_key, sql_key),
    ("t04_company_key", "company", T.company_key, sql_key),
    ("t06_location_key", "location", T.location_key, sql_location),
    ("t07_filter_key", "title", T.filter_key, sql_filter_key),
    ("t08_slug", "location", T.slug, lambda e: f"trim(regexp_replace({sql_fold(e)}, '[^a-z0-9]+', '-', 'g'), '-')"),
    ("t09_city_key", "location", P.city_key, sql_city),
    ("t10_municipality", "location", lambda c: P.municipality(P.city_key(c)), lambda e: sql_municipality(f"({sql_city(e)})")),
    ("t14_explicit_company", "company", T.explicit_company, lambda e: f"{sql_key(e)} NOT IN ({', '.join(map(quoted, ('', *NOT_A_COMPANY)))})"),
    ("t16_masked", "title", T.masked, lambda e: f"length({e}) = 0 OR length(regexp_replace({e}, '[^*]', '', 'g')) > 0.3 * length({e})"),
    ("t18_has_text", "title", T.has_text, lambda e: f"length(trim({e})) > 0"),
    ("t23_source_label", "source", T.source_label, lambda e: f"coalesce({sql_map(f'lower(trim({e}))', SOURCE_LABELS)}, trim({e}))"),
    ("t23_contract_label", "contract_type", T.contract_label, lambda e: f"coalesce({sql_map(f'lower(trim({e}))', CONTRACT_LABELS)}, trim({e}))"),
):
    QUERIES[_name], ORACLES[_name] = keyed(_column, _make, _sql)


@query("t05_legal_forms", WITH_OFFERS + f"SELECT regexp_replace({sql_squeeze(sql_fold('company'))}, '((^| )({FORMS}))+$', '') AS k, count(DISTINCT company) AS n FROM offers GROUP BY 1")
def t05(spark, sf_dir):
    return offers(spark, sf_dir).groupBy(T.without_legal_form(T.squeeze(T.fold(F.col("company")))).alias("k")).agg(F.count_distinct("company").alias("n"))


@query("t13_non_city", WITH_OFFERS + f"SELECT DISTINCT location AS label, {sql_location('location')} AS key FROM offers WHERE {sql_location('location')} IN ('france', 'ile de france')")
def t13(spark, sf_dir):
    rows = P.evidence(offers(spark, sf_dir)).where("kind = 'non_city'")
    return rows.select("label", "key")


_WORDS = " UNION ALL ".join(f"SELECT {quoted(w)} AS w, {RANK[lv]} AS r" for w, lv in SENIORITY_WORDS.items())


@query("t15_seniority", WITH_OFFERS + f", words AS ({_WORDS}), titles AS (SELECT DISTINCT title, experience_level FROM offers), told AS (SELECT title, experience_level, max(r) AS r FROM (SELECT title, experience_level, unnest(string_split({sql_key('title')}, ' ')) AS w FROM titles) JOIN words USING (w) GROUP BY ALL) SELECT t.title, t.experience_level, greatest(r, {sql_map('t.experience_level', RANK)}) AS level FROM titles t LEFT JOIN told ON t.title = told.title AND t.experience_level IS NOT DISTINCT FROM told.experience_level")
def t15(spark, sf_dir):
    titles = offers(spark, sf_dir).select("title", "experience_level").distinct()
    return titles.withColumn("level", T.seniority(F.col("title"), F.col("experience_level")))


@query("t17_title_similarity")
def t17(spark, sf_dir):
    """The pairs of titles among candidates that are POSSIBLE or nearer, with their similarity; SQL has no such similarity."""
    from offerloom.operators import resolve as D

    return D.near_titles(settled(spark, lambda: D.profiles(D.prepared(listings(spark, sf_dir))), "profiles"))


_BLOCKS = r"regexp_replace(regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>', '', 'gis'), '<style\b.*?</style\s*>', '', 'gis'), '<br\s*/?>|</(p|div|li|ul|ol|h[1-6]|tr|section|article)\s*>', chr(10), 'gi')"
_ENTITIES = f"regexp_replace({_BLOCKS}, '<[^>]*>', '', 'g')"
for _name, _sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _ENTITIES = f"replace({_ENTITIES}, '{_name}', '{_sign}')"


@query("t19_rich_text", rf"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace({_ENTITIES}, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM pages")
def t19(spark, sf_dir):
    return star(spark, sf_dir, "pages").select("page_id", T.rich_text(F.col("html")).alias("text"))


@query("t20_one_line", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS line FROM pages")
def t20(spark, sf_dir):
    return star(spark, sf_dir, "pages").select("page_id", T.one_line(F.col("html")).alias("line"))


@query("t21_text_lines", "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 0), chr(10)) AS lines FROM documents")
def t21(spark, sf_dir):
    return star(spark, sf_dir, "documents").select("doc_id", T.text_lines(F.col("text")).alias("lines"))


@query("t24_external_id", WITH_OFFERS + "SELECT source, external_id, CASE WHEN source = 'linkedin' THEN external_id ELSE concat(source, '_', external_id) END AS bare FROM offers")
def t24(spark, sf_dir):
    tagged = F.concat_ws("_", "source", "external_id")
    return offers(spark, sf_dir).select("source", "external_id", T.without_prefix(tagged, "linkedin_").alias("bare"))


_SAID = ("Contrat CDI, temps plein", "CDD de 6 mois", "Stage", "Contrat d'apprentissage", "Intérim / MIS", "Freelance ou indépendant", "VIE")
_MEANT = ("cdi", "cdd", "stage", "alternance", "interim", "freelance", None)


@query("x1_worded_contract", "SELECT contract, family, count(*) AS n FROM (SELECT " + " ".join(f"{'CASE' if not i else ''} WHEN o_orderkey % 7 = {i} THEN {quoted(x)}" for i, x in enumerate(_SAID)) + " END AS contract, " + " ".join(f"{'CASE' if not i else ''} WHEN o_orderkey % 7 = {i} THEN {quoted(x) if x else 'NULL'}" for i, x in enumerate(_MEANT)) + " END AS family FROM orders) GROUP BY ALL")
def x1(spark, sf_dir):
    from offerloom.sources.cards import worded_contract

    said = F.element_at(F.array(*[F.lit(x) for x in _SAID]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    rows = star(spark, sf_dir, "orders").select(said.alias("contract"))
    return rows.groupBy("contract", worded_contract(F.col("contract")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


# Texts that reach each branch, made of the rows: T14, T16 and T18 of titles and companies that are often none.
_ODD = "CASE c_custkey % 8 WHEN 0 THEN 'Confidentiel' WHEN 1 THEN 'Non communiqué' WHEN 2 THEN '***' WHEN 3 THEN concat('****', left(c_name, 6)) WHEN 4 THEN '   ' WHEN 5 THEN 'Entreprise générique' WHEN 6 THEN NULL ELSE c_name END"


@query("t14_placeholders", f"SELECT c_custkey, c_custkey % 8 IN (3, 7) AS company, CASE WHEN c_custkey % 8 = 6 THEN true ELSE c_custkey % 8 IN (2, 3) END AS masked, coalesce(length(trim({_ODD})) > 0, false) AS told FROM customer")
def t14(spark, sf_dir):
    rows = star(spark, sf_dir, "customer").select("c_custkey", F.expr(_ODD).alias("odd"))
    return rows.select("c_custkey", F.coalesce(T.explicit_company(F.col("odd")), F.lit(False)).alias("company"), T.masked(F.col("odd")).alias("masked"), T.has_text(F.col("odd")).alias("told"))


@query("t25_clean_external_id", WITH_OFFERS + r"SELECT external_id AS raw, CASE WHEN regexp_matches(external_id, '^[A-Za-z0-9][A-Za-z0-9_-]{0,127}$') THEN external_id END AS id FROM offers WHERE source = 'freework'")
def t25(spark, sf_dir):
    rows = offers(spark, sf_dir).where("source = 'freework'")
    return rows.select(F.col("external_id").alias("raw"), T.clean_external_id(F.concat(F.lit("tags-freework_"), F.col("external_id")), "freework").alias("id"))


@query("t26_url_id", WITH_OFFERS + "SELECT DISTINCT url, concat('url_', sha256(url)) AS id FROM offers")
def t26(spark, sf_dir):
    return offers(spark, sf_dir).select("url", T.url_id(F.col("url")).alias("id")).distinct()


@query("t27_canonical_url", WITH_OFFERS + "SELECT DISTINCT url, url AS canonical FROM offers")
def t27(spark, sf_dir):
    return offers(spark, sf_dir).select("url", T.canonical_url(F.concat(F.col("url"), F.lit("/")), ("www.example.com",), "^/jobs/[0-9-]+$").alias("canonical")).distinct()


@query("t28_query_terms", WITH_OFFERS + "SELECT DISTINCT title, skill_brand, CASE WHEN length(trim(title)) > 0 THEN concat(trim(title), '|', trim(title), ' ', skill_brand) END AS terms FROM offers")
def t28(spark, sf_dir):
    rows = offers(spark, sf_dir).select("title", "skill_brand").distinct()
    return rows.withColumn("terms", F.array_join(T.query_terms(F.col("title"), F.array("skill_brand", F.upper("skill_brand"))), "|"))


@query("d1_iso_dates", "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS at, NULL::TIMESTAMP AS bad FROM orders")
def d1(spark, sf_dir):
    rows = star(spark, sf_dir, "orders")
    return rows.select("o_orderkey", S.iso_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("at"), S.iso_timestamp(F.concat(F.lit("x"), F.col("o_orderpriority"))).alias("bad"))


@query("d2_relative_dates", f"SELECT l_linenumber, l_quantity::INT AS q, TIMESTAMP '{AS_OF}' - INTERVAL (l_quantity::INT) DAY AS at FROM lineitem GROUP BY ALL")
def d2(spark, sf_dir):
    rows = star(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_quantity").cast("int").alias("q")).distinct()
    return rows.withColumn("at", S.relative_date(F.concat(F.lit("Publié il y a "), F.col("q"), F.lit(" jours")), as_of()))


@query("d3_yesterday", f"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN TIMESTAMP '{AS_OF}' WHEN 1 THEN TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY END AS at FROM orders")
def d3(spark, sf_dir):
    said = F.when(F.col("o_orderkey") % 3 == 0, "Aujourd'hui").when(F.col("o_orderkey") % 3 == 1, "Publié hier").otherwise("bientôt")
    return star(spark, sf_dir, "orders").select("o_orderkey", S.relative_date(said, as_of()).alias("at"))


@query("d4_day_first_dates", "SELECT o_orderkey, date_trunc('day', o_orderdate) AS at FROM orders")
def d4(spark, sf_dir):
    shown = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "dd-MM-yyyy"))
    return star(spark, sf_dir, "orders").select("o_orderkey", S.lenient_date(shown).alias("at"))


@query("d7_days_ago", WITH_OFFERS + f"SELECT source, greatest(0, date_diff('second', posted_at, TIMESTAMP '{AS_OF}') // 86400)::INT AS days, count(*) AS n FROM offers WHERE posted_at IS NOT NULL GROUP BY ALL")
def d7(spark, sf_dir):
    rows = offers(spark, sf_dir).where("posted_at is not null")
    return rows.groupBy("source", S.days_ago(F.col("posted_at"), as_of()).alias("days")).agg(F.count(F.lit(1)).alias("n"))


_MONTHS = "[" + ", ".join(quoted(m) for m in S.MONTHS) + "]"


@query("d8_french_dates", f"SELECT o_orderkey, concat(day(o_orderdate), ' ', ({_MONTHS})[month(o_orderdate)], ' ', year(o_orderdate)) AS shown FROM orders")
def d8(spark, sf_dir):
    return star(spark, sf_dir, "orders").select("o_orderkey", S.french_date(F.date_trunc("day", "o_orderdate")).alias("shown"))


@query("d9_schedule", "SELECT o_orderkey, date_trunc('day', o_orderdate) + INTERVAL 8 HOUR + INTERVAL 30 MINUTE AS due FROM orders")
def d9(spark, sf_dir):
    return star(spark, sf_dir, "orders").select("o_orderkey", S.schedule_instant(F.date_trunc("day", "o_orderdate"), 8, 30, "UTC").alias("due"))


@query("m2_nearest_radius", "SELECT DISTINCT p_size, CASE WHEN p_size <= 7 THEN 5 WHEN p_size <= 17 THEN 10 WHEN p_size <= 37 THEN 25 WHEN p_size <= 75 THEN 50 ELSE 100 END AS radius FROM part")
def m2(spark, sf_dir):
    return star(spark, sf_dir, "part").select("p_size", S.nearest_radius(F.col("p_size")).alias("radius")).distinct()


@query("m3_occurrences", "SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS n FROM documents")
def m3(spark, sf_dir):
    return star(spark, sf_dir, "documents").select("doc_id", S.occurrences(F.col("text"), "the").cast("bigint").alias("n"))


@query("p2_text_salary", "SELECT p_partkey, floor(p_retailprice) AS low, floor(p_retailprice * 1.5) AS high, 'EUR' AS currency FROM part")
def p2(spark, sf_dir):
    shown = F.concat(F.floor("p_retailprice"), F.lit(" à "), F.floor(F.col("p_retailprice") * 1.5), F.lit(" € par an"))
    return star(spark, sf_dir, "part").select("p_partkey", S.text_salary(shown).alias("s")).select("p_partkey", "s.low", "s.high", "s.currency")


@query("p3_numbers", "SELECT p_partkey, round(p_retailprice, 2) AS value FROM part")
def p3(spark, sf_dir):
    shown = F.replace(F.replace(F.format_number("p_retailprice", 2), F.lit(","), F.lit(" ")), F.lit("."), F.lit(","))
    return star(spark, sf_dir, "part").select("p_partkey", S.number(shown).alias("value"))


@query("p6_has_salary", WITH_LISTINGS + "SELECT source, count(*) FILTER (salary_max IS NOT NULL) AS n FROM listings GROUP BY 1")
def p6(spark, sf_dir):
    has = S.has_salary(F.lit(None).cast("double"), F.col("salary_max"), F.lit("EUR"))
    return listings(spark, sf_dir).groupBy("source").agg(F.count_if(has).alias("n"))


@query("a1_split_list", "SELECT p_partkey, lower(p_type) AS a, lower(p_brand) AS b FROM part")
def a1(spark, sf_dir):
    items = S.split_list(F.concat(F.lower("p_type"), F.lit(" ;, "), F.lower("p_brand"), F.lit(" \n")))
    return star(spark, sf_dir, "part").select("p_partkey", items[0].alias("a"), items[1].alias("b"))


@query("a2_stable_union", "SELECT p_partkey, concat(p_type, '|', p_brand) AS items FROM part")
def a2(spark, sf_dir):
    union = S.stable_union(F.array("p_type", "p_brand"), F.array(F.upper("p_brand"), F.lower("p_type")))
    return star(spark, sf_dir, "part").select("p_partkey", F.array_join(union, "|").alias("items"))


@query("a3_contains_all", WITH_OFFERS + "SELECT skill_type, skill_brand, count(*) AS n FROM offers WHERE skill_brand = 'brand#11' GROUP BY ALL")
def a3(spark, sf_dir):
    rows = offers(spark, sf_dir).where(S.contains_all(F.array("skill_type", "skill_brand"), [" Brand#11 "]))
    return rows.groupBy("skill_type", "skill_brand").agg(F.count(F.lit(1)).alias("n"))


@query("a4_contains_any", WITH_OFFERS + "SELECT skill_brand, count(*) AS n FROM offers WHERE skill_brand IN ('brand#11', 'brand#12') GROUP BY ALL")
def a4(spark, sf_dir):
    rows = offers(spark, sf_dir).where(S.contains_any(F.array("skill_type", "skill_brand"), ["BRAND#11", "brand#12"]))
    return rows.groupBy("skill_brand").agg(F.count(F.lit(1)).alias("n"))


@query("p5_salary_label", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat(format('{:,}', round(p_retailprice)::BIGINT), ' - ', format('{:,}', round(p_retailprice * 2)::BIGINT), ' EUR') WHEN 1 THEN concat('from ', format('{:,}', round(p_retailprice)::BIGINT), ' EUR') WHEN 2 THEN concat('up to ', format('{:,}', round(p_retailprice * 2)::BIGINT), ' EUR') END AS label FROM part")
def p5(spark, sf_dir):
    kind = F.col("p_partkey") % 4
    low, high = F.when(kind.isin(0, 1, 3), F.round("p_retailprice")), F.when(kind.isin(0, 2, 3), F.round(F.col("p_retailprice") * 2))
    return star(spark, sf_dir, "part").select("p_partkey", S.salary_label(low, high, F.when(kind == 3, "euro").otherwise("EUR")).alias("label"))
