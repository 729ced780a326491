"""Data quality: rules as columns, violations as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from offerloom.functions.text import has_text
from offerloom.functions.values import METROPOLES, METROPOLES_DATE, METROPOLES_LIST, METROPOLES_PAGE, SOURCES

CONTRACTS = ("cdi", "cdd", "interim", "stage", "alternance", "freelance", "other")
LEVELS = ("internship", "junior", "mid", "senior", "lead", "director")


def reasons(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks; a rule without an answer is broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))


def checked_offers(offers: DataFrame, scanned: str | None = None) -> DataFrame:
    """Q2: add reasons and valid. F18: an offer of another source than the scanned one (a column's name) is not valid."""
    optional = lambda c, domain: F.col(c).isNull() | F.col(c).isin(*domain)
    rules = {
        "source": F.col("source").isin(*SOURCES),
        "external_id": has_text(F.col("external_id")),
        "title": has_text(F.col("title")),
        "company": has_text(F.col("company")),
        "url": F.col("url").rlike(r"^https?://[^\s/]+"),
        "contract_type": optional("contract_type", CONTRACTS),
        "experience_level": optional("experience_level", LEVELS),
    }
    if scanned is not None:
        rules["scanned"] = F.col("source") == F.col(scanned)
    rows = offers.withColumn("reasons", reasons(rules))
    return rows.withColumn("valid", F.size("reasons") == 0)


def store_checked(rows: DataFrame, path: str, rules: tuple[str, ...]) -> dict[str, int]:
    """Q2: write checked rows in one job, the good ones under valid=true and the rejected ones with their reasons under valid=false, and return
    what was observed on the way: offers, valid, and how many broke each of `rules`. Nothing is counted by reading again."""
    seen = Observation("checked")
    broken = [F.count_if(F.array_contains("reasons", rule)).alias(rule) for rule in rules]
    rows.observe(seen, F.count(F.lit(1)).alias("offers"), F.count_if("valid").alias("valid"), *broken).write.partitionBy("valid").parquet(path)
    return seen.get


def checked_searches(searches: DataFrame) -> DataFrame:
    """Q3, Q4: rules are flags, so older rows with repeats or unknown values stay readable."""
    rules = {
        "name": has_text(F.col("name")) & (F.length("name") <= 200),
        "keywords": F.size("keywords") >= 1,
        "radius_km": F.col("radius_km").isNull() | (F.col("radius_km") >= 1),
        "salary_min": F.col("salary_min").isNull() | (F.col("salary_min") >= 0),
        "max_results": F.col("max_results").between(1, 1000),
        "sources": (F.size("sources") >= 1) & (F.size(F.array_distinct("sources")) == F.size("sources")) & (F.size(F.array_except("sources", F.array(*[F.lit(s) for s in SOURCES]))) == 0),
    }
    rows = searches.withColumn("reasons", reasons(rules))
    return rows.withColumn("valid", F.size("reasons") == 0)


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Q5: keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def misordered_edges(edges: DataFrame) -> DataFrame:
    """Q5: edges that are not from a smaller to a larger id."""
    return edges.where("left_id >= right_id")


def area_violations(areas: DataFrame) -> DataFrame:
    """Q7: (rule, area) of a table (area, center, alias_list, commune_codes, commune_names) that breaks a rule."""
    name = F.col("center")
    rules = {
        "aliases_repeat": F.size(F.array_distinct("alias_list")) == F.size("alias_list"),
        "codes_repeat": F.size(F.array_distinct("commune_codes")) == F.size("commune_codes"),
        "names_repeat": F.size(F.array_distinct("commune_names")) == F.size("commune_names"),
        "code_form": F.forall("commune_codes", lambda c: c.rlike(r"^(?:\d{5}|2[AB]\d{3})$")),
        "center_in_aliases": F.array_contains("alias_list", name),
        "center_in_communes": F.array_contains("commune_names", name),
    }
    return areas.select("area", F.explode(reasons(rules)).alias("rule"))


def area_file_violations(areas: DataFrame) -> DataFrame:
    """Q7: (area, rule) of all that is wrong with a full area file, as read_areas gives it: the rules of each group by itself, what is expected of the
    areas that are known, and what only shows between groups (an area given twice or not at all, an alias of several areas).

    Nothing stops at a first fault, and an absent value breaks its rule. An area without a key has the area null. Rules of an
    unknown area's size, code and addresses have nothing to compare with and are left out.
    """
    expected = areas.sparkSession.createDataFrame(
        [(key, n, code, METROPOLES_PAGE.get(key, METROPOLES_LIST.format(code)), METROPOLES_LIST.format(code)) for key, (n, code) in METROPOLES.items()],
        "known string, communes int, code string, page string, machine string",
    )
    rows = areas.join(F.broadcast(expected), F.col("area") == F.col("known"), "left")
    foreign = F.col("known").isNull()
    texts = lambda c: F.forall(c, lambda x: has_text(x))
    rules = {
        "reference_date": F.col("reference_date") == METROPOLES_DATE,
        "unknown_area": ~foreign,
        "official_name": has_text(F.col("official_name")),
        "epci_code": foreign | (F.col("epci_code") == F.col("code")),
        "source_url": foreign | (F.col("source_url") == F.col("page")),
        "machine_url": foreign | (F.col("machine_readable_source_url") == F.col("machine")),
        "commune_count": foreign | (F.size("commune_codes") == F.col("communes")),
        "aliases": (F.size("alias_list") > 0) & texts("alias_list"),
        "commune_names": texts("commune_names"),
    }
    inside = rows.select("area", F.explode(reasons(rules)).alias("rule"))
    twice = repeated_keys(areas, "area").select("area", F.lit("area_repeats").alias("rule"))
    absent = expected.join(areas, F.col("area") == F.col("known"), "left_anti").select(F.col("known").alias("area"), F.lit("missing").alias("rule"))
    named = areas.select("area", F.explode(F.array_distinct("alias_list")).alias("alias"))
    shared = named.groupBy("alias").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = named.join(shared, "alias", "left_semi").select("area", F.lit("alias_of_several").alias("rule")).distinct()
    return area_violations(areas).unionByName(inside).unionByName(twice).unionByName(absent).unionByName(shared)
