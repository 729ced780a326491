"""Landed result pages to offers: JSON by schemas, JSON-LD by variants; HTML is in cards."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.functions.scalars import iso_timestamp, stated_minimum
from offerloom.functions.text import has_text
from offerloom.sources import cards

BOARD_PAGE = "results array<struct<id string, title string, company struct<display_name string>, location struct<display_name string>, redirect_url string, description string, contract_type string, created string, salary_min double, salary_max double>>, count long"
INDEX_PAGE = "hits array<struct<reference string, objectID string, name string, organization struct<name string, slug string>, offices array<struct<city string, country string>>, slug string, summary string, contract_type string, remote string, published_at string, salary_minimum double, salary_yearly_minimum double, salary_maximum double, experience_level_minimum double>>, nbHits long, nbPages long"
#: Contract codes of the search index, and labels on the cards.
INDEX_CONTRACTS = {"full_time": "cdi", "temporary": "cdd", "internship": "stage", "apprenticeship": "alternance", "freelance": "freelance", "part_time": "cdi", "vie": "other", "other": "other"}
URL = r"^https?://[^\s/?#]+"


def _lookup(c, values: dict[str, str]):
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def board_offers(pages: DataFrame) -> DataFrame:
    """The job board's API pages (column body). Rows without id, title, company or a URL go; a page that is no such JSON has no rows."""
    r = pages.select(F.explode(F.from_json("body", BOARD_PAGE)["results"]).alias("r"))
    rows = r.select(
        F.concat(F.lit("adzuna_"), F.col("r.id")).alias("external_id"),
        F.lit("adzuna").alias("source"),
        F.col("r.redirect_url").alias("url"),
        F.col("r.title").alias("title"),
        F.col("r.company.display_name").alias("company"),
        F.coalesce(F.nullif(F.col("r.location.display_name"), F.lit("")), F.lit("France")).alias("location"),
        F.col("r.description").alias("description"),
        _lookup(F.col("r.contract_type"), {"permanent": "cdi", "contract": "cdd"}).alias("contract_type"),
        F.lit(None).cast("string").alias("experience_level"),
        F.lit(None).cast("boolean").alias("remote"),
        F.col("r.salary_min").alias("salary_min"),
        F.col("r.salary_max").alias("salary_max"),
        iso_timestamp(F.col("r.created")).alias("posted_at"),
    )
    return rows.where(has_text(F.col("external_id")) & has_text(F.col("title")) & has_text(F.col("company")) & F.col("url").rlike(URL))


def index_offers(pages: DataFrame) -> DataFrame:
    """The search index's pages. A salary minimum of 0 counts as missing; rows without a name or the two slugs go."""
    h = pages.select(F.explode(F.from_json("body", INDEX_PAGE)["hits"]).alias("h"))
    office = F.try_element_at("h.offices", F.lit(1))
    place = F.coalesce(F.nullif(F.concat_ws(", ", F.nullif(office["city"], F.lit("")), F.nullif(office["country"], F.lit(""))), F.lit("")), F.lit("France"))
    years = F.col("h.experience_level_minimum")
    rows = h.select(
        F.concat(F.lit("wttj_"), F.coalesce("h.reference", "h.objectID")).alias("external_id"),
        F.lit("wttj").alias("source"),
        F.concat(F.lit("https://www.welcometothejungle.com/fr/companies/"), F.nullif(F.col("h.organization.slug"), F.lit("")), F.lit("/jobs/"), F.nullif(F.col("h.slug"), F.lit(""))).alias("url"),
        F.col("h.name").alias("title"),
        F.coalesce(F.nullif(F.col("h.organization.name"), F.lit("")), F.lit("Non spécifié")).alias("company"),
        place.alias("location"),
        F.col("h.summary").alias("description"),
        _lookup(F.lower("h.contract_type"), INDEX_CONTRACTS).alias("contract_type"),
        F.when(years <= 1, "junior").when(years <= 3, "mid").when(years <= 6, "senior").when(years.isNotNull(), "lead").alias("experience_level"),
        F.col("h.remote").isin("fulltime", "partial").alias("remote"),
        F.coalesce(F.nullif(F.col("h.salary_minimum"), F.lit(0.0)), F.nullif(F.col("h.salary_yearly_minimum"), F.lit(0.0))).alias("salary_min"),
        F.col("h.salary_maximum").alias("salary_max"),
        iso_timestamp(F.col("h.published_at")).alias("posted_at"),
    )
    return rows.where(has_text(F.col("external_id")) & has_text(F.col("title")) & F.col("url").isNotNull())


def json_ld(pages: DataFrame, body: str = "html", any_depth: bool = False) -> DataFrame:
    """(page_id, posting variant) of the JobPosting objects in ld+json blocks, at the top, in a list or in @graph; or at any
    depth, which takes a walk in Python and gives objects that tell the same once."""
    if any_depth:
        found = cards.structured_jobs(pages.select("page_id", F.col(body).alias("html"))).where("rank = 1")
        return found.select("page_id", F.try_parse_json("job").alias("posting"))
    blocks = F.regexp_extract_all(body, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    rows = pages.select("page_id", F.explode(blocks).alias("b")).select("page_id", F.try_parse_json("b").alias("v")).where("v is not null")
    listed = F.coalesce(F.expr("try_variant_get(v, '$.@graph', 'array<variant>')"), F.expr("try_variant_get(v, '$', 'array<variant>')"), F.array("v"))
    items = rows.select("page_id", F.explode(listed).alias("posting"))
    kind = F.coalesce(F.expr("try_variant_get(posting, '$.@type', 'array<string>')"), F.array(F.expr("try_variant_get(posting, '$.@type', 'string')")))
    return items.where(F.array_contains(kind, "JobPosting"))


def details(postings: DataFrame, shown: DataFrame | None = None, zero_is_missing: bool = False) -> DataFrame:
    """Detail snapshots of postings; they need a title and a description or a salary bound. A text is a string that is
    not blank, or a list of one such; objects, numbers and longer lists are none.

    `shown` has what the pages show (page_id, title, company, location, description, skills, and salary_text), which stands in field by
    field for what a posting lacks, or for the posting; a minimum is then the first amount in euros (P4). Where
    `zero_is_missing`, a minimum of 0 gives way to the single value. Values that are no numbers, such as booleans, are none.
    """
    get = lambda path, kind="string": F.expr(f"try_variant_get(posting, '{path}', '{kind}')")
    number_ = lambda path: F.when(F.expr(f"schema_of_variant(try_variant_get(posting, '{path}', 'variant'))") != "BOOLEAN", get(path, "double"))

    def said(path: str) -> Column:
        kind = F.expr(f"schema_of_variant(try_variant_get(posting, '{path}', 'variant'))")
        one = F.when(kind == "STRING", get(path)).when((kind == "ARRAY<STRING>") & (F.size(get(path, "array<string>")) == 1), F.try_element_at(get(path, "array<string>"), F.lit(1)))
        return F.nullif(F.btrim(one, F.lit(" \t\r\n")), F.lit(""))

    least = number_("$.baseSalary.value.minValue")
    least = F.nullif(least, F.lit(0.0)) if zero_is_missing else least
    postal, town = said("$.jobLocation.address.postalCode"), said("$.jobLocation.address.addressLocality")
    rows = postings.select(
        "page_id",
        said("$.title").alias("title"),
        said("$.hiringOrganization.name").alias("company"),
        F.when(postal.isNotNull(), F.concat(town, F.lit(" ("), postal, F.lit(")"))).otherwise(town).alias("location"),
        said("$.description").alias("description"),
        F.coalesce(least, number_("$.baseSalary.value.value")).alias("salary_min"),
        number_("$.baseSalary.value.maxValue").alias("salary_max"),
        said("$.baseSalary.currency").alias("salary_currency"),
        F.coalesce(get("$.skills", "array<string>"), F.split(get("$.skills"), r"\s*,\s*")).alias("skills"),
        iso_timestamp(get("$.datePosted")).alias("posted_at"),
    )
    if shown is not None:
        texts = ("title", "company", "location", "description")
        page = shown.select("page_id", *[F.nullif(F.btrim(c), F.lit("")).alias(f"shown_{c}") for c in texts], F.col("skills").alias("shown_skills"), stated_minimum(F.col("salary_text")).alias("shown_min"))
        rows = rows.join(page, "page_id", "full").withColumns({c: F.coalesce(F.nullif(F.btrim(c), F.lit("")), f"shown_{c}") for c in texts} | {"skills": F.coalesce("skills", "shown_skills"), "salary_min": F.coalesce("salary_min", "shown_min")})
        rows = rows.select("page_id", *texts, "salary_min", "salary_max", "salary_currency", "skills", "posted_at")
    return rows.where(has_text(F.col("title")) & (has_text(F.col("description")) | F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()))


#: A parser for each source, from its landed pages to offers.
PARSERS: dict[str, Callable[..., DataFrame]] = {
    "linkedin": cards.card_offers_a,
    "hellowork": cards.card_offers_b,
    "francetravail": cards.card_offers_c,
    "wttj": lambda pages, as_of: index_offers(pages),
    "adzuna": lambda pages, as_of: board_offers(pages),
    "freework": lambda pages, as_of: cards.card_offers_d(pages),
}


def union_of_sources(frames: list[DataFrame]) -> DataFrame:
    """S9, L1."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_board_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed API pages as whole files, one row each, for board_offers and index_offers."""
    return spark.read.option("wholetext", True).text(path).withColumnRenamed("value", "body")
