"""Keys, dates, salaries and lists on cases that matter."""

import datetime as dt
import unicodedata

import pytest
from pyspark.sql import functions as F

from offerloom.functions import scalars as S
from offerloom.functions import text as T
from offerloom.operators import places as P


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_keys(spark):
    values = ["Développeur·se H/F", "SAS Institute S.A.S.", "Société Anonyme", "Straße ﬁn", "Chef (75)", "Lyon - 69", "Œuvre", None, "", "Data F - H Engineer SARL SAS"]
    assert column(spark, values, T.text_key) == ["developpeur se", "sas institute", "", "strasse fin", "chef", "lyon", "uvre", None, "", "data engineer"]


def test_locations(spark):
    values = ["France", "Paris, France", "Île-de-France", "Paris (75)", "Marseille 13", "Lyon – France", "Nantes (France)"]
    assert column(spark, values, T.location_key) == ["france", "paris", "ile de france", "paris", "marseille", "lyon", "nantes"]
    values = ["Lyon 7ème arrondissement - 69", "Paris 75", "Paris 3e", "Paris 21e", "Brest"]
    keys = column(spark, values, P.city_key)
    assert keys == ["lyon 7", "paris", "paris 3", "paris 21", "brest"]
    assert column(spark, keys, P.municipality) == ["lyon", "paris", "paris", "paris 21", "brest"]


@pytest.mark.parametrize(
    ("label", "kind", "key"),
    [
        ("Paris (75)", "place", "paris"),
        ("France", "non_city", "france"),
        ("Île-de-France", "non_city", "ile de france"),
        ("Télétravail", "unknown", ""),
        ("Paris / télétravail", "place", "paris"),
        ("Télétravail à Paris", "place", "paris"),
        ("Remote Paris", "unknown", ""),
        ("Non spécifié", "unknown", ""),
        ("Paris, Bretagne", "conflict", ""),
        ("Paris, Lyon", "unknown", ""),
        ("Marseille, France", "place", "marseille"),
        ("Paris, France, Lyon", "conflict", ""),
        (None, "unknown", ""),
        ("Lyon - 2 jours/semaine télétravail", "place", "lyon"),
    ],
)
def test_location_evidence(spark, label, kind, key):
    got = P.evidence(spark.createDataFrame([(label,)], "location string")).first()
    assert (got.kind, got.key) == (kind, key)


def test_seniority_and_masks(spark):
    assert column(spark, ["Senior Lead", "Sr Dev", "Dev", "Stage"], lambda c: T.seniority(c, F.lit("junior"))) == [4, 3, 1, 1]
    assert column(spark, ["***", "a*b", "abcdef*", ""], T.masked) == [True, True, False, True]
    assert column(spark, ["N/C", "Confidentiel", "Non précisé", "ACME", ""], T.explicit_company) == [False, False, False, True, False]


def test_dates(spark):
    now = F.to_timestamp(F.lit("2024-05-10 12:00:00"))
    values = ["il y a 2 jours", "3 weeks ago", "Aujourd'hui", "hier", "il y a 5 min", "1 mois", "rien", None, "fichier"]
    day = lambda *a: dt.datetime(2024, *a)
    assert column(spark, values, lambda c: S.relative_date(c, now)) == [day(5, 8, 12), day(4, 19, 12), day(5, 10, 12), day(5, 9, 12), day(5, 10, 11, 55), day(4, 10, 12), None, None, day(5, 9, 12)]
    assert column(spark, ["fichier"], lambda c: S.relative_date(c, now, word_bounded=True)) == [None]
    assert column(spark, ["2024-01-02", "02/01/2024", "02-01-2024", "x"], S.lenient_date) == [dt.datetime(2024, 1, 2)] * 3 + [None]
    overlap = S.schedule_instant(F.to_timestamp(F.lit("2026-10-25 12:00:00")), 2, 30)
    assert spark.range(1).select(overlap.alias("x")).first().x == dt.datetime(2026, 10, 25, 0, 30)
    assert column(spark, ["2024-08-01 23:30:00"], lambda c: S.french_date(F.to_timestamp(c))) == ["2 août 2024"]


def test_salaries(spark):
    got = column(spark, ["38 000 € - 45 000,50 €", "USD 10", "rien"], S.text_salary)
    assert [tuple(g) for g in got] == [(38000.0, 45000.5, "EUR"), (10.0, None, "USD"), (None, None, None)]
    assert column(spark, ["1 234,5", "x"], S.number) == [1234.5, None]


def test_lists(spark):
    assert column(spark, ["a, b;;\nc "], S.split_list) == [["a", "b", "c"]]
    assert column(spark, ["Python"], lambda c: S.stable_union(F.array(c, F.lit("SQL")), F.array(F.lit("sql "), F.lit("Go")))) == [["Python", "SQL", "Go"]]
    assert column(spark, ["Python"], lambda c: S.contains_all(F.array(c), [])) == [False]
    assert column(spark, ["dev"], lambda c: T.query_terms(c, F.array(F.lit("spark"), F.lit("SPARK "), F.lit("")))) == [["dev", "dev spark"]]


def test_urls_and_ids(spark):
    values = ["https://www.example.com/jobs/1/", "http://www.example.com/jobs/1", "https://evil.com/jobs/1", "https://www.example.com/jobs/1?x=1"]
    assert column(spark, values, lambda c: T.canonical_url(c, ("www.example.com",), "^/jobs/[0-9]+$")) == ["https://www.example.com/jobs/1", None, None, None]
    assert column(spark, ["tags-freework_9", "a b", "x-1"], lambda c: T.clean_external_id(c, "freework")) == ["9", None, "x-1"]


def test_fold_agrees_with_unicode(spark):
    """Every character of the scripts that are folded, as decomposition, no marks and case folding make it."""
    codes = [c for c in [*range(0x20, 0x530), *range(0x1E00, 0x1F00)] if c != 0x34F and unicodedata.category(chr(c)) not in ("Cn", "Cc", "Me")]
    rows = spark.createDataFrame([(c, f"a{chr(c)}b") for c in codes], "c int, s string").select("c", T.fold(F.col("s")).alias("f")).collect()
    want = lambda c: "".join(x for x in unicodedata.normalize("NFKD", f"a{chr(c)}b") if not unicodedata.combining(x)).casefold()
    assert {chr(r.c): r.f for r in rows if r.f != want(r.c)} == {}
