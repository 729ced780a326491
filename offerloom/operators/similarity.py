"""T17 as a join: the pairs of a company's titles whose similarity is a threshold or more, without comparing all of them.

The similarity of two titles is 2 * M / (la + lb), with M letters in k matching blocks. Between two blocks stands a letter that does
not match, so k - 1 <= la + lb - 2 * M, and as a block of n letters holds n - 1 pairs of neighbouring letters, the titles share at
least M - k >= 3 * M - (la + lb) - 1 of these. A threshold t thus asks for (1.5 * t - 1) * (la + lb) - 1 shared pairs of letters. Pairs of letters,
each with its number among equal ones, are put in order of rarity; what shares so many has one of the first few of each in
common. So titles meet by company and pair of letters, never by company alone, and only what shares enough is compared letter by letter.
Where companies share their titles, a pair of letters that few different titles have is met once for all companies.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerloom.session import grown, shared_table

SLACK = 1e-9
#: Longs in a title's mask of tokens.
MASKS = 4


def _letters(keys: pd.Series) -> np.ndarray:
    """How often each byte value (modulo 64) occurs in each key; at most so many letters can match between two."""
    raw = [k.encode() for k in keys]
    owner = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
    value = np.frombuffer(b"".join(raw), np.uint8) & 63
    return np.bincount(owner * 64 + value, minlength=len(raw) * 64).reshape(-1, 64)


def ratio_udf(least: float):
    """The similarity of two keys, or null where their letters alone show that it is below `least`."""

    @F.pandas_udf(T.DoubleType())
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        bound = 2 * np.minimum(_letters(left), _letters(right)).sum(1) / np.maximum(1, [len(a.encode()) + len(b.encode()) for a, b in zip(left, right, strict=True)])
        return pd.Series([SequenceMatcher(None, a, b).ratio() if most >= least else None for a, b, most in zip(left, right, bound, strict=True)], dtype="float64")

    return ratio


def title_scores(pairs: DataFrame, least: float) -> DataFrame:
    """The distinct (a, b) keys, a <= b, whose similarity is `least` or more, with it. Only what lengths and letters allow is compared."""
    pairs = pairs.select("a", "b").distinct()
    bound = 2 * F.least(F.length("a"), F.length("b")) / F.greatest(F.length("a") + F.length("b"), F.lit(1))
    equal = pairs.where("a = b").withColumn("score", F.lit(1.0))
    near = pairs.where((F.col("a") != F.col("b")) & (bound >= least)).withColumn("score", ratio_udf(least)("a", "b")).where(F.col("score") >= least)
    return equal.unionByName(near)


def _pairs_of_letters(title: Column) -> Column:
    """Each pair of neighbouring letters with its number among equal ones."""
    found = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(title) - 1), lambda i: F.substring(title, i, F.lit(2))))
    return F.transform(found, lambda c, i: F.concat(c, (i - F.array_position(found, c)).cast("string")))


def title_tokens(titles: DataFrame) -> DataFrame:
    """(title_key, size, tokens) of distinct titles, the rarest tokens of all first; titles of one letter have none."""
    tokens = F.when(F.length("title_key") > 1, _pairs_of_letters(F.col("title_key"))).otherwise(F.array().cast("array<string>"))
    rows = shared_table(titles.select("title_key").distinct().withColumn("tokens", tokens), "tokens")
    each = rows.select("title_key", F.explode("tokens").alias("token"))
    ranked = each.join(each.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token").groupBy("title_key").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t"))
    return rows.select("title_key", F.length("title_key").alias("size")).join(ranked, "title_key", "left").select("title_key", "size", F.coalesce(F.col("t.token"), F.array().cast("array<string>")).alias("tokens"))


def similar_titles(units: DataFrame, least: float) -> DataFrame:
    """(company_key, a, b, score) of the different titles a < b of a company whose similarity is `least` or more.

    `units` has company_key and title_key; repeated rows do not matter. Titles too short to have to share a pair of letters meet
    each other directly; there are few of so few letters.
    """
    share = 1.5 * least - 1
    if share <= 0:
        raise ValueError("the bound holds for thresholds over two thirds")
    units = shared_table(units.select("company_key", "title_key").distinct(), "units")
    tokens = title_tokens(units)
    bits = tokens.select("title_key", F.explode("tokens").alias("token")).withColumn("bit", F.pmod(F.hash("token"), F.lit(64 * MASKS))).groupBy("title_key").agg(*[F.bit_or(F.when(F.expr(f"bit div 64 = {i}"), F.expr("shiftleft(1L, bit % 64)")).otherwise(0)).alias(f"mask{i}") for i in range(MASKS)])
    masks = [f"mask{i}" for i in range(MASKS)]
    held = units.groupBy("title_key").agg(F.count(F.lit(1)).alias("companies"))
    tokens = shared_table(tokens.join(bits, "title_key", "left").fillna(0, masks).join(held, "title_key"), "letters")
    shortest = F.col("size") * (1 + least / (2 - least))  # with the shortest title that can still be near enough
    need = F.greatest(F.lit(1), F.ceil(share * shortest - 1 - SLACK))
    prefix = F.slice("tokens", 1, F.greatest(F.lit(0), (F.size("tokens") - need + 1).cast("int")))
    tiny = F.when(share * (F.col("size") + 1) - 1 - SLACK <= 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    lost = F.size("tokens") - sum(F.bit_count(m) for m in masks)  # tokens that share their bit with another one
    each = tokens.withColumn("lost", lost).select("title_key", "companies", "size", "lost", *masks, F.explode(F.concat(tiny, prefix)).alias("token"))
    # a token whose titles are no more, squared, than its rows in all companies is met without companies
    once = each.groupBy("token").agg((F.count(F.lit(1)) * F.count(F.lit(1)) <= F.sum("companies")).alias("once"))
    each = shared_table(each.join(once, "token").drop("companies"), "prefixes")
    side = lambda rows, x, keys: rows.select(*keys, *[F.col(c).alias(f"{x}_{c}") for c in ("title_key", "size", "lost", *masks)])
    both = F.col("a_size") + F.col("b_size")
    long_enough = (F.col("a_title_key") < F.col("b_title_key")) & (2 * F.least("a_size", "b_size") >= least * both - SLACK)
    most = sum(F.bit_count(F.col(f"a_{m}").bitwiseAND(F.col(f"b_{m}"))) for m in masks) + F.least("a_lost", "b_lost")  # at most so many tokens are common

    def meet(rows: DataFrame, *keys: str) -> DataFrame:
        met = side(rows, "a", keys).join(side(rows, "b", keys), list(keys)).where(long_enough & (most >= share * both - 1 - SLACK))
        return met.select(F.col("a_title_key").alias("a"), F.col("b_title_key").alias("b"))

    met = meet(each.where("once"), "token").unionByName(meet(units.join(each.where("not once"), "title_key"), "company_key", "token"))
    met = shared_table(met.distinct(), "met-titles")
    of = lambda x: tokens.select(F.col("title_key").alias(x), F.col("tokens").alias(f"{x}_tokens"), F.col("companies").alias(f"{x}_companies"))
    pairs = met.join(of("a"), "a").join(of("b"), "b")
    common = F.size(F.array_intersect("a_tokens", "b_tokens")) >= share * (F.length("a") + F.length("b")) - 1 - SLACK
    rarer = F.col("a_companies") <= F.col("b_companies")
    scored = title_scores(pairs.where(common), least).join(pairs.select("a", "b", rarer.alias("rarer")), ["a", "b"])
    # from the title of fewer companies to the other one
    scored = shared_table(scored.select("a", "b", "score", F.when(F.col("rarer"), F.col("a")).otherwise(F.col("b")).alias("title_key"), F.when(F.col("rarer"), F.col("b")).otherwise(F.col("a")).alias("other")), "scores")
    return units.join(scored, "title_key").drop("title_key").join(grown(units.withColumnRenamed("title_key", "other")), ["company_key", "other"]).select("company_key", "a", "b", "score")


def components(edges: DataFrame) -> DataFrame:
    """(company_key, title_key, component): the smallest title that a title of the pairs (company_key, a, b) is joined to, step by step.

    Every round takes the smallest label of the neighbours and then that label's own label; each is written, and the rounds end when
    nothing changes, after about the logarithm of the longest chain."""
    both = edges.select("company_key", "a", "b").unionByName(edges.select("company_key", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = shared_table(both, "title-edges")
    labels = shared_table(both.groupBy("company_key", F.col("a").alias("title_key")).agg(F.least("a", F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(grown(labels.withColumnRenamed("title_key", "b")), ["company_key", "b"]).groupBy("company_key", F.col("a").alias("title_key")).agg(F.min("component").alias("near"))
        step = labels.join(grown(near), ["company_key", "title_key"]).select("company_key", "title_key", F.least("component", "near").alias("up"), F.col("component").alias("was"))
        jump = labels.select("company_key", F.col("title_key").alias("up"), F.col("component").alias("over"))
        step = step.join(grown(jump), ["company_key", "up"]).select("company_key", "title_key", F.least("up", "over").alias("component"), "was")
        step = shared_table(step, "labels")
        labels = step.drop("was")
        if step.where("component <> was").isEmpty():
            return labels
