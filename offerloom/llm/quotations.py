"""Conversations in reply order, by linking quotations to the messages they come from.

Lines that begin with ">" are quoted, as deeply as they have such marks. The quoted text of each level is cut into passages: its
lines, and its sentences with line ends inside them as blanks, so that quotes that were wrapped anew still meet; long ones
become overlapping windows of WINDOW words. Passages are normalised and hashed, and a hash meets the own passages (without
quoted lines and the credits above them) of earlier messages of the same conversation. A quoted passage of fewer words than a
window, but SHORT or more, that is no earlier passage whole is looked for inside longer ones: of the messages of a conversation,
runs of just those numbers of words are hashed that its quotations have. The message from which most quoted
characters come, at the lowest level that matches any, is what a message replies to; one without a matching quotation
follows the message before it. Replies come right after what they reply to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import shared_table

MARKS = r"^[ \t]{0,3}(?:>[ \t]?)+"
#: Words of a passage at most; longer ones are cut into overlapping windows of so many.
WINDOW = 8
#: Words that a quoted passage needs to be found inside a longer line or sentence.
SHORT = 3
#: Turns that a task puts in order at a time.
SPAN = 256


def line_levels(text: Column) -> Column:
    """An array of (level, line) of the lines of a text, marks and carriage returns removed; empty for a null text."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), "[^>]", ""))
    return F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("line")))


def _words(lines: Column) -> Column:
    """The words (lower case, letters and digits) of each distinct line and each distinct sentence of an array of lines."""
    whole = F.split(F.array_join(lines, " "), r"(?<=[.!?])\s+")
    plain = F.transform(F.concat(lines, whole), lambda s: F.btrim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " ")))
    return F.transform(F.array_distinct(F.filter(plain, lambda s: F.length(s) > 0)), lambda s: F.split(s, " "))


def _runs(words: Column, n: Column) -> Column:
    """All runs of n words, or the whole of what has fewer."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda i: F.array_join(F.slice(words, i, n), " "))


def passages(lines: Column) -> Column:
    """The distinct normalised passages of an array of lines."""
    return F.array_distinct(F.flatten(F.transform(_words(lines), lambda w: _runs(w, F.lit(WINDOW)))))


def parts(lines: Column, lengths: Column) -> Column:
    """The distinct runs of so many words, for each of `lengths`, out of the longer lines and sentences of an array of lines."""
    longer = lambda n: F.filter(_words(lines), lambda w: F.size(w) > n)
    return F.array_distinct(F.flatten(F.transform(lengths, lambda n: F.flatten(F.transform(longer(n), lambda w: _runs(w, n))))))


def without_quotes(text: Column) -> Column:
    """The text without quoted lines and the credits above them; null stays null."""
    kept = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(?im)^[^>\n]{0,200}\b(wrote|schrieb|a écrit|escribió)[ \t]*:[ \t]*\n(?=[ \t]{0,3}>)", "")
    kept = F.regexp_replace(kept, r"(?m)^[ \t]{0,3}>[^\n]*\n?", "")
    return F.when(text.rlike(r"(?m)^[ \t]{0,3}>"), F.btrim(kept, F.lit("\n "))).otherwise(text)


def quotation_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, origin): the earlier turn that a message quotes most, for messages with a matching quotation."""
    rows = messages.where(F.col("turn").isNotNull()).select("conv_id", "turn", "text", F.coalesce(F.col("text").rlike(r"(?m)^[ \t]{0,3}>"), F.lit(False)).alias("quotes"))
    quoting = rows.where("quotes").withColumn("lines", line_levels(F.col("text")))
    quoting = quoting.select("conv_id", "turn", "lines", F.explode(F.array_distinct(F.transform(F.filter("lines", lambda x: x["level"] > 0), lambda x: x["level"]))).alias("level"))
    of_level = F.transform(F.filter("lines", lambda x: x["level"] == F.col("level")), lambda x: x["line"])
    quoted = quoting.select("conv_id", "turn", "level", F.explode(passages(of_level)).alias("s"))
    # a bit for each number of words, SHORT or more but less than a window, that a conversation quotes
    length = F.size(F.split("s", " "))
    asked = F.when((length >= SHORT) & (length < WINDOW), F.expr("shiftleft(1, size(split(s, ' ')))")).otherwise(0)
    threads = quoted.groupBy(F.col("conv_id").alias("thread")).agg(F.bit_or(asked).alias("asked"))
    own = rows.join(threads, F.col("conv_id").eqNullSafe(F.col("thread")))
    own_lines = F.split(F.regexp_replace(F.coalesce(without_quotes(F.col("text")), F.lit("")), r"\r\n?", "\n"), "\n")
    lengths = F.filter(F.array(*[F.lit(n) for n in range(SHORT, WINDOW)]), lambda n: F.getbit(F.col("asked"), n) == 1)
    own = own.select("conv_id", "turn", own_lines.alias("lines"), lengths.alias("lengths"))
    at_level = lambda level, found: F.transform(found, lambda s: F.struct(F.lit(level).alias("level"), s.alias("s")))
    of_own = F.concat(at_level(0, passages(F.col("lines"))), at_level(-1, parts(F.col("lines"), F.col("lengths"))))
    own = own.select("conv_id", "turn", F.explode(of_own).alias("own")).select("conv_id", "turn", "own.level", "own.s")
    both = quoted.unionByName(own).select("conv_id", "turn", "level", F.xxhash64("s").alias("key"), F.length("s").alias("size"))
    before = Window.partitionBy("conv_id", "key").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    latest = lambda level: F.max(F.when(F.col("level") == level, F.col("turn"))).over(before)
    met = both.withColumn("origin", F.coalesce(latest(0), latest(-1))).where("level > 0 and origin is not null")
    votes = met.groupBy("conv_id", "turn", "level", "origin").agg(F.sum("size").alias("size"))
    best = F.max(F.struct(F.negative("level").alias("level"), "size", "origin")).alias("best")
    return votes.groupBy("conv_id", "turn").agg(best).select("conv_id", "turn", F.col("best.origin").alias("origin"))


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def reply_order(messages: DataFrame) -> DataFrame:
    """Each message of (conv_id, turn, role, text) with reply_to, depth, path and its text without quotes, in reply order.

    `path` sorts the messages of a conversation: a reply's path begins with the path of what it quotes, and messages after
    it without a quotation continue there. reply_to is the quoted turn, or else the turn before; depth counts the quotations
    on the way. Rows of a null conv_id are one conversation; a null turn quotes nothing and is quoted by nothing, and comes first. Repeated
    rows stay and share their places; two messages of one turn share its links. Null and empty texts quote nothing. Other
    columns pass through; columns of the added names are replaced.
    """
    messages = messages.drop("reply_to", "depth", "path", "quoted_lines").withColumn("turn", F.col("turn").cast("bigint"))
    links = shared_table(quotation_links(messages), "links")
    turns = messages.select("conv_id", "turn").distinct().join(links.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "origin"), _same("conv_id", "c") & _same("turn", "t"), "left").drop("c", "t")
    turns = turns.withColumn("span", F.floor(F.col("turn") / SPAN)).withColumn("linked", F.when(F.col("origin").isNotNull(), F.col("turn")))
    # The last link and the last turn at or before each turn: inside a span of turns, or else carried over from spans before.
    order = Window.partitionBy("conv_id", "span").orderBy("turn")
    spans = turns.groupBy("conv_id", "span").agg(F.max("linked").alias("linked"), F.max("turn").alias("turn"))
    earlier = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col("conv_id").alias("c"), F.col("span").alias("s"), F.max("linked").over(earlier).alias("old_link"), F.max("turn").over(earlier).alias("old_turn"))
    turns = turns.withColumn("here", F.max("linked").over(order)).withColumn("prior", F.lag("turn").over(order))
    turns = turns.join(spans, _same("conv_id", "c") & _same("span", "s")).select("conv_id", "turn", "origin", F.coalesce("here", "old_link").alias("head"), F.coalesce("prior", "old_turn").alias("prior"))
    turns = shared_table(turns, "turns")

    # Heads are the linked turns. What stands before a head's own turn in its path: the path of its origin, by doubling.
    parents = turns.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("head").alias("above"))
    heads = turns.where("origin is not null").join(parents, _same("conv_id", "c") & (F.col("origin") == F.col("t")))
    heads = shared_table(heads.select("conv_id", "turn", F.array("origin").alias("before"), "above"), "heads")
    while heads.where("above is not null").limit(1).count():
        up = heads.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("before").alias("more"), F.col("above").alias("next"))
        joined = heads.join(up, _same("conv_id", "c") & (F.col("above") == F.col("t")), "left")
        heads = shared_table(joined.select("conv_id", "turn", F.when(F.col("more").isNull(), F.col("before")).otherwise(F.concat("more", "before")).alias("before"), F.col("next").alias("above")), "heads")

    heads = heads.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "before")
    placed = turns.join(heads, _same("conv_id", "c") & (F.col("head") == F.col("t")), "left")
    before = F.coalesce("before", F.array().cast("array<bigint>"))
    placed = placed.select(F.col("conv_id").alias("__conv"), F.col("turn").alias("__turn"), F.coalesce("origin", "prior").alias("reply_to"), F.size(before).alias("depth"), F.concat(before, F.array("turn")).alias("path"))
    out = messages.join(placed, _same("conv_id", "__conv") & _same("turn", "__turn")).drop("__conv", "__turn")
    quoted = F.size(F.filter(line_levels(F.col("text")), lambda x: x["level"] > 0))
    out = out.withColumn("quoted_lines", quoted).withColumn("text", without_quotes(F.col("text")))
    return out.repartitionByRange("conv_id", "path").sortWithinPartitions("conv_id", "path")


def quotation_digest(messages: DataFrame) -> DataFrame:
    rows = reply_order(messages.select("conv_id", "turn", "role", "text"))
    return rows.select("conv_id", "turn", "role", "reply_to", "depth", F.array_join("path", "/").alias("path"), F.col("quoted_lines").cast("bigint").alias("quoted_lines"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
