"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order: counts of the bytes that follow each context of up to three bytes.
A byte that a context has not seen is reached by an escape to the next shorter context, with the seen bytes excluded there
(escape probability d / (n + d) for d different bytes in n). After the fit the statistics are frozen, so the code length of
every byte after every context is a number that can be tabulated; a text's code length in a language is an exact sum of them, and
the shortest one decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import id_remainder, unit_hash
from .texts import FOLD, PIECE, U64, pieces, raw

UNDETERMINED = "und"
#: The context symbol of places before a text's start.
START = 256
#: Contexts of which the statistics are worked out at a time.
SLICE = 1024


def _history(symbols: np.ndarray, bounds: np.ndarray, lo: int, hi: int, start: int) -> list[np.ndarray]:
    """The third, second and first symbols before each place of symbols[lo:hi]; none reaches over a row's start."""
    out = []
    for back in (3, 2, 1):
        past = np.full(hi - lo, start, symbols.dtype)
        skip = max(0, back - lo)
        past[skip:] = symbols[lo + skip - back : hi - back]
        for k in range(back):
            at = bounds[:-1] + k - lo
            past[at[(at >= 0) & (at < hi - lo)]] = start
        out.append(past)
    return out


def gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, gram, n) of the four-symbol sequences, nine bits a symbol, in (text, lang) rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                data, bounds = raw(piece.column(0))
                symbols = FOLD[data].astype(np.int64)
                a, b, c = _history(symbols, bounds, 0, len(symbols), START)
                grams = ((a << 9 | b) << 9 | c) << 9 | symbols
                names, code = np.unique(np.array(piece.column(1).to_pylist(), object).astype(str), return_inverse=True)
                keys, n = np.unique(np.repeat(code.astype(np.int64), np.diff(bounds)) << 36 | grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names[keys >> 36].tolist(), pa.string()), pa.array(keys & (1 << 36) - 1), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    return sample.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Trees:
    """The frozen trees of all languages, without loss: every context of the sample, whatever their number.

    Contexts of up to two symbols have the bits of each symbol in a table. Of the longest contexts, the symbols seen after them
    have a row each; for all others, what the escape costs in each language is added to the bits after the shorter context. So the tables
    grow with the different four-symbol sequences of the sample, not with contexts times symbols.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        # in an order of their own, so that sums agree from run to run
        rank = np.lexsort((gram, lang))
        lang, gram, n = lang[rank], gram[rank], n[rank]
        symbols = [gram >> 27 & 511, gram >> 18 & 511, gram >> 9 & 511, gram & 511]
        used = np.unique(symbols[3])
        k = len(used) + 1  # the last symbol stands for all bytes that the sample lacks
        self.symbol = np.full(257, k - 1, np.int32)
        self.symbol[used] = np.arange(k - 1)
        self.symbol[START] = k
        self.size, self.base = k, k + 1
        a, b, c, d = (self.symbol[x].astype(np.int64) for x in symbols)
        base = self.base
        self.node = np.zeros((base, base), np.int32)
        tables, parents, above, start = [], np.zeros(1, np.int64), np.full((len(langs), 1, k), 1 / k), 0
        for order in range(3):
            context = [np.zeros_like(c), c, b * base + c][order]
            keys, inverse = np.unique(context, return_inverse=True)
            parent = np.searchsorted(parents, [np.zeros_like(keys), np.zeros_like(keys), keys % base][order])
            own = np.empty((len(langs), len(keys), k))
            rows = np.argsort(inverse, kind="stable")
            for lo in range(0, len(keys), SLICE):
                hi = min(lo + SLICE, len(keys))
                part = rows[slice(*np.searchsorted(inverse[rows], [lo, hi]))]
                counts = np.zeros((len(langs), hi - lo, k))
                np.add.at(counts, (lang[part], inverse[part] - lo, d[part]), n[part])
                own[:, lo:hi] = self._probabilities(counts, above[:, parent[lo:hi]])
            tables.append(-np.log2(own.transpose(1, 2, 0)).astype(np.float32))
            ids = start + np.arange(len(keys), dtype=np.int32)
            if order == 1:
                self.node[:, keys] = ids
            elif order == 2:
                self.node.reshape(-1)[keys] = ids
            start += len(keys)
            parents, above = keys, own
        self.bits = np.concatenate(tables).reshape(-1, len(langs))
        self._longest((a * base + b) * base + c, d, lang, n, parents, above)

    def _longest(self, context: np.ndarray, d: np.ndarray, lang: np.ndarray, n: np.ndarray, parents: np.ndarray, above: np.ndarray) -> None:
        """Tables of the longest contexts: `seen`, the bits of the symbols seen in any language, and `escape`, what all others cost more
        than after the shorter context."""
        k, base, many = self.size, self.base, len(self.langs)
        keys, at = np.unique(context, return_inverse=True)
        parent = np.searchsorted(parents, keys % base**2)
        self.deepest = np.full(base**3, len(keys), np.int32)
        self.deepest[keys] = np.arange(len(keys), dtype=np.int32)
        cell, size = at * many + lang, len(keys) * many
        total, different = np.bincount(cell, n, size), np.bincount(cell, minlength=size)
        mass = 1 - np.bincount(cell, above[lang, parent[at], d], size)
        leaves = (different > 0) & (different < k) & (mass > 0)
        escape = np.where(leaves, different / np.maximum(total + different, 1), 0.0)
        cost = np.zeros(size)
        cost[leaves] = -np.log2(escape[leaves] / mass[leaves])
        self.escape = np.append(cost, np.zeros(many)).reshape(-1, many).astype(np.float32)  # the last row: a context never met
        self.grams, row = np.unique(at * k + d, return_inverse=True)
        self.shift = U64(61 - len(self.grams).bit_length())  # eight slots or more for each sequence
        self.slots = np.zeros(1 << 64 - int(self.shift), np.int32)
        self.slots[self._slot(self.grams)] = np.arange(len(self.grams), dtype=np.int32)
        node, symbol = self.grams // k, self.grams % k
        self.seen = self.escape[node] - np.log2(above[:, parent[node], symbol].T).astype(np.float32)
        self.seen[row, lang] = -np.log2(n / total[cell] * (1 - escape[cell]))

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return grams.astype(U64) * U64(0x9E3779B97F4A7C15) >> self.shift

    def _places(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of sequences in `seen`, and the places of those that have none; what shares a slot is searched for."""
        place = self.slots[self._slot(asked)]
        rest = np.flatnonzero(self.grams[place] != asked)
        found = np.searchsorted(self.grams, asked[rest])
        found[found == len(self.grams)] = 0
        place[rest] = found
        return place, rest[self.grams[found] != asked[rest]]

    @staticmethod
    def _probabilities(counts: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Of each symbol: seen ones by their counts, the others by the escape and the shorter context, without those seen."""
        total, different = counts.sum(2, keepdims=True), (counts > 0).sum(2, keepdims=True)
        rest = np.where(counts > 0, 0, parent)
        mass = rest.sum(2, keepdims=True)
        escape = np.where(mass > 0, different / np.maximum(total + different, 1), 0)
        seen = counts / np.maximum(total, 1) * (1 - escape)
        return np.where(total > 0, seen + escape * rest / np.maximum(mass, 1e-300), parent)

    def lengths(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits of each row in each language."""
        out = np.zeros((len(bounds) - 1, len(self.langs)))
        symbols = self.symbol[FOLD[data]]
        for lo in range(0, len(data), PIECE):
            hi = min(lo + PIECE, len(data))
            a, b, c = _history(symbols, bounds, lo, hi, self.size)
            d = symbols[lo:hi]
            node = self.deepest[(a * self.base + b) * self.base + c]
            place, other = self._places(node.astype(np.int64) * self.size + d)
            bits = self.seen[place]
            bits[other] = self.escape[node[other]] + self.bits[self.node[b[other], c[other]].astype(np.int64) * self.size + d[other]]
            cuts = np.clip(bounds, lo, hi) - lo
            rows = np.flatnonzero(np.diff(cuts))
            if len(rows):
                out[rows] += np.add.reduceat(bits, cuts[rows], axis=0, dtype=np.float64)
        return out


def fit(docs: DataFrame, may_learn: Column, per_language: int = 1500, passage: int = 1 << 14) -> Trees | None:
    """Fit on a hash-chosen sample of about `per_language` texts of each non-null `lang`; a text of more than `passage` characters teaches
    by a passage of so many, the place of which its hash chooses.

    The shares, a number for each language, are broadcast: no text is shuffled. Nothing that the sample holds is left out of the
    trees; what reaches the driver are the counts of its different four-symbol sequences, which those two parameters bound. None if there
    is nothing to learn from.
    """
    may = docs.where(may_learn & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    share = may.groupBy("lang").agg((F.lit(float(per_language)) / F.count(F.lit(1))).alias("share"))
    sample = may.join(F.broadcast(share), "lang").where(unit_hash("doc_id", seed=41) < F.col("share"))
    spare = F.char_length("text") - passage
    chosen = F.when(spare > 0, F.substr("text", (F.pmod(F.xxhash64("text"), spare + 1) + 1).cast("int"), F.lit(passage))).otherwise(F.col("text"))
    rows = gram_counts(sample.select(chosen.alias("text"), "lang")).toArrow()
    if not rows.num_rows:
        return None
    coded = rows["lang"].combine_chunks().dictionary_encode()
    langs, place = np.unique(np.array(coded.dictionary.to_pylist()), return_inverse=True)
    return Trees([str(x) for x in langs], place[coded.indices.to_numpy()], rows["gram"].to_numpy(), rows["n"].to_numpy())


def _scored(docs: DataFrame, trees: Trees) -> tuple[DataFrame, list[Column]]:
    """docs under names of their own, with the best language, its share and its code length, and the columns of docs in it."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    others = [c for c in docs.columns if c != "text"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for piece in pieces(batch):
                bits = own.lengths(*raw(piece.column(0)))
                best = bits.argmin(1)
                share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                arrays = [*piece.columns, pa.array([own.langs[i] for i in best], pa.string()), pa.array(share), pa.array(bits.min(1))]
                yield pa.RecordBatch.from_arrays(arrays, [*piece.schema.names, "__lang", "__score", "__bits"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("text", *[F.col(f"`{c}`").alias(f"__{i}__") for i, c in enumerate(others)], lettered.alias("__lettered"))
    rows = rows.mapInArrow(score, T.StructType([*rows.schema.fields, T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType()), T.StructField("__bits", T.DoubleType())]))
    rows = rows.withColumn("__lang", F.when(F.col("__lettered"), F.col("__lang")).otherwise(UNDETERMINED)).withColumn("__score", F.when(F.col("__lettered"), F.col("__score")).otherwise(0.0))
    return rows, [F.col("text" if c == "text" else f"__{others.index(c)}__").alias(c) for c in docs.columns]


def predict(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """Add lang_pred, score, the share of the best language in 2**-bits, and bits, the code length in it, from `text` alone.

    A null text, one without a letter, or one scored without any tree is `und` with score 0. Equal texts get equal results;
    ties go to the language first in code point order. Columns of docs with these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "bits")
    if trees is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0), "bits": F.lit(0.0)})
    rows, own = _scored(docs, trees)
    return rows.select(*own, F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__bits").alias("bits"))


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents never learned from; a null id is neither held out nor learned from."""
    return F.coalesce(id_remainder(doc_id, 4) == 2, F.lit(False))


def language_digest(docs: DataFrame) -> DataFrame:
    trees = fit(docs, id_remainder("doc_id", 4) != 2)
    return predict(docs.select("doc_id", "text"), trees).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def confident(docs: DataFrame, least: float = 0.5, most_bits: float = 4.5, spare_bits: float = 64.0) -> DataFrame:
    """The documents whose language is recognised: not `und`, with a score of at least `least`, and not foreign to all languages.

    The share of the best language is near 1 for noise and unknown languages too; but these cost more than `most_bits` a byte
    in every tree (text of a learned language costs 2 to 3), beside `spare_bits`, which short texts need.
    """
    trees = fit(docs, id_remainder("doc_id", 4) != 2)
    if trees is None:
        return docs.where(F.lit(False))
    rows, own = _scored(docs, trees)
    known = (F.col("__lang") != UNDETERMINED) & (F.col("__score") >= least)
    return rows.where(known & (F.col("__bits") <= most_bits * F.octet_length("text") + spare_bits)).select(*own)
