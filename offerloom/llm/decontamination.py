"""Benchmark decontamination by a prefix-filtered set join.

Every item of a benchmark is cut into windows of consecutive words. The words of a window are ordered by rarity in the
corpus; as the whole window has to be contained, its rarest word is the prefix that any match must share. Documents probe
an index from prefix words to (window, place of the word in it); what lies within the document by that place and the window's
length is verified word by word. Documents are never shuffled: the index of a block of windows is broadcast, its size is
bounded by `block_windows`, and a larger benchmark takes one more narrow pass over the documents for each further block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .texts import ALNUM, U64, pieces, raw, words

#: Entries of the tables that say which hashes are worth a search.
SIEVE = 1 << 20


def sieve(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(SIEVE, bool)
    bits[(hashes & U64(SIEVE - 1)).astype(np.int64)] = True
    return bits


def places_in(found: np.ndarray, bits: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in `found` that hold one of the sorted `known`, and which."""
    at = np.flatnonzero(bits[(found & U64(SIEVE - 1)).astype(np.int64)])
    if not len(at) or not len(known):
        return at[:0], at[:0]
    k = np.minimum(np.searchsorted(known, found[at]), len(known) - 1)
    hit = known[k] == found[at]
    return at[hit], k[hit]


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(item, window, hashes): the windows of each item, hashes of their words; items without words have none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                data, bounds = raw(piece.column(0))
                starts, _, hashes = words(data, bounds, ALNUM)
                first = np.searchsorted(starts, bounds)
                items, texts = piece.column(1).to_pylist(), []
                ids = []
                for item, a, b in zip(items, first[:-1], first[1:], strict=True):
                    own = hashes[a:b]
                    for i in range(max(1, len(own) - size + 1) if len(own) else 0):
                        texts.append(own[i : i + size].tobytes())
                        ids.append(item)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.binary())], ["item", "hashes"])

    rows = benchmark.select("text", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"))
    return rows.mapInArrow(cut, "item string, hashes binary").distinct()


class Index:
    """Windows by their rarest word; all arrays, so that it is sent to the tasks as it is.

    `windows` has the hashes of the words of each (item, window) row, equal windows next to each other; `known` and `counts` are the
    sorted words of the windows and how often the corpus has each.
    """

    def __init__(self, items: pa.Array, windows: pa.Array, known: np.ndarray, counts: np.ndarray):
        data, bounds = raw(windows)
        flat, first = data.view(U64) if len(data) else np.zeros(0, U64), bounds // 8
        cells = windows.to_pylist()
        new = np.array([i == 0 or x != cells[i - 1] for i, x in enumerate(cells)], bool)
        starts = np.flatnonzero(new)
        self.items = items
        self.item_at = np.append(starts, len(windows))
        self.length = np.diff(first)[starts]
        self.first = np.append(0, np.cumsum(self.length))
        inside = np.repeat(new, np.diff(first))
        self.flat = flat[inside]
        # the rarest word of each window, ties by hash: the first in the order of (window, count, hash)
        window = np.repeat(np.arange(len(starts)), self.length)
        n = counts[np.searchsorted(known, self.flat)] if len(known) else np.zeros(0, np.int64)
        order = np.lexsort((self.flat, n, window))
        rarest = order[self.first[:-1]] if len(starts) else np.zeros(0, np.int64)
        self.place = rarest - self.first[:-1]
        prefix = self.flat[rarest]
        self.window_of = np.argsort(prefix, kind="stable")
        self.prefixes, at = np.unique(prefix[self.window_of], return_index=True)
        self.at = np.append(at, len(prefix))
        self.bits = sieve(self.prefixes)

    def items_of(self, windows: np.ndarray) -> set[str]:
        """The items that hold any of the windows."""
        return {x for w in windows for x in self.items[self.item_at[w] : self.item_at[w + 1]].to_pylist()}

    def matches(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of each occurrence in rows whose words begin at `first`."""
        at, k = places_in(hashes, self.bits, self.prefixes)
        many = self.at[k + 1] - self.at[k]
        at = np.repeat(at, many)
        step = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        window = self.window_of[np.repeat(self.at[k], many) + step]
        start = at - self.place[window]
        row = np.searchsorted(first, at, "right") - 1
        fits = (start >= first[row]) & (start + self.length[window] <= first[row + 1])
        start, window = start[fits], window[fits]
        for j in range(int(self.length.max(initial=0))):
            open_ = j < self.length[window]
            same = hashes[np.minimum(start + j, len(hashes) - 1)] == self.flat[np.minimum(self.first[window] + j, len(self.flat) - 1)]
            keep = same | ~open_
            start, window = start[keep], window[keep]
        return start, window


def corpus_counts(docs: DataFrame, known: np.ndarray) -> np.ndarray:
    """How often each of the given sorted words (hashes) occurs in all the documents."""
    bits = sieve(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            for piece in pieces(batch):
                _, k = places_in(words(*raw(piece.column(0)), ALNUM)[2], bits, known)
                total += np.bincount(k, minlength=len(known))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(known[used].astype(np.int64)), pa.array(total[used])], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(len(known), np.int64)
    total[np.searchsorted(known, rows["word"].to_numpy().view(U64))] = rows["n"].to_numpy()
    return total


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_windows: int = 100_000) -> DataFrame:
    """Add n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256 and contaminated to docs.

    docs needs `text`, benchmark `item_id` and `text`. Null and empty texts have no words and no hits; items without words
    have no windows; a null item id counts as the empty string; equal windows of several items count for each of them.
    Repeated rows get equal results; columns of docs of the same names are replaced. `block_windows` bounds what is broadcast
    at once and what the driver holds (about 300 bytes a window). Words are compared by 64-bit hashes, all words of a window each.
    """
    docs = docs.drop("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    spark, windows = docs.sparkSession, item_windows(benchmark, size).cache()
    blocks = -(-windows.count() // block_windows)
    others = [c for c in docs.columns if c != "text"]
    out = docs.select("text", *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(others)], F.lit(None).cast("binary").alias("__hit__"), F.lit(None).cast("array<string>").alias("__items__"))
    counted = T.StructType([T.StructField("__n__", T.LongType()), T.StructField("__h__", T.LongType()), *[f for f in out.schema if f.name != "__hit__"]])
    for block in range(max(1, blocks)):
        part = windows.where(F.pmod(F.xxhash64("hashes"), F.lit(max(1, blocks))) == block).toArrow().sort_by("hashes")
        items, hashes = (part[c].combine_chunks() if part.num_rows else pa.array([], k) for c, k in (("item", pa.string()), ("hashes", pa.binary())))
        known = np.unique(raw(hashes)[0].view(U64)) if part.num_rows else np.zeros(0, U64)
        index = spark.sparkContext.broadcast(Index(items, hashes, known, corpus_counts(docs, known) if len(known) else np.zeros(0, np.int64)))
        last = block >= blocks - 1
        out = out.mapInArrow(_matcher(index, len(others) + 1, last), counted if last else out.schema)
    windows.unpersist()
    items = F.coalesce(F.col("__items__"), F.array().cast("array<string>"))
    return out.select(
        *[F.col("text" if c == "text" else f"__{others.index(c)}").alias(c) for c in docs.columns],
        F.col("__n__").alias("n_words"),
        F.col("__h__").alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("__h__") > 0).alias("contaminated"),
    )


def _matcher(index, hit_at: int, last: bool):
    """Note the hit words and items of a block of windows in the columns at `hit_at`; the `last` block counts words and hits instead."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            for piece in pieces(batch):
                data, bounds = raw(piece.column(0))
                starts, _, hashes = words(data, bounds, ALNUM)
                first = np.searchsorted(starts, bounds)
                start, window = own.matches(hashes, first)
                if len(start):
                    row = np.searchsorted(first, start, "right") - 1
                    hits, items = piece.column(hit_at).to_pylist(), piece.column(hit_at + 1).to_pylist()
                    for r in np.unique(row):
                        mine = row == r
                        size = int(first[r + 1] - first[r])
                        edge = np.zeros(size + 1, np.int64)
                        np.add.at(edge, start[mine] - first[r], 1)
                        np.add.at(edge, start[mine] - first[r] + own.length[window[mine]], -1)
                        covered = np.cumsum(edge[:-1]) > 0
                        if hits[r] is not None:
                            covered |= np.unpackbits(np.frombuffer(hits[r], np.uint8), count=size).astype(bool)
                        hits[r] = np.packbits(covered).tobytes()
                        items[r] = sorted(own.items_of(np.unique(window[mine])).union(items[r] or ()))
                    arrays = list(piece.columns)
                    arrays[hit_at], arrays[hit_at + 1] = pa.array(hits, piece.schema.field(hit_at).type), pa.array(items, piece.schema.field(hit_at + 1).type)
                    piece = pa.RecordBatch.from_arrays(arrays, schema=piece.schema)
                yield _counted(piece, np.diff(first), hit_at) if last else piece

    return match


def _counted(piece: pa.RecordBatch, n: np.ndarray, hit_at: int) -> pa.RecordBatch:
    """The piece with numbers of words and of hit words first, without the hit words themselves."""
    hit = [0 if x is None else int(np.unpackbits(np.frombuffer(x, np.uint8)).sum()) for x in piece.column(hit_at).to_pylist()]
    kept = [i for i in range(piece.num_columns) if i != hit_at]
    return pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(hit, pa.int64()), *[piece.column(i) for i in kept]], ["__n__", "__h__", *[piece.schema.names[i] for i in kept]])


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs.select("doc_id", "text"), benchmark).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
