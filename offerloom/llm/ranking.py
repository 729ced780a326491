"""Ranked lexical search of many items at once, with common parts of their sums evaluated once.

An item's score of a document is a sum over the item's terms. Terms that occur in the same items are one operand; then, again and again,
the two operands that most items still share become a new one, until no two items share a pair. The operands form a graph in which an item
is the sum of the few that are left to it. A document's operands are evaluated once, level by level, for all items.

The corpus is tokenised once for a block of items: what it holds of their terms is written as postings, from which counts over all documents
come first, and then the accumulators. Each task keeps the best documents of each item, so that a shuffle sees tasks * items * k rows at most.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import shared_table
from .texts import ALNUM, pieces, raw, trimmed, words

#: Items of a block: their terms and graph are broadcast.
ITEMS = 1000
#: An item's operands between which pairs are mined; those in most items first. What is not mined is added item by item.
MINED = 64
#: Bytes of texts in a row of postings, and cells of operands and documents at a time.
SLICE, CELLS = 1 << 21, 1 << 21


@dataclass
class Graph:
    """Operands of a block of items: first the classes of terms, then sums of two earlier ones."""

    class_of: np.ndarray  # of each term
    classes: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # (sum, left, right), each level of earlier ones
    operands: np.ndarray  # of all items, item after item
    first: np.ndarray  # where each item's begin
    items: np.ndarray  # places of the items that have terms

    def scores(self, operands: np.ndarray) -> np.ndarray:
        """Items by documents, from the classes' scores by documents, which are extended by the sums."""
        for z, x, y in self.levels:
            operands[z] = operands[x] + operands[y]
        return np.add.reduceat(operands[self.operands], self.first, axis=0)


def shared_sums(terms: list[np.ndarray], n_terms: int) -> Graph:
    """Mine the graph of items given as arrays of different term numbers below n_terms."""
    holders = defaultdict(list)
    for i, own in enumerate(terms):
        for t in own.tolist():
            holders[t].append(i)
    numbers: dict[tuple, int] = {}
    class_of = np.array([numbers.setdefault(tuple(holders[t]), len(numbers)) for t in range(n_terms)], np.int64)
    items = [i for i, own in enumerate(terms) if len(own)]
    left = {i: set(class_of[terms[i]].tolist()) for i in items}
    sharing = Counter(c for own in left.values() for c in own)
    mined = {i: set(sorted((c for c in own if sharing[c] > 1), key=lambda c: (-sharing[c], c))[:MINED]) for i, own in left.items()}
    pairs: dict[tuple[int, int], set[int]] = defaultdict(set)
    for i in items:
        for pair in combinations(sorted(mined[i]), 2):
            pairs[pair].add(i)
    queue = [(-len(s), pair) for pair, s in pairs.items() if len(s) > 1]
    heapq.heapify(queue)
    level_of, nodes, levels = [0] * len(numbers), len(numbers), defaultdict(list)
    while queue:
        n, (x, y) = heapq.heappop(queue)
        own = pairs.get((x, y), ())
        if len(own) != -n:
            if len(own) > 1:
                heapq.heappush(queue, (-len(own), (x, y)))
            continue
        z, nodes, own = nodes, nodes + 1, sorted(own)
        level_of.append(1 + max(level_of[x], level_of[y]))
        levels[level_of[z]].append((z, x, y))
        for i in own:
            for o in mined[i]:
                for old in (x, y):
                    if o != old:
                        pairs[min(o, old), max(o, old)].discard(i)
            for kept in (mined[i], left[i]):
                kept -= {x, y}
            for o in mined[i]:
                pairs[o, z].add(i)
            mined[i].add(z)
            left[i].add(z)
        for o in sorted({o for i in own for o in mined[i]} - {z}):
            if len(pairs[o, z]) > 1:
                heapq.heappush(queue, (-len(pairs[o, z]), (o, z)))
    steps = [tuple(np.array(c, np.int64) for c in zip(*levels[k], strict=True)) for k in sorted(levels)]
    operands = [sorted(left[i]) for i in items]
    first = np.cumsum([0, *map(len, operands)])[: len(items)]
    return Graph(class_of, len(numbers), steps, np.array([c for own in operands for c in own], np.int64), first, np.array(items, np.int64))


def postings(docs: DataFrame, hashes: np.ndarray, key: str, text: str) -> DataFrame:
    """A row for some documents: their keys and numbers of terms, and of the terms in `hashes` (sorted): document, term and occurrences."""
    sent = docs.sparkSession.sparkContext.broadcast(hashes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for piece in pieces(batch, SLICE):
                data, bounds = raw(piece.column(0))
                starts, _, found = words(data, bounds, ALNUM)
                row = np.searchsorted(bounds, starts, "right") - 1
                at = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
                here = known[at] == found if len(known) else np.zeros(len(found), bool)
                cells, n = np.unique(row[here] * len(known) + at[here], return_counts=True)
                lists = [piece.column(1), *map(pa.array, (np.bincount(row, minlength=piece.num_rows), cells // max(1, len(known)), cells % max(1, len(known)), n.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists], ["keys", "size", "doc", "term", "n"])
        trimmed()

    kinds = "keys array<long>, size array<long>, doc array<long>, term array<long>, n array<long>"
    return docs.select(F.col(text).alias("text"), F.col(key).cast("long").alias("key")).mapInArrow(count, kinds)


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    for i in range(batch.num_rows):
        yield tuple(batch.column(n)[i].values for n in names)


def _counted(found: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and in how many documents each known term is."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms + 2, np.int64)
        for batch in batches:
            for size, term in _rows(batch, "size", "term"):
                size = size.to_numpy(zero_copy_only=False)
                total += np.concatenate([np.bincount(term.to_numpy(zero_copy_only=False), minlength=n_terms), [np.count_nonzero(size), size.sum()]]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["term", "n"])

    total = np.zeros(n_terms + 2, np.int64)
    for r in found.select("size", "term").mapInArrow(add, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        total[r["term"]] = r["n"]
    return int(total[-2]), int(total[-1]), total[:-2]


def _best(found: DataFrame, graph: Graph, weights: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best documents of each item."""
    sent = found.sparkSession.sparkContext.broadcast((graph, weights))

    def cut(item, score, null, key):
        order = np.lexsort((key, null, -score, item))
        item, score, null, key = (x[order] for x in (item, score, null, key))
        here = np.arange(len(item)) - np.searchsorted(item, item, "left") < k
        return item[here], score[here], null[here], key[here]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, weights = sent.value
        nodes = graph.classes + sum(len(z) for z, _, _ in graph.levels)
        step = max(1, CELLS // max(1, nodes))
        held = (np.zeros(0, np.int64),) * 4
        least = np.ones(len(graph.items), np.int64)
        for batch in batches:
            for keys, *others in _rows(batch, "keys", "size", "doc", "term", "n"):
                size, doc, term, n = (x.to_numpy(zero_copy_only=False) for x in others)
                null, key = keys.is_null().to_numpy(zero_copy_only=False).astype(np.int64), keys.fill_null(0).to_numpy(zero_copy_only=False)
                m = 100 - 50 + (50 * size * total) // length if length else size
                part = weights[term] * ((1_000_000_000 * n) // (1000 * n + 20 * m[doc]))
                for at in range(0, len(size), step):
                    docs = min(step, len(size) - at)
                    i, j = np.searchsorted(doc, [at, at + docs])
                    operands = np.zeros((nodes, docs), np.int64)
                    np.add.at(operands, (graph.class_of[term[i:j]], doc[i:j] - at), part[i:j])
                    scores = graph.scores(operands)
                    item, place = np.nonzero(scores >= least[:, None])
                    held = cut(*(np.concatenate(x) for x in zip(held, (item, scores[item, place], null[at + place], key[at + place]), strict=True)))
                    full = np.flatnonzero(np.bincount(held[0], minlength=len(least)) == k)
                    least[full] = held[1][np.searchsorted(held[0], full, "right") - 1]
        item, score, null, key = held
        yield pa.RecordBatch.from_arrays([pa.array(graph.items[item]), pa.array(key, mask=null > 0), pa.array(score)], ["item", "doc_id", "score"])
        trimmed()

    return found.mapInArrow(rank, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each item's k highest-scoring documents with a score above 0: item_id, rank, doc_id, score.

    Terms are runs of ASCII letters (A-Z lower-cased), digits and characters beyond ASCII. Equal scores go by ascending doc_id, null last.
    Null and empty texts have no terms; items without terms, or whose terms no document has, return no row. A document given twice is two
    documents, an item given twice is one; items of one id and different texts are ranked each on its own. Other columns are not looked at.
    """
    items = shared_table(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct(), "items")
    blocks = max(1, -(-items.count() // ITEMS))
    out = None
    for i in range(blocks):
        block = items.where(F.pmod(F.hash("item_id", "text"), F.lit(blocks)) == i).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        data, bounds = raw(block["text"].combine_chunks())
        starts, _, found = words(data, bounds, ALNUM)
        hashes, number = np.unique(found, return_inverse=True)
        row = np.searchsorted(bounds, starts, "right") - 1
        terms = [np.unique(number.ravel()[row == r]) for r in range(block.num_rows)]
        graph = shared_sums(terms, len(hashes))
        rows = shared_table(postings(docs, hashes, key, text), "postings")
        total, length, df = _counted(rows, len(hashes))
        weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        best = _best(rows, graph, weights, total, length, k) if len(graph.items) else rows.sparkSession.createDataFrame([], "item long, doc_id long, score long")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = best.withColumn("rank", rank).where(F.col("rank") <= k)
        names = docs.sparkSession.createDataFrame(list(enumerate(block["item_id"].to_pylist())), T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", items.schema["item_id"].dataType)]))
        best = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return out
