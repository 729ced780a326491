"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence is toxic with the logistic of the summed weights of its words and their beginnings,
and a document with the noisy-or of its sentences, so weights for sentences are learned though only documents have labels. The same
sentence probabilities then tell where in a document the offence is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .decontamination import places_in, sieve
from .shared import id_remainder, unit_hash
from .texts import ALNUM, BYTE_VALUE, FOLD, U64, byte_class, mixed, pieces, raw, words

#: Bytes that end a sentence.
STOP = byte_class(lambda b: b in b".!?\n")
#: Bytes of a word's beginnings, which stand for words that the sample lacks.
STEMS = (4, 5)
#: A sentence's log-odds before any word speaks.
PRIOR = -7.0


def sentences(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features (32-bit hashes of each word, then of its beginnings), the first feature of each sentence (and the end), the first
    sentence of each row (and the end), and the features' places.

    A sentence holds a word at least and lies in one row.
    """
    starts, ends, hashes = words(data, bounds, ALNUM)
    number = np.searchsorted(np.flatnonzero(STOP[data]), starts) + np.searchsorted(bounds, starts, "right")
    first = np.append(np.flatnonzero(np.diff(number, prepend=-1)), len(hashes)) if len(hashes) else np.zeros(1, np.int64)
    row = np.searchsorted(first[:-1], np.searchsorted(starts, bounds))
    begin, parts = np.zeros(len(starts), U64), [hashes]
    for j in range(max(STEMS)):
        at = np.minimum(starts + j, max(0, len(data) - 1))
        begin = np.where(starts + j < ends, mixed(begin + BYTE_VALUE[FOLD[data[at]]]), begin) if len(data) else begin
        if j + 1 in STEMS:
            parts.append(begin ^ U64(j + 1))
    features = np.stack(parts, 1).ravel() & U64(0xFFFFFFFF)
    return features, len(parts) * first, row, np.repeat(np.stack([starts, ends]), len(parts), axis=1)


class Weights:
    """Weights of words, by sorted hash."""

    def __init__(self, known: np.ndarray, weight: np.ndarray, bias: float):
        self.known, self.weight, self.bias, self.bits = known, weight, bias, sieve(known)

    def log_clean(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log of the probability that a sentence is not toxic, for each sentence."""
        at, k = places_in(hashes, self.bits, self.known)
        spoken = np.bincount(np.searchsorted(first, at, "right") - 1, self.weight[k], len(first) - 1)
        return -np.logaddexp(0, self.bias + spoken)


def learn(bags: list[tuple[int, float, np.ndarray, np.ndarray]], rounds: int = 150, rate: float = 0.15, ridge: float = 2e-4, least_docs: int = 3) -> Weights:
    """Fit by full-batch gradient steps (Adam) on (label, weight, features, first feature of each sentence and the end) of each document."""
    bags = [b for b in bags if len(b[2])]
    label, weight = np.array([b[0] for b in bags], float), np.array([b[1] for b in bags], float)
    if not len(bags):
        return Weights(np.zeros(0, U64), np.zeros(0), PRIOR)
    kept, n = np.unique(np.concatenate([np.unique(b[2]) for b in bags]), return_counts=True)
    known = kept[n >= least_docs].astype(U64)
    size = np.array([len(b[2]) for b in bags])
    hashes = np.concatenate([b[2] for b in bags]).astype(U64)
    per_doc = np.array([len(b[3]) - 1 for b in bags])
    first = np.concatenate([b[3][:-1] + o for b, o in zip(bags, np.cumsum(size) - size, strict=True)])
    at, word = places_in(hashes, sieve(known), known)
    word, sentence = word.astype(np.int32), (np.searchsorted(first, at, "right") - 1).astype(np.int32)
    del hashes, at, kept
    begin = np.cumsum(per_doc) - per_doc
    doc = np.repeat(np.arange(len(bags)), per_doc)
    x = np.zeros(len(known) + 1)
    x[-1] = PRIOR
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1):
        z = x[-1] + np.bincount(sentence, x[word], len(first))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.add.reduceat(np.log1p(-p * (1 - 1e-12)), begin)
        pull = weight * np.where(label > 0, -np.exp(clean) / np.maximum(-np.expm1(clean), 1e-9), 1.0)
        to_z = p * pull[doc] / weight.sum()
        g = np.append(np.bincount(word, to_z[sentence], len(known)), to_z.sum()) + ridge * np.append(x[:-1], x[-1] - PRIOR) / 10
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    strong = np.abs(x[:-1]) > 0.02
    return Weights(known[strong], x[:-1][strong], float(x[-1]))


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, sample_docs: int = 6000, longest: int = 1 << 16) -> Weights:
    """Fit on about `sample_docs` labelled documents, chosen by hash, of `longest` bytes at most each: half of each label, as far as
    there are so many, with weights that give the labels their shares back.

    Rows without an id or a label teach nothing; of several labels of a document the largest counts. The driver holds the words of the
    sample as numbers, four bytes each.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & may_learn)
    marked = marked.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    share = {r["toxic"]: min(1.0, sample_docs / 2 / r["n"]) for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = max(share.values(), default=1.0)
    of_label = lambda value: F.when(F.col("toxic") == 1, value(share.get(1, most))).otherwise(value(share.get(0, most)))
    draw = unit_hash("doc_id", seed=43)
    marked = marked.where(draw < of_label(lambda x: x)).withColumn("weight", of_label(lambda x: most / x))
    sample = docs.where((draw < most) & (F.octet_length("text") <= longest)).select("text", "doc_id").join(F.broadcast(marked), "doc_id").select("text", "toxic", "weight")  # about sample_docs rows

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                hashes, first, row, _ = sentences(*raw(piece.column(0)))
                word = first[row]
                out = [(hashes[a:b].astype(np.uint32).tobytes(), (first[r : s + 1] - a).tobytes()) for a, b, r, s in zip(word[:-1], word[1:], row[:-1], row[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns[1:], pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["toxic", "weight", "words", "first"])

    # in an order of their own, so that sums, and so the weights, agree from run to run
    rows = sample.mapInArrow(bags, "toxic int, weight double, words binary, first binary").toArrow().sort_by([("words", "ascending"), ("toxic", "ascending")])
    views = zip(rows["toxic"].to_pylist(), rows["weight"].to_pylist(), *[[np.frombuffer(x.as_buffer(), kind) for x in rows[c]] for c, kind in (("words", np.uint32), ("first", np.int64))], strict=True)
    return learn(list(views))


def score(docs: DataFrame, weights: Weights, offending: float = 0.5) -> DataFrame:
    """Add score, predicted, n_sentences and spans (byte places and probability of sentences of `offending` and over).

    Null and empty texts, and texts without words, have no sentence and score 0. Repeated rows score alike; columns of docs
    of these names are replaced.
    """
    docs = docs.drop("score", "predicted", "n_sentences", "spans")
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select("text", *[F.col(f"`{c}`").alias(f"__{i}__") for i, c in enumerate(others)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for piece in pieces(batch):
                data, bounds = raw(piece.column(0))
                hashes, first, row, place = sentences(data, bounds)
                clean = own.log_clean(hashes, first)
                total = np.concatenate([[0], np.cumsum(clean)])
                bad = np.flatnonzero(-np.expm1(clean) >= offending)
                owner = np.searchsorted(row, bad, "right") - 1
                spans = [[] for _ in range(piece.num_rows)]
                for s, r in zip(bad, owner, strict=True):
                    spans[r].append((int(place[0, first[s]] - bounds[r]), int(place[1, first[s + 1] - 1] - bounds[r]), float(-np.expm1(clean[s]))))
                of_row = np.array([clean[a:b].sum() for a, b in zip(row[:-1], row[1:], strict=True)])
                arrays = [*piece.columns, pa.array(-np.expm1(of_row)), pa.array(np.diff(row), pa.int64()), pa.array([[dict(zip(("start", "end", "score"), x, strict=True)) for x in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))]
                yield pa.RecordBatch.from_arrays(arrays, [*piece.schema.names, "score", "n_sentences", "spans"])

    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
    rows = rows.mapInArrow(judge, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("n_sentences", T.LongType()), T.StructField("spans", spans)]))
    return rows.select(*[F.col("text" if c == "text" else f"__{others.index(c)}__").alias(c) for c in docs.columns], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "spans")


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    weights = fit(docs, labels, id_remainder("doc_id", 5) != 0)
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    return score(docs.select("doc_id", "text"), weights).select("doc_id", held_out.alias("held_out"), "score", "predicted", "n_sentences", F.size("spans").alias("n_offending"))
