"""Nearest neighbours with randomly rotated one-bit codes.

Vectors are taken relative to the nearest of a few centroids, rotated by random orthogonal matrices and reduced to the signs
of their components, with scalars: the length of the residual and its inner product with each of its codes. The packed
signs give unbiased estimates of inner products with a query and a bound on the error of their mean, hence a lower bound on the
distance. The nearest by estimate are measured on the original vectors; the distance of the last of them is the limit, and
whatever has a lower bound within it is measured too.

The query set meets all rows in blocks: codes and vectors stay where they are, in blocks of a few megabytes, and a pass over them
takes a broadcast block of queries, whose size is a parameter; of each meeting only the nearest of each query leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import shared_table

#: The binary columns of a block of codes.
CELLS = ("nodes", "vectors", "near", "packed", "length", "own")
#: Standard deviations that the error bound covers.
SURE = 4.5


class Frame:
    """Rotation and centroids for vectors of one length."""

    def __init__(self, sample: np.ndarray, centroids: int, rotations: int = 4, seed: int = 5, rounds: int = 8):
        rng = np.random.default_rng(seed)
        size = sample.shape[1]
        self.size, self.rotations = size, rotations
        self.turn = np.concatenate([np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(rotations)], axis=1)
        centre = sample[rng.choice(len(sample), min(centroids, len(sample)), replace=False)]
        for _ in range(rounds):
            near = self._nearest(sample, centre)
            total = np.zeros_like(centre)
            np.add.at(total, near, sample)
            n = np.bincount(near, minlength=len(centre))
            centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
        self.centre = centre

    @staticmethod
    def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return ((centre**2).sum(1) - 2 * x @ centre.T).argmin(1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Centroid, packed signs, residual length and inner products of the residual's direction with its codes, of each row."""
        near = self._nearest(x, self.centre)
        rest = (x - self.centre[near]) @ self.turn
        length = np.sqrt((rest**2).sum(1) / self.rotations)
        own = np.abs(rest).reshape(len(x), self.rotations, self.size).sum(2) / np.maximum(length, 1e-300)[:, None] / np.sqrt(self.size)
        return near.astype(np.int32), np.packbits(rest > 0, axis=1), length, np.where(length[:, None] > 0, own, 1.0)

    def estimates(self, codes: tuple, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance of each query (row) to each code (column): the estimate and its lower bound."""
        near, packed, length, own = codes
        middle, low = (np.empty((len(query), len(near)), np.float32) for _ in range(2))
        spread = np.sqrt((np.maximum(0, 1 - own**2) / own**2).sum(1)) / self.rotations * SURE / np.sqrt(max(1, self.size - 1))
        for c in np.unique(near):
            at = np.flatnonzero(near == c)
            sign = np.unpackbits(packed[at], axis=1, count=self.size * self.rotations).astype(np.float32) * 2 - 1
            sign *= np.repeat(1 / own[at], self.size, axis=1)
            rest = query - self.centre[c]
            far = np.sqrt((rest**2).sum(1))
            inner = ((rest @ self.turn).astype(np.float32) @ sign.T) * (length[at] / (self.rotations * np.sqrt(self.size)))
            distance = far[:, None] ** 2 + length[at] ** 2 - 2 * inner
            error = 2 * far[:, None] * (length * spread)[at] + 1e-5 * (far[:, None] ** 2 + length[at] ** 2)
            middle[:, at], low[:, at] = distance, distance - error
        return middle, low

    def nearest(self, codes: tuple, vectors: np.ndarray, query: np.ndarray, k: int, limit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the columns of its k nearest that are not beyond its limit, and their distances; ties with the last are included."""
        middle, low = self.estimates(codes, query)
        reach = limit**2 * (1 + 1e-6)
        for q, m, lo, most in zip(query, middle, low, reach, strict=True):
            if lo.min() > most:
                yield np.zeros(0, np.int64), np.zeros(0)
                continue
            some = np.argpartition(m, min(4 * k, len(m)) - 1)[: 4 * k]
            first = np.sort(((vectors[some] - q) ** 2).sum(1))
            at = np.flatnonzero(lo <= min(most, first[min(k, len(first)) - 1] * (1 + 1e-6)))
            at = np.union1d(at, some)
            distance = np.sqrt(((vectors[at] - q) ** 2).sum(1))
            keep = distance <= np.partition(distance, min(k, len(at)) - 1)[min(k, len(at)) - 1]
            yield at[keep], distance[keep]


class Best:
    """The k nearest found so far of each query of a block, ties with the last included."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.limit = np.full(len(ids), np.inf)
        self.found = [(np.zeros(0, np.int64), np.zeros(0))] * len(ids)

    def add(self, at: int, nodes: np.ndarray, distance: np.ndarray) -> None:
        if not len(nodes):
            return
        nodes, distance = (np.concatenate(x) for x in zip(self.found[at], (nodes, distance), strict=True))
        if len(nodes) >= self.k:
            self.limit[at] = np.partition(distance, self.k - 1)[self.k - 1]
            near = distance <= self.limit[at]
            nodes, distance = nodes[near], distance[near]
        self.found[at] = nodes, distance

    def batches(self, size: int = 512) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.ids), size):
            part = self.found[at : at + size]
            query = np.repeat(self.ids[at : at + size], [len(n) for n, _ in part])
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate([n for n, _ in part])), pa.array(np.concatenate([d for _, d in part]))], ["query_id", "node", "score"])


def usable(vectors: DataFrame) -> DataFrame:
    """The rows with an id and a vector that is not null, empty, zero, or with a null or non-finite component."""
    v = F.col("embedding")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull()).where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")


def distinct_vectors(vectors: DataFrame, most: int, salts: int = 32) -> DataFrame:
    """(node, vec_ids, embedding): each different vector once, with its `most` smallest ids in order.

    No search for fewer than `most` neighbours can miss anything by that. Ids are cut to the smallest in salted parts first, so a
    vector that a third of the rows share is no group of that size.
    """
    rows = vectors.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
    for key in (["embedding", "salt"], ["embedding"]):
        rows = rows.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy("vec_id"))).where(F.col("at") <= most)
    groups = rows.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("vec_ids"))
    return groups.select(F.col("vec_ids")[0].alias("node"), "vec_ids", "embedding")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = np.array([len(x) for x in batch.column(at)])
    for size in np.unique(sizes):
        yield int(size), batch.filter(pa.array(sizes == size))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, sample: int = 20_000, centroids: int = 32, rotations: int = 4, code_block: int = 8192, query_block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each query row by Euclidean distance, ties to smaller ids.

    The rotation and the centroids are fitted on about `sample` vectors chosen by hash; every usable vector is coded.
    Rows that are not `usable` take no part; vectors of another length are not compared; all rows with a query's id count as
    its own; repeated ids are found once. A query without other rows has no result. A pass over the codes takes about
    `query_block` queries, which the driver holds at a time.
    """
    spark = vectors.sparkSession
    sound = usable(vectors)
    nodes = shared_table(distinct_vectors(sound, k + 1), "vectors")
    queries = shared_table(sound.where(is_query).dropDuplicates(["vec_id"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))), "queries")
    total, asked = nodes.count(), queries.count()
    if not total or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = min(1.0, sample / total)
    rows = nodes.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("node", "embedding").orderBy("node").limit(2 * sample).toArrow()
    frames = {}
    for batch in rows.combine_chunks().to_batches():
        frames |= {size: Frame(_matrix(part.column(1)), centroids, rotations) for size, part in _by_length(batch, 1)}
    shared = spark.sparkContext.broadcast(frames)
    frame_of = lambda size: shared.value.get(size) or Frame(np.zeros((1, size)), 1, rotations)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, own in _by_length(batch, 1):
                frame = frame_of(size)
                for at in range(0, own.num_rows, code_block):
                    part = own.slice(at, code_block)
                    x = _matrix(part.column(1))
                    cells = [c.tobytes() for c in (part.column(0).to_numpy(), x, *frame.encode(x))]
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]], ["size", *CELLS])

    codes = shared_table(nodes.select("node", "embedding").mapInArrow(encode, "size int, " + ", ".join(f"{c} binary" for c in CELLS)), "codes")

    def scanned(block) -> DataFrame:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {size: Best(ids, k + 1) for size, (ids, _) in block.value.items()}
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    size = row["size"]
                    if size not in best:
                        continue
                    asked, own = block.value[size][1], best[size]
                    node = np.frombuffer(row["nodes"], np.int64)
                    x = np.frombuffer(row["vectors"]).reshape(len(node), size)
                    code = (np.frombuffer(row["near"], np.int32), np.frombuffer(row["packed"], np.uint8).reshape(len(node), -1), np.frombuffer(row["length"]), np.frombuffer(row["own"]).reshape(len(node), -1))
                    for at in range(0, len(asked), 256):
                        near = frame_of(size).nearest(code, x, asked[at : at + 256], k + 1, own.limit[at : at + 256].copy())
                        for j, (columns, distance) in enumerate(near, at):
                            own.add(j, node[columns], distance)
            for own in best.values():
                yield from own.batches()

        return codes.mapInArrow(scan, "query_id long, node long, score double")

    passes, parts = [], -(-asked // query_block)
    for part in range(parts):
        chosen = queries.where(F.col("part") % parts == part).select("vec_id", "embedding").toArrow().combine_chunks().to_batches()
        by_size: dict[int, list] = {}
        for batch in chosen:
            for size, own in _by_length(batch, 1):
                by_size.setdefault(size, []).append((own.column(0).to_numpy(), _matrix(own.column(1))))
        block = spark.sparkContext.broadcast({size: tuple(np.concatenate(x) for x in zip(*found, strict=True)) for size, found in by_size.items()})
        passes.append(shared_table(scanned(block), "found"))
        block.destroy()
    shared.destroy()
    found = reduce(DataFrame.unionByName, passes)
    pairs = found.join(nodes.select("node", "vec_ids"), "node").select("query_id", "score", F.explode("vec_ids").alias("vec_id")).where("vec_id <> query_id")
    by_query = Window.partitionBy("query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = pairs.withColumn("rank", F.row_number().over(by_query.orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_digest(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, F.col("vec_id") % 100 == 0)
