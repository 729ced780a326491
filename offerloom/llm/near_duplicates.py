"""Near-duplicate documents with SetSketch registers.

Each set of word shingles is summarised by registers: exponentially spaced, truncated values of the minima of m exponential
variables, merged by maximum. Equal registers of two sets are about as likely as their Jaccard similarity, so bands of
registers find candidates; the similarity of a candidate is estimated by the joint likelihood of greater, smaller and equal
registers given both set sizes, and what may reach the threshold is verified on the full sets.

Equal sets are one node from the start. In a bucket of a band, members are linked with the bucket's two leaders, chance members
of it, so a bucket of any size costs two candidates a member. The best of these for each node are verified and make components,
then the others that still join two of these.
Of the buckets that still hold several components, small ones give all their pairs between these; the members of large ones meet
by the rarest shingles of their full sets, which misses no pair that can reach the threshold. Registers and full sets are
written once, for nodes that share a bucket with another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import components
from .shared import shared_table
from .texts import U64, VISIBLE, mixed, pieces, raw, runs_of, words

REGISTERS = 200
BAND = 5
BANDS = REGISTERS // BAND
#: Members of a bucket of which all pairs are candidates; the sets of larger ones meet by the prefixes of their full sets.
SMALL = 32
#: Sets of one side that a block of a shingle's pairs has.
BLOCK = 256
#: Columns of 64 bits in which a set's members leave their parities.
PARITY = tuple(f"m{i}" for i in range(8))
#: The base of the spacing and the largest value of a register.
BASE = 1.001
TOP = 65_534
#: Points are drawn until a set has FIRST for each register on average; where a register is empty then (odds of e**-8 each), until
#: it has DENSITY, after which one stays empty with odds of e**-24.
FIRST, DENSITY = 8.0, 24.0
#: Points that are drawn at a time.
CELLS = 1 << 16


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the word shingles of each row; fewer words than `size` are one shingle, none are none."""
    starts, _, hashes = words(data, bounds, VISIBLE)
    first = np.searchsorted(starts, bounds)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        out.append(np.unique(runs_of(hashes[a:b], min(size, max(1, b - a)))))
    return out


def _draw(minimum: np.ndarray, seed: np.ndarray, owner: np.ndarray, limit: np.ndarray) -> None:
    """Lower `minimum` (a cell for each set and register) by all points of the members before their limits in time."""
    time, step = np.zeros(len(seed)), 0
    while len(seed):
        many = max(1, min(CELLS // len(seed), 64))
        draw = mixed(seed[:, None] + np.arange(step + 1, step + many + 1, dtype=U64) * U64(0xA0761D6478BD642F))
        gap = np.log(((draw >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / -REGISTERS
        gap[:, 0] += time
        times = np.cumsum(gap, axis=1)
        live = times < limit[:, None]
        row, at = np.nonzero(live)
        register = (mixed(draw[row, at]) % U64(REGISTERS)).astype(np.int64)
        np.minimum.at(minimum, owner[row] * REGISTERS + register, times[row, at])
        more = live[:, -1]
        seed, owner, limit, time = seed[more], owner[more], limit[more], times[more, -1]
        step += many


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of each set, one row of REGISTERS numbers each; an empty set has zeros.

    A member makes a Poisson process of points in time, each with a register drawn by hash; a register's minimum is its first
    point of any member. Points later than the time by which every register has one change nothing, so they are not drawn:
    most sets are done after FIRST points a register, however large they are, and the others go on to DENSITY.
    """
    size = np.array([len(s) for s in sets], np.int64)
    minimum = np.full(len(sets) * REGISTERS, np.inf)
    seed, owner = np.concatenate([*sets, np.zeros(0, U64)]), np.repeat(np.arange(len(sets)), size)
    for density in (FIRST, DENSITY):
        unfilled = np.isinf(minimum.reshape(-1, REGISTERS)).any(1)[owner]
        seed, owner = seed[unfilled], owner[unfilled]
        _draw(minimum, seed, owner, density / size[owner])
    # A set of n members has minima near 1/n; the spacing covers sets up to e**(TOP * log(BASE)) members.
    value = np.floor(1 - np.log(np.maximum(minimum, 1e-300)) / np.log(BASE)) + 8_000
    return np.where(np.isinf(minimum), 0, np.clip(value, 1, TOP)).astype(np.uint16).reshape(-1, REGISTERS)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(uid, doc_id, tid, n_shingles, same, registers): uid is a scrambled row number, tid a hash of the text, same one of the set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                sets = shingle_sets(*raw(piece.column(0)), size)
                table = registers(sets)
                uid = mixed(piece.column(1).to_numpy().view(U64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid), *piece.columns[2:], pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.sha256(s.tobytes()).digest()[:16] for s in sets], pa.binary()), pa.array([r.tobytes() for r in table], pa.binary())],
                    ["uid", "doc_id", "tid", "n_shingles", "same", "registers"],
                )

    rows = docs.select("text", F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tid"))
    return rows.mapInArrow(sketch, "uid long, doc_id long, tid long, n_shingles long, same binary, registers binary")


def joint_similarity(first: np.ndarray, second: np.ndarray, n1: np.ndarray, n2: np.ndarray, grid: int = 101) -> np.ndarray:
    """The similarity of greatest likelihood for each pair of register rows and set sizes."""
    more, less = (first > second).sum(1), (first < second).sum(1)
    same = first.shape[1] - more - less
    u = n1 / (n1 + n2)
    v = 1 - u
    best, at = np.full(len(u), -np.inf), np.zeros(len(u))
    chance = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)
    for share in np.linspace(0, 1, grid):
        j = share * np.minimum(u / v, v / u)
        up, down = (np.clip(chance(np.clip(x, 0, 1)), 1e-12, 1) for x in (u - v * j, v - u * j))
        likelihood = more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))
        better = likelihood > best
        best[better], at[better] = likelihood[better], j[better]
    return at


def estimated(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The (a, b) pairs whose estimated similarity reaches `least`, with it."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                r = [np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3)]
                n = [part.column(i).to_numpy().astype(float) for i in (4, 5)]
                j = joint_similarity(*r, *n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(j)], ["a", "b", "j"]).filter(pa.array(j >= least))

    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "r_a", "r_b", "n_a", "n_b")
    rows = rows.where(F.least("n_a", "n_b") >= (least - 1e-9) * F.greatest("n_a", "n_b"))
    return rows.mapInArrow(estimate, "a long, b long, j double")


def full_sets(nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(node, n, members, m0, …): the full set of each node, as its sorted shingle hashes, from the text of its representative, and the
    parities of how many members fall to each of 64 * len(PARITY) places."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tid"), "text")
    owners = nodes.select("node", F.col("rep_id").alias("doc_id"), F.col("rep_tid").alias("tid"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                sets = shingle_sets(*raw(piece.column(0)), size)
                places = 64 * len(PARITY)
                odd = np.array([np.bincount((s % U64(places)).astype(np.int64), minlength=places) & 1 for s in sets], np.uint8)
                parity = np.packbits(odd, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([piece.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), *[pa.array(np.ascontiguousarray(x)) for x in parity.T]], ["node", "n", "members", *PARITY])

    rows = texts.join(owners, texts.doc_id.eqNullSafe(owners.doc_id) & (texts.tid == owners.tid)).select("text", "node")
    return rows.mapInArrow(cut, "node long, n long, members binary, " + ", ".join(f"{m} long" for m in PARITY)).dropDuplicates(["node"])


def near_enough(percent: int) -> Column:
    """Whether sizes (n_a, n_b) and parities (a_m0, b_m0, …) of two sets let them reach the threshold.

    Each place where the parities differ has a member that only one of the sets has, and sets of that similarity have at most
    (100 - percent) * (n_a + n_b) / (100 + percent) such members.
    """
    apart = reduce(add, [F.bit_count(F.col(f"a_{m}").bitwiseXOR(F.col(f"b_{m}"))) for m in PARITY])
    alike = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return alike & ((100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b")))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs with 100 * |intersection| >= percent * |union| on the full sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                both = np.frombuffer(x.as_py() + y.as_py(), U64).copy()
                both.sort(kind="stable")  # which merges two sorted runs
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda x, y: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("members").alias(y))
    rows = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return rows.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """(node, bucket): a row for each node and band; the bucket is a hash of the band's registers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                table = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, BAND).astype(U64)
                band = np.zeros(table.shape[:2], U64)
                for i in range(BAND):
                    band = mixed(band + table[:, :, i] + U64(i))
                bucket = mixed(band + np.arange(BANDS, dtype=U64))
                node = part.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, BANDS)), pa.array(bucket.ravel().view(np.int64))], ["node", "bucket"])

    return nodes.select("node", "registers").mapInArrow(cut, "node long, bucket long")


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node, members, low, high) of the buckets of two members or more; low and high are the bucket's leaders.

    Nodes are scrambled numbers, so the smallest and the largest are chance members, and near copies, which share many
    buckets, have the same leaders in most.
    """
    rows = bucket_rows(nodes)
    state = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("low"), F.max("node").alias("high")).where("members > 1")
    return shared_table(rows.join(state, "bucket"), "met")


def led_pairs(met: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b: each member of a bucket with the two leaders of the bucket."""
    pairs = met.select("node", F.explode(F.array("low", "high")).alias("leader")).where("node <> leader")
    return pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def open_buckets(rows: DataFrame, label: DataFrame) -> DataFrame:
    """(node, bucket, component, members) of the buckets whose members are not all in one component."""
    named = rows.join(label, "node", "left").select("node", "bucket", "members", F.coalesce("component", "node").alias("component"))
    state = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return shared_table(named.join(state.select("bucket"), "bucket"), "open")


def _side(x: str) -> list[Column]:
    return [F.col("node").alias(x), F.col("component").alias(f"c_{x}"), F.col("n").alias(f"n_{x}"), *[F.col(m).alias(f"{x}_{m}") for m in PARITY]]


def cross_pairs(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of different components that can reach the threshold, in the buckets of SMALL members at most; prefix_pairs has those
    of larger ones."""
    few = rows.where(F.col("members") <= SMALL).drop("members").join(sets.select("node", "n", *PARITY), "node")
    return few.select("bucket", *_side("a")).join(few.select("bucket", *_side("b")), "bucket").where((F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & near_enough(percent)).select("a", "b")


def shingle_rows(sets: DataFrame) -> DataFrame:
    """(node, n, shingle): a row for each member of each full set."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                node, n = part.column(0).to_numpy(), part.column(1).to_numpy()
                members = np.frombuffer(b"".join(part.column(2).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, n)), pa.array(np.repeat(n, n)), pa.array(members)], ["node", "n", "shingle"])

    return sets.select("node", "n", "members").mapInArrow(explode, "node long, n long, shingle long")


def prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """(node, n, shingle, place): the rarest shingles of each set, of which two sets of that similarity share one at least.

    Sets are put into one order, by the number of the given sets that have a shingle, then by its hash. If A and B share at least
    percent * |A| / 100 members, the first that they share is at a place of A before |A| - percent * |A| / 100, counted from
    0, and likewise in B. Shingles of one set only come first and link nothing, so they are counted but not ranked.
    """
    shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    common = rows.join(shared, "shingle").withColumn("common", F.count(F.lit(1)).over(Window.partitionBy("node")))
    place = F.col("n") - F.col("common") + F.row_number().over(Window.partitionBy("node").orderBy("sets", "shingle")) - 1
    return common.withColumn("place", place).where(100 * (F.col("n") - F.col("place")) >= percent * F.col("n")).select("node", "n", "shingle", "place")


def prefix_pairs(sets: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b), a < b, of different components: all pairs of the sets that can reach the threshold, and few that cannot.

    Two sets that reach it share a shingle of their prefixes, their sizes and parities are near enough, and from the first shared
    shingle on each has as many members as the intersection needs. Shingles that many prefixes have are met in salted blocks.
    """
    rows = prefixes(shared_table(shingle_rows(sets), "shingles"), percent)
    named = rows.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = shared_table(named, "prefixes")
    open_ = named.groupBy("shingle").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    rows = named.join(open_.select("shingle", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks")), "shingle")
    rows = rows.join(sets.select("node", *PARITY), "node")
    left = rows.select("shingle", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.col("place").alias("p_a"), *_side("a"))
    right = rows.select("shingle", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("place").alias("p_b"), *_side("b"))
    enough = (100 + percent) * F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) >= percent * (F.col("n_a") + F.col("n_b"))
    met = (left["shingle"] == right["shingle"]) & (left["block"] == right["block"]) & (F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b"))
    return left.join(right, met & enough & near_enough(percent)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, margin: float = 0.14, with_node: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs, which needs doc_id and text.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of `size`-word shingles; component_id
    is the smallest doc_id that links lead to. Null texts and texts without words have an empty set and link with nothing.
    A null id counts for component_id only if its component has no other; kept is doc_id = component_id, nulls alike. Repeated
    rows are one set, so they share a component and are kept or not together. `with_node` adds the number of the component and
    the hash of the text.
    """
    base = shared_table(sketches(docs, size), "sketches")
    filled = base.where("n_shingles > 0")
    first = filled.groupBy("same").agg(F.min("uid").alias("uid"))
    nodes = filled.join(first.select("uid"), "uid", "left_semi")
    nodes = shared_table(nodes.select(F.col("uid").alias("node"), "same", F.col("doc_id").alias("rep_id"), F.col("tid").alias("rep_tid"), "n_shingles", "registers"), "nodes")
    met = shared_buckets(nodes)
    # What shares no bucket is done; registers and full sets go on for the others only.
    near = shared_table(nodes.join(met.select("node").distinct(), "node", "left_semi"), "near")
    sets = shared_table(full_sets(near, docs, size), "sets")

    # First each node's best pair with a leader, then the other pairs with leaders, then whatever is left between different components.
    least = percent / 100 - margin
    led = shared_table(estimated(led_pairs(met), near, least), "led")
    sides = led.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", "j")
    best = sides.groupBy("node").agg(F.max(F.struct("j", F.negative("a").alias("na"), "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    best = shared_table(best, "best")
    label = shared_table(components(shared_table(verified(best, sets, percent), "links")), "label")
    rest = between(led.select("a", "b").join(best, ["a", "b"], "left_anti"), label)
    label = shared_table(joined_components(label, verified(rest, sets, percent)), "label")
    rows = open_buckets(met, label)
    large = sets.join(rows.where(F.col("members") > SMALL).select("node").distinct(), "node", "left_semi")
    left = cross_pairs(rows, sets, percent).unionByName(prefix_pairs(large, label, percent)).distinct().join(led, ["a", "b"], "left_anti")
    links = verified(estimated(shared_table(left, "left"), near, least), sets, percent)
    label = joined_components(label, links)

    named = base.select("doc_id", "tid", "n_shingles", "uid", "same").join(nodes.select("same", "node"), "same", "left").join(label, "node", "left")
    named = named.withColumn("component", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).otherwise(F.col("uid")))
    ids = shared_table(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "ids")  # written, so that Spark can split the join below
    facts = named.join(ids, "component").select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("component").alias("node"), "tid")
    return facts if with_node else facts.drop("node", "tid")


def between(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs whose nodes are not in one component yet."""
    side = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    rows = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return rows.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")


def joined_components(label: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (node, component) after more links between nodes, found on one node for each component."""
    side = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    rows = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    joined = components(shared_table(rows, "links"))
    renamed = label.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return renamed.unionByName(joined.join(label, "node", "left_anti"))


def near_duplicates_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text"), size=4)


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without all but one of each group of near-duplicates: that of smallest doc_id (nulls last) stays.

    Of rows given twice one stays, unless they are without words: texts with an empty set are no duplicates of anything.
    Columns pass through unchanged.
    """
    names = docs.columns
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("text_hash"))
    chosen = near_duplicates(docs.select("doc_id", "text"), size, percent, with_node=True)
    lead = chosen.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tid")).alias("m"))
    lead = lead.select(F.col("m.doc_id").alias("k"), F.col("m.tid").alias("t")).distinct()
    same = F.col("id").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("t"))
    empty = ~F.coalesce(F.col("row.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = keyed.join(lead, same, "left_semi").where(~empty)
    # a hash of the whole row tells rows given twice
    once = kept.withColumn("n", F.row_number().over(Window.partitionBy("id", "text_hash").orderBy(F.to_json("row")))).where("n = 1")
    return once.select("row.*").unionByName(keyed.where(empty).select("row.*"))
