"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash of `GRAM` bytes marks triggers: the place where it is smallest (the first such) in a window of `length` bytes. A
window's content alone decides its trigger, so equal windows anywhere have the same trigger at the same distance, and the
triggers cut each text into phrases (runs of windows with one trigger) that copies share. The dictionary keeps each
different phrase with its first occurrence in corpus order. Where all phrases of a trigger are equal, that first occurrence settles
every window of the phrase. Where a trigger has several phrases, as at the edges of copies, the suffixes of the
dictionary phrases are sorted to a depth of `length` bytes, trigger by trigger, and equal neighbours are put in corpus order.

A trigger that many documents have with different phrases, as at the edges of a passage that a third of the corpus shares, is hot:
its phrases are dealt out by their own hashes, sorted in parts, and of each part only the windows that it has first go on, to be
compared with those of the other parts by hash. A sample tells which triggers are hot; that only decides how work is dealt out.

Hashes group: triggers by 32 bits of theirs (a clash costs a sort, not a wrong answer), phrases by 64 bits beside the trigger's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_table
from .texts import BYTE_VALUE, PIECE, U64, _powers, mixed, pieces, raw

GRAM = 32
#: Bytes of text whose phrases make one row for each bucket, and a bucket's share of the whole text.
CHUNK = 1 << 24
LAST = (1 << 63) - 1
#: A bucket's share of the dictionary phrases to be sorted.
SORTED = 20_000
#: Documents that hot triggers are looked for in, and the share of them, and least number, with different phrases that makes one hot.
SAMPLE, HOT_SHARE, HOT_LEAST = 8_000, 0.002, 32
#: Numbers of hot triggers begin here; windows of theirs that a part takes.
HOT, PART = 1 << 62, 1_000_000
COLUMNS = [("t", np.uint32), ("c", np.uint64), ("o", np.int64), ("v", np.uint32), ("lo", np.int32), ("span", np.uint8), ("back", np.uint8)]


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over x[i : i + width], for each i that has so many."""
    span = 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def phrases(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(trigger hash, phrase hash, first window, last window, trigger's place) of the phrases of a text of `length` bytes or more."""
    n, width = len(data), length - GRAM + 1
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(BYTE_VALUE[data] * up[:n], out=sums[1:])
    gram = mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    key = (gram & U64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=U64)
    owner = (_slide(key, width, np.minimum) & U64(0xFFFFFFFF)).astype(np.int64)
    first = np.append(0, np.flatnonzero(np.diff(owner)) + 1)
    last, at = np.append(first[1:] - 1, len(owner) - 1), owner[first]
    content = mixed((sums[last + length] - sums[first]) * down[first]) + mixed((at - first).astype(U64) << U64(8) | (last - first).astype(U64))
    return gram[at], mixed(content), first, last, at


def _segments(data: np.ndarray, length: int) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """The phrases of a text of any length: long texts in overlapping segments, each begun with the phrase that the last one cut."""
    start = 0
    while True:
        end = min(start + PIECE, len(data))
        found = phrases(data[start:end], length)
        if end == len(data):
            yield start, found
            return
        yield start, tuple(x[:-1] for x in found)
        start += int(found[2][-1])


def _again(group: tuple[np.ndarray, ...], o: np.ndarray, v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by group, o, v and place: which repeat one of a smaller o or an earlier one of their own text, and which are
    the row before again, as rows given twice have them."""
    changed = lambda *columns: np.append(True, np.any([x[1:] != x[:-1] for x in columns], 0))[: len(o)]
    head = lambda new: np.flatnonzero(new)[np.cumsum(new) - 1]
    own = changed(*group, o, v)
    return (o > o[head(changed(*group))]) | (at > at[head(own)]), ~own & ~changed(at)


def hot_triggers(docs: DataFrame, length: int, total: int) -> np.ndarray:
    """The sorted hashes of the triggers that have many different phrases in a sample of about SAMPLE of `total` (text, o, v) rows.

    There are at most as many as the sample has phrases, over HOT_LEAST and HOT_SHARE of its documents.
    """
    share = min(1.0, SAMPLE / max(1, total))
    least = max(HOT_LEAST, int(HOT_SHARE * min(total, SAMPLE)))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                data, bounds = raw(piece.column(0))
                found = [x[:2] for a, b in zip(bounds[:-1], bounds[1:], strict=True) for _, x in _segments(data[a:b], length)]
                t, c = (np.concatenate(x) for x in zip(*found, strict=True))
                pairs = np.unique(np.stack([t, c]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in np.ascontiguousarray(pairs)], ["t", "c"])

    chosen = docs.where(F.pmod(F.xxhash64("o", "v"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("text")
    counts = chosen.mapInArrow(parse, "t long, c long").distinct().groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return np.sort(counts.select("t").toArrow()["t"].to_numpy().view(U64))


def phrase_rows(docs: DataFrame, length: int, buckets: int, hot: np.ndarray) -> DataFrame:
    """Packed phrases of (text, o, v) rows: a row for each bucket and chunk of text, of equal phrases in a chunk only the first; the
    others, known to be repeats, are a row of a bucket below 0, which the chunk's first phrase draws. Phrases of hot triggers
    have buckets from `buckets` on, which their own hashes draw."""

    def pack(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        t, c, o, v, lo, span, back = (np.concatenate(x) for x in zip(*parts, strict=True))
        bucket = (t % U64(buckets)).astype(np.int64)
        at = np.minimum(np.searchsorted(hot, t), len(hot) - 1)
        is_hot = hot[at] == t if len(hot) else np.zeros(len(t), bool)
        bucket = np.where(is_hot, buckets + (mixed(c) % U64(buckets)).astype(np.int64), bucket)
        t = np.where(is_hot, at.astype(np.uint32), (t // U64(buckets)).astype(np.uint32))
        rank = np.lexsort((lo, v, o, c, t, bucket))
        t, c, o, v, lo, span, back, bucket = (x[rank] for x in (t, c, o, v, lo, span, back, bucket))
        again, twice = _again((bucket, t, c), o, v, lo)
        # rows of one id with other texts are kept: they are neither earlier nor later
        keep, again = np.flatnonzero(~again & ~twice), again & ~twice
        cuts = np.append(np.flatnonzero(np.diff(bucket[keep], prepend=-2)), len(keep))
        groups = [(int(bucket[keep[a]]), keep[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        groups.append((-1 - int(mixed(c[:1])[0] % U64(buckets)), np.flatnonzero(again)))
        cells = [[x[g].tobytes() for _, g in groups] for x in (t, c, o, v, lo, span, back)]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in groups], pa.int64()), *[pa.array(x, pa.binary()) for x in cells]], ["bucket", *[n for n, _ in COLUMNS]])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for piece in pieces(batch):
                data, bounds = raw(piece.column(0))
                os, vs = piece.column(1).to_numpy(), piece.column(2).to_numpy()
                for a, b, o, v in zip(bounds[:-1], bounds[1:], os, vs, strict=True):
                    for start, (t, c, first, last, at) in _segments(data[a:b], length):
                        n = len(t)
                        parts.append((t, c, np.full(n, o), np.full(n, v & 0xFFFFFFFF, np.uint32), (first + start).astype(np.int32), (last - first).astype(np.uint8), (at - last).astype(np.uint8)))
                held += len(data)
                if held >= CHUNK and parts:
                    yield pack(parts)
                    parts, held = [], 0
        if parts:
            yield pack(parts)

    return docs.mapInArrow(parse, "bucket long, " + ", ".join(f"{n} binary" for n, _ in COLUMNS))


def _settler(buckets: int):
    def settle(table: pa.Table) -> pa.Table:
        """Of a bucket: phrases that repeat an earlier one, and first ones whose trigger has other phrases too (kind 1)."""
        t, c, o, v, lo, span, back = (np.frombuffer(b"".join(table[n].to_pylist()), kind) for n, kind in COLUMNS)
        bucket = table["bucket"][0].as_py()
        if bucket < 0:
            kind, show = np.zeros(len(t), np.int8), np.ones(len(t), bool)
        else:
            rank = np.lexsort((lo, v, o, c, t))
            t, c, o, v, lo, span, back = (x[rank] for x in (t, c, o, v, lo, span, back))
            new_t = np.append(True, t[1:] != t[:-1])
            new_c = new_t | np.append(True, c[1:] != c[:-1])
            group = np.cumsum(new_c) - 1
            repeat, twice = _again((group,), o, v, lo)
            rival = ~repeat & ~new_c
            several = np.bincount(np.cumsum(new_t) - 1, new_c)[np.cumsum(new_t) - 1] > 1 if bucket < buckets else np.ones(len(t), bool)
            kind, show = np.where(repeat, 0, 1).astype(np.int8), (repeat | several | rival) & ~twice
        return pa.table({"o": o[show], "v": v[show].astype(np.int64), "lo": lo[show], "span": span[show].astype(np.int32), "back": back[show].astype(np.int32), "t": t[show].astype(np.int64) + (bucket << 32 if bucket < buckets else HOT), "kind": kind[show]})

    return settle


def _content(windows: np.ndarray, d: int) -> np.ndarray:
    """A hash of each row of bytes and the distance d."""
    width = -(-windows.shape[1] // 8) * 8
    cells = np.zeros((len(windows), width), np.uint8)
    cells[:, : windows.shape[1]] = windows
    total = np.full(len(windows), d + 1, U64)
    for word in cells.view(U64).T:
        total = mixed(total ^ word) * U64(0x9E3779B97F4A7C15)
    return mixed(total)


def _sorter(length: int, parts: int):
    def settle(table: pa.Table) -> pa.Table:
        """Of a bucket of dictionary phrases: which of their windows equal a window that starts earlier, as bits from the first on; and
        the windows of hot triggers that the bucket has first, packed for each part."""
        t, o, v, lo, span, back = (table[n].to_numpy() for n in ("t", "o", "v", "lo", "span", "back"))
        texts = table["text"].combine_chunks()
        data, bounds = raw(texts)
        at = lo + span + back
        order = np.lexsort((at, v, o))
        bits = np.zeros((len(t), length), bool)
        key = t.astype(">i8").view(np.uint8).reshape(-1, 8)
        first = []
        for d in range(length - GRAM + 1):  # windows of one trigger are equal only at one distance from it
            start = at[order] - d
            rows = order[(start >= lo[order]) & (start <= (lo + span)[order])]
            if not len(rows):
                continue
            begin = bounds[rows] + at[rows] - d - lo[rows]
            suffix = np.empty((len(rows), 8 + length), np.uint8)
            suffix[:, :8] = key[rows]
            suffix[:, 8:] = data[begin[:, None] + np.arange(length)]
            rank = np.argsort(suffix.view(f"V{8 + length}").ravel(), kind="stable")
            ordered = suffix[rank]
            new = np.append(True, (ordered[1:] != ordered[:-1]).any(1))
            r = rows[rank]
            later, _ = _again((np.cumsum(new),), o[r], v[r], at[r])
            bits[r[later], (at - d - lo)[r[later]]] = True
            ours = np.flatnonzero(~later & (t[r] >= HOT))
            if len(ours):
                first.append((_content(ordered[ours], d), o[r[ours]], v[r[ours]], (at[r[ours]] - d).astype(np.int32)))
        some = bits.any(1)
        found = {"o": o[some], "v": v[some], "lo": lo[some].astype(np.int32), "bits": pa.array([x.tobytes() for x in np.packbits(bits[some], axis=1)], pa.binary())}
        if not first:
            return pa.table({**found, "part": pa.nulls(int(some.sum()), pa.int64()), "windows": pa.nulls(int(some.sum()), pa.binary())})
        cells = [np.concatenate(x) for x in zip(*first, strict=True)]
        part = (cells[0] >> U64(20)) % U64(parts)
        rank = np.argsort(part, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(part[rank].astype(np.int64), prepend=-1)), len(rank))
        packed = [b"".join(x[rank[a:b]].tobytes() for x in cells) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        more, fill = len(packed), int(some.sum())
        return pa.table(
            {
                "o": np.append(found["o"], np.zeros(more, np.int64)),
                "v": np.append(found["v"], np.zeros(more, np.int64)),
                "lo": np.append(found["lo"], np.zeros(more, np.int32)),
                "bits": pa.concat_arrays([found["bits"], pa.nulls(more, pa.binary())]),
                "part": pa.concat_arrays([pa.nulls(fill, pa.int64()), pa.array(part[rank][cuts[:-1]].astype(np.int64))]),
                "windows": pa.concat_arrays([pa.nulls(fill, pa.binary()), pa.array(packed, pa.binary())]),
            }
        )

    return settle


def _joined(table: pa.Table) -> pa.Table:
    """Of a part: the windows that equal one that starts earlier, as (o, v, lo)."""
    parts = []
    for x in table["windows"].to_pylist():
        n = len(x) // 28
        parts.append([np.frombuffer(x, kind, n, start * n) for kind, start in ((np.uint64, 0), (np.int64, 8), (np.int64, 16), (np.int32, 24))])
    h, o, v, w = (np.concatenate(x) for x in zip(*parts, strict=True))
    rank = np.lexsort((w, v, o, h))
    later, _ = _again((h[rank],), o[rank], v[rank], w[rank])
    r = rank[later]
    return pa.table({"o": o[r], "v": v[r], "lo": w[r]})


def repeated(docs: DataFrame, length: int = 100) -> DataFrame:
    """(o, v, lo, span, bits) of the repeated windows of (text, o, v) rows: windows lo to lo + span, or those set in bits from lo."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(F.octet_length("text") >= length).alias("rows")).first()
    long = docs.where(F.octet_length("text") >= length)
    chunks = max(8, -(-(total["bytes"] or 0) // CHUNK))
    rows = phrase_rows(long, length, chunks, hot_triggers(long, length, total["rows"]))
    cells = rows.groupBy("bucket").applyInArrow(_settler(chunks), "o long, v long, lo int, span int, back int, t long, kind byte")
    cells = shared_table(cells, "phrases")
    open_ = cells.where("kind = 1")
    asked = open_.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.when(F.col("t") >= HOT, F.col("span") + 1)), F.lit(0)).alias("windows")).first()
    buckets, parts = max(1, -(-asked["rows"] // SORTED)), max(1, -(-asked["windows"] // PART))
    listed = open_.groupBy("o", "v").agg(F.collect_list(F.struct("lo", "span", "back", "t")).alias("open"))
    with_text = listed.join(long.dropDuplicates(["o", "v"]).select(F.col("o").alias("o2"), F.col("v").alias("v2"), "text"), (F.col("o") == F.col("o2")) & (F.col("v") == F.col("v2")))
    entries = with_text.select("o", "v", "text", F.explode("open").alias("p"))
    text = F.substring(F.col("text").cast("binary"), F.col("p.lo") + 1, F.col("p.span") + length)
    # phrases of a trigger are sorted together, those of a hot one wherever they fall
    deal = F.when(F.col("p.t") >= HOT, F.xxhash64("o", "v", "p.lo")).otherwise(F.xxhash64("p.t"))
    entries = entries.select("o", "v", "p.lo", "p.span", "p.back", "p.t", text.alias("text"), F.pmod(deal, F.lit(buckets)).alias("bucket"))
    edges = entries.groupBy("bucket").applyInArrow(_sorter(length, parts), "o long, v long, lo int, bits binary, part long, windows binary")
    edges = shared_table(edges, "edges")
    apart = edges.where("part is not null").select("part", "windows").groupBy("part").applyInArrow(_joined, "o long, v long, lo int")
    none, zero = F.lit(None), F.lit(0)
    found = cells.where("kind = 0").select("o", "v", "lo", "span", none.cast("binary").alias("bits"))
    found = found.unionByName(edges.where("part is null").select("o", "v", "lo", none.cast("int").alias("span"), "bits"))
    return found.unionByName(apart.select("o", "v", "lo", zero.alias("span"), none.cast("binary").alias("bits")))


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of docs, which needs doc_id and text.

    Each byte inside a string of `length` bytes that also starts earlier (in a smaller doc_id, or earlier in the same document) is
    removed; `kept` holds the other bytes. A null text is empty; texts shorter than `length` stay whole. A null id
    comes after all others. Rows of equal id are neither before nor after each other, so a row given twice keeps what one keeps.
    """
    own = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("o"), F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)).alias("v"))
    marks = repeated(own, length).groupBy("o", "v").agg(F.collect_list(F.struct("lo", "span", "bits")).alias("marks")).withColumnsRenamed({"o": "mo", "v": "mv"})
    rows = own.join(marks, (F.col("o") == F.col("mo")) & (F.col("v") == F.col("mv")), "left").select("text", "o", "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                data, bounds = raw(piece.column(0))
                facts = []
                for a, b, marks in zip(bounds[:-1], bounds[1:], piece.column(2).to_pylist(), strict=True):
                    text = data[a:b]
                    if not marks:
                        facts.append((len(text), 0, 0, text.tobytes()))
                        continue
                    edge = np.zeros(len(text) + 1, np.int32)
                    for m in marks:
                        if m["bits"] is None:
                            edge[m["lo"]] += 1
                            edge[m["lo"] + m["span"] + length] -= 1
                        else:
                            starts = m["lo"] + np.flatnonzero(np.unpackbits(np.frombuffer(m["bits"], np.uint8)))
                            np.add.at(edge, starts, 1)
                            np.add.at(edge, starts + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    facts.append((len(text), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])).sum()), text[~gone].tobytes()))
                n, removed, spans, kept = zip(*facts, strict=True)
                yield pa.RecordBatch.from_arrays([piece.column(1), *[pa.array(x, pa.int64()) for x in (n, removed, spans)], pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())], ["o", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = rows.mapInArrow(cut, "o long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(F.nullif("o", F.lit(LAST)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def repeats_digest(docs: DataFrame) -> DataFrame:
    return without_repeats(docs.select("doc_id", "text")).drop("kept")
