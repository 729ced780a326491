"""Alignment of two tokenizers' tokens over the same bytes.

Offsets where tokens of both end cut a text's tokens into groups. A byte range of a text gives a fragment: the tokens before its first such
offset (open prefix), the closed groups, and the tokens after its last one (open suffix). Two neighbouring fragments compose into one:
the suffix of the left and the prefix of the right become a closed group, or stay open where a fragment has no cut. That is associative, so
the chunks of a long document are encoded in tasks of their own and composed as a tree, `FAN` at a time; only open ends travel.

Neither tokenizer joins anything across a space that follows a character other than white space, so a text is a sequence of units that are encoded
alone, once for all their occurrences in a task's cache; a chunk reads on to the ends of the units that its ends fall into and keeps the tokens
that end inside it. Units are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import shared_table
from .texts import BYTE_VALUE, U64, mixed, pieces, raw, trimmed

FILES = ("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")
#: Bytes of a text from which it is cut into chunks of so many.
CHUNK = 1 << 16
#: Fragments that a task of the tree composes.
FAN = 32
#: Bytes of the longest unit that is kept by its hash, units that a worker keeps before it forgets those not met since as many others, and units encoded at once.
KEPT, CACHE, BLOCK = 256, 150_000, 2000
#: Bytes of texts handled at a time.
SLICE = 1 << 21
#: Units whose groups are written as text at a time.
TOLD = 8192
#: Token pairs that are broadcast at once, 17 bytes each.
PAIRS = 4_000_000
SPACES = np.array([b in (*range(9, 14), *range(28, 33)) for b in range(256)])
_POWERS = np.multiply.accumulate(np.full(KEPT, 0x9E3779B97F4A7C15, U64))
_LOADED: dict[str, Encoder] = {}


def _byte_of() -> dict[str, int]:
    """The character by which byte-level vocabularies write each byte: visible ones of Latin-1 as they are, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _gather(bounds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the entries of rows, in a table where row i has entries bounds[i] to bounds[i + 1]."""
    size = bounds[rows + 1] - bounds[rows]
    return np.repeat(bounds[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(_bounds(values)[bounds])


def packed(values: np.ndarray) -> bytes:
    kind = np.uint8 if not len(values) or values.max() < 256 else np.uint16 if values.max() < 65536 else np.uint32
    return np.dtype(kind).char.encode() + values.astype(kind).tobytes()


def unpacked(value: bytes) -> np.ndarray:
    return np.frombuffer(value, np.dtype(chr(value[0])), offset=1).astype(np.int64)


class Encoder:
    """Both tokenizers, and the tokens and groups of the units met so far."""

    def __init__(self, file_a: bytes, file_b: bytes):
        self.a, self.b = tokenizers.Tokenizer.from_buffer(file_a), sentencepiece.SentencePieceProcessor(model_proto=file_b)
        self.a.encode_special_tokens = True
        byte_of, vocabulary = _byte_of(), json.loads(file_a)["model"]["vocab"]
        self.bytes_a = [b""] * (max(self.a.get_vocab_size(), max(vocabulary.values()) + 1))
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        ids = range(self.b.vocab_size())
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in ids)]
        self.size_a, self.size_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.known: dict[int, bytes] = {}
        self.before: dict[int, bytes] = {}

    def units(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts (after the space in front), ends and rows of the units; a space stands in front of each row's first one too."""
        at = np.flatnonzero(data == 0x20)
        at = at[~np.isin(at, bounds[:-1])]
        one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        wide = (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | (three == 0xE1) & (two == 0x9A) | (three == 0xE2) & ((two == 0x80) | (two == 0x81)) | (three == 0xE3) & (two == 0x80)
        at = at[~(SPACES[one] | wide)]
        at = at[~np.isin(at + 1, bounds[1:])]  # a space that ends a row
        firsts = bounds[:-1][np.diff(bounds) > 0]
        starts = np.concatenate([firsts, at])
        order = np.argsort(starts, kind="stable")
        skip = np.concatenate([np.zeros(len(firsts), np.int64), np.ones(len(at), np.int64)])[order]
        starts = starts[order]
        ends = np.concatenate([starts[1:], bounds[-1:]])[: len(starts)]
        return starts + skip, ends, np.searchsorted(bounds, starts, "right") - 1

    def _alone(self, content: str) -> bytes:
        a, b = np.array(self.a.encode(" " + content, add_special_tokens=False).ids, np.int64), np.array(self.b.encode(content, num_threads=1), np.int64)
        whole = b" " + content.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return np.zeros(2, np.uint32).tobytes()
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        cut = [np.diff(np.searchsorted(x, both, "right"), prepend=0) for x in (end_a, end_b)]
        return np.concatenate([[len(both), len(a)], *cut, a, b]).astype(np.uint32).tobytes()

    def _block(self, contents: list[str]) -> list[bytes]:
        """What _alone gives for each; encoded in one go, as units do not see each other."""
        raw_units = [b" " + c.encode() for c in contents]
        whole = b"".join(raw_units)
        a = self.a.encode_batch_fast(["".join(" " + c for c in contents)], add_special_tokens=False)[0].ids
        b = self.b.encode(" ".join(contents), num_threads=1)
        same = b"".join(map(self.bytes_a.__getitem__, a)) == whole == b"".join(map(self.bytes_b.__getitem__, b))
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        end_a, end_b, ends = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]), np.cumsum([len(x) for x in raw_units])
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        if not same or not np.isin(ends, both).all():
            return [self._alone(c) for c in contents]
        cut_a, cut_b = (np.searchsorted(x, both, "right") for x in (end_a, end_b))
        g = np.searchsorted(both, ends, "right")
        # each unit's numbers of groups and tokens, then its parts one after the other
        parts = [(np.diff(cut_a, prepend=0), g), (np.diff(cut_b, prepend=0), g), (a, cut_a[g - 1]), (b, cut_b[g - 1])]
        sizes = [np.diff(last, prepend=0) for _, last in parts]
        bounds = _bounds(2 + sum(sizes))
        flat, at = np.zeros(bounds[-1], np.uint32), bounds[:-1] + 2
        flat[at - 2], flat[at - 1] = sizes[0], sizes[2]
        for (values, last), n in zip(parts, sizes, strict=True):
            flat[np.repeat(at - last + n, n) + np.arange(last[-1])] = values[: last[-1]]
            at = at + n
        packed_units, places = flat.tobytes(), (4 * bounds).tolist()
        return [packed_units[i:j] for i, j in zip(places[:-1], places[1:], strict=True)]

    def encoded(self, data: np.ndarray, bounds: np.ndarray) -> tuple[Units, np.ndarray, np.ndarray]:
        """The different units of the rows, the unit at each occurrence, and each row's number of occurrences."""
        starts, ends, rows = self.units(data, bounds)
        if not len(starts):
            return Units.of([]), np.zeros(0, np.int64), np.zeros(len(bounds) - 1, np.int64)
        size = ends - starts
        short = np.minimum(size, KEPT)
        hashes = np.zeros(len(starts), U64)
        with np.errstate(over="ignore"):
            for i in range(0, len(starts), 1 << 16):
                begin, n = starts[i : i + (1 << 16)], short[i : i + (1 << 16)]
                at = _bounds(n)
                inside = np.arange(at[-1]) - np.repeat(at[:-1], n)
                sums = np.zeros(at[-1] + 1, U64)
                np.cumsum(BYTE_VALUE[data[np.repeat(begin, n) + inside]] * _POWERS[inside], out=sums[1:])
                hashes[i : i + (1 << 16)] = mixed(sums[at[1:]] - sums[at[:-1]] + size[i : i + (1 << 16)].astype(U64))
            long = np.flatnonzero(size > KEPT)  # each on its own
            hashes[long] = mixed(long.astype(U64) ^ U64(0x5851F42D4C957F2D))
        hashes, first, codes = np.unique(hashes, return_index=True, return_inverse=True)
        found = [self.known.get(h) or self.before.get(h) if s <= KEPT else None for h, s in zip(hashes.tolist(), size[first].tolist(), strict=True)]
        new = [i for i, x in enumerate(found) if x is None]
        last, block = data[ends[first] - 1], []
        for i in new:
            content = data[starts[first[i]] : ends[first[i]]].tobytes().decode("utf-8", "replace")
            if SPACES[last[i]] or size[first[i]] > KEPT or content != content.rstrip():
                found[i] = self._alone(content)
            else:
                block.append((i, content))
        for at in range(0, len(block), BLOCK):
            some = block[at : at + BLOCK]
            for (i, _), value in zip(some, self._block([c for _, c in some]), strict=True):
                found[i] = value
        if len(self.known) > CACHE:
            self.known, self.before = {}, self.known
        self.known.update((h, value) for h, value, s in zip(hashes.tolist(), found, size[first].tolist(), strict=True) if s <= KEPT)
        return Units.of(found), codes.ravel(), np.bincount(rows, minlength=len(bounds) - 1)


@dataclass
class Units:
    """Groups of each unit, tokens of each group, and the tokens' ids. A unit without a group is one whose bytes the tokens do not give back."""

    groups: np.ndarray
    of_a: np.ndarray
    of_b: np.ndarray
    a: np.ndarray
    b: np.ndarray

    @classmethod
    def of(cls, values: list[bytes]) -> Units:
        flat = np.frombuffer(b"".join(values), np.uint32).astype(np.int64)
        at = _bounds(np.array([len(v) // 4 for v in values], np.int64))
        groups, tokens = (flat[at[:-1] + i] for i in range(2)) if values else (np.zeros(0, np.int64),) * 2
        cuts = np.stack([at[:-1] + 2, at[:-1] + 2 + groups, at[:-1] + 2 + 2 * groups, at[:-1] + 2 + 2 * groups + tokens, at[1:]], 1) if values else np.zeros((0, 5), np.int64)
        part = lambda i: flat[_gather(cuts[:, i : i + 2].ravel(), np.arange(0, 2 * len(values), 2))]
        return cls(groups, *(part(i) for i in range(4)))

    def packed(self) -> list[bytes]:
        return [packed(x) for x in (self.groups, self.of_a, self.of_b, self.a, self.b)]

    def bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _bounds(self.groups), _bounds(self.of_a), _bounds(self.of_b)

    def links(self, size_b: int) -> tuple[np.ndarray, np.ndarray]:
        """The id pairs of all links, a * size_b + b, and the bounds of the units in them."""
        of_unit, at_a, at_b = self.bounds()
        each = self.of_a * self.of_b
        inside = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        wide = np.repeat(self.of_b, each)
        keys = self.a[np.repeat(at_a[:-1], each) + inside // wide] * size_b + self.b[np.repeat(at_b[:-1], each) + inside % wide]
        return keys, _bounds(each)[of_unit]

    def texts(self) -> list[str]:
        """a1,a2|b1;a3|b2,b3 of each unit; worked out for a block of units at a time, as numbers as Python's text take many times their bytes."""
        bounds, out = self.bounds(), []
        for at in range(0, len(self.groups), TOLD):
            of_unit = bounds[0][at : at + TOLD + 1]
            at_a, at_b = (x[of_unit[0] : of_unit[-1] + 1] for x in bounds[1:])
            a, b = (list(map(str, x[i[0] : i[-1]].tolist())) for x, i in ((self.a, at_a), (self.b, at_b)))
            of_unit, at_a, at_b = ((x - x[0]).tolist() for x in (of_unit, at_a, at_b))
            groups = [",".join(a[i:j]) + "|" + ",".join(b[k:m]) for i, j, k, m in zip(at_a[:-1], at_a[1:], at_b[:-1], at_b[1:], strict=True)]
            out += [groups[i] if j == i + 1 else ";".join(groups[i:j]) for i, j in zip(of_unit[:-1], of_unit[1:], strict=True)]
        return out


PARTS = ("groups", "of_a", "of_b", "a", "b")


def _loaded(files) -> Encoder:
    if files.id not in _LOADED:
        _LOADED.clear()
        _LOADED[files.id] = Encoder(*files.value)
    return _LOADED[files.id]


def _unloaded() -> None:
    """Python workers stay from stage to stage: what comes after the encoding has no use for the tokenizers and their units."""
    if _LOADED:
        _LOADED.clear()
        trimmed()


class _Files:
    """The two vocabulary files, read by the driver and broadcast: a few MB whatever the corpus."""

    def __init__(self, spark, paths: tuple[str, str]):
        content = [Path(p).read_bytes() for p in paths]
        self.id, self._sent = hashlib.sha256(b"".join(content)).hexdigest(), spark.sparkContext.broadcast(content)
        self.size_b = sentencepiece.SentencePieceProcessor(model_proto=content[1]).vocab_size()

    @property
    def value(self) -> list[bytes]:
        return self._sent.value


@dataclass
class Alignment:
    """Encoded texts as tables: a row of `short` is a batch of documents with the units they have in common; `long` has the closed
    groups of the chunks and those that the tree closed, by number of the document and place; `numbered` has the long documents' columns."""

    short: DataFrame
    long: DataFrame
    numbered: DataFrame
    key: str
    size_b: int


def _kinds(key: T.DataType) -> T.StructType:
    fields = [("part", T.LongType()), ("keys", T.ArrayType(key)), ("occurrences", T.BinaryType()), ("codes", T.BinaryType()), *[(p, T.BinaryType()) for p in PARTS]]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", files: tuple[str, str] = FILES, chunk: int = CHUNK) -> Alignment:
    """Encode all texts by both tokenizers. Null and empty texts, and texts that a tokenizer does not give back, have no tokens;
    repeated rows are documents of their own; other columns are not looked at."""
    spark = docs.sparkSession
    sent = _Files(spark, files)
    rows = docs.select(F.col(text).alias("text"), F.col(key).alias("key"))
    is_long = F.coalesce(F.octet_length("text") >= chunk, F.lit(False))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _loaded(sent), TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, SLICE):
                units, codes, occurrences = encoder.encoded(*raw(piece.column(0)))
                keys = piece.column(1)
                columns = [pa.array([part]), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), *[pa.array([x], pa.binary()) for x in (packed(occurrences), packed(codes), *units.packed())]]
                yield pa.RecordBatch.from_arrays(columns, ["part", "keys", "occurrences", "codes", *PARTS])
                part += 1
                del units, codes, occurrences, columns
                trimmed()
        trimmed()

    short = shared_table(rows.where(~is_long).mapInArrow(encode, _kinds(docs.schema[key].dataType)), "encoded")
    numbered = shared_table(rows.where(is_long).withColumn("r", F.monotonically_increasing_id()), "long-texts")
    return Alignment(short, _composed(numbered, sent, chunk), numbered.drop("text"), key, sent.size_b)


def _chunks(numbered: DataFrame, sent: _Files, chunk: int) -> DataFrame:
    """(r, k, bytes, lo, hi, end): chunks and their units' bytes; tokens that end after lo and not after hi are theirs. A unit is cut
    once at most, so that a text without spaces is encoded twice and no more."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _loaded(sent)
        for batch in batches:
            for r, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(x.as_buffer(), np.uint8)
                # places count the space in front of the text, and so a unit begins where its content does in the text
                starts, ends, _ = encoder.units(data, np.array([0, len(data)]))
                inner = np.arange(chunk, len(data), chunk)
                inner = inner[np.unique(np.searchsorted(starts, inner, "right"), return_index=True)[1]]
                places = [0, *inner.tolist(), len(data) + 1]
                for k, (lo, hi) in enumerate(zip(places[:-1], places[1:], strict=True)):
                    u, v = (np.searchsorted(starts, [lo, hi - 1], "right") - 1).tolist()
                    own = int(starts[u])
                    yield pa.RecordBatch.from_pydict({"r": [r], "k": pa.array([k], pa.int32()), "bytes": [data[own : ends[v]].tobytes()], "lo": [lo - own], "hi": [hi - own]})

    return numbered.select("r", F.col("text").cast("binary")).mapInArrow(cut, "r long, k int, bytes binary, lo long, hi long")


OPEN = ("pre_a", "pre_b", "suf_a", "suf_b")


def fragments(chunks: DataFrame, sent: _Files) -> DataFrame:
    """A chunk's fragment: its open ends, the chunk of its first cut (null: none), and its closed groups; `bad`: the bytes do not come back."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _loaded(sent)
        for batch in batches:
            for row in batch.to_pylist():
                data = np.frombuffer(row["bytes"], np.uint8)
                units, codes, _ = encoder.encoded(data, np.array([0, len(data)]))
                bad = bool((units.groups[codes] == 0).any())
                of_unit, at_a, at_b = units.bounds()
                g = _gather(of_unit, codes)
                a, b = units.a[_gather(at_a, g)], units.b[_gather(at_b, g)]
                end_a, end_b = np.cumsum(encoder.size_a[a]), np.cumsum(encoder.size_b[b])
                in_a, in_b = ((x > row["lo"]) & (x <= row["hi"]) for x in (end_a, end_b))
                a, b, end_a, end_b = a[in_a], b[in_b], end_a[in_a], end_b[in_b]
                both = np.intersect1d(end_a, end_b, assume_unique=True)
                cut_a, cut_b = (np.searchsorted(x, both, "right") for x in (end_a, end_b))
                i, j, m, n = (int(cut_a[0]), int(cut_b[0]), int(cut_a[-1]), int(cut_b[-1])) if len(both) else (len(a), len(b), len(a), len(b))
                closed = Units(np.array([max(0, len(both) - 1)]), np.diff(cut_a), np.diff(cut_b), a[i:m], b[j:n])
                ends = dict(zip(OPEN, ([x.tolist()] for x in (a[:i], b[:j], a[m:], b[n:])), strict=True))
                yield pa.RecordBatch.from_pydict({"r": [row["r"]], "k": pa.array([row["k"]], pa.int32()), "bad": [bad], "first": pa.array([row["k"] if len(both) else None], pa.int32()), **{c: pa.array(v, pa.list_(pa.int32())) for c, v in ends.items()}, **{p: [x] for p, x in zip(PARTS, closed.packed(), strict=True)}})
        trimmed()

    kinds = "r long, k int, bad boolean, first int, " + ", ".join(f"{c} array<int>" for c in OPEN) + ", " + ", ".join(f"{p} binary" for p in PARTS)
    return chunks.mapInArrow(encode, kinds)


def compose(rows: pd.DataFrame) -> tuple[dict, list[tuple[int, list, list]]]:
    """One fragment of neighbouring ones (in order of k), and the groups that close between them: (chunk that closes it, a, b)."""
    state, closed = None, []
    for row in rows.sort_values("k").to_dict("records"):
        row = {k: list(v) if k in OPEN else None if k == "first" and pd.isna(v) else v for k, v in row.items()}
        if state is None:
            state = row
        elif state["first"] is None:  # all is open still
            state |= {"pre_a": state["pre_a"] + row["pre_a"], "pre_b": state["pre_b"] + row["pre_b"], "first": row["first"], "suf_a": row["suf_a"], "suf_b": row["suf_b"]}
        elif row["first"] is None:
            state |= {"suf_a": state["suf_a"] + row["pre_a"], "suf_b": state["suf_b"] + row["pre_b"]}
        else:
            closed.append((int(row["first"]), state["suf_a"] + row["pre_a"], state["suf_b"] + row["pre_b"]))
            state |= {"suf_a": row["suf_a"], "suf_b": row["suf_b"]}
    return state, closed


_OPEN_ROW = "r long, k int, first int, " + ", ".join(f"{c} array<int>" for c in OPEN)


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    state, closed = compose(rows)
    done = [{"r": state["r"], "k": 2 * k, "pre_a": a, "pre_b": b, "suf_a": [], "suf_b": [], "closed": True} for k, a, b in closed]
    return pd.DataFrame([state | {"k": int(rows["up"].iloc[0]), "closed": False}, *done])[["r", "k", "first", *OPEN, "closed"]].astype({"first": "Int32"})


def _composed(numbered: DataFrame, sent: _Files, chunk: int) -> DataFrame:
    """(r, place, and the parts of closed groups) of the long texts whose bytes come back."""
    rows = shared_table(fragments(_chunks(numbered, sent, chunk).repartition("r", "k"), sent), "fragments")
    good = rows.join(rows.where("bad").select("r").distinct(), "r", "left_anti")
    closed = good.select("r", (2 * F.col("k") + 1).alias("place"), *PARTS)
    level, top = good.select("r", "k", "first", *OPEN), rows.agg(F.max("k")).first()[0] or 0
    between = level.where("false").select("r", F.col("k").alias("place"), "pre_a", "pre_b")
    while top:
        top //= FAN
        level = shared_table(level.withColumn("up", F.expr(f"k div {FAN}").cast("int")).groupBy("r", "up").applyInPandas(_fold, _OPEN_ROW + ", closed boolean"), "composed")
        between = between.unionByName(level.where("closed").select("r", F.col("k").alias("place"), "pre_a", "pre_b"))
        level = level.where("not closed").drop("closed")
    # a text's start is a cut as well, so what is before its first one is a group
    between = between.unionByName(level.select("r", F.lit(0).alias("place"), "pre_a", "pre_b"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(np.array(a, np.int64), np.array(b, np.int64)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            parts = zip(*[Units(np.array([1]), np.array([len(a)]), np.array([len(b)]), a, b).packed() for a, b in rows], strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(p, pa.binary()) for p in parts]], ["r", "place", *PARTS])

    groups = between.where(F.size("pre_a") > 0).mapInArrow(pack, "r long, place int, " + ", ".join(f"{p} binary" for p in PARTS))
    return shared_table(closed.unionByName(groups), "closed")


def _batch(row: dict) -> tuple[Units, np.ndarray, np.ndarray]:
    """The units of a row of `short`, the unit at each occurrence, and the bounds of the documents in them; documents with a unit that does
    not come back have none."""
    units, codes, occurrences = Units(*(unpacked(row[p]) for p in PARTS)), unpacked(row["codes"]), unpacked(row["occurrences"])
    bounds = _bounds(occurrences)
    bad = _sums((units.groups[codes] == 0).astype(np.int64), bounds) > 0
    if bad.any():
        codes, occurrences = codes[~np.repeat(bad, occurrences)], np.where(bad, 0, occurrences)
    return units, codes, _bounds(occurrences)


def _piece(row: dict) -> Units:
    """The groups of a row of `long`, as one unit."""
    units = Units(*(unpacked(row[p]) for p in PARTS))
    units.groups = np.array([units.groups.sum()])
    return units


def link_counts(found: Alignment) -> DataFrame:
    """(a, b, n, best): in how many documents the ids are linked, and whether no other b is linked with a in more. Tasks add up what
    their documents hold before anything is shuffled; the pairs of long documents are made different first."""
    size_b = found.size_b

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _unloaded()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def added() -> None:
            keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
            keys, at = np.unique(keys, return_inverse=True)
            held[:] = [(keys, np.bincount(at, n, len(keys)).astype(np.int64))]

        for batch in batches:
            for row in batch.to_pylist():
                units, codes, bounds = _batch(row)
                keys, at = units.links(size_b)
                keys, inverse = np.unique(keys, return_inverse=True)
                inverse, n = inverse.ravel().astype(np.int32), np.zeros(len(keys), np.int64)
                for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    if j > i:
                        n[np.unique(inverse[_gather(at, np.unique(codes[i:j]))])] += 1
                held.append((keys[n > 0], n[n > 0]))
                if sum(len(k) for k, _ in held) > 1_000_000:
                    added()
                    if len(held[0][0]) > 500_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["pair", "n"])
        if held:
            added()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], ["pair", "n"])
        trimmed()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _unloaded()
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.unique(_piece(row).links(size_b)[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row["r"])), pa.array(keys)], ["r", "pair"])

    short = found.short.mapInArrow(count, "pair long, n long")
    long = found.long.mapInArrow(spread, "r long, pair long").distinct().groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    pairs = short.unionByName(long).groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = shared_table(pairs.select(F.expr(f"pair div {size_b}").alias("a"), F.expr(f"pair % {size_b}").alias("b"), "n"), "links")
    most = pairs.groupBy("a").agg(F.max("n").alias("most"))
    return pairs.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


FACTS = ("n_a", "n_b", "n_groups", "n_links")


def _formed(units: Units, codes: np.ndarray, bounds: np.ndarray, texts: bool = True) -> tuple[dict[str, np.ndarray], Iterator[str]]:
    """Counts and the groups' text for each document of a batch, the texts one at a time."""
    of_unit, at_a, at_b = units.bounds()
    per_unit = (at_a[of_unit[1:]] - at_a[of_unit[:-1]], at_b[of_unit[1:]] - at_b[of_unit[:-1]], units.groups, _sums(units.of_a * units.of_b, of_unit))
    told = units.texts() if texts else []
    joined = (";".join([told[c] for c in codes[i:j].tolist()]) for i, j in (zip(bounds[:-1], bounds[1:], strict=True) if texts else ()))
    return {f: _sums(x[codes], bounds) for f, x in zip(FACTS, per_unit, strict=True)}, joined


def token_groups(found: Alignment) -> DataFrame:
    """(key, place, groups): the groups as text a1,a2|b1;a3|b2,b3, a row for a document; for a long one several, by place."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column("keys")[i].values, pa.array(list(_formed(*_batch(row))[1]), pa.string())], ["key", "groups"])

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pydict({"r": [row["r"]], "place": pa.array([row["place"]], pa.int32()), "groups": _piece(row).texts()})

    key = found.numbered.schema["key"].dataType
    few = found.short.mapInArrow(short, T.StructType([T.StructField("key", key), T.StructField("groups", T.StringType())])).select("key", F.lit(0).alias("place"), "groups")
    many = found.long.mapInArrow(long, "r long, place int, groups string").where("groups <> ''").join(found.numbered, "r").select("key", "place", "groups")
    return few.unionByName(many).withColumnRenamed("key", found.key)


def _blocks(counts: DataFrame, size_b: int) -> list:
    """The counted pairs in broadcasts of about PAIRS each: sorted keys, counts, and which are their a's best."""
    counts = shared_table(counts.select((F.col("a") * size_b + F.col("b")).alias("pair"), "n", "best"), "counted")
    blocks = max(1, -(-counts.count() // PAIRS))
    for i in range(blocks):
        rows = counts.where(F.pmod(F.hash("pair"), F.lit(blocks)) == i).toArrow().sort_by("pair")
        yield i, blocks, counts.sparkSession.sparkContext.broadcast(tuple(rows[c].to_numpy() for c in ("pair", "n", "best")))


def linked(found: Alignment, counts: DataFrame) -> DataFrame:
    """Per document: its key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 ('' without tokens).

    The counted pairs are broadcast in blocks of a fixed size, one narrow pass over the encoded texts for each. The hash of a long document's
    groups is taken in order of place by one task, piece by piece."""
    size_b, key = found.size_b, found.numbered.schema["key"].dataType

    def sums(units: Units, block) -> tuple[np.ndarray, np.ndarray]:
        keys, n, best = block.value
        pair, at = units.links(size_b)
        if not len(keys):
            return (np.zeros(len(at) - 1, np.int64),) * 2
        place = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        here = keys[place] == pair
        return _sums(here & best[place], at), _sums(np.where(here, n[place], 0), at)

    def short(block, first: bool):
        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _unloaded()
            for batch in batches:
                for i, row in enumerate(batch.to_pylist()):
                    units, codes, bounds = _batch(row)
                    facts, texts = _formed(units, codes, bounds, first)
                    best, total = (_sums(x[codes], bounds) for x in sums(units, block))
                    hashes = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts] if first else [None] * len(best)
                    n = len(best)
                    columns = [pa.array(np.full(n, row["part"])), pa.array(np.arange(n)), batch.column("keys")[i].values, *[pa.array(x if first else np.zeros(n, np.int64)) for x in facts.values()], pa.array(best), pa.array(total), pa.array(hashes, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "at", "key", *FACTS, "n_best", "count_sum", "groups_sha256"])
                    del units, codes, texts
                    trimmed()

        return apply

    def long(block, first: bool):
        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _unloaded()
            for batch in batches:
                for row in batch.to_pylist():
                    units = _piece(row)
                    facts, _ = _formed(units, np.array([0]), np.array([0, 1]), False)
                    best, total = sums(units, block)
                    yield pa.RecordBatch.from_arrays([pa.array([row["r"]]), *[pa.array(x if first else np.zeros(1, np.int64)) for x in facts.values()], pa.array(best), pa.array(total)], ["r", *FACTS, "n_best", "count_sum"])
            trimmed()

        return apply

    numbers = [*FACTS, "n_best", "count_sum"]
    longs = ", ".join(f"{c} long" for c in numbers)
    kind = T.StructType([T.StructField("part", T.LongType()), T.StructField("at", T.LongType()), T.StructField("key", key), *[T.StructField(c, T.LongType()) for c in numbers], T.StructField("groups_sha256", T.StringType())])
    few = many = None
    for i, blocks, block in _blocks(counts, size_b):
        one, other = found.short.mapInArrow(short(block, i == 0), kind), found.long.mapInArrow(long(block, i == 0), f"r long, {longs}")
        if blocks > 1:
            one, other = shared_table(one, "sums"), shared_table(other, "sums")
        few, many = (one, other) if few is None else (few.unionByName(one), many.unionByName(other))
    if blocks > 1:
        few = few.groupBy("part", "at").agg(F.first("key").alias("key"), *[F.sum(c).alias(c) for c in numbers], F.max("groups_sha256").alias("groups_sha256"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _unloaded()
        own, r, begun = hashlib.sha256(), None, False
        for batch in batches:
            for row in batch.to_pylist():
                if row["r"] != r:
                    if r is not None:
                        yield pa.RecordBatch.from_pydict({"r": [r], "groups_sha256": [own.hexdigest()]})
                    own, r, begun = hashlib.sha256(), row["r"], False
                if text := _piece(row).texts()[0]:
                    own.update((";" * begun + text).encode())
                    begun = True
        if r is not None:
            yield pa.RecordBatch.from_pydict({"r": [r], "groups_sha256": [own.hexdigest()]})

    hashes = found.long.repartition("r").sortWithinPartitions("r", "place").mapInArrow(hashed, "r long, groups_sha256 string")
    many = many.groupBy("r").agg(*[F.sum(c).alias(c) for c in numbers]).join(hashes, "r")
    many = found.numbered.join(many, "r", "left").select("key", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return few.select("key", *numbers, "groups_sha256").unionByName(many).withColumnRenamed("key", found.key)


def alignment_digest(docs: DataFrame) -> DataFrame:
    found = align(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    return linked(found, link_counts(found))
