"""Small cases for each operator, against brute force where SQL has no words for it."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from offerloom.llm import decontamination, language, mixing, near_duplicates, neighbours, quotations, repeats, sharding, toxicity, warc
from offerloom.llm.components import components
from offerloom.llm.texts import ALNUM, FOLD, VISIBLE, raw, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Copies, near copies, ties, nulls in each column, empty and long texts, rows given twice."""
    rng = random.Random(3)
    base = [sentence(rng, rng.randrange(20, 120)) for _ in range(40)]
    rows = [(i, t, rng.choice(["en", "fr"]), rng.choice(["a", "b", "b", "b", None]), len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[5], "en", "b", 1) for i in range(30)]
    rows += [(200 + i, " ".join(w if j != 3 * i else "changed" for j, w in enumerate(base[6].split())), "en", "b", 1) for i in range(20)]
    rows += [(300, None, None, None, None), (301, "", "en", "a", 0), (302, "...", "en", "a", 3), (303, "One two", "en", "a", 7), (304, "ONE two", "fr", "a", 7)]
    rows += [(305, sentence(rng, 30_000, 5000), "en", "b", 1), (None, base[7] + " x", "en", "a", 1), (306, base[8], "en", "a", 1), (306, base[8], "en", "a", 1)]
    rows += [(307, "é" * 150 + " ß" * 80, "fr", "c", 1), (308, "ab" * 400, "en", "c", 1)]
    return frame(spark, rows)


def test_sharding_rows_and_slots(spark, docs):
    rows = sharding.shard_digest(docs, shards=7).collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(v) for v in slots.values()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        b = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(b) + 16, zlib.crc32(b), "rows", None)


def test_mixing_without_ids_comes_near_the_targets(spark):
    rows = [(None, f"a b c {i}" if same else "one of many", "x") for same in (0, 1) for i in range(400)] + [(7, "again", "y")] * 500 + [(i, "w " * 40, "z") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_digest(docs).collect()
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[r.source] - r.target) < 0.12 * r.target for r in got)
    numbers = mixing.numbered(docs, most=7).groupBy("doc_id", "text", "source").agg(F.sort_array(F.collect_list("number")).alias("n")).collect()
    assert all(r.n == list(range(len(r.n))) for r in numbers) and sum(len(r.n) for r in numbers) == len(rows)


def test_sharding_keeps_the_mixture(spark):
    rows = [(i, str(i), "en", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(3000)]
    got = sharding.interleave_shards(frame(spark, rows), 10).groupBy("shard", "source").count().collect()
    whole = defaultdict(int)
    for r in rows:
        whole[r[3]] += 1
    for r in got:
        assert abs(r["count"] - whole[r.source] / 10) <= 2
    assert sharding.interleave_shards(frame(spark, []), 3).collect() == []


def brute_targets(sizes):
    """Excess over three times a source's size goes to the others by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mixing_targets_and_copies(spark, docs):
    rows = mixing.mix_digest(docs).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
    want = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
    texts = [x.text for x in docs.collect()]
    assert sum(sizes.values()) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_digest(docs.repartition(3)).collect()))
    copies = sum(r.copies for r in rows)
    assert mixing.mix(docs).count() == copies and mixing.mix(docs).columns == docs.columns


def test_language_learns_and_ignores_labels(spark):
    rng = random.Random(1)
    parts = {"en": ["the", "ing", "and", "tion"], "fr": ["eau", "les", "que", "ais"]}
    text = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(30))
    rows = [(i, text(lang), lang, "s", 1) for i in range(300) for lang in [rng.choice(["en", "fr"])]]
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "123 !!", "fr", "s", 0), (None, text("fr"), None, None, None)]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in language.language_digest(df).collect()}
    assert len(got) == len(rows)
    for i, _, lang, *_ in rows[:300]:
        held = zlib.crc32(str(i).encode()) % 4 == 2
        assert got[i].held_out == held and got[i].lang_pred == lang and 0.5 < got[i].score <= 1
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[None].lang_pred == "fr" and not got[None].held_out
    noise = [(910, "".join(random.Random(1).choice("bcdfghjklmnpqrstvwxz ") for _ in range(900)), "en", "s", 0), (911, "не знакомый язык, которого никто не учил " * 9, "xx", "s", 0)]
    learned = [r for r in rows if r[2] != "xx"]
    assert {r.doc_id for r in language.confident(frame(spark, learned)).collect()} == set(range(300)) | {None}
    odd = language.predict(frame(spark, [*learned, *noise]), language.fit(frame(spark, learned), F.lit(True)))
    foreign = odd.where("bits > 4.5 * octet_length(text) + 64 and lang_pred <> 'und'")
    assert {r.doc_id for r in foreign.collect()} == {910, 911}
    assert language.language_digest(frame(spark, [])).collect() == []


def brute_bits(learned, text, alphabet):
    """Bits of the last symbol of a byte string after up to three before it, by trees of dictionaries; None stands before a text."""
    trees = defaultdict(lambda: defaultdict(int))
    for x in learned:
        symbols = [None, None, None, *x]
        for i in range(3, len(symbols)):
            for order in range(4):
                trees[tuple(symbols[i - order : i])][symbols[i]] += 1

    def probabilities(context):
        if context is None:
            return {s: 1 / len(alphabet) for s in alphabet}
        shorter, seen = probabilities(context[1:] if context else None), trees.get(context)
        if not seen:
            return shorter
        total, rest = sum(seen.values()), sum(p for s, p in shorter.items() if s not in seen)
        escape = len(seen) / (total + len(seen)) if len(seen) < len(alphabet) else 0
        return {s: seen[s] / total * (1 - escape) if s in seen else escape * p / rest for s, p in shorter.items()}

    symbols, bits = [None, None, None, *text], 0
    for i in range(3, len(symbols)):
        chances = probabilities(tuple(symbols[i - 3 : i]))
        assert math.isclose(sum(chances.values()), 1)
        bits -= math.log2(chances[symbols[i] if symbols[i] in chances else -1])
    return bits


def test_code_lengths_match_brute_force(spark):
    rng = random.Random(9)
    text = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 90)))
    learned = {"x": [text("aab cé") for _ in range(20)], "y": [text("abbd ") for _ in range(9)], "z": ["a"]}
    rows = [(i, t, lang, None, None) for i, (lang, t) in enumerate((lang, t) for lang, ts in learned.items() for t in ts)]
    trees = language.fit(frame(spark, rows), F.lit(True))
    asked = [*(text("abcdé e!") for _ in range(40)), "a", *learned["y"], "ab d" * 200]
    got = trees.lengths(*raw(pa.array(asked)))
    # the last symbol stands for all bytes that nothing was learned of
    alphabet = {b for ts in learned.values() for t in ts for b in t.lower().encode()} | {-1}
    for i, lang in enumerate(trees.langs):
        want = [brute_bits([t.lower().encode() for t in learned[lang]], t.lower().encode(), alphabet) for t in asked]
        assert np.allclose(got[:, i], want, rtol=1e-5, atol=1e-4)


def test_long_texts_teach_by_a_passage(spark):
    rows = [(0, "le chat noir " * 20_000, "fr", None, None), (1, "the black cat " * 60_000, "en", None, None)]
    trees = language.fit(frame(spark, rows), F.lit(True))
    got = {r.doc_id: r.lang_pred for r in language.predict(frame(spark, rows + [(2, "the black cat", None, None, None), (3, "le chat noir", None, None, None)]), trees).collect()}
    assert got == {0: "fr", 1: "en", 2: "en", 3: "fr"}


def brute_neighbours(rows, k):
    sound = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in sound:
        if q % 100 == 0:
            near = sorted({(math.dist(x, y), i) for i, y in sound if i != q and len(y) == len(x)})
            out[q] = [(i, d) for d, i in near[:k]]
    return out


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((600, 16)).astype(np.float32)
    vectors[40:90] = vectors[0]
    vectors[100:103] = vectors[200]
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [None] * 16), (800, [1.0, 2.0]), (801, [1.0, 2.5]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.nearest_digest(df).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = brute_neighbours(rows, 10)
    assert set(got) == set(q for q, v in want.items() if v)
    for q, near in got.items():
        near.sort()
        assert [r for r, _, _ in near] == list(range(1, len(near) + 1))
        assert [i for _, i, _ in near] == [i for i, _ in want[q]]
        assert all(math.isclose(s, d, rel_tol=1e-12) for (_, _, s), (_, d) in zip(near, want[q], strict=True))


def test_warc_round_trip(spark, tmp_path):
    big = "".join(f"<p>{i} é\r\n\r\nWARC/1.1\r\n</p>" for i in range(3000))
    rows = [(1, "http://a/", "x"), (2, None, None), (3, "http://b/\r\nx", big), (4, "u", "x"), (5, "u", ""), (6, "u", big), (7, "u", "0\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archive_digest(df).collect()}
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", 0), i)
    for i, _, h in rows:
        b = (h or "").encode()
        want = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if last[h or ""] == i else "revisit", None if last[h or ""] == i else last[h or ""])
        assert tuple(got[i])[1:] == want
    # repeated pages are one response and revisits of it; an empty table has no archives
    twice = warc.archive_digest(df.union(df.limit(1))).where("page_id = 1 or page_id = 4").collect()
    assert sorted(r.record_type for r in twice) == ["response", "revisit", "revisit"]
    broken = b"".join(warc._record("response" if n == "1" else "continuation", "urn:page:9:0", b"abc", [("WARC-Segment-Number", n), ("WARC-Segment-Origin-ID", "<urn:page:9:0>" if n != "1" else None), ("WARC-Segment-Total-Length", "99" if n == "2" else None)]) + b"\r\n\r\n" for n in "12")
    (tmp_path / "part-0").write_bytes(broken)
    assert [r.complete for r in warc.read_archives(spark, str(tmp_path)).collect()] == [False]


@given(st.binary(max_size=300), st.integers(1, 50))
@settings(max_examples=50, deadline=None)
def test_chunks_round_trip(payload, size):
    assert warc.dechunked(warc.chunked(payload, size)) == payload


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_decontamination_matches_brute_force(spark, docs):
    rows = docs.collect()
    rng = random.Random(4)
    items = [(1, " ".join(rows[3].text.split()[5:30])), (2, "one TWO"), (3, None), (4, "..."), (10, rows[4].text.upper()), (11, sentence(rng, 40))]
    items += [(20, " ".join((rows[305 - 300].text or "").split()[2:12])), (21, "é" * 150)]
    for block in (500_000, 7):
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = decontamination.contamination(docs, bench, block_windows=block)
        assert got.columns[:5] == docs.columns
        for r in got.collect():
            own, hit, found = tokens(r.text), set(), set()
            for item, text in items:
                w = tokens(text)
                for window in [w[i : i + 10] for i in range(max(1, len(w) - 9))] if w else []:
                    for p in range(len(own) - len(window) + 1):
                        if own[p : p + len(window)] == window:
                            hit |= set(range(p, p + len(window)))
                            found.add(str(item))
            want = (len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want


def brute_components(rows, size, percent):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOWER))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j].doc_id for j in range(len(rows)) if find(j) == find(i) and rows[j].doc_id is not None]
        out.append((r.doc_id, len(sets[i]), min(ids, default=None)))
    return out


def test_near_duplicates_match_brute_force(spark, docs):
    got = near_duplicates.near_duplicates_digest(docs).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=key) == sorted(brute_components(docs.collect(), 4, 80), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_keep_one_of_each_group(spark, docs):
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns
    want = {c for _, n, c in brute_components(docs.collect(), 5, 80) if n}
    empty = {r.doc_id for r in docs.collect() if not re.search(r"[^\x20\x09-\x0D]", r.text or "")}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted(want | empty)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Couples of near copies among many texts that are less alike, all in the same large buckets."""
    monkeypatch.setattr(near_duplicates, "SMALL", 1)
    rng = random.Random(11)
    words = sentence(rng, 120, 5000).split()
    rows = []
    for k in range(60):
        one = list(words)
        for j in rng.sample(range(120), 3):
            one[j] = f"one{k}x{j}"
        two = list(one)
        for j in rng.sample(range(120), 2):
            two[j] = f"two{k}x{j}"
        rows += [(2 * k, " ".join(one), "en", "a", 1), (2 * k + 1, " ".join(two), "en", "a", 1)]
    few = frame(spark, rows)
    got = near_duplicates.near_duplicates_digest(few).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(few.collect(), 4, 80))


def test_prefixes_meet_every_link(spark):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(6):
        words = rng.integers(0, 1000, int(rng.integers(6, 80)))
        for _ in range(12):
            one = words.copy()
            one[rng.random(len(one)) < 0.02] = rng.integers(0, 1000)
            texts.append(" ".join(map(str, one[: len(one) - int(rng.integers(0, 4))])))
    texts = sorted(set(texts))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(max(1, len(t.split()) - 2))} for t in texts]
    nodes = spark.createDataFrame([(i, i) for i in range(len(texts))], "node long, rep_id long")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = nodes.join(docs.select(F.col("doc_id").alias("rep_id"), F.xxhash64("text").alias("rep_tid")), "rep_id")
    full = near_duplicates.full_sets(nodes, docs, 3)
    got = {tuple(r) for r in near_duplicates.prefix_pairs(full, spark.createDataFrame([], "node long, component long"), 70).collect()}
    links = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j])}
    assert len(links) > 50 and links <= got


def test_joint_estimate_is_near_the_similarity():
    rng = np.random.default_rng(8)
    pool = rng.integers(1, 1 << 62, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[200:2100])
    table = near_duplicates.registers([a, b])
    j = near_duplicates.joint_similarity(table[:1], table[1:], np.array([2000.0]), np.array([1900.0]))[0]
    assert abs(j - 1800 / 2100) < 0.1
    whole = near_duplicates.registers([np.union1d(a, b)])
    assert (np.maximum(table[0], table[1]) == whole[0]).mean() > 0.99


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == dict.fromkeys(range(51), 0) | {100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_quotations(spark):
    rows = [
        (1, 0, "u", "Hello there. How are you?"),
        (1, 1, "a", "I am fine. Thanks!"),
        (1, 2, "u", "Good to know."),
        (1, 3, "a", "Ann wrote:\n> I am\n> fine. thanks\nNice"),
        (1, 4, "u", "go on"),
        (1, 5, "a", ">> I am fine.\n> Nice\nyes"),
        (1, 6, "u", "> go on\nno"),
        (2, 0, "u", None),
        (2, None, "u", "> Good to know."),
        (None, 1, "u", "x"),
        (2, 0, "u", None),
        (3, 0, "u", "> Good to know.\nfrom elsewhere"),
        (4, 0, "u", "We meet at noon by the old harbour, and then we go on by train to the coast."),
        (4, 1, "a", "Not now."),
        (4, 2, "u", "> by the old harbour, and\nwhich one?"),
        (4, 3, "a", "> the coast\ntwo words are too few"),
    ]
    got = quotations.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("role", "role")).collect()
    assert len(got) == len(rows)
    one = {r.turn: r for r in got if r.conv_id == 1}
    assert [r.turn for r in got if r.conv_id == 1] == [0, 1, 3, 5, 4, 6, 2]  # 5 replies to 3, 6 to 4
    assert (one[3].reply_to, one[3].text, one[3].depth, one[3].quoted_lines) == (1, "Nice", 1, 2)
    assert (one[5].reply_to, one[5].text) == (3, "yes")
    assert one[6].path == [*one[4].path, 6] and one[6].reply_to == 4
    assert [r.reply_to for r in got if r.conv_id == 3] == [None]
    assert {r.turn: (r.reply_to, r.depth) for r in got if r.conv_id == 4} == {0: (None, 0), 1: (0, 0), 2: (0, 1), 3: (2, 1)}
    assert quotations.reply_order(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def brute_reply_order(messages):
    """(conv_id, turn) -> (reply_to, path) by walking each conversation; turns of a conversation differ."""

    def passages(lines):
        whole = re.split(r"(?<=[.!?])\s+", " ".join(lines))
        plain = {" ".join(re.findall(r"[^\W_]+", x.lower())) for x in [*lines, *whole]} - {""}
        cut = lambda w: [" ".join(w[i : i + 8]) for i in range(max(1, len(w) - 7))]
        return {x for s in plain for x in cut(s.split())}, plain

    def inside(x, plain):
        return 3 <= len(x.split()) <= 7 and any(x != s and f" {x} " in f" {s} " for s in plain)

    def levels(text):
        out, own = defaultdict(list), []
        lines = (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
        marks = [re.match(r"[ \t]{0,3}(?:>[ \t]?)+", x) for x in lines]
        for i, (line, mark) in enumerate(zip(lines, marks, strict=True)):
            if mark:
                out[mark[0].count(">")].append(line[mark.end() :])
            elif not (i + 1 < len(lines) and marks[i + 1] and re.search(r"\bwrote[ \t]*:[ \t]*$", line)):
                own.append(line)
        return out, passages(own)

    found = {}
    by_conv = defaultdict(list)
    for conv, turn, text in messages:
        by_conv[conv].append((turn, text))
    for conv, rows in by_conv.items():
        own, head, before, prior = {}, None, {}, None
        heads = {}
        for turn, text in sorted(rows, key=lambda r: r[0]):
            quoted, own_passages = levels(text)
            votes = defaultdict(int)
            for level, lines in quoted.items():
                for x in passages(lines)[0]:
                    earlier = [t for t, (o, _) in own.items() if x in o] or [t for t, (_, o) in own.items() if inside(x, o)]
                    if earlier:
                        votes[-level, max(earlier)] += len(x)
            reply = prior
            if votes:
                top = max(level for level, _ in votes)
                reply = max((n, t) for (level, t), n in votes.items() if level == top)[1]
                before[turn] = before.get(heads[reply], []) + [reply]
                head = turn
            heads[turn] = head
            found[conv, turn] = (reply, before.get(head, []) + [turn])
            own[turn], prior = own_passages, turn
    return found


def test_quotations_match_brute_force(spark):
    rng = random.Random(21)
    rows = []
    for conv in range(12):
        said = []
        for turn in range(rng.randrange(1, 14)):
            lines = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 14))) + rng.choice([".", "!", ""]) for _ in range(rng.randrange(1, 4))]
            if said and rng.random() < 0.6:
                words = rng.choice(said).replace("\n", " ").split()
                at = rng.randrange(len(words))
                part = words[at : at + rng.randrange(1, 20)]
                width = rng.randrange(2, 9)
                depth = ">" * rng.choice([1, 1, 2, 3])
                quote = [f"{depth} {' '.join(part[i : i + width])}" for i in range(0, len(part), width)]
                lines = [*(["Ann wrote:"] if rng.random() < 0.5 else []), *quote, *lines]
            text = rng.choice(["\n", "\r\n"]).join(lines)
            said.append("\n".join(x for x in lines if not x.startswith((">", "Ann"))))
            rows.append((conv, turn, "u", text))
    got = quotations.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = brute_reply_order([(c, t, x) for c, t, _, x in rows])
    assert {(r.conv_id, r.turn): (r.reply_to, list(r.path)) for r in got} == want
    assert sum(r.depth > 0 for r in got) > 30
    assert [(r.conv_id, list(r.path)) for r in got] == sorted((r.conv_id, list(r.path)) for r in got)
    assert quotations.reply_order(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_toxicity_finds_documents_and_sentences(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        parts = [sentence(rng, 12, 60) for _ in range(6)]
        bad = rng.random() < 0.3
        if bad:
            parts[2] += " vile"
        rows.append((i, ". ".join(parts), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    rows += [(600, None, "en", "s", 0), (601, "", "en", "s", 0), (None, "vile", "en", "s", 0)]
    labels += [(None, 1, 1), (3, None, None), (999, 1, 1)]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_digest(docs, marks).collect()}
    for i, _, toxic in labels[:500]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].predicted == toxic == int(got[i].score >= 0.5)
    assert got[600].score == got[601].score == 0 and got[None].predicted == 1
    weights = toxicity.fit(docs, marks, toxicity.id_remainder("doc_id", 5) != 0)
    found = toxicity.score(docs, weights).where("predicted = 1 and doc_id is not null").collect()
    assert all(len(r.spans) == 1 and "vile" in r.text[r.spans[0].start : r.spans[0].end] for r in found)
    assert toxicity.toxicity_digest(frame(spark, []), marks.limit(0)).collect() == []


def brute_repeats(rows, length):
    """Windows in the order of ids (nulls last); rows of one id do not see each other."""
    first, out = {}, []
    order = lambda r: (r.doc_id is None, r.doc_id or 0)
    for r in sorted(rows, key=order):
        b = (r.text or "").encode()
        for s in range(len(b) - length + 1):
            first.setdefault(b[s : s + length], (order(r), s))
    for r in rows:
        b = (r.text or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < (order(r), s):
                gone[s : s + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((r.doc_id, len(b), int(gone.sum()), int((gone & ~np.append(False, gone[:-1])[: len(gone)]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_match_brute_force(spark, docs):
    rows = [r for r in docs.collect() if r.doc_id != 305]
    got = [tuple(r) for r in repeats.repeats_digest(docs.where("doc_id <> 305 or doc_id is null")).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(got, key=key) == sorted(brute_repeats(rows, 100), key=key)
    assert any(r[2] and r[2] < r[1] for r in got)
    assert repeats.repeats_digest(docs.limit(0)).collect() == []


def test_rows_given_twice_keep_what_one_keeps(spark):
    rng = random.Random(4)
    own, lone, common = (sentence(rng, 80, 9000) for _ in range(3))
    rows = [(1, own), (1, own), (2, common + " x"), (3, common + " y"), (3, common + " y"), (4, "a"), (4, own[:200] + "-" + own[:200])]
    rows = frame(spark, [(i, t, "en", "a", 1) for i, t in [*rows, (None, lone), (None, lone), (5, lone[::-1]), (5, lone[::-1] * 2)]])
    got = [tuple(r) for r in repeats.repeats_digest(rows.coalesce(1)).collect()]
    apart = [tuple(r) for r in repeats.repeats_digest(rows.repartition(11)).collect()]
    once = [r for r in rows.collect() if r.doc_id != 5 or len(r.text) == len(lone)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(got, key=key) == sorted(apart, key=key)
    assert sorted([r for r in got if r[0] != 5 or r[1] == len(lone)], key=key) == sorted(brute_repeats(once, 100), key=key)
    assert [r[2] for r in got if r[0] in (1, None)] == [0, 0, 0, 0]
    # rows of one id with other texts do not see each other, but each its own repeats
    assert [r[2] for r in got if r[0] == 5 and r[1] > len(lone)] == [len(lone)]


def test_hot_triggers_are_split_and_joined_again(spark, monkeypatch):
    """A passage that all documents share, with different surroundings, some of which two or more have in common for a while."""
    for name, value in (("HOT_LEAST", 3), ("HOT_SHARE", 0.0), ("SORTED", 25), ("PART", 60)):
        monkeypatch.setattr(repeats, name, value)
    rng = random.Random(31)
    passage, edge, end = sentence(rng, 60, 9000), sentence(rng, 12, 9000), sentence(rng, 10, 9000)
    rows = []
    for i in range(40):
        left = sentence(rng, rng.randrange(0, 40), 9000) + (edge[-(3 * i) :] if i % 3 else "")
        right = (end[: 4 * i] if i % 4 else "") + sentence(rng, rng.randrange(0, 40), 9000)
        rows.append((i, left + passage[rng.choice([0, 0, 7, 30]) :] + right, "en", "a", 1))
    rows += [rows[7], (8, rows[9][1][5:], "en", "a", 1), (None, passage, "en", "a", 1)]
    few = frame(spark, rows)
    assert len(repeats.hot_triggers(few.selectExpr("text", "coalesce(doc_id, 99) as o", "0L as v"), 100, len(rows))) > 3
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    got = sorted([tuple(r) for r in repeats.repeats_digest(few.repartition(5)).collect()], key=key)
    alone = [r for r in rows if r[0] != 8]
    want = sorted(brute_repeats(frame(spark, alone).collect(), 100), key=key)
    assert [r for r in sorted([tuple(r) for r in repeats.repeats_digest(frame(spark, alone)).collect()], key=key)] == want
    assert len(got) == len(rows) and sum(r[2] > 0 for r in got) > 35


def test_long_texts_are_cut_into_the_same_phrases(monkeypatch):
    rng = np.random.default_rng(0)
    data = rng.integers(97, 123, 20_000).astype(np.uint8)
    whole = {tuple(x) for x in zip(*[c.tolist() for c in repeats.phrases(data, 100)], strict=True)}
    monkeypatch.setattr(repeats, "PIECE", 1000)
    parts = {(t, c, f + s, la + s, a + s) for s, p in repeats._segments(data, 100) for t, c, f, la, a in zip(*[x.tolist() for x in p], strict=True)}
    assert parts == whole


@given(st.lists(st.text(alphabet="aB é\t\nz0.-", max_size=40), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_words_match_patterns(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    bounds = np.cumsum([0] + [len(b) for b in raw])
    for inside, pattern in ((ALNUM, rb"[0-9a-z\x80-\xff]+"), (VISIBLE, rb"[^\x20\x09-\x0D]+")):
        starts, ends, hashes = words(data, bounds, inside)
        got = [bytes(FOLD[data[s:e]]) for s, e in zip(starts, ends, strict=True)]
        want = [w for b in raw for w in re.findall(pattern, bytes(FOLD[np.frombuffer(b, np.uint8)]))]
        assert got == want
        assert len({(w, int(h)) for w, h in zip(got, hashes, strict=True)}) == len(set(got)) == len(set(hashes.tolist()))


def test_empty_tables(spark):
    none = frame(spark, [])
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    some = frame(spark, [(1, "one two three four", "en", "a", 1)])
    assert mixing.mix(none).collect() == [] and mixing.mix_digest(none).collect() == []
    assert sharding.interleave_shards(none, 4).collect() == []
    assert near_duplicates.near_duplicates_digest(none).collect() == [] and near_duplicates.keep_one(none).collect() == []
    assert neighbours.nearest_digest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert warc.archive_digest(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    assert decontamination.contamination_digest(none, items).collect() == []
    r = decontamination.contamination_digest(some, items.limit(0)).first()
    assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (4, 0, 0, False)
    assert [x.n_hit for x in decontamination.contamination_digest(some, items).collect()] == [3]


def test_columns_with_clashing_names(spark):
    """What a table has beside the named columns passes through, and what has a result's name is replaced."""
    rng = random.Random(6)
    rows = [(i, sentence(rng, 30), "en", "a", 1) for i in range(12)]
    extra = ("lang_pred", "score", "bits", "n_words", "n_hit", "shard", "slot", "rate", "spans", "predicted", "contaminated")
    inside = ("row", "id", "node", "uid", "same", "__row", "__hash", "weight", "toxic", "t", "o", "v", "number", "__lang", "text_hash", "dotted.name")
    docs = frame(spark, rows).withColumns({c: F.lit(f"own {c}") for c in (*extra, *inside)})
    items = spark.createDataFrame([(1, rows[3][1])], "item_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    weights = toxicity.fit(docs, marks, F.lit(True))
    results = {
        "language": language.predict(docs, language.fit(docs, F.lit(True))),
        "decontamination": decontamination.contamination(docs, items),
        "toxicity": toxicity.score(docs, weights),
        "sharding": sharding.interleave_shards(docs, 3),
        "mixing": mixing.mix(docs),
        "near-duplicates": near_duplicates.keep_one(docs),
        "confident": language.confident(docs),
    }
    for name, result in results.items():
        got = result.collect()
        assert {r.doc_id for r in got} <= set(range(12)) and got, name
        assert all(r[c] == f"own {c}" for r in got for c in inside), name
    assert {r.lang_pred for r in results["language"].collect()} == {"en"}
    assert {r.lang_pred for r in results["confident"].collect()} == {"own lang_pred"}
    turns = spark.createDataFrame([(1, 0, "u", "Hello there."), (1, 1, "a", "> Hello there.\nHi")], "conv_id long, turn long, role string, text string").withColumns({c: F.lit("own") for c in ("path", "c", "t", "span", "head", "before", "level", "s")})
    got = quotations.reply_order(turns).collect()
    assert [(r.turn, r.reply_to, list(r.path), r.c, r.span) for r in got] == [(0, None, [0], "own", "own"), (1, 0, [0, 1], "own", "own")]
