"""Personal data, alignment of tokenizers and ranked search against brute force, and on odd rows."""

import collections
import hashlib
import math
import random
import re
import tracemalloc

import numpy as np
import pytest
import sentencepiece
import tokenizers

from offerloom.llm import alignment, private_data, ranking
from offerloom.llm.queries import LLM_ORACLES

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def base_by_hand(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, digits[::-1])))
            if k == 0 or (k == 1 and all(int(p) <= 255 for p in m[0].split("."))) or (k == 2 and 14 <= len(digits) <= 19 and total % 10 == 0) or (k == 3 and 10 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_the_patterns():
    rng, seen = random.Random(1), collections.Counter()
    for _ in range(40_000):
        letters = rng.choice(["0123456789. -", "ab.@é-+1", "12.+( )-@a", "01 -", "1.2.", "0123456789 -.+()@a.b"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        got = [x[:3] for x in private_data.find(text) if x[3]]
        assert got == base_by_hand(text), text
        seen.update(k for _, k, _ in got)
    assert all(seen[k] > 20 for k in range(4))


def test_further_kinds_are_validated():
    found = lambda text: [(private_data.KINDS[k], text[a:b]) for a, k, b, base in private_data.find(text) if not base]
    assert found("see https://bob:s3cret@host.example.com/a") == [("login", "bob:s3cret")]
    assert found("IBAN DE89 3704 0044 0532 0130 00.") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert found("DE88 3704 0044 0532 0130 00 and XDE89370400440532013000") == []
    assert found("Account no. 1234-5678-90, recount 12345678, account 12") == [("account", "1234-5678-90")]
    assert found("josé.garcía@exämple.com") == [("email", "josé.garcía@exämple.com")]
    assert found("prose of ordinary words: 4.0, 2024 and 12:30") == []
    assert private_data.find("a" * 300_000 + "@" + "1 " * 300_000) == []


def test_private_digest_on_odd_rows(spark):
    texts = ["a@b.cd and 1.2.3.4, +1 (555) 123-4567", "", None, "é " * 5 + "x@y.zz", "x " * 50_000 + "4111 1111 1111 1111"]
    rows = [(i, t, "mine", 3) for i, t in enumerate(texts)] + [(0, texts[0], "mine", 4), (None, "1.2.3.4", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_email int")
    for r in private_data.private_digest(docs).collect():
        text = texts[r.doc_id] if r.doc_id is not None else "1.2.3.4"
        base = base_by_hand(text)
        told = ",".join(f"{private_data.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for _, k, _ in base) for j in range(4))
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and r.spans == told
    assert private_data.private_digest(docs.where("false")).isEmpty()
    assert private_data.private_spans(docs, name="spans").schema["spans"].dataType == private_data.SPANS
    assert private_data.masked(docs).where("doc_id = 0").first().text == "[email] and [ip], [phone]" and private_data.masked(docs).where("doc_id = 2").first().text is None


def alignment_by_hand(docs):
    a_tok, b_tok = tokenizers.Tokenizer.from_file(alignment.FILES[0]), sentencepiece.SentencePieceProcessor(model_file=alignment.FILES[1])
    a_tok.encode_special_tokens = True
    byte_of, groups = alignment._byte_of(), []
    for _, text in docs:
        own = []
        a, b = (a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)) if text else ([], [])
        raw_a = [bytes(byte_of[c] for c in a_tok.id_to_token(i)) for i in a]
        raw_b = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if text and b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            at = [0, 0]
            now = ([], [])
            rest = [list(zip(a, raw_a, strict=True)), list(zip(b, raw_b, strict=True))]
            while rest[0] or rest[1]:
                side = 0 if at[0] <= at[1] else 1
                i, x = rest[side].pop(0)
                now[side].append(i)
                at[side] += len(x)
                if at[0] == at[1]:
                    own.append(now)
                    now = ([], [])
        groups.append(own)
    links = [[(x, y) for p, q in own for x in p for y in q] for own in groups]
    count = collections.Counter(pair for own in links for pair in set(own))
    best = collections.Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    for (doc, _), own, pairs in zip(docs, groups, links, strict=True):
        told = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in own)
        yield (doc, sum(len(p) for p, _ in own), sum(len(q) for _, q in own), len(own), len(pairs), sum(count[x] == best[x[0]] for x in pairs), sum(count[x] for x in pairs), hashlib.sha256(told.encode()).hexdigest() if own else "")


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize(("chunk", "fan", "pairs"), [(1 << 16, 32, 4_000_000), (40, 3, 1500)])
def test_alignment_matches_whole_texts(spark, monkeypatch, chunk, fan, pairs):
    monkeypatch.setattr(alignment, "FAN", fan)
    monkeypatch.setattr(alignment, "PAIRS", pairs)
    rng = random.Random(chunk)
    words = ["the", "house", "été", "日本語", "\n", "\n\n", " ", "  ", "don't", "x", "\t", " ", "<s>", "<|endoftext|>", "<0x41>", "123", "4,5", "😀", "naïve", "a" * 300, "。", "\u0085", "　 ", "I'm", "=="]
    texts = ["", None, "a", " ", "  ", "a ", " a", "\n", "▁", "a▁ b", "x\n y", "x\n  y"] + ["".join(rng.choice(words) + rng.choice([" ", " ", "", "\n"]) for _ in range(rng.randint(1, 120))) for _ in range(50)]
    docs = [(i // 2, t) for i, t in enumerate(texts)] + [(None, "no id"), (1, "x" * 3000), (1, "x" * 3000)]
    found = alignment.align(spark.createDataFrame([(*d, "mine") for d in docs], "doc_id long, text string, n_a string").repartition(3), chunk=chunk)
    got = alignment.linked(found, alignment.link_counts(found)).select(*COLUMNS).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, alignment_by_hand(docs)))
    told = collections.defaultdict(list)
    for r in alignment.token_groups(found).where("doc_id = 20").orderBy("place").collect():
        told[r.doc_id].append(r.groups)
    hashes = {r.groups_sha256 for r in got if r.doc_id == 20}
    assert chunk == 40 and found.long.count() > 100 or all(hashlib.sha256(g.encode()).hexdigest() in hashes for g in told[20])


def test_fragments_compose_in_any_order():
    import pandas as pd

    rng = random.Random(2)
    for _ in range(200):
        rows = []
        for k in range(rng.randint(1, 9)):
            cut, some = rng.random() < 0.6, lambda: [rng.randrange(99) for _ in range(rng.randrange(3))]
            rows.append({"r": 1, "k": k, "first": k if cut else None, "pre_a": some(), "pre_b": some(), "suf_a": some() if cut else [], "suf_b": some() if cut else []})
        whole, closed = alignment.compose(pd.DataFrame(rows, dtype=object))
        cut = rng.randint(1, len(rows))
        parts = [alignment.compose(pd.DataFrame(x, dtype=object)) for x in (rows[:cut], rows[cut:]) if x]
        both, between = alignment.compose(pd.DataFrame([p for p, _ in parts], dtype=object))
        assert {c: both[c] for c in (*alignment.OPEN, "first")} == {c: whole[c] for c in (*alignment.OPEN, "first")}
        assert sorted(between + [g for _, own in parts for g in own]) == sorted(closed)


def test_groups_as_text_need_little_memory(monkeypatch):
    rng = np.random.default_rng(5)
    n_groups = rng.integers(0, 5, 40_000)
    of_a, of_b = rng.integers(1, 4, (2, n_groups.sum()))
    units = alignment.Units(n_groups, of_a, of_b, rng.integers(0, 50_000, of_a.sum()), rng.integers(0, 32_000, of_b.sum()))
    codes, bounds = np.flatnonzero(n_groups), np.array([0, 0, *range(100, np.count_nonzero(n_groups), 100)])
    tracemalloc.start()
    size = sum(len(t) for t in alignment._formed(units, codes, bounds)[1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * size
    told = units.texts()
    monkeypatch.setattr(alignment, "TOLD", 7)
    assert units.texts() == told and [t.count("|") for t in told] == n_groups.tolist()


def test_tokenizers_go_from_workers_that_encode_no_more(monkeypatch):
    monkeypatch.setattr(alignment, "_LOADED", {"id": "an encoder"})
    alignment._unloaded()
    assert not alignment._LOADED


def test_alignment_of_no_documents(spark):
    found = alignment.align(spark.createDataFrame([], "doc_id long, text string"))
    assert alignment.linked(found, alignment.link_counts(found)).isEmpty() and alignment.token_groups(found).isEmpty()


def ranking_by_hand(docs, items, k):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    bags = [(d, collections.Counter(words(t))) for d, t in docs]
    total, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(w for _, b in bags for w in b)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for d, b in bags:
            n = sum(b.values())
            m = 50 + 50 * n * total // length if length else 0
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 20 * m)) for w in set(words(text)) if b[w])
            scored += [(-s, d is None, d or 0, d)] * (s > 0)
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out


@pytest.mark.parametrize("blocks", [1000, 7])
def test_ranked_search_matches_all_sums(spark, monkeypatch, blocks):
    monkeypatch.setattr(ranking, "ITEMS", blocks)
    monkeypatch.setattr(ranking, "CELLS", 500)
    rng = random.Random(blocks)
    words = ["the", "of", "Red", "blue", "été", "x1", "data", "日本", "zeta", "ion"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    docs = [(i // 2, some(40)) for i in range(160)] + [(None, "red red"), (900, None), (901, ""), (902, "the " * 60_000)]
    items = [(i, some(12)) for i in range(30)] + [(3, "the red"), (40, None), (41, "..."), (42, "absent"), (43, "RED the")] * 2
    got = ranking.search(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, rank int").repartition(5), spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, score string"), k=7)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, ranking_by_hand(docs, items, 7)))


def test_shared_sums_are_whole_and_shared():
    import numpy as np

    rng = random.Random(6)
    items = [np.unique([rng.randrange(40) for _ in range(rng.randint(0, 15))]).astype(np.int64) for _ in range(60)]
    graph = ranking.shared_sums(items, 40)
    values = np.array([rng.randrange(10**9) for _ in range(40)])
    nodes = np.zeros((graph.classes + sum(len(z) for z, _, _ in graph.levels), 1), np.int64)
    np.add.at(nodes, (graph.class_of, 0), values)
    got = dict(zip(graph.items.tolist(), graph.scores(nodes)[:, 0].tolist(), strict=True))
    assert got == {i: int(values[own].sum()) for i, own in enumerate(items) if len(own)}
    assert len(graph.operands) + len(nodes) - graph.classes < sum(map(len, items))


def test_ranked_search_without_rows(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranking.search(docs, items).isEmpty() and ranking.search(items.withColumnRenamed("item_id", "doc_id"), items.where("false")).isEmpty()
    assert "op13_ranked_search" in LLM_ORACLES
