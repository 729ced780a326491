"""The pipeline against its stages by brute force, on documents whose languages are plain."""

import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from offerloom.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, docs, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    parts = {"en": ["the", "ing", "and", "tion"], "fr": ["eau", "les", "que", "ais"]}
    text = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(4)) for _ in range(40))
    rows = [(i, text(lang), lang, rng.choice("aab"), 1) for i in range(120) for lang in [rng.choice(["en", "fr"])]]
    copies = [(200 + i, rows[i][1] + (" end" if i % 2 else ""), rows[i][2], "b", 1) for i in range(10)]
    junk = [(300, None, "en", "a", 0), (301, "12 34 !", "fr", "a", 0), (302, "", None, None, 0)]
    leak = (310, text("en") + " " + "one two three four five six seven eight nine ten eleven", "en", "a", 1)
    items = [(1, "One two three four five six seven eight nine ten"), (2, None)]
    docs = spark.createDataFrame([*rows, *copies, *junk, leak, rows[50]], DOCS)
    write(spark, str(tmp_path), docs, items)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "near-duplicates", "decontamination", "mixing", "sharding"]

    left = [r for r in rows]  # junk, copies (of smaller ids), the leak and the row given twice are gone
    clean = spark.createDataFrame(left, DOCS)
    copies_of = {r.doc_id: r.copies for r in mixing.mix_digest(clean).collect()}
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in copies_of.items() if v}
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(len(slots.get(s, [])) for s in range(40)) <= 1
    texts = {r[0]: r[1] for r in rows}
    assert all(r.text == texts[r.doc_id] for r in out) and all(re.search("[a-z]", r.text) for r in out)


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (2, None, None, None, None)], DOCS)
    write(spark, str(tmp_path), docs, [(1, "x")])
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.where(F.lit(False)), str(tmp_path)).collect() == []
