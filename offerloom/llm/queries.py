"""The registered queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import alignment_digest
from .decontamination import contamination_digest
from .language import language_digest
from .mixing import mix_digest
from .near_duplicates import near_duplicates_digest
from .neighbours import nearest_digest
from .private_data import private_digest
from .quotations import quotation_digest
from .ranking import search
from .repeats import repeats_digest
from .sharding import shard_digest
from .shared import table
from .toxicity import toxicity_digest
from .warc import archive_digest


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_digest(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_digest(table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_digest(table(spark, sf_dir, "embeddings"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_digest(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates_digest(table(spark, sf_dir, "documents"))


def op8_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation_digest(table(spark, sf_dir, "conversations"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(table(spark, sf_dir, "documents"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_digest(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digest(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_mixing,
        op3_language_id,
        op4_neighbours,
        op5_warc,
        op6_decontamination,
        op7_near_duplicates,
        op8_quotations,
        op9_toxicity,
        op10_repeats,
        op11_personal_data,
        op12_alignment,
        op13_ranked_search,
    )
}
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SHINGLE_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: SQL for the queries that SQL can express on whole tables (the CRC-32 of op1 byte by byte, with a table made from its rule). op8, op10, op11 and op12
#: are held against brute force in tests/llm, the models of op3 and op9 by their accuracy on planted and held-out documents.
LLM_ORACLES: dict[str, str] = {
    "op1_sharding": r"""
WITH crc AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
d AS (SELECT doc_id, source, coalesce(strlen(text), 0) + 16 AS size, hex(encode(coalesce(text, ''))) AS x FROM documents),
sums AS (SELECT doc_id, source, size, xor(list_reduce(list_prepend(4294967295, list_transform(range(size - 16), lambda i: CAST(concat('0x', substr(x, (2 * i + 1)::INT, 2)) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM d, crc),
hashed AS (SELECT *, md5(concat('17:', coalesce(doc_id::VARCHAR, ''), ':', text_crc32)) AS h FROM sums),
ranked AS (SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY h, text_crc32) - 1) / (2 * count(*) OVER (PARTITION BY source)) AS fraction FROM hashed),
placed AS (SELECT *, row_number() OVER (ORDER BY fraction, source NULLS FIRST, h, text_crc32) - 1 AS p, count(*) OVER () AS n FROM ranked),
sharded AS (SELECT *, (p * 40) // n AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard, (p - (shard * n + 39) // 40)::BIGINT AS slot, NULL::INT AS grown_shard FROM sharded""",
    "op2_mixing": r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS hash, row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1 AS number FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight FROM sized GROUP BY source),
levels AS (SELECT *, 3 * source_size / weight AS stop,
  (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM sums),
targets AS (SELECT source, source_size, coalesce(least(3 * source_size::DOUBLE, weight * max(CASE WHEN level <= stop THEN level END) OVER ()), 0) AS target FROM levels),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0 END AS rate FROM targets),
picked AS (SELECT s.doc_id, s.size, r.source_size, r.target, s.source, floor(rate)::INT + (CASE WHEN
  CAST(concat('0x', substr(md5(concat('29:', coalesce(s.doc_id::VARCHAR, ''), ':', s.hash, ':', s.number)), 1, 13)) AS BIGINT) / power(2::DOUBLE, 52) < rate - floor(rate) THEN 1 ELSE 0 END) AS copies
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, source, copies FROM picked""",
    "op4_neighbours": r"""
WITH v AS (SELECT vec_id, embedding, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.x, c.x) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10""",
    "op5_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST(concat('0x', substr(h, (i // 4)::INT * 5 + 1, 5)) AS BIGINT) >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS digest,
  max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM b""",
    "op6_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_WORDS}, []) AS w FROM benchmark),
windows AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, w[i:i + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
keys AS (SELECT array_to_string(win, ' ') AS k, len(win) AS n, item FROM windows),
sizes AS (SELECT DISTINCT n FROM keys),
grams AS (SELECT r, p, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, p, g.n, item FROM grams g JOIN keys USING (k, n)),
covered AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS s FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)""",
    "op7_near_duplicates": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_SHINGLE_WORDS}, []) AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
links AS (SELECT a.r AS x, b.r AS y FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r JOIN n na ON na.r = a.r JOIN n nb ON nb.r = b.r GROUP BY a.r, b.r, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
comp AS (SELECT reach.x AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.y GROUP BY reach.x)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM d LEFT JOIN n USING (r) JOIN comp USING (r)""",
    "op13_ranked_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
sums AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS docs, sum(len(w))::BIGINT AS length FROM d),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
post AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
parts AS (SELECT p.r, term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(w) * docs) // length))) AS part
  FROM post p JOIN dfs USING (term) JOIN d ON d.r = p.r, sums),
scored AS (SELECT item_id, r, sum(part)::BIGINT AS score FROM parts JOIN q USING (term) GROUP BY item_id, r HAVING sum(part) > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored JOIN d USING (r)) WHERE rank <= 50""",
}
