"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, clustering, decontam, html, language, linededup, neardup, packing, phrases, sharding, topk, toxicity, warc
from .common import id_crc, shared_dir, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(id_crc("doc_id") % 5 != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", (id_crc("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_turns(rows))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out()))
    found = language.predict(docs, model)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "removed_words")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The map lasts, one for each folder of tables: the next run edits the version that this one leaves.
    placed = sharding.assign(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/slot-maps/{zlib.crc32(sf_dir.encode()):08x}", 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, dim=64, scale=64.0)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64, scale=256.0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_packing, op3_chat, op4_language, op5_line_dedup, op6_sharding, op7_topk, op8_html, op9_decontamination, op10_near_dedup, op11_warc, op12_phrases, op13_clustering)}
#: Brute force over all pairs of vectors.
OP7_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
#: Equal payloads by the text itself; base 32 is spelled from every five hexadecimal digits of the hash.
OP11_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS leader FROM p),
d AS (
  SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(hex, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS v,
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS b
  FROM g)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(v, lambda x: b[((x >> 15) & 31) + 1] || b[((x >> 10) & 31) + 1] || b[((x >> 5) & 31) + 1] || b[(x & 31) + 1]), '') AS payload_digest,
  CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = leader THEN NULL ELSE leader END AS refers_to,
  TRUE AS block_ok, CASE WHEN page_id = leader THEN TRUE END AS payload_ok
FROM d
"""
#: All windows of one to three words, counted.
OP12_SQL = """
WITH t AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (
  SELECT lang, 1 AS m, ws[i] AS a, NULL AS b, NULL AS c FROM i
  UNION ALL SELECT lang, 2, ws[i], ws[i + 1], NULL FROM i WHERE i < len(ws)
  UNION ALL SELECT lang, 3, ws[i], ws[i + 1], ws[i + 2] FROM i WHERE i + 1 < len(ws)),
f AS (SELECT lang, m, a, b, c, CAST(count(*) AS HUGEINT) AS n FROM g GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, count(*) AS n FROM i GROUP BY lang),
cuts AS (
  SELECT x.lang, x.a, x.b, x.c, x.n, 1 AS k, y.n AS l, z.n AS r
  FROM f x JOIN f y ON y.m = 1 AND y.lang = x.lang AND y.a = x.a
           JOIN f z ON z.m = 1 AND z.lang = x.lang AND z.a = x.b WHERE x.m = 2
  UNION ALL
  SELECT x.lang, x.a, x.b, x.c, x.n, 1, y.n, z.n
  FROM f x JOIN f y ON y.m = 1 AND y.lang = x.lang AND y.a = x.a
           JOIN f z ON z.m = 2 AND z.lang = x.lang AND z.a = x.b AND z.b = x.c WHERE x.m = 3
  UNION ALL
  SELECT x.lang, x.a, x.b, x.c, x.n, 2, y.n, z.n
  FROM f x JOIN f y ON y.m = 2 AND y.lang = x.lang AND y.a = x.a AND y.b = x.b
           JOIN f z ON z.m = 1 AND z.lang = x.lang AND z.a = x.c WHERE x.m = 3),
scored AS (SELECT *, (1000000 * n * n) // (l * r) AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, a, b, c ORDER BY score, k) = 1),
alone AS (
  SELECT * FROM best x WHERE x.c IS NOT NULL OR NOT EXISTS (
    SELECT 1 FROM f y WHERE y.m = 3 AND y.lang = x.lang AND 100 * y.n >= 50 * x.n
      AND (y.a = x.a AND y.b = x.b OR y.b = x.a AND y.c = x.b))),
spelled AS (SELECT lang, concat_ws(' ', a, b, c) AS phrase, n AS a, l, r, score FROM alone),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM spelled)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(ranked.a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(totals.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def op13_sql(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds, each a pair of common tables over all vectors and centroids."""
    nearest = """a{i} AS MATERIALIZED (
  SELECT row, min_by(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.row, z.c, CAST(list_sum(list_transform(list_zip(v.v, z.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
    FROM v, c{i} z) GROUP BY row)"""
    moved = """s{i} AS (
  SELECT c, j, sum(v[j]) AS s, count(*) AS n FROM a{i} JOIN v USING (row), (SELECT unnest(range(1, 65)) AS j) GROUP BY ALL),
m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM s{i} GROUP BY c),
c{next} AS MATERIALIZED (SELECT z.c, coalesce(m.v, z.v) AS v FROM c{i} z LEFT JOIN m{i} m ON m.c = z.c)"""
    steps = [x for i in range(rounds) for x in (nearest.format(i=i), moved.format(i=i, next=i + 1))] + [nearest.format(i=rounds)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM (
    SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, v FROM v ORDER BY h NULLS LAST, v LIMIT {k})),
{", ".join(steps)},
t AS (SELECT c, CAST(sum(d) AS BIGINT) AS s FROM a{rounds} GROUP BY c)
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, t.s AS cluster_inertia,
  (SELECT CAST(sum(s) AS BIGINT) FROM t) AS inertia, sha256(array_to_string(z.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (row) JOIN t ON t.c = a.c JOIN c{rounds} z ON z.c = a.c
"""


SQL: dict[str, str] = {"op7_topk": OP7_SQL, "op11_warc": OP11_SQL, "op12_phrases": OP12_SQL, "op13_clustering": op13_sql()}
