"""One query opN_<name> for each operator, over its whole tables with production parameters, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm.staging import staged, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonoframe.llm.decontaminate import find_contamination

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonoframe.llm.substring_dedup import remove_repeats

    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonoframe.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonoframe.llm import quality
    from sonoframe.llm.langid import held_out

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, machine).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonoframe.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonoframe.llm.sharding import shard_documents

    placed = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), "law", "shard", "slot", "grown_shard")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonoframe.llm import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs)
    return langid.identify(docs.drop("lang"), model).select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonoframe.llm.tokens import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, "byte_bpe_50k.json").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", "over_limit")


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonoframe.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonoframe.llm.mixing import measured, mix_sources

    docs = measured(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text")
    return mix_sources(staged(docs, "mix-measured"), measures=True).select("doc_id", "size", "source_size", "target", "taken")


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonoframe.llm.whitening import whiten

    found = whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonoframe.llm.alignment import align

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align(docs, "byte_bpe_50k.json", "piece_bpe_32k.model", keep_text=False).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonoframe.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.classify(docs, model).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_decontaminate, op2_substring_dedup, op3_nearest, op4_quality, op5_warc, op6_shard, op7_language_id, op8_token_counts, op9_near_dup, op10_mix, op11_whiten, op12_align, op13_toxicity)
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH item AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS i, regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
pattern AS (
  SELECT DISTINCT i, m, list_slice(w, k, k + m - 1) AS win
  FROM (SELECT i, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM (SELECT i, w, least(10, len(w)) AS m FROM item WHERE len(w) > 0))),
doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
place AS (
  SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM doc, (SELECT DISTINCT m FROM pattern) WHERE len(w) >= m),
hit AS (
  SELECT r, k, p.m, i FROM (SELECT r, k, m, list_slice(w, k, k + m - 1) AS win FROM place) JOIN pattern p USING (m, win)),
word AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(k, k + m)) AS x FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, i FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(word.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(word.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN named USING (r)
"""

OP2 = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT r, doc_id, k, md5(array_to_string(list_slice(w, k, k + 49), ' ')) AS h FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM doc WHERE doc_id IS NOT NULL AND len(w) >= 50)),
first AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h),
gone AS (SELECT DISTINCT r, x FROM (SELECT r, unnest(range(k, k + 50)) AS x FROM win JOIN first USING (h) WHERE d < doc_id)),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS x, unnest(w) AS v FROM doc),
stay AS (SELECT r, count(*) AS n, string_agg(v, ' ' ORDER BY x) AS t FROM word ANTI JOIN gone USING (r, x) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN stay USING (r)
"""

OP3 = """
WITH ok AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pair AS (SELECT q.vec_id AS query_id, c.vec_id, q.v AS a, c.v AS b FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 AND len(q.v) = len(c.v)),
scored AS (SELECT query_id, vec_id,
    list_reduce(list_transform(range(1, len(a) + 1), lambda i: a[i] * b[i]), lambda x, y: x + y)
    / (sqrt(list_reduce(list_transform(a, lambda x: x * x), lambda x, y: x + y)) * sqrt(list_reduce(list_transform(b, lambda x: x * x), lambda x, y: x + y))) AS score FROM pair)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored) WHERE r <= 5
"""

OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= 100
"""

OP9 = rf"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
place AS (SELECT doc_id, w, least(len(w), 5) AS m, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS k FROM doc WHERE len(w) > 0),
shingle AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, k, k + m - 1), ' ')) AS h FROM place),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingle x JOIN shingle y USING (h) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach(v, c) AS (SELECT DISTINCT a, a FROM link UNION SELECT b, c FROM reach JOIN link ON a = v),
comp AS (SELECT v, min(c) AS c FROM reach GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(d.doc_id = coalesce(c, d.doc_id), TRUE) AS kept
FROM doc d LEFT JOIN size USING (doc_id) LEFT JOIN comp ON v = d.doc_id
"""

OP10 = r"""
WITH base AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS k, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS tie,
    '17:' || coalesce(CAST(doc_id AS VARCHAR), '') AS key FROM documents),
hashed AS (SELECT *, md5(key) AS h FROM base),
src AS (SELECT k, max(source) AS source, CAST(sum(size) AS BIGINT) AS s FROM base GROUP BY k),
r1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rn, CAST(sum(s) OVER () AS BIGINT) AS total, 3 * s AS cap FROM src),
r2 AS (SELECT *, (rn - 1) % 3 + 1 AS w FROM r1),
r3 AS (SELECT *, row_number() OVER o AS i, CAST(coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
    CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest FROM r2 WINDOW o AS (ORDER BY cap / w, rn)),
r4 AS (SELECT *, CAST(total - before AS DOUBLE) / rest AS level FROM r3),
pick AS (SELECT level FROM r4 WHERE level <= cap / w ORDER BY i LIMIT 1),
tgt AS (SELECT k, rn, s, total, least(CAST(cap AS DOUBLE), pick.level * w) AS t FROM r4, pick),
q0 AS (SELECT *, CASE WHEN total > 0 THEN CAST(floor(t / (total / CAST(ceil(total / 16) AS BIGINT)) + 0.5) AS BIGINT) ELSE 0 END AS q0, CAST(ceil(total / 16) AS BIGINT) AS n FROM tgt),
q1 AS (SELECT *, CAST(n - sum(q0) OVER () AS BIGINT) AS d FROM q0),
seat AS (SELECT k, rn, t, d, j, CASE WHEN d > 0 THEN q0 + j ELSE q0 - 1 - j END AS seat FROM (SELECT *, unnest(range(0, abs(d))) AS j FROM q1)),
moved AS (SELECT k, sum(sign(d)) AS more FROM (SELECT *, row_number() OVER (ORDER BY CASE WHEN d > 0 THEN -t / (2 * seat + 1) ELSE t / (2 * seat + 1) END, rn, j) AS r FROM seat WHERE seat >= 0) WHERE r <= abs(d) GROUP BY k),
quota AS (SELECT q1.*, CAST(q0 + coalesce(more, 0) AS BIGINT) AS q FROM q1 LEFT JOIN moved USING (k)),
placed AS (SELECT b.*, s, t, CAST('0x' || substr(h, 9, 8) AS BIGINT) % greatest(4096, CAST(2 ** ceil(log2(greatest(1, ceil(total / 1048576)))) AS BIGINT)) % greatest(1, CAST(ceil(s / 1048576) AS BIGINT)) AS sub FROM hashed b JOIN tgt USING (k)),
sh AS (SELECT k, sub, CAST(ceil(sum(size) / 16) AS BIGINT) AS nb FROM placed GROUP BY k, sub),
sh2 AS (SELECT *, CAST(sum(nb) OVER (PARTITION BY k ORDER BY sub) AS HUGEINT) AS cum, CAST(sum(nb) OVER (PARTITION BY k) AS HUGEINT) AS all_nb FROM sh),
sh3 AS (SELECT sh2.*, least(q, 3 * all_nb) AS q FROM sh2 JOIN quota USING (k)),
sh4 AS (SELECT *, CASE WHEN nb = 0 THEN 0 ELSE q * cum // all_nb - q * (cum - nb) // all_nb END AS qj FROM sh3),
sh5 AS (SELECT k, sub, nb, CASE WHEN nb = 0 THEN 0 ELSE qj // nb END AS e, CASE WHEN nb = 0 THEN 0 ELSE qj % nb END AS r,
    CASE WHEN nb = 0 THEN 0 ELSE CAST('0x' || substr(md5('17:' || k || ':' || sub), 1, 8) AS BIGINT) % nb END AS a FROM sh4),
laid AS (SELECT *, sum(size) OVER (PARTITION BY k, sub ORDER BY h, key, size, tie ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi FROM placed)
SELECT doc_id, size, s AS source_size, t AS target, CAST(e * size
  + greatest(0, least(hi, (a + r) * 16) - greatest(hi - size, a * 16))
  + CASE WHEN a + r > nb THEN greatest(0, least(hi, (a + r - nb) * 16) - greatest(hi - size, 0)) ELSE 0 END AS BIGINT) AS taken
FROM laid JOIN sh5 USING (k, sub)
"""

ORACLE_SQL: dict[str, str] = {"op1_decontaminate": OP1, "op2_substring_dedup": OP2, "op3_nearest": OP3, "op5_warc": OP5, "op9_near_dup": OP9, "op10_mix": OP10}
