"""The registered queries of the operators here, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_mixture")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmura.llm.mixture import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


@query("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmura.llm.suffix_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents")).drop("spans")


@query("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmura.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


@query("op9_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmura.llm.language import identify_language

    return identify_language(table(spark, sf_dir, "documents"))


@query("op10_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS last FROM p),
bits AS (SELECT *, [('0x' || hex[2 * i + 1 : 2 * i + 2])::INT FOR i IN range(20)] AS b FROM q)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate([
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
      (((b[(5 * j) // 8 + 1] << 8) + coalesce(b[(5 * j) // 8 + 2], 0)) >> (11 - (5 * j) % 8)) % 32 + 1]
    FOR j IN range(32)], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM bits
""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmura.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from murmura.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmura.llm.quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmura.llm.weak_labels import classify_quality

    return classify_quality(table(spark, sf_dir, "documents"))


@query("op5_topk", """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
WHERE rank <= 10
""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmura.llm.topk import top_products

    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op8_jaccard")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmura.llm.jaccard import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query("op11_filter_audit", r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
f AS (
  SELECT doc_id, part,
    (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
    + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS failed
  FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (
  SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
    list_sum([0] || [1 << (ascii(filter_order[j]) - 65) FOR j IN range(1, step)])::INT AS before
  FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o)),
r AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (failed & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (failed & before = 0 AND failed & bit <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (failed & before <> 0 AND failed & bit <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (failed = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (failed & before = 0 AND failed & bit <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (failed & before = 0 AND failed & bit <> 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmura.llm.filter_audit import audit_filters

    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_line_dedup", """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (
  SELECT doc_id, lines, [translate(
    trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FOR x IN lines] AS keys FROM d),
u AS (SELECT doc_id, unnest(list_distinct(keys)) AS key FROM e),
m AS (SELECT key, max(doc_id) AS holder FROM u WHERE length(key) >= 20 GROUP BY key HAVING count(*) >= 3),
g AS (SELECT doc_id, list(u.key) AS gone FROM u JOIN m ON u.key = m.key AND u.doc_id <> m.holder GROUP BY doc_id),
k AS (
  SELECT doc_id, lines, [z[1] FOR z IN list_zip(lines, keys) IF NOT list_contains(coalesce(gone, []), z[2])] AS kept
  FROM e LEFT JOIN g USING (doc_id))
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
  sha256(array_to_string(kept, chr(10))) AS kept_sha256
FROM k
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmura.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_lexical_search", r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
n AS (SELECT doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS l FROM n),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (
  SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, n, unnest(terms) AS term FROM n)
  WHERE term IN (SELECT term FROM i) GROUP BY doc_id, term),
w AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w
  FROM p, c GROUP BY term),
s AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // l))))::BIGINT AS score
  FROM i JOIN p USING (term) JOIN w USING (term), c GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM s WHERE score > 0)
WHERE rank <= 50
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from murmura.llm.lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
