"""One query per operator over its whole table, with production parameters, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteline.llm import alignment, decontam, infill, langid, mixing, secrets, simhash, suffixdedup, tokens, topk, toxicity, url_filters, vantage
from siteline.llm.common import read


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page at a fetch time made from its number, against list logs made from the pages' keys."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 977 % 31536000)
    out = url_filters.evaluate(pages.withColumn("fetched_at", fetched), url_filters.entries_from_pages(pages))
    return out.select("page_id", "host", F.col("n_active").cast("long").alias("n_active"), "verdict", "list_name", "key", F.unix_timestamp("since").alias("since_s"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best inner products with all vectors for every hundredth one."""
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document."""
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, links at up to 4 bits."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of 10 words of the benchmark, and the items."""
    return decontam.digest(decontam.removal_spans(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in passages of 50 words that occur again."""
    return suffixdedup.digest(suffixdedup.repeats(read(spark, sf_dir, "documents")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150 % of all words takes of every document."""
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out fifth."""
    docs = read(spark, sf_dir, "documents")
    return toxicity.predicted(toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels"))))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from lang outside the held-out third."""
    return langid.identify(read(spark, sf_dir, "documents"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens of every document."""
    return tokens.token_counts(read(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document, with how common the links' pairs are."""
    return alignment.align(read(spark, sf_dir, "documents"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of all vectors for every hundredth one; at factor one the trees leave out no nearer vector."""
    return vantage.nearest(read(spark, sf_dir, "embeddings"), relax=1.0)


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in fill-in-middle form and rebuilt from it, as hashes."""
    return infill.digest(infill.transform(read(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filters, op2_topk, op3_secrets, op4_simhash, op5_decontamination, op6_repeats, op7_mixing, op8_toxicity, op9_language, op10_tokens, op11_alignment, op12_neighbours, op13_infill)
}

ORACLES: dict[str, str] = {}

ORACLES["op7_mixing"] = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || cast(doc_id AS VARCHAR)) AS ord
  FROM documents),
s AS (
  SELECT source, cast(sum(size) AS BIGINT) AS source_size,
         cast([3, 1, 2][cast((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS BIGINT) AS weight
  FROM d GROUP BY source),
c AS (
  SELECT *, 2.0::double * source_size / weight AS at_level FROM s),
o AS (
  SELECT *, coalesce(sum(2 * source_size) OVER w, 0) AS caps_before, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS free,
         sum(source_size) OVER () AS total
  FROM c WINDOW w AS (ORDER BY at_level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (
  SELECT (3 * total - 2 * caps_before)::double AS a, (2 * free)::double AS b
  FROM o WHERE (3 * total - 2 * caps_before)::double / (2 * free)::double < at_level ORDER BY at_level LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN (SELECT count(*) FROM lev) = 0 OR weight * (SELECT a FROM lev) >= 2.0::double * source_size * (SELECT b FROM lev)
              THEN (2 * source_size)::double ELSE weight * (SELECT a FROM lev) / (SELECT b FROM lev) END AS target
  FROM s),
p AS (
  SELECT source, source_size, target,
         cast(coalesce(least(floor(target / nullif(source_size, 0)), 2), 0) AS BIGINT) AS whole
  FROM t),
k AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole,
         cast(floor(p.target) AS BIGINT) - p.whole * p.source_size
           - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, cast(whole * size + greatest(least(left_, size), 0) AS BIGINT) AS taken FROM k
"""

ORACLES["op2_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: cast(floor(1024 * x::double) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, cast(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10
"""

ORACLES["op12_neighbours"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::double) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda x, y: x + y)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, cast(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p) WHERE rank <= 10
"""

ORACLES["op13_infill"] = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || cast(doc_id AS VARCHAR)) AS h FROM documents),
t AS (
  SELECT *, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS w,
         cast('0x' || h[1:8] AS BIGINT) AS h1, cast('0x' || h[9:16] AS BIGINT) AS h2,
         cast('0x' || h[17:24] AS BIGINT) AS h3, cast('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, cast(len(w) AS BIGINT) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (
  SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, cast(CASE WHEN form <> 'plain' THEN length(prefix) END AS BIGINT) AS prefix_chars,
       cast(CASE WHEN form <> 'plain' THEN length(middle) END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p
"""

ORACLES["op1_url_filters"] = """
WITH cap AS (
  SELECT page_id, url, 1704067200 + page_id * 977 % 31536000 AS fetched,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
         regexp_extract(url, '^[^:]*://[^/?#]*(/[^?#]*)?', 1) AS path
  FROM pages),
lab AS (SELECT *, string_split(host, '.') AS l, regexp_extract(path, '^/([^/]+)', 1) AS first FROM cap),
keyed AS (
  SELECT page_id, fetched, unnest(list_concat(
           list_transform(range(1, greatest(len(l) - 1, 1) + 1), lambda i: 'd:' || array_to_string(l[i:], '.')),
           CASE WHEN first <> '' THEN ['p:' || host || '/' || first] ELSE [] END,
           ['u:' || host || path])) AS key
  FROM lab WHERE host IS NOT NULL),
ks AS (
  SELECT key, min(page_id) AS first_page, cast(('0x' || substr(md5(key), 1, 4)) AS INT) AS m, substr(key, 1, 1) AS kind
  FROM keyed GROUP BY key),
log AS (
  SELECT 'hosts' AS list_name, 'block' AS verdict, key, 'add' AS action, 1704067200 + (m % 200) * 86400 AS t0 FROM ks WHERE kind = 'd' AND m % 3 <> 2
  UNION ALL SELECT 'hosts', 'block', key, 'remove', 1704067200 + (m % 200 + 60) * 86400 FROM ks WHERE kind = 'd' AND m % 3 <> 2
  UNION ALL SELECT 'hosts', 'block', key, 'add', 1704067200 + (m % 200 + 120) * 86400 FROM ks WHERE kind = 'd' AND m % 3 <> 2 AND m % 2 = 0
  UNION ALL SELECT 'sections', 'allow', key, 'add', 1704067200 + (m % 150) * 86400 FROM ks WHERE kind = 'p' AND m % 5 = 0
  UNION ALL SELECT 'pages', 'block', key, 'add', 1704067200 + (m % 300) * 86400 FROM ks WHERE kind = 'u' AND first_page % 97 = 0),
iv AS (
  SELECT * FROM (SELECT *, lead(t0) OVER (PARTITION BY list_name, key ORDER BY t0) AS t1 FROM log) WHERE action = 'add'),
act AS (
  SELECT k.page_id, i.*, row_number() OVER (PARTITION BY k.page_id ORDER BY length(i.key) DESC, i.verdict = 'block' DESC, i.list_name DESC, i.key DESC, i.t0 DESC) AS rn,
         count(*) OVER (PARTITION BY k.page_id) AS n
  FROM keyed k JOIN iv i ON k.key = i.key AND k.fetched >= i.t0 AND (i.t1 IS NULL OR k.fetched < i.t1))
SELECT c.page_id, c.host, cast(coalesce(a.n, 0) AS BIGINT) AS n_active, coalesce(a.verdict, 'none') AS verdict, a.list_name, a.key, cast(a.t0 AS BIGINT) AS since_s
FROM cap c LEFT JOIN act a ON a.page_id = c.page_id AND a.rn = 1
"""
