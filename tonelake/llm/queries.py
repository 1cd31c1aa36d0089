"""The corpus operators' queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language_id, manifest, mixing, ngram_join, pieces, repeats, token_count, topk, toxicity, url_rules, warc
from .common import shared_dir, table

#: Where the public vocabulary files lie; a parameter of the queries, never part of this repository.
TOKENIZER_DIR: str | None = None


def tokenizer_path(name: str) -> str:
    if TOKENIZER_DIR:
        return f"{TOKENIZER_DIR}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


#: Rules of the url query: (verdict, host, path).
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Target shares of the mixing query; the sources not named share the rest equally.
MIX_WEIGHTS, MIX_SEED = {"src0": 0.1, "src1": 0.1}, "mix-1"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), length=200, keep_bytes=False)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85, missing_ids=True)


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_rules.judge(pages, url_rules.rule_frame(pages, URL_RULES))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, seed=MIX_SEED)
    return mixing.spread(mixed, "copy", "mix_key")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc.round_trip(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"), min_bytes=0)
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out(F.col("doc_id")))
    prototypes = language_id.fit(docs, ~F.col("held_out"))
    return language_id.predict(docs, prototypes).select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), keep_ids=False)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=10, scale=1024)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tampered = F.when(picked, manifest.lowered(F.col("text"))).otherwise(F.col("text"))
    return manifest.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], group_col="lang", changed={"text": tampered}).drop("path")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~language_id.held_out(F.col("id")))
    scored = toxicity.scores(docs, models)
    return scored.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP4_SQL = """
WITH rules(says, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), urls AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages
), fits AS (
  SELECT page_id, host, path, h || p AS rule, says,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC) AS place
  FROM urls LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(says, 'allow') AS verdict FROM fits WHERE place = 1
"""

OP5_SQL = """
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), named AS (
  SELECT source, n, CASE WHEN source IN ('src0', 'src1') THEN 0.1e0 END AS share FROM counts
), raw AS (
  SELECT source, n, coalesce(share, (1e0 - (0.1e0 + 0.1e0)) / (SELECT count(*) FROM named WHERE share IS NULL)) AS raw FROM named
), rates AS (
  SELECT source, raw / (SELECT sum(raw) FROM raw) * (SELECT sum(n) FROM raw) / n AS mean FROM raw
), steps AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS total FROM rates
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), total + p * mean / (k + 1) FROM steps WHERE k < ceil(mean + 12 * sqrt(mean) + 20)
), draws AS (
  SELECT d.*, CAST('0x' || substr(md5('mix-1|' || doc_id), 1, 13) AS BIGINT) / 4503599627370496e0 AS u FROM documents d
), copies AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(s.k) AS c
  FROM draws d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.total <= d.u GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, copy, md5('mix-1|order|' || doc_id || '|' || copy) AS mix_key
FROM (SELECT *, unnest(range(1, c + 1)) AS copy FROM copies)
"""

OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages
)
SELECT page_id, strlen(html) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to, true AS complete
FROM p
"""

OP10_SQL = """
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM x q JOIN x c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP11_SQL = """
WITH RECURSIVE rows AS (
  SELECT doc_id, lang, source, n_chars, text,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM documents
), fields AS (
  SELECT *, CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS now,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
           || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM rows
), leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS found FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves
), up AS (
  SELECT lang, 0 AS level, pos, n, leaf AS node FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY lang, level, pos // 8, n
), subroots AS (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang IS NOT NULL, lang::BLOB) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
), over AS (
  SELECT 0 AS level, pos, n, subroot AS node FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY pos)) FROM over WHERE n > 1 GROUP BY level, pos // 8, n
), low_steps AS (
  SELECT lang, level, pos, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM up WHERE n > 1 WINDOW w AS (PARTITION BY lang, level, pos // 8 ORDER BY pos)
), high_steps AS (
  SELECT level, pos, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM over WHERE n > 1 WINDOW w AS (PARTITION BY level, pos // 8 ORDER BY pos)
), low_walk AS (
  SELECT doc_id, lang, leaf, pos AS start, 0 AS level, pos, n, found AS node, '' AS seen FROM placed
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, w.start, w.level + 1, w.pos // 8, (w.n + 7) // 8, sha256(s.l || w.node || s.r), w.seen || s.l || s.r
  FROM low_walk w JOIN low_steps s ON w.lang IS NOT DISTINCT FROM s.lang AND w.level = s.level AND w.pos = s.pos
), high_walk AS (
  SELECT w.doc_id, w.lang, w.leaf, w.start, s.subroot, 0 AS level, s.pos, s.n, w.node, w.seen FROM low_walk w JOIN subroots s ON w.lang IS NOT DISTINCT FROM s.lang WHERE w.n = 1
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, w.start, w.subroot, w.level + 1, w.pos // 8, (w.n + 7) // 8, sha256(s.l || w.node || s.r), w.seen || s.l || s.r
  FROM high_walk w JOIN high_steps s ON w.level = s.level AND w.pos = s.pos
)
SELECT w.doc_id, w.leaf, w.subroot, o.node AS root, sha256(w.seen) AS proof_sha256, w.node AS folded_root, w.node = o.node AS verified
FROM high_walk w, over o WHERE w.n = 1 AND o.n = 1
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_suffix_dedup, op3_ngram_join, op4_url_rules, op5_mixing, op6_language_id, op7_warc, op8_token_counts, op9_sentencepiece, op10_top_k, op11_merkle_manifest, op12_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op4_url_rules": OP4_SQL, "op5_mixing": OP5_SQL, "op7_warc": OP7_SQL, "op10_top_k": OP10_SQL, "op11_merkle_manifest": OP11_SQL}
