"""The jobs as queries: each runs twice over the whole tables into one new folder, and gives what stands there after the second run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import ingest, tone_index
from tonelake.plans.queries import NEAR_VIEWS, NORMAL, PROXY, ROWS, VIEWS, cut, rounded
from tonelake.session import shared_dir


def job1_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "job1", keep=True)
    for _ in range(2):
        ingest.run(spark, f"{sf_dir}/documents.parquet*", f"{folder}/output", f"{folder}/checkpoint", ingest.Settings(near_days=True))
    return ingest.result(spark, f"{folder}/output")


def job2_tone_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "job2", keep=True)
    for _ in range(2):
        tone_index.run(spark, sf_dir, f"{folder}/output")
    return rounded(tone_index.result(spark, f"{folder}/output"), "index_value", "breadth", "market_return")


JOB1_SQL = f"""WITH {NEAR_VIEWS}, {NORMAL}, digests AS (
  SELECT *, sha256(norm_text) AS text_sha256, CAST(length(norm_text) AS INT) AS n_chars FROM signed
), texts AS (
  SELECT day, text_sha256, count(*) AS n_posts, count(DISTINCT chat_id) AS n_channels, min(item_key) AS first_key FROM digests WHERE n_chars > 0 GROUP BY day, text_sha256
)
SELECT d.item_key, d.chat_id, d.message_id, d.date, d.day, d.text_sha256, d.n_chars, d.simhash, d.document_fp,
       coalesce(t.n_posts, 1) AS n_posts, coalesce(t.n_channels, 1) AS n_channels, coalesce(t.first_key, d.item_key) AS first_key
FROM digests d LEFT JOIN texts t USING (day, text_sha256)
"""

JOB2_SQL = f"""WITH {VIEWS}, {ROWS}, {PROXY}, valued AS (
  SELECT *, CAST(score AS DOUBLE) AS v, CAST(score AS DOUBLE) - avg(score) OVER (PARTITION BY chat_id, level) AS off FROM eligible WHERE level IN ('macro', 'market', 'sector', 'stock')
), per AS (
  SELECT day, level, count(*) AS n_items, count(DISTINCT chat_id) AS n_channels, count(*) / (count(*) + 5e0) * (coalesce(sum(v), 0) / count(*)) AS shrunk,
         coalesce(sum(off), 0) / count(*) AS demeaned, (count(*) FILTER (score > 0) - count(*) FILTER (score < 0)) / CAST(count(*) AS DOUBLE) AS breadth
  FROM valued GROUP BY day, level
), long AS (
  SELECT day, level, n_items, n_channels, breadth, m.method, CASE m.method WHEN 'shrinkage' THEN shrunk WHEN 'breadth' THEN breadth ELSE demeaned END AS x
  FROM per, (VALUES ('shrinkage'), ('channel_demeaned'), ('breadth')) m(method)
), shared AS (
  SELECT *, CASE level WHEN 'macro' THEN 0.4e0 WHEN 'market' THEN 0.3e0 WHEN 'stock' THEN 0.2e0 END AS share FROM long WHERE level <> 'sector'
), both_kinds AS (
  SELECT day, level, method, x, n_items, n_channels, breadth FROM long
  UNION ALL
  SELECT day, 'composite', method, sum(share * x) / sum(share), CAST(sum(n_items) AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE) FROM shared GROUP BY day, method
), placed AS (
  SELECT *, (SELECT min(c.date) FROM calendar c WHERE c.date >= CAST(b.day AS DATE)) AS session FROM both_kinds b
)
SELECT p.day, p.method, p.level, {cut('p.x')} AS index_value, p.n_items, p.n_channels, {cut('p.breadth')} AS breadth, p.session, {cut('m.market_return')} AS market_return, m.n_tickers
FROM placed p LEFT JOIN proxy m ON m.date = p.session
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (job1_ingest, job2_tone_index)}


def oracle_sql() -> dict[str, str]:
    return {"job1_ingest": JOB1_SQL, "job2_tone_index": JOB2_SQL}
