"""Every operator as a query over the whole test tables, next to SQL that a second engine can run.

Doubles that come from sums are cut to six places by ``floor(x * 1e6 + 0.5) / 1e6``, which has one meaning in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions import text as T
from tonelake.operators import calibration, dedupe, market, report, scoring, toneindex, validation
from tonelake.operators import scores as S
from tonelake.session import shared_dir, stored
from tonelake.sources import synthetic as data
from tonelake.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
VIEWS, NEAR_VIEWS = data.sql_views(), data.sql_views(near=True)
# Common table expressions that several queries share.
ROWS = """broad AS (
  SELECT s.*, i.date AS item_date, substr(i.date, 1, 10) AS day, i.is_cluster_head, i.mention_channels, s.direction * s.magnitude AS score
  FROM scores s JOIN items i ON i.chat_id = s.chat_id AND i.message_id = s.message_id
  WHERE s.rubric_version = 'v2' AND s.direction IS NOT NULL AND (i.is_cluster_head = 1 OR i.is_cluster_head IS NULL)
), confident AS (SELECT * FROM broad WHERE confidence IS NULL OR confidence >= 0.4),
eligible AS (SELECT * FROM confident WHERE novelty IS NULL OR novelty <> 'recap')"""
CALENDAR = "calendar AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM prices))"
PROXY = CALENDAR + """, covered AS (
  SELECT ticker FROM prices GROUP BY ticker HAVING count(close) / (SELECT count(*) FROM calendar) >= 0.95
), returns AS (
  SELECT a.date, c.pos, a.ticker, CASE WHEN b.close <> 0 THEN a.close / b.close - 1 END AS ret
  FROM prices a JOIN calendar c ON a.date = c.date LEFT JOIN calendar d ON d.pos = c.pos - 1 LEFT JOIN prices b ON b.ticker = a.ticker AND b.date = d.date
), proxy AS (
  SELECT date, avg(ret) AS market_return, stddev_samp(ret) AS vol, count(ret) AS n_tickers
  FROM returns WHERE ticker IN (SELECT ticker FROM covered) GROUP BY date HAVING count(ret) > 0
)"""
SHRUNK = """, shrunk AS (
  SELECT CAST(day AS DATE) AS date, count(*) AS n_items, count(*) / (count(*) + 5e0) * (coalesce(sum(CAST(score AS DOUBLE)), 0) / count(*)) AS index_value
  FROM {rows} GROUP BY day
)"""
CORR = "CASE WHEN stddev_pop(x) * stddev_pop(y) <> 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END"


def cut(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def r6(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * 1e6 + 0.5).cast("double") / 1e6


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def query(sql: str | None = None, views: str | None = VIEWS) -> Callable[[Query], Query]:
    """Registers a function under its name. ``sql`` goes behind the table expressions: either ``SELECT ...`` or ``, more AS (...) SELECT ...``."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"WITH {views}\n{sql}" if views else sql
        return f

    return add


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return data.items(spark, sf_dir), data.scores(spark, sf_dir)


def kept_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as a stored table, for plans that read them several times (calendar, returns, proxy)."""
    return stored(data.prices(spark, sf_dir), "prices")


# Sources, sinks and changes of tables


@query("SELECT date, ticker, close FROM prices WHERE date >= DATE '1998-03-01'")
def s3_prices_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.prices_since(data.prices(spark, sf_dir), "1998-03-01")


MESSAGES_SQL = """, messages AS (
  SELECT i.chat_id, i.message_id + k AS message_id, i.date, CASE WHEN (i.message_id + k) % 5 <> 0 THEN i.text END AS text,
         (i.message_id + k) % 7 = 0 AS has_photo, (i.message_id + k) % 11 = 0 AS has_document
  FROM items i, (VALUES (0), (100000)) v(k)
), known AS (SELECT * FROM items WHERE chat_id <> 3)"""


def _messages(items: DataFrame) -> DataFrame:
    both_times = items.withColumn("message_id", F.explode(F.array(F.col("message_id"), F.col("message_id") + 100000)))
    n = F.col("message_id")
    return both_times.select("chat_id", "message_id", "date", F.when(n % 5 != 0, F.col("text")).alias("text"), (n % 7 == 0).alias("has_photo"), (n % 11 == 0).alias("has_document"))


@query(MESSAGES_SQL + """, marks AS (SELECT chat_id, max(message_id) AS last_id FROM known GROUP BY chat_id)
SELECT m.chat_id, m.message_id, m.date, m.text, m.has_photo, m.has_document FROM messages m LEFT JOIN marks k ON m.chat_id = k.chat_id
WHERE (CASE WHEN k.last_id IS NULL THEN CAST(substr(m.date, 1, 10) AS DATE) >= DATE '1998-06-15' - 30 ELSE m.message_id > k.last_id END)
  AND (length(m.text) > 0 OR m.has_photo OR m.has_document)""")
def s4_new_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = data.items(spark, sf_dir)
    return tables.new_messages(_messages(items), items.filter("chat_id <> 3"), now=F.lit("1998-06-15"))


@query("SELECT chat_id, max(message_id) AS last_id FROM items GROUP BY chat_id UNION ALL SELECT 999, 0")
def s5_high_water_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = data.items(spark, sf_dir)
    channels = items.select("chat_id").distinct().unionByName(spark.createDataFrame([(999,)], "chat_id bigint"))
    return tables.high_water_marks(items, channels)


@query("""SELECT chat_id, message_id, chat_name, date, CASE WHEN message_id % 2 = 0 THEN 'text' ELSE type END AS type,
  CASE WHEN message_id % 2 = 0 THEN 'edited' ELSE text END AS text, extracted_text, mention_channels FROM items
UNION ALL SELECT chat_id, message_id + 1000000, chat_name, date, 'text', 'edited', NULL, NULL FROM items WHERE message_id % 2 = 0""")
def s7_upsert_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = data.items(spark, sf_dir)
    edits = items.filter("message_id % 2 = 0").select("chat_id", F.explode(F.array(F.col("message_id"), F.col("message_id") + 1000000)).alias("message_id"), "chat_name", "date", F.lit("text").alias("type"), F.lit("edited").alias("text"))
    return tables.upsert_items(items, edits).select("chat_id", "message_id", "chat_name", "date", "type", "text", "extracted_text", "mention_channels")


@query("""SELECT chat_id, message_id, rubric_version, CASE WHEN message_id % 3 = 0 AND rubric_version = 'v2' THEN 1 ELSE direction END AS direction,
  CASE WHEN message_id % 3 = 0 AND rubric_version = 'v2' THEN '1999-01-02' ELSE scored_at END AS scored_at FROM scores""")
def s8_upsert_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = data.scores(spark, sf_dir)
    base = scores.filter("message_id % 3 = 0 and rubric_version = 'v2'")
    older = base.withColumns({"direction": F.lit(-1), "scored_at": F.lit("1999-01-01")})
    newer = base.withColumns({"direction": F.lit(1), "scored_at": F.lit(None).cast("string")})
    out = tables.upsert_scores(scores, older.unionByName(newer), now=F.lit("1999-01-02"))
    return out.select("chat_id", "message_id", "rubric_version", "direction", "scored_at")


@query("""SELECT chat_id, message_id, CASE WHEN message_id % 4 = 0 THEN 'new' ELSE summary END AS summary,
  CASE WHEN message_id % 4 = 0 THEN 1.5e0 ELSE sentiment_score END AS sentiment_score, CASE WHEN message_id % 4 = 0 THEN 'macro' ELSE scope END AS scope,
  CASE WHEN message_id % 4 = 0 THEN 'now' END AS summarized_at FROM items""")
def s9_update_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = data.items(spark, sf_dir)
    new = items.filter("message_id % 4 = 0").select("chat_id", "message_id", F.lit("new").alias("summary"), F.lit(1.5).alias("sentiment_score"), F.lit("macro").alias("scope"), F.lit("t").alias("topic"))
    return tables.update_summaries(items, new, now=F.lit("now")).select("chat_id", "message_id", "summary", "sentiment_score", "scope", "summarized_at")


@query("""SELECT chat_id, message_id, CASE WHEN type = 'photo' THEN NULL ELSE extracted_text END AS extracted_text,
  CASE WHEN type = 'photo' THEN 'image_pending' WHEN message_id % 6 = 0 THEN 'ok' ELSE extract_status END AS extract_status,
  CASE WHEN type = 'photo' THEN 0 WHEN message_id % 6 = 0 THEN coalesce(length(extracted_text), 0) ELSE extract_chars END AS extract_chars FROM items""")
def s10_update_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = data.items(spark, sf_dir)
    photo = F.col("type") == "photo"
    new = items.filter(photo | (F.col("message_id") % 6 == 0)).select("chat_id", "message_id", F.when(~photo, F.col("extracted_text")).alias("extracted_text"), F.when(photo, "image_pending").otherwise("ok").alias("extract_status"))
    return tables.update_extractions(items, new, now=F.lit("now")).select("chat_id", "message_id", "extracted_text", "extract_status", "extract_chars")


@query("""SELECT chat_id, message_id, CASE WHEN substr(date, 1, 10) <> '1998-02-01' THEN summary END AS summary,
  CASE WHEN substr(date, 1, 10) <> '1998-02-01' THEN sentiment_score END AS sentiment_score FROM items""")
def s12_reset_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.reset_summaries(data.items(spark, sf_dir), "1998-02-01").select("chat_id", "message_id", "summary", "sentiment_score")


@query("SELECT chat_id, message_id, CAST(direction AS INT) AS direction, TRY_CAST(magnitude AS DOUBLE) AS magnitude, level FROM gold_raw WHERE direction IS NOT NULL")
def s14_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.typed_gold(data.gold(spark, sf_dir))


@query("SELECT chat_id, message_id, NULL AS direction, NULL AS magnitude, NULL AS level FROM (SELECT DISTINCT chat_id, message_id FROM scores) ORDER BY md5(concat('42_', chat_id, '_', message_id)) LIMIT 60")
def s16_gold_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.gold_template(data.scores(spark, sf_dir))


@query("SELECT chat_id, message_id, chat_name, type, file_path, date FROM items WHERE type IN ('document', 'photo') AND extract_status IS NULL")
def s20_pending_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pending_media(data.items(spark, sf_dir))


# Projections and filters


@query(f", {ROWS} SELECT chat_id, message_id, day, level, score, confidence, mention_channels FROM eligible")
def f1_index_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.index_set(*both(spark, sf_dir)).select("chat_id", "message_id", "day", "level", "score", "confidence", "mention_channels")


@query("SELECT chat_id, message_id, chat_name FROM items WHERE substr(date, 1, 10) >= '1998-05-01'")
def f4_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.on_days(data.items(spark, sf_dir), since="1998-05-01").select("chat_id", "message_id", "chat_name")


@query("SELECT DISTINCT substr(date, 1, 10) AS day FROM items WHERE sentiment_score IS NULL AND text IS NOT NULL")
def f6_unscored_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unscored_days(data.items(spark, sf_dir))


@query("SELECT chat_id, message_id, date FROM items WHERE summary IS NULL")
def f7_unsummarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unsummarised(data.items(spark, sf_dir)).select("chat_id", "message_id", "date")


@query(f", {ROWS} SELECT chat_id, message_id, day, level, direction, magnitude, score, novelty FROM broad")
def f8_broad_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.broad_set(*both(spark, sf_dir)).select("chat_id", "message_id", "day", "level", "direction", "magnitude", "score", "novelty")


EVENTS = """events AS (SELECT s.chat_id, s.message_id, s.rubric_version, s.ticker, s.direction, CAST(substr(i.date, 1, 10) AS DATE) AS event_date
  FROM scores s JOIN items i ON i.chat_id = s.chat_id AND i.message_id = s.message_id WHERE s.ticker IS NOT NULL AND s.direction IS NOT NULL AND s.direction <> 0)"""


@query(f", {EVENTS} SELECT * FROM events")
def f9_tagged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tagged_events(*both(spark, sf_dir))


@query("""SELECT chat_id, message_id, CAST(sign(sentiment_score) AS INT) AS direction, CAST(least(3, round_even(abs(sentiment_score), 0)) AS INT) AS magnitude, scope AS level
FROM items WHERE sentiment_score IS NOT NULL""")
def f13_migrate_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.migrate_legacy(data.items(spark, sf_dir))


# Joins


@query("""SELECT s.chat_id, s.message_id, s.rubric_version, s.scored_at, s.direction * s.magnitude AS score FROM scores s
JOIN (SELECT chat_id, message_id, max(scored_at) AS m FROM scores GROUP BY ALL) l ON s.chat_id = l.chat_id AND s.message_id = l.message_id AND s.scored_at = l.m""")
def j2_latest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest_scores(data.scores(spark, sf_dir)).select("chat_id", "message_id", "rubric_version", "scored_at", "score")


@query("""SELECT chat_id, message_id, date FROM items i WHERE (text IS NOT NULL OR extracted_text IS NOT NULL)
AND NOT EXISTS (SELECT 1 FROM scores s WHERE s.chat_id = i.chat_id AND s.message_id = i.message_id AND s.rubric_version = 'finbert-v1')""")
def j3_unscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unscored(*both(spark, sf_dir), rubric="finbert-v1").select("chat_id", "message_id", "date")


PAIRS = """pairs AS (SELECT g.chat_id, g.message_id, g.direction AS direction_a, f.direction AS direction_b, g.direction * g.magnitude AS score_a, f.direction * f.magnitude AS score_b
  FROM scores g JOIN scores f ON g.chat_id = f.chat_id AND g.message_id = f.message_id
  WHERE g.rubric_version = 'v2' AND f.rubric_version = 'finbert-v1' AND g.direction IS NOT NULL AND f.direction IS NOT NULL)"""


@query(f", {PAIRS} SELECT * FROM pairs")
def j4_rubric_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rubric_pairs(data.scores(spark, sf_dir))


@query(f", {EVENTS} SELECT DISTINCT event_date, (SELECT min(p.date) FROM prices p WHERE p.date >= event_date) AS session FROM events")
def j9_next_trading_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = S.tagged_events(*both(spark, sf_dir)).select("event_date").distinct()
    return market.next_trading_day(events, kept_prices(spark, sf_dir), "event_date")


BOILERPLATE_SQL = "x"
for _p in T.BOILERPLATE:
    BOILERPLATE_SQL = f"regexp_replace({BOILERPLATE_SQL}, '{_p}', ' ', 'gs')"
NORMAL = f"""plain AS (
  SELECT *, concat(coalesce(text, ''), ' ', coalesce(extracted_text, '')) AS raw FROM items
), stripped AS (
  SELECT *, regexp_replace(regexp_replace(raw, 'https?://\\S+', ' ', 'g'), '\\d{{2,3}}-\\d{{3,4}}-\\d{{4}}', ' ', 'g') AS x FROM plain
), prints AS (
  SELECT chat_id, message_id, date, type, concat(chat_id, '_', message_id) AS item_key, CAST(substr(date, 1, 10) AS DATE) AS day,
         lower(trim(regexp_replace(regexp_replace({BOILERPLATE_SQL}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS norm_text,
         CASE WHEN type = 'document' AND length(extracted_text) > 0 THEN concat(extract_chars, ':', md5(substr(extracted_text, 1, 1000))) END AS document_fp
  FROM stripped
), hashed AS (
  SELECT item_key, CAST('0x' || substr(md5(t), 17, 16) AS UBIGINT) AS h FROM (SELECT item_key, unnest(string_split(norm_text, ' ')) AS t FROM prints) WHERE length(t) > 1
), bit_sums AS (
  SELECT item_key, i, sum(CASE WHEN (h >> CAST(i AS UBIGINT)) & 1 = 1 THEN 1 ELSE -1 END) AS w FROM hashed, range(0, 64) r(i) GROUP BY item_key, i
), simhashes AS (
  SELECT item_key, CAST(sum(CASE WHEN w > 0 THEN CAST(1 AS HUGEINT) << CAST(i AS INT) ELSE 0 END) AS HUGEINT) AS u FROM bit_sums GROUP BY item_key
), signed AS (
  SELECT p.*, CAST(CASE WHEN coalesce(u, 0) >= 9223372036854775808 THEN u - 18446744073709551616 ELSE coalesce(u, 0) END AS BIGINT) AS simhash
  FROM prints p LEFT JOIN simhashes s USING (item_key)
)"""


@query(f", {NORMAL} SELECT item_key, chat_id, message_id, date, day, norm_text, document_fp, simhash FROM signed", NEAR_VIEWS)
def t_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.fingerprints(data.items(spark, sf_dir, near=True))


@query(f""", {NORMAL}, reps AS (SELECT norm_text, day, min(item_key) AS rep, min(simhash) AS simhash FROM signed WHERE norm_text <> '' GROUP BY norm_text, day)
SELECT a.rep AS a, b.rep AS b FROM reps a JOIN reps b ON (a.day < b.day OR a.day = b.day AND a.rep < b.rep) AND b.day - a.day <= 1
WHERE bit_count(xor(a.simhash, b.simhash)) <= 10""", NEAR_VIEWS)
def j10_candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Stored, as texts would be normalised again for each condition on them.
    prints = stored(dedupe.fingerprints(data.items(spark, sf_dir, near=True)).select("item_key", "day", "norm_text", "simhash"), "prints")
    return dedupe.candidate_pairs(prints).select("a", "b")


@query()
def t_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.cluster_items(data.items(spark, sf_dir, near=True))


@query()
def a13_cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.size_histogram(dedupe.cluster_items(data.items(spark, sf_dir, near=True)))


@query()
def a14_cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.cluster_summary(dedupe.cluster_items(data.items(spark, sf_dir, near=True)))


# Only equal texts count as similar here, which SQL can tell; the clusters are all that can be reached by links, found round by round.
COPIES = f""", {NORMAL}, links AS (
  SELECT a.item_key AS a, b.item_key AS b FROM signed a JOIN signed b ON a.norm_text = b.norm_text AND a.norm_text <> '' AND abs(a.day - b.day) <= 1 AND a.item_key <> b.item_key
  UNION SELECT a.item_key, b.item_key FROM signed a JOIN signed b ON a.document_fp = b.document_fp AND a.item_key <> b.item_key
), reached AS (SELECT item_key AS a, item_key AS b FROM signed UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
named AS (SELECT b AS item_key, min(a) AS dup_cluster_id FROM reached GROUP BY b),
sized AS (SELECT dup_cluster_id, CAST(count(DISTINCT chat_id) AS INT) AS mention_channels, arg_min(item_key, (date, message_id, chat_id)) AS head FROM named JOIN signed USING (item_key) GROUP BY dup_cluster_id),
clusters AS (SELECT s.chat_id, s.message_id, item_key, dup_cluster_id, CAST(item_key = head AS INT) AS is_cluster_head, mention_channels FROM signed s JOIN named USING (item_key) JOIN sized USING (dup_cluster_id))"""


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.cluster_items(data.items(spark, sf_dir, near=True), hamming_limit=3, ratio=100.0)


@query(COPIES + " SELECT * FROM clusters", "RECURSIVE " + NEAR_VIEWS)
def t_copy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir)


@query(COPIES + " SELECT mention_channels, count(*) AS n_clusters FROM clusters WHERE is_cluster_head = 1 GROUP BY mention_channels", "RECURSIVE " + NEAR_VIEWS)
def a13_copy_cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.size_histogram(_copies(spark, sf_dir))


@query(COPIES + """ SELECT count(*) AS n_items, count(*) FILTER (is_cluster_head = 1) AS n_clusters, count(*) FILTER (is_cluster_head = 1 AND mention_channels > 1) AS n_cross_channel FROM clusters""", "RECURSIVE " + NEAR_VIEWS)
def a14_copy_cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.cluster_summary(_copies(spark, sf_dir))


# The limits of the operator, over posts short enough for 128-bit integers: candidates are compared by their longest common subsequence, and clusters take the
# smallest name among their neighbours round by round.
CATALOGUE = f""", {NORMAL}, reps AS (SELECT norm_text, day, min(item_key) AS rep, min(simhash) AS simhash FROM signed WHERE norm_text <> '' GROUP BY norm_text, day),
pairs AS (SELECT a.rep AS p, b.rep AS q, a.norm_text AS a, b.norm_text AS b, (CAST(1 AS HUGEINT) << length(a.norm_text)) - 1 AS ones FROM reps a JOIN reps b
  ON a.rep < b.rep AND abs(a.day - b.day) <= 1 AND bit_count(xor(a.simhash, b.simhash)) <= 10),
steps AS (SELECT *, list_transform(range(1, length(b) + 1), lambda j: list_sum(list_transform(range(1, length(a) + 1), lambda i: CASE WHEN substr(a, i, 1) = substr(b, j, 1) THEN CAST(1 AS HUGEINT) << (i - 1) ELSE 0 END))) AS masks FROM pairs),
folded AS (SELECT *, list_reduce(masks, lambda row_, mask: ((row_ + (row_ & CAST(mask AS HUGEINT))) | xor(row_, row_ & CAST(mask AS HUGEINT))) & ones, ones) AS final FROM steps),
found AS (
  SELECT p, q FROM folded WHERE 200 * (length(a) - bit_count(final)) >= 85 * (length(a) + length(b))
  UNION SELECT r.rep, s.item_key FROM reps r JOIN signed s USING (norm_text, day)
), links AS (SELECT p AS a, q AS b FROM found UNION SELECT q, p FROM found),
rounds AS (
  SELECT 0 AS k, item_key, item_key AS label FROM signed
  UNION ALL
  SELECT r.k + 1, l.a, min(r.label) FROM rounds r JOIN links l ON l.b = r.item_key WHERE r.k < 60 GROUP BY r.k + 1, l.a
), named AS (SELECT item_key, label AS dup_cluster_id FROM rounds WHERE k = 60),
sized AS (SELECT dup_cluster_id, CAST(count(DISTINCT chat_id) AS INT) AS mention_channels, arg_min(item_key, (date, message_id, chat_id)) AS head FROM named JOIN signed USING (item_key) GROUP BY dup_cluster_id),
clusters AS (SELECT s.chat_id, s.message_id, item_key, dup_cluster_id, CAST(item_key = head AS INT) AS is_cluster_head, mention_channels FROM signed s JOIN named USING (item_key) JOIN sized USING (dup_cluster_id))"""
CATALOGUE_VIEW = "RECURSIVE " + data.catalogue_view()


@query(CATALOGUE + " SELECT * FROM clusters", CATALOGUE_VIEW)
def t_catalogue_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.cluster_items(data.catalogue(spark, sf_dir))


@query(CATALOGUE + " SELECT mention_channels, count(*) AS n_clusters FROM clusters WHERE is_cluster_head = 1 GROUP BY mention_channels", CATALOGUE_VIEW)
def a13_catalogue_cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.size_histogram(dedupe.cluster_items(data.catalogue(spark, sf_dir)))


@query(CATALOGUE + """ SELECT count(*) AS n_items, count(*) FILTER (is_cluster_head = 1) AS n_clusters, count(*) FILTER (is_cluster_head = 1 AND mention_channels > 1) AS n_cross_channel FROM clusters""", CATALOGUE_VIEW)
def a14_catalogue_cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.cluster_summary(dedupe.cluster_items(data.catalogue(spark, sf_dir)))


@query(CATALOGUE + " SELECT p AS a, q AS b FROM folded WHERE 200 * (length(a) - bit_count(final)) >= 85 * (length(a) + length(b))", CATALOGUE_VIEW)
def j11_similar_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = stored(dedupe.fingerprints(data.catalogue(spark, sf_dir), hashed=False).select("item_key", "day", "norm_text"), "prints")
    reps = stored(dedupe.representatives(prints), "representatives")
    found = dedupe.similar_links(reps, confirm="pairs")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


# The same bit-parallel table, in 128-bit integers: names are shorter than that.
@query("""WITH pairs AS (SELECT a.p_partkey, a.p_name AS a, b.p_name AS b, (CAST(1 AS HUGEINT) << length(a.p_name)) - 1 AS ones FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
steps AS (SELECT *, list_transform(range(1, length(b) + 1), lambda j: list_sum(list_transform(range(1, length(a) + 1), lambda i: CASE WHEN substr(a, i, 1) = substr(b, j, 1) THEN CAST(1 AS HUGEINT) << (i - 1) ELSE 0 END))) AS masks FROM pairs),
folded AS (SELECT *, list_reduce(masks, lambda row_, mask: ((row_ + (row_ & CAST(mask AS HUGEINT))) | xor(row_, row_ & CAST(mask AS HUGEINT))) & ones, ones) AS final FROM steps)
SELECT p_partkey, a, b, 200e0 * (length(a) - bit_count(final)) / (length(a) + length(b)) AS ratio FROM folded""", None)
def t_indel_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_name").alias("a"))
    following = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return parts.join(following, "p_partkey").select("p_partkey", "a", "b", T.indel_ratio("a", "b").alias("ratio"))


@query(f", {EVENTS} SELECT count(*) AS skipped FROM events WHERE ticker NOT IN (SELECT ticker FROM prices)")
def j12_events_without_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.events_without_prices(S.tagged_events(*both(spark, sf_dir)), data.prices(spark, sf_dir))


@query("SELECT chat_id, concat('채널', row_number() OVER (ORDER BY chat_id)) AS channel FROM (SELECT DISTINCT chat_id FROM items)")
def w8_channel_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.channel_labels(data.items(spark, sf_dir))


# Daily indices

BREADTH = "(coalesce(sum(CASE WHEN score > 0 THEN w END), 0) - coalesce(sum(CASE WHEN score < 0 THEN w END), 0)) / sum(w)"
MEAN = "CASE WHEN sum(w) <> 0 THEN coalesce(sum(v * w), 0) / sum(w) ELSE avg(v) END"


def index_sql(value: str, *, rows: str = "eligible", weight: str = "1e0", demean: bool = False, by: str = "") -> str:
    v = "CAST(score AS DOUBLE)" + (f" - avg(score) OVER (PARTITION BY chat_id{by})" if demean else "")
    return f""", {ROWS}, weighted AS (SELECT *, {weight} AS w, {v} AS v FROM {rows})
SELECT day{by}, {cut(value)} AS index_value, count(*) AS n_items, count(DISTINCT chat_id) AS n_channels, {cut(BREADTH)} AS breadth FROM weighted GROUP BY day{by}"""


SHRINK = f"count(*) / (count(*) + 5e0) * ({MEAN})"
CONSENSUS = "CAST(coalesce(mention_channels, 1) AS DOUBLE)"


def _index(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return rounded(toneindex.daily_index(*both(spark, sf_dir), **options), "index_value", "breadth")


@query(index_sql(SHRINK))
def daily_index_shrinkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)


@query(index_sql(SHRINK, rows="confident"))
def daily_index_with_recap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, include_recap=True)


@query(index_sql(SHRINK, weight=CONSENSUS))
def daily_index_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, by_consensus=True)


@query(index_sql(MEAN, demean=True))
def daily_index_channel_demeaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, method="channel_demeaned")


@query(index_sql(BREADTH))
def daily_index_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, method="breadth")


@query(index_sql(SHRINK, rows="(SELECT * FROM eligible WHERE level = 'market')"))
def daily_index_market_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, level="market")


@query(index_sql(MEAN, demean=True, by=", level", weight=CONSENSUS))
def level_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(toneindex.level_indices(*both(spark, sf_dir), method="channel_demeaned", by_consensus=True), "index_value", "breadth")


@query(f""", {ROWS}, per AS (SELECT day, level, count(*) AS n, count(*) / (count(*) + 5e0) * (coalesce(sum(CAST(score AS DOUBLE)), 0) / count(*)) AS x FROM eligible GROUP BY day, level),
shared AS (SELECT *, CASE level WHEN 'macro' THEN 0.4e0 WHEN 'market' THEN 0.3e0 WHEN 'stock' THEN 0.2e0 END AS share FROM per WHERE level IN ('macro', 'market', 'stock'))
SELECT day, {cut("sum(share * x) / sum(share)")} AS index_value, CAST(sum(n) AS BIGINT) AS n_items FROM shared GROUP BY day""")
def a8_weighted_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(toneindex.weighted_composite(*both(spark, sf_dir), toneindex.parse_weights("macro=0.4,market=0.3, stock=0.2")), "index_value")


# Market


@query(f", {PROXY} SELECT date, {cut('market_return')} AS market_return, {cut('vol')} AS cross_sectional_vol, n_tickers FROM proxy")
def m1_market_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.market_proxy(kept_prices(spark, sf_dir)), "market_return", "cross_sectional_vol")


@query(f", {PROXY} SELECT date, pos, ticker, {cut('ret')} AS ret FROM returns")
def w1_session_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.session_returns(data.prices(spark, sf_dir)), "ret").select("date", "pos", "ticker", "ret")


@query(f", {PROXY} SELECT ticker FROM covered")
def a10_eligible_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.eligible_tickers(data.prices(spark, sf_dir))


@query(f", {CALENDAR} SELECT date, pos FROM calendar")
def w9_trading_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.trading_calendar(data.prices(spark, sf_dir))


@query(f""", {PROXY} SELECT (SELECT count(*) FROM proxy) AS proxy_days, (SELECT arg_max(n_tickers, date) FROM proxy) AS last_tickers,
  min(date) AS first_session, max(date) AS last_session, count(*) AS n_sessions FROM calendar""")
def a35_proxy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.proxy_summary(kept_prices(spark, sf_dir))


@query(f", {PROXY} SELECT date, {cut('market_return')} AS market_return, n_tickers FROM proxy ORDER BY date DESC LIMIT 10")
def o7_last_proxy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.last_rows(market.market_proxy(kept_prices(spark, sf_dir))), "market_return").select("date", "market_return", "n_tickers")


@query("SELECT date, ticker, n FROM (SELECT date, ticker, count(*) AS n FROM prices GROUP BY ALL UNION ALL SELECT DATE '2000-01-01', 'x', 2) WHERE n > 1")
def t20_duplicate_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = spark.createDataFrame([("x", 1.0), ("x", 2.0)], "ticker string, close double").withColumn("date", F.lit("2000-01-01").cast("date"))
    return market.duplicate_prices(data.prices(spark, sf_dir).unionByName(twice))


# Validation


def _three(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    items, scores = both(spark, sf_dir)
    return toneindex.daily_index(items, scores), toneindex.daily_index(items, scores, include_recap=True), market.market_proxy(kept_prices(spark, sf_dir))


@query(f""", {ROWS}, {PROXY}{SHRUNK.format(rows="eligible")}, recap AS (SELECT CAST(day AS DATE) AS date, count(*) / (count(*) + 5e0) * (coalesce(sum(CAST(score AS DOUBLE)), 0) / count(*)) AS index_value FROM confident GROUP BY day),
sides AS (SELECT false AS include_recap, date, index_value AS x FROM shrunk UNION ALL SELECT true, date, index_value FROM recap),
c AS (SELECT include_recap, count(*) AS n, {CORR} AS corr FROM (SELECT include_recap, x, market_return AS y FROM sides JOIN proxy USING (date)) GROUP BY include_recap),
d AS (SELECT (SELECT abs(corr) FROM c WHERE include_recap) - (SELECT abs(corr) FROM c WHERE NOT include_recap) AS drop_)
SELECT include_recap, n, {cut("corr")} AS corr, n < 30 AS small_sample, {cut("drop_")} AS drop, coalesce(drop_ > 0.15, false) AS recap_driven FROM c, d""")
def m2_contemporaneous(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain, recap, proxy = _three(spark, sf_dir)
    return rounded(validation.contemporaneous(plain, recap, proxy), "corr", "drop")


@query(f""", {ROWS}, {PROXY}{SHRUNK.format(rows="eligible")}, placed AS (SELECT date, market_return, row_number() OVER (ORDER BY date) AS pos FROM proxy),
pairs AS (SELECT k, s.index_value AS x, b.market_return AS y FROM placed a JOIN range(-5, 6) r(k) ON true JOIN placed b ON b.pos = a.pos + k JOIN shrunk s ON s.date = a.date),
c AS (SELECT k, count(*) AS n, CASE WHEN count(*) >= 3 THEN {CORR} END AS corr FROM pairs GROUP BY k),
f AS (SELECT *, CASE WHEN n >= 4 AND abs(corr) < 1 THEN tanh(atanh(corr) - 1.96 / sqrt(n - 3)) END AS lo, CASE WHEN n >= 4 AND abs(corr) < 1 THEN tanh(atanh(corr) + 1.96 / sqrt(n - 3)) END AS hi FROM c)
SELECT CAST(r.k AS INT) AS k, {cut("corr")} AS corr, coalesce(n, 0) AS n, {cut("lo")} AS ci_lo, {cut("hi")} AS ci_hi, {cut("hi - corr")} AS err_plus, {cut("corr - lo")} AS err_minus
FROM range(-5, 6) r(k) LEFT JOIN f ON f.k = r.k""")
def m3_lead_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain, _, proxy = _three(spark, sf_dir)
    return rounded(validation.lead_lag(plain, proxy), "corr", "ci_lo", "ci_hi", "err_plus", "err_minus")


# erfc by its series of positive terms.
NORMAL_P = "1 - 2 / sqrt(pi()) * exp(-x * x) * list_sum(list_transform(range(0, 400), lambda k: exp(2 * k * ln(2e0) + (2 * k + 1) * ln(x) + lgamma(k + 1) - lgamma(2 * k + 2))))"
# Three normal equations by their adjugate; sums of products of scores at a distance, with Bartlett weights.
M4 = f""", {ROWS}, {PROXY}{SHRUNK.format(rows="eligible")}, placed AS (SELECT date, market_return, row_number() OVER (ORDER BY date) AS pos FROM proxy),
obs AS (SELECT row_number() OVER (ORDER BY a.date) AS i, b.market_return AS y, s.index_value AS x1, a.market_return AS x2 FROM placed a JOIN placed b ON b.pos = a.pos + 1 JOIN shrunk s ON s.date = a.date),
m AS (SELECT CAST(count(*) AS DOUBLE) AS a, sum(x1) AS b, sum(x2) AS c, sum(x1 * x1) AS d, sum(x1 * x2) AS e, sum(x2 * x2) AS f, sum(y) AS u, sum(x1 * y) AS v, sum(x2 * y) AS w FROM obs),
det AS (SELECT *, a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d) AS det FROM m),
inv AS (SELECT a AS n, u, v, w, [[(d * f - e * e) / det, (c * e - b * f) / det, (b * e - c * d) / det], [(c * e - b * f) / det, (a * f - c * c) / det, (b * c - a * e) / det],
  [(b * e - c * d) / det, (b * c - a * e) / det, (a * d - b * b) / det]] AS q FROM det),
beta AS (SELECT n, q, list_transform(q, lambda r: r[1] * u + r[2] * v + r[3] * w) AS beta FROM inv),
g AS (SELECT i, list_transform([1e0, x1, x2], lambda x: x * (y - beta[1] - beta[2] * x1 - beta[3] * x2)) AS g FROM obs, beta),
s AS (SELECT r, c, sum((CASE WHEN p.i = o.i THEN 1e0 ELSE 1 - abs(p.i - o.i) / 6e0 END) * p.g[r] * o.g[c]) AS s FROM g p JOIN g o ON abs(p.i - o.i) <= 5, range(1, 4) rr(r), range(1, 4) cc(c) GROUP BY r, c),
se AS (SELECT k, n, beta[k] AS coef, sqrt(greatest((SELECT sum(q[k][r] * s * q[c][k]) FROM s), 0)) AS std_err FROM beta, range(1, 4) kk(k)),
z AS (SELECT *, coef / nullif(std_err, 0) AS t, abs(coef / nullif(std_err, 0)) / sqrt(2) AS x FROM se)
SELECT ['const', 'index_t', 'return_t'][k] AS name, {cut("coef")} AS coef, {cut("std_err")} AS std_err, {cut("t")} AS t, {cut(NORMAL_P)} AS p, CAST(n AS BIGINT) AS n FROM z"""


@query(M4)
def m4_next_return_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain, _, proxy = _three(spark, sf_dir)
    return rounded(validation.next_return_regression(plain, proxy), "coef", "std_err", "t", "p")


PATHS = """, known AS (SELECT * FROM events WHERE ticker IN (SELECT ticker FROM prices)),
rolled AS (SELECT e.*, (SELECT min(p.date) FROM prices p WHERE p.date >= e.event_date) AS t0 FROM known e),
placed AS (SELECT r.*, c.pos AS t0_pos FROM rolled r JOIN calendar c ON c.date = r.t0),
above AS (SELECT r.ticker, r.pos, r.ret - p.market_return AS above FROM returns r JOIN proxy p ON p.date = r.date),
steps AS (SELECT p.*, g.k, coalesce(a.above, 0) AS gain FROM placed p JOIN range(-5, 11) g(k) ON true LEFT JOIN above a ON a.ticker = p.ticker AND a.pos = p.t0_pos + g.k),
paths AS (SELECT chat_id, message_id, rubric_version, ticker, direction, event_date, t0, CAST(k AS INT) AS k, sum(gain) OVER (PARTITION BY chat_id, message_id, rubric_version ORDER BY k) AS car FROM steps)"""


@query(f", {EVENTS}, {PROXY}{PATHS} SELECT chat_id, message_id, rubric_version, ticker, direction, event_date, t0, k, {cut('car')} AS car FROM paths")
def m5_event_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.event_paths(S.tagged_events(*both(spark, sf_dir)), kept_prices(spark, sf_dir)), "car")


# Student's distribution for whole degrees of freedom v: finite sums over powers of the cosine of the angle atan(t / sqrt(v)).
STUDENT_P = """1 - CASE WHEN v % 2 = 0
  THEN abs(sin(a)) * list_sum(list_transform(range(0, v // 2), lambda m: exp(lgamma(2 * m + 1) - 2 * m * ln(2e0) - 2 * lgamma(m + 1)) * power(cos(a), 2 * m)))
  ELSE 2 / pi() * (abs(a) + CASE WHEN v >= 3 THEN abs(sin(a)) * list_sum(list_transform(range(0, (v - 1) // 2), lambda m: exp(2 * m * ln(2e0) + 2 * lgamma(m + 1) - lgamma(2 * m + 2)) * power(cos(a), 2 * m + 1))) ELSE 0 END) END"""


@query(f""", {EVENTS}, {PROXY}{PATHS}, tested AS (SELECT direction, k, count(*) AS n, avg(car) AS mean_car, avg(car) / (stddev_samp(car) / sqrt(count(*))) AS t
  FROM paths WHERE k IN (0, 1, 3, 5, 10) GROUP BY direction, k HAVING count(*) >= 2), angles AS (SELECT *, n - 1 AS v, atan(t / sqrt(n - 1)) AS a FROM tested)
SELECT direction, k, n, {cut("mean_car")} AS mean_car, {cut("t")} AS t, {cut(STUDENT_P)} AS p, n < 30 AS small_sample FROM angles""")
def a20_event_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = validation.event_paths(S.tagged_events(*both(spark, sf_dir)), kept_prices(spark, sf_dir))
    return rounded(validation.event_summary(paths), "mean_car", "t", "p")


@query(f", {EVENTS}, {PROXY}{PATHS} SELECT direction, k, {cut('avg(car)')} AS mean_car, count(*) AS n FROM paths GROUP BY direction, k")
def a21_mean_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validation.mean_paths(validation.event_paths(S.tagged_events(*both(spark, sf_dir)), kept_prices(spark, sf_dir))), "mean_car")


@query(f""", {ROWS}, {PROXY}{SHRUNK.format(rows="eligible")}, numbered AS (SELECT *, row_number() OVER (ORDER BY date) AS pos FROM shrunk),
smooth AS (SELECT a.date, sum(b.index_value * power(0.8e0, a.pos - b.pos)) / sum(power(0.8e0, a.pos - b.pos)) AS ewma FROM numbered a JOIN numbered b ON b.pos <= a.pos GROUP BY a.date),
level AS (SELECT date, exp(sum(ln(1 + market_return)) OVER (ORDER BY date)) AS market_level FROM proxy WHERE date BETWEEN (SELECT min(date) FROM shrunk) AND (SELECT max(date) FROM shrunk))
SELECT date, {cut("index_value")} AS index_value, {cut("ewma")} AS ewma, n_items, {cut("ln(market_level)")} AS log_market_level
FROM (SELECT * FROM shrunk JOIN smooth USING (date)) FULL JOIN level USING (date)""")
def m9_index_against_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain, _, proxy = _three(spark, sf_dir)
    rows = validation.index_against_market(plain, proxy).withColumn("log_market_level", F.log("market_level"))
    return rounded(rows, "index_value", "ewma", "log_market_level").drop("market_level")


# Calibration and rubrics

MATCHED = """gold AS (SELECT chat_id, message_id, CAST(direction AS INT) AS direction, TRY_CAST(magnitude AS DOUBLE) AS magnitude, level FROM gold_raw WHERE direction IS NOT NULL),
m AS (SELECT g.direction AS dg, g.magnitude AS mg, g.level AS lg, s.direction AS ds, s.magnitude AS ms, s.level AS ls
  FROM gold g JOIN scores s ON g.chat_id = s.chat_id AND g.message_id = s.message_id WHERE s.rubric_version = 'v2')"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.matched(tables.typed_gold(data.gold(spark, sf_dir)), S.latest_scores(data.scores(spark, sf_dir), "v2"))


@query(f", {MATCHED} SELECT count(*) AS n, count(dg = ds) AS n_direction, {cut('avg(CAST(dg = ds AS DOUBLE))')} AS accuracy, count(mg - ms) AS n_magnitude, {cut('avg(abs(mg - ms))')} AS mae FROM m")
def m10_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.agreement(_matched(spark, sf_dir)), "accuracy", "mae")


@query(f", {MATCHED} SELECT lg AS level_gold, ls AS level_llm, count(*) AS n FROM m WHERE lg IS NOT NULL AND ls IS NOT NULL GROUP BY ALL")
def a19_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.confusion(_matched(spark, sf_dir))


@query(f""", {MATCHED}, p AS (SELECT dg * mg AS x, ds * ms AS y FROM m WHERE dg * mg IS NOT NULL AND ds * ms IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2e0 AS x, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2e0 AS y FROM p)
SELECT count(*) AS n, {cut(CORR)} AS rho FROM r""")
def a16_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.spearman(_matched(spark, sf_dir)), "rho")


@query(f", {PAIRS}, q AS (SELECT *, CASE WHEN score_b IS NOT NULL THEN score_a END AS x, CASE WHEN score_a IS NOT NULL THEN score_b END AS y FROM pairs) SELECT count(*) AS n, {cut('avg(CAST(direction_a = direction_b AS DOUBLE))')} AS agreement, {cut(CORR)} AS corr FROM q")
def a33_rubric_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.rubric_agreement(S.rubric_pairs(data.scores(spark, sf_dir))), "agreement", "corr")


# Report datasets


@query(f", {ROWS} SELECT level, score, count(*) AS n FROM broad WHERE score IS NOT NULL AND level IS NOT NULL GROUP BY ALL")
def a24_score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.score_histogram(S.broad_set(*both(spark, sf_dir)))


@query(f""", {ROWS}, w AS (SELECT level, CAST(date_trunc('week', CAST(day AS DATE)) AS DATE) AS week, avg(score) AS m FROM broad WHERE score IS NOT NULL AND level IS NOT NULL GROUP BY ALL)
SELECT l.level, d.week, strftime(d.week, '%m/%d') AS label, {cut("m")} AS mean_score FROM (VALUES ('macro'), ('market'), ('sector'), ('stock')) l(level) CROSS JOIN (SELECT DISTINCT week FROM w) d LEFT JOIN w USING (level, week)""")
def a22_level_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.level_weeks(S.broad_set(*both(spark, sf_dir))), "mean_score")


@query(f""", {ROWS}, labels AS (SELECT chat_id, concat('채널', row_number() OVER (ORDER BY chat_id)) AS channel, n_total FROM (SELECT chat_id, count(*) AS n_total FROM items GROUP BY chat_id))
SELECT b.chat_id, channel, {cut("avg(score)")} AS avg_score, count(*) AS n_scored, n_total, {cut("count(*) / CAST(n_total AS DOUBLE) * 100")} AS coverage_pct
FROM broad b JOIN labels USING (chat_id) GROUP BY b.chat_id, channel, n_total""")
def a23_channel_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, scores = both(spark, sf_dir)
    return rounded(report.channel_calibration(S.broad_set(items, scores), items), "avg_score", "coverage_pct")


@query(f""", {ROWS}, i AS (SELECT count(*) AS total_items, count(*) FILTER (text IS NOT NULL OR extracted_text IS NOT NULL) AS scorable,
  count(*) FILTER (type IN ('document', 'photo') AND (extract_status IS NULL OR extract_status <> 'ok')) AS extract_incomplete FROM items),
x AS (SELECT median(n) AS median_daily_n FROM (SELECT count(*) AS n FROM eligible GROUP BY day)), s AS (SELECT count(*) AS scored FROM scores WHERE rubric_version = 'v2' AND direction IS NOT NULL)
SELECT i.*, scored, (SELECT count(*) FROM eligible) AS n_valid, median_daily_n, {cut("scored * 100e0 / scorable")} AS coverage_pct FROM i, x, s""")
def a25_stat_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, scores = both(spark, sf_dir)
    return rounded(report.stat_strip(items, scores, S.index_set(items, scores), toneindex.daily_index(items, scores)), "coverage_pct")


@query(f", {ROWS} SELECT count(*) FILTER (level = 'stock' AND score > 0) AS n_positive, count(*) FILTER (level = 'stock' AND score < 0) AS n_negative FROM broad")
def a28_stock_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.stock_signs(S.broad_set(*both(spark, sf_dir)))


@query("""SELECT chat_name, type, extract_status, 0 AS is_total, count(*) AS n FROM items WHERE type IN ('document', 'photo') GROUP BY ALL
UNION ALL SELECT NULL, NULL, extract_status, 1, count(*) FROM items WHERE type IN ('document', 'photo') GROUP BY extract_status""")
def a29_extraction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.extraction_counts(data.items(spark, sf_dir))


RECENT = """labels AS (SELECT chat_id, concat('채널', row_number() OVER (ORDER BY chat_id)) AS channel FROM (SELECT DISTINCT chat_id FROM items)),
recent AS (SELECT i.date, channel, s.chat_id, s.message_id, s.level, s.direction, s.magnitude, s.direction * s.magnitude AS score, s.driver, s.novelty, i.mention_channels, s.summary
  FROM scores s JOIN items i ON i.chat_id = s.chat_id AND i.message_id = s.message_id JOIN labels l ON l.chat_id = s.chat_id
  WHERE s.rubric_version = 'v2' AND s.direction IS NOT NULL ORDER BY i.date DESC, s.chat_id, s.message_id LIMIT 150)"""


@query(f", {RECENT} SELECT * FROM recent")
def o2_recent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.recent_items(*both(spark, sf_dir))


@query(f", {RECENT} SELECT * FROM recent WHERE level = 'stock' AND contains(date, '1998-06')")
def f10_searched_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.searched(report.recent_items(*both(spark, sf_dir)), level="stock", date_part="1998-06")


@query("SELECT substr(i.date, 1, 10) AS day, s.rubric_version, count(*) AS n FROM scores s JOIN items i ON i.chat_id = s.chat_id AND i.message_id = s.message_id GROUP BY ALL")
def a30_scored_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.scored_per_day(*both(spark, sf_dir))


@query("""SELECT i.chat_id, i.message_id, CASE WHEN message_id % 2 = 0 THEN 'c' ELSE NULL END AS dup_cluster_id, CASE WHEN message_id % 2 = 0 THEN 1 ELSE is_cluster_head END AS is_cluster_head,
  CASE WHEN message_id % 2 = 0 THEN 5 ELSE mention_channels END AS mention_channels FROM items i""")
def s11_update_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = data.items(spark, sf_dir)
    new = items.filter("message_id % 2 = 0").select("chat_id", "message_id", F.lit("c").alias("dup_cluster_id"), F.lit(1).alias("is_cluster_head"), F.lit(5).alias("mention_channels"))
    return tables.update_clusters(items, new).select("chat_id", "message_id", "dup_cluster_id", "is_cluster_head", "mention_channels")


@query("""SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, extract_status NULLS LAST) AS INT) AS place, extract_status, count(*) AS n
FROM items WHERE type IN ('document', 'photo') GROUP BY extract_status""")
def o8_status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.status_totals(data.items(spark, sf_dir))


# Files written and read again, batches of work


@query("SELECT DISTINCT chat_id, chat_name FROM items")
def s13_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "channels")
    pairs = data.items(spark, sf_dir).select("chat_id", "chat_name").distinct()
    names = F.map_from_entries(F.collect_list(F.struct(F.col("chat_id").cast("string"), "chat_name")))  # a channel each
    pairs.agg(F.to_json(names).alias("value")).write.text(path)
    return tables.load_channels(spark, path)


@query("SELECT chat_id, message_id, CAST(direction AS INT) AS direction, TRY_CAST(magnitude AS DOUBLE) AS magnitude, level FROM gold_raw WHERE direction IS NOT NULL")
def s15_gold_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_gold(spark, tables.write_csv(data.gold(spark, sf_dir), shared_dir(spark, "gold") + "/gold.csv", "v2"))


@query("""SELECT CAST(to_json(struct_pack(chat_name := chat_name, type := type, extract_status := extract_status, is_total := is_total, n := n)) AS VARCHAR) AS record FROM (
SELECT chat_name, type, extract_status, 0 AS is_total, count(*) AS n FROM items WHERE type IN ('document', 'photo') GROUP BY ALL
UNION ALL SELECT NULL, NULL, extract_status, 1, count(*) FROM items WHERE type IN ('document', 'photo') GROUP BY extract_status)""")
def s18_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.json_records(report.extraction_counts(data.items(spark, sf_dir)).select("chat_name", "type", "extract_status", "is_total", "n"))


@query("SELECT chat_id, message_id, chat_name, type, file_path, date FROM items WHERE type IN ('document', 'photo') AND chat_name = 'src3' ORDER BY date, chat_id, message_id LIMIT 5")
def s20_media_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pending_media(data.items(spark, sf_dir), force=True, channel="src3", limit=5)


@query(MESSAGES_SQL + """ SELECT m.chat_id, m.message_id, concat_ws('/', 'media', i.chat_name, substr(m.date, 1, 7), CASE WHEN m.has_photo THEN concat(m.message_id, '.jpg') ELSE concat('f', m.message_id, '.pdf') END) AS path
FROM messages m JOIN items i ON i.chat_id = m.chat_id AND i.message_id = m.message_id % 100000 WHERE m.has_photo OR m.has_document""")
def s21_media_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = data.items(spark, sf_dir)
    names = items.select("chat_id", (F.col("message_id") % 100000).alias("n"), "chat_name")
    media = _messages(items).filter("has_photo or has_document").withColumn("n", F.col("message_id") % 100000).join(names, ["chat_id", "n"])
    named = media.withColumn("file_name", F.concat(F.lit("f"), F.col("message_id").cast("string"), F.lit(".pdf")))
    return named.select("chat_id", "message_id", tables.media_path("media").alias("path"))


@query("""SELECT chat_id, message_id, date FROM items i WHERE (text IS NOT NULL OR extracted_text IS NOT NULL) AND substr(date, 1, 10) >= '1998-02-01'
AND NOT EXISTS (SELECT 1 FROM scores s WHERE s.chat_id = i.chat_id AND s.message_id = i.message_id AND s.rubric_version = 'finbert-v1') ORDER BY date, chat_id, message_id LIMIT 25""")
def o3_work_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unscored(*both(spark, sf_dir), rubric="finbert-v1", since="1998-02-01", limit=25).select("chat_id", "message_id", "date")


# Texts and scorers


@query("SELECT chat_id, message_id, regexp_replace(concat_ws(chr(10) || chr(10), nullif(text, ''), nullif(extracted_text, '')), '^\\s+|\\s+$', '', 'g') AS input FROM items")
def t_scoring_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.items(spark, sf_dir).select("chat_id", "message_id", T.scoring_input(F.col("text"), F.col("extracted_text")).alias("input"))


@query("""SELECT page_id, nullif(regexp_extract(html, 'https?://\\S+'), '') AS url,
  CASE WHEN page_id % 5 = 0 THEN 'photo' WHEN page_id % 5 = 1 THEN 'document' WHEN regexp_extract(html, 'https?://\\S+') <> '' THEN 'link' ELSE 'text' END AS type FROM pages""", None)
def t_item_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("link", T.first_url(F.col("html")))
    return pages.select("page_id", F.col("link").alias("url"), T.item_type(F.col("page_id") % 5 == 0, F.col("page_id") % 5 == 1, F.col("link")).alias("type"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'no_file' WHEN doc_id % 7 = 1 THEN 'image_pending' WHEN doc_id % 7 = 2 THEN 'error'
  WHEN length(text) < 200 THEN 'scanned' ELSE 'ok' END AS extract_status FROM documents""", None)
def t_extract_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = F.col("doc_id") % 7
    path = F.when(n == 0, None).when(n == 1, "/a/b.JPG").when(n == 2, "/a.pdf/b.docx").otherwise("/a/b.PDF")
    return docs.select("doc_id", T.extract_status(path, F.lit(True), F.lit("document"), F.col("text")).alias("extract_status"))


@query("""SELECT doc_id, CASE label WHEN 'positive' THEN 1 WHEN 'neutral' THEN 0 WHEN 'negative' THEN -1 END AS direction,
  CASE WHEN label = 'neutral' THEN 0 WHEN p >= 0.9 THEN 3 WHEN p >= 0.75 THEN 2 WHEN p >= 0.5 THEN 1 ELSE 0 END AS magnitude
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'neutral' WHEN 2 THEN 'negative' ELSE 'other' END AS label, (n_chars % 101) / 100e0 AS p FROM documents)""", None)
def l6_classifier_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    label = F.get(F.array(*map(F.lit, ("positive", "neutral", "negative", "other"))), (F.col("doc_id") % 4).cast("int"))
    rows = docs.select("doc_id", label.alias("label"), ((F.col("n_chars") % 101) / F.lit(100.0)).alias("p"))
    return rows.select("doc_id", scoring.label_to_direction(F.col("label")).alias("direction"), scoring.confidence_to_magnitude(F.col("label"), F.col("p")).alias("magnitude"))


def echo_scorer(prompt: str) -> str:
    """A stand-in scorer that answers by rule: some entries valid, some out of range, some broken, some left out."""
    import json
    import re

    out = []
    for ident in re.findall(r"(?m)^\[(\d+_\d+)\] \(", prompt):
        n = int(ident.split("_")[1])
        if n % 7 == 0:
            continue
        entry = {"item_id": ident, "direction": n % 5 - 2, "magnitude": n % 6, "confidence": (n % 100) / 100, "level": "macro" if n % 11 else "galaxy", "sector_code": "bank" if n % 2 else "none", "summary": "s"}
        out.append(entry if n % 13 else {"item_id": ident, "direction": "up"})
    return json.dumps({"items": out})


@query("""SELECT chat_id, message_id, CASE WHEN ok THEN greatest(-1, least(1, message_id % 5 - 2)) END AS direction, CASE WHEN ok THEN least(3, message_id % 6) END AS magnitude,
  CASE WHEN ok THEN 'macro' END AS level, CASE WHEN ok AND message_id % 2 = 1 THEN 'bank' END AS sector_code
FROM (SELECT *, message_id % 7 <> 0 AND message_id % 13 <> 0 AND message_id % 11 <> 0 AS ok FROM items WHERE text IS NOT NULL OR extracted_text IS NOT NULL)""")
def l1_scored_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = data.items(spark, sf_dir).filter("text is not null or extracted_text is not null")
    rows = scoring.parse_responses(scoring.ask(scoring.prompts(waiting), echo_scorer))
    return rows.select("chat_id", "message_id", "direction", "magnitude", "level", "sector_code")


def moody_scorer(prompt: str) -> str:
    """A stand-in that fails where the first item listed has an even number."""
    if int(prompt.split("]")[0].split("_")[1]) % 2 == 0:
        raise RuntimeError("refused")
    return echo_scorer(prompt)


@query("""SELECT chat_id, message_id, CASE WHEN first_id % 2 = 0 THEN 'REQUEST_ERROR: refused' END AS error, first_id % 2 = 1 AND message_id % 7 <> 0 AND message_id % 13 <> 0 AND message_id % 11 <> 0 AS scored
FROM (SELECT *, first_value(message_id) OVER (PARTITION BY substr(date, 1, 10) ORDER BY date, chat_id, message_id) AS first_id FROM items WHERE text IS NOT NULL OR extracted_text IS NOT NULL)""")
def l5_request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = data.items(spark, sf_dir).filter("text is not null or extracted_text is not null")
    rows = scoring.parse_responses(scoring.ask(scoring.prompts(waiting), moody_scorer))
    failed = F.when(F.startswith("raw_response", F.lit("REQUEST_ERROR")), F.col("raw_response"))
    return rows.select("chat_id", "message_id", failed.alias("error"), F.col("direction").isNotNull().alias("scored"))


def old_scorer(prompt: str) -> str:
    """A stand-in for the old layout: scores beyond the bounds, unknown scopes, items left out and items nobody asked about."""
    import json
    import re

    ids = re.findall(r"(?m)^\[(\d+_\d+)\] \(", prompt)
    entries = [{"item_id": i, "summary": f"s{n}", "sentiment_score": n % 15 - 7, "scope": "macro" if n % 4 else "galaxy", "topic": "t"} for i in ids for n in [int(i.split("_")[1])] if n % 7]
    return json.dumps({"items": [*entries, {"item_id": "999_0", "summary": "", "sentiment_score": 1, "scope": "macro", "topic": ""}]})


@query("""SELECT chat_id, message_id, concat('s', message_id) AS summary, CAST(greatest(-5, least(5, message_id % 15 - 7)) AS DOUBLE) AS sentiment_score, 'macro' AS scope, 't' AS topic
FROM items WHERE text IS NOT NULL AND message_id % 7 <> 0 AND message_id % 4 <> 0""")
def l10_legacy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = data.items(spark, sf_dir).filter("text is not null")
    return scoring.legacy_scores(waiting, scoring.parse_legacy(scoring.ask(scoring.prompts(waiting), old_scorer)))


def length_classifier(texts: list[str]) -> list[tuple[str, float]]:
    """A stand-in classifier by the length of the text."""
    return [(("positive", "neutral", "negative")[len(t) % 3], len(t) % 100 / 100) for t in texts]


@query("""SELECT chat_id, message_id, 1 - n % 3 AS direction, CASE WHEN n % 3 = 1 THEN 0 WHEN n % 100 >= 90 THEN 3 WHEN n % 100 >= 75 THEN 2 WHEN n % 100 >= 50 THEN 1 ELSE 0 END AS magnitude, substr(input, 1, 200) AS summary
FROM (SELECT *, length(input) AS n FROM (SELECT chat_id, message_id, regexp_replace(concat_ws(chr(10) || chr(10), nullif(text, ''), nullif(extracted_text, '')), '^\\s+|\\s+$', '', 'g') AS input FROM items)) WHERE n > 0""")
def l8_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.classify(data.items(spark, sf_dir), length_classifier).select("chat_id", "message_id", "direction", "magnitude", "summary")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
