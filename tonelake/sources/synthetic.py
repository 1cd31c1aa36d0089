"""The domain tables derived from the star-schema test tables, by integer arithmetic that any SQL engine evaluates alike.

Each table is a list of SQL expressions over one driver table, so the same text gives the Spark frame and the second engine's view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.schemas import DRIVERS, HORIZONS, ITEMS, LEVELS, NOVELTY, PRICES, SCORES, SECTOR_CODES, conform


def h(salt: int, modulus: int) -> str:
    return f"(((doc_id * 7919 + {salt}) % 10007) % {modulus})"


def pick(values: tuple[str, ...], salt: int) -> str:
    return "CASE " + " ".join(f"WHEN {h(salt, len(values))} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


TYPE = f"CASE {h(1, 4)} WHEN 0 THEN 'document' WHEN 1 THEN 'photo' WHEN 2 THEN 'link' ELSE 'text' END"
LEVEL = pick(LEVELS, 8)
CHANNEL = "CAST(substr(source, 4) AS BIGINT)"
EXTRACTED = f"CASE WHEN {h(1, 4)} = 0 AND {h(13, 5)} <> 0 THEN text END"
ITEM_COLUMNS = {
    "chat_id": CHANNEL,
    "chat_name": "source",
    "message_id": "doc_id",
    "date": f"concat(CAST(DATE '1998-01-01' + CAST({h(11, 181)} AS INT) AS STRING), 'T00:00:00+00:00')",
    "type": TYPE,
    "text": f"CASE WHEN {h(14, 19)} <> 0 THEN text END",
    "url": f"CASE WHEN {h(1, 4)} = 2 THEN concat('https://example.org/', CAST(doc_id AS STRING)) END",
    "summary": f"CASE WHEN {h(28, 3)} = 0 THEN concat('s', CAST(doc_id AS STRING)) END",
    "sentiment_score": f"CASE WHEN {h(29, 5)} <> 0 THEN ({h(30, 21)} - 10) / 2e0 END",
    "scope": pick(LEVELS, 31),
    "topic": "lang",
    "extracted_text": EXTRACTED,
    "extract_status": f"CASE WHEN {h(1, 4)} = 1 THEN 'image_pending' WHEN {h(1, 4)} = 0 AND {h(13, 5)} <> 0 AND {h(15, 4)} = 1 THEN 'scanned' WHEN {h(1, 4)} = 0 AND {h(13, 5)} <> 0 THEN 'ok' END",
    "extract_chars": f"length({EXTRACTED})",
    "is_cluster_head": f"CASE {h(16, 9)} WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 1 END",
    "mention_channels": f"CASE WHEN {h(12, 4)} <> 0 THEN {h(12, 4)} END",
}
#: Items whose dates lie close together, so that copies fall inside and outside the duplicate window.
NEAR_DATE = "concat(CAST(DATE '1998-01-01' + CAST(doc_id % 5 AS INT) AS STRING), 'T00:00:00+00:00')"
#: Short posts about parts: many differ in a word or a number only.
CATALOGUE_COLUMNS = {
    "chat_id": "p_partkey % 7",
    "chat_name": "concat('c', CAST(p_partkey % 7 AS STRING))",
    "message_id": "p_partkey",
    "date": "concat(CAST(DATE '1998-01-01' + CAST(p_partkey % 5 AS INT) AS STRING), 'T00:00:00+00:00')",
    "type": "'text'",
    "text": "concat(p_name, ' ', p_brand, ' ', p_type, ' ', p_name, ' size ', CAST(p_size AS STRING), ' ', p_type, ' ', p_name)",
}
SCORE_COLUMNS = {
    "chat_id": CHANNEL,
    "message_id": "doc_id",
    "rubric_version": "'v2'",
    "model": "'m2'",
    "direction": f"CASE WHEN {h(2, 11)} <> 0 THEN {h(3, 3)} - 1 END",
    "magnitude": f"CASE WHEN {h(4, 13)} <> 0 THEN {h(5, 4)} END",
    "confidence": f"CASE WHEN {h(6, 17)} <> 0 THEN {h(7, 101)} / 100e0 END",
    "level": LEVEL,
    "sector_code": f"CASE WHEN {h(8, 4)} = 2 THEN {pick(SECTOR_CODES, 19)} END",
    "ticker": f"CASE WHEN {h(8, 4)} = 3 THEN lpad(CAST({h(10, 10)} AS STRING), 6, '0') END",
    "driver": pick(DRIVERS, 17),
    "novelty": pick(NOVELTY, 9),
    "horizon": pick(HORIZONS, 18),
    "scored_at": f"concat('1998-07-0', CAST(1 + {h(20, 3)} AS STRING), ' 00:00:00')",
}
CONFIDENCE = f"({h(22, 101)} / 100e0)"
CLASSIFIER_COLUMNS = {
    "chat_id": CHANNEL,
    "message_id": "doc_id",
    "rubric_version": "'finbert-v1'",
    "model": "'classifier'",
    "direction": "CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 ELSE 0 END",
    "magnitude": f"CASE WHEN toxic <> 1 AND quality <> 1 THEN 0 WHEN {CONFIDENCE} >= 0.9 THEN 3 WHEN {CONFIDENCE} >= 0.75 THEN 2 WHEN {CONFIDENCE} >= 0.5 THEN 1 ELSE 0 END",
    "confidence": CONFIDENCE,
    "scored_at": f"concat('1998-07-0', CAST(1 + {h(21, 3)} AS STRING), ' 00:00:00')",
}
GOLD_COLUMNS = {
    "chat_id": CHANNEL,
    "message_id": "doc_id",
    "direction": f"CASE WHEN {h(32, 9)} <> 0 THEN CAST({h(23, 3)} - 1 AS STRING) END",
    "magnitude": f"CASE {h(25, 7)} WHEN 0 THEN NULL WHEN 1 THEN 'n/a' ELSE CAST({h(24, 4)} AS STRING) END",
    "level": f"CASE WHEN {h(27, 5)} <> 0 THEN {pick(LEVELS, 26)} END",
}
CLOSE = "CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE)"
TICKER = "lpad(CAST(l_suppkey % 8 AS STRING), 6, '0')"
LABELLED = "(SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def _frame(df: DataFrame, columns: dict[str, str], layout: str) -> DataFrame:
    return conform(df.selectExpr(*[f"{v} AS {k}" for k, v in columns.items()]), layout)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_items(documents: DataFrame, *, near: bool = False) -> DataFrame:
    """Documents as items; ``near`` spreads them over five days only."""
    return _frame(documents, ITEM_COLUMNS | ({"date": NEAR_DATE} if near else {}), ITEMS)


def items(spark: SparkSession, sf_dir: str, *, near: bool = False) -> DataFrame:
    return as_items(_read(spark, sf_dir, "documents"), near=near)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as short posts within five days."""
    return _frame(_read(spark, sf_dir, "part"), CATALOGUE_COLUMNS, ITEMS)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores under both rubrics; the classifier's for labelled documents."""
    docs = _read(spark, sf_dir, "documents")
    labelled = docs.select("doc_id", "source").join(_read(spark, sf_dir, "labels"), "doc_id")
    return _frame(docs, SCORE_COLUMNS, SCORES).unionByName(_frame(labelled, CLASSIFIER_COLUMNS, SCORES))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-made labels as text, as a CSV file would have them, for the labelled documents."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.join(_read(spark, sf_dir, "labels").select("doc_id"), "doc_id").selectExpr(*[f"{v} AS {k}" for k, v in GOLD_COLUMNS.items()])


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily closes of eight tickers on weekdays, in cents per unit sold."""
    day = F.to_date("l_shipdate")
    rows = _read(spark, sf_dir, "lineitem").filter(~F.dayofweek(day).isin(1, 7))
    return conform(rows.groupBy(day.alias("date"), F.expr(TICKER).alias("ticker")).agg(F.expr(CLOSE).alias("close")), PRICES)


def _view(name: str, table: str, columns: dict[str, str], layout: str | None = None) -> str:
    out = []
    for part in (layout or ", ".join(f"{k} string" for k in columns)).split(", "):
        column, kind = part.split()
        kind = kind if layout else {"chat_id": "bigint", "message_id": "bigint"}.get(column, kind)
        out.append(f"CAST({columns.get(column, 'NULL')} AS {kind}) AS {column}")
    return f"{name} AS (SELECT {', '.join(out)} FROM {table})"


def catalogue_view() -> str:
    return _view("items", "part", CATALOGUE_COLUMNS, ITEMS)


def sql_views(*, near: bool = False) -> str:
    """The same tables as common table expressions, for use behind WITH."""
    item_columns = ITEM_COLUMNS | ({"date": NEAR_DATE} if near else {})
    return ",\n".join([
        _view("items", "documents", item_columns, ITEMS),
        _view("scores_v2", "documents", SCORE_COLUMNS, SCORES),
        _view("scores_classifier", LABELLED, CLASSIFIER_COLUMNS, SCORES),
        "scores AS (SELECT * FROM scores_v2 UNION ALL SELECT * FROM scores_classifier)",
        _view("gold_raw", LABELLED, GOLD_COLUMNS),
        f"prices AS (SELECT CAST(l_shipdate AS DATE) AS date, {TICKER} AS ticker, {CLOSE} AS close FROM lineitem "
        "WHERE dayofweek(CAST(l_shipdate AS DATE)) NOT IN (0, 6) GROUP BY 1, 2)",
    ])
