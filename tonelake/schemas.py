"""Column layouts, fixed value lists, and conforming of older layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed values of the data model.
LEVELS = ("macro", "market", "sector", "stock")
METHODS = ("shrinkage", "channel_demeaned", "breadth")
NOVELTY = ("new", "recap", "repost")
HORIZONS = ("intraday", "short", "medium")
ITEM_TYPES = ("photo", "document", "text", "link")
EXTRACT_STATUSES = ("ok", "scanned", "image_pending", "no_file", "error")
DRIVERS = ("monetary_policy", "earnings", "flows", "geopolitics", "fx", "regulation", "valuation", "supply_chain", "commodity", "other")
SECTOR_CODES = (
    "semiconductor", "battery", "auto", "shipbuilding", "chemical", "steel", "bank", "securities", "insurance", "telecom", "internet_game",
    "retail", "construction", "energy", "utility", "transport", "food_beverage", "cosmetics", "robotics_ai", "bio_pharma", "defense", "other",
)
RUBRIC, CLASSIFIER_RUBRIC = "v2", "finbert-v1"

ITEMS = (
    "chat_id bigint, chat_name string, message_id bigint, date string, type string, text string, file_path string, file_name string, url string, "
    "summary string, summarized_at string, sentiment_score double, scope string, topic string, extracted_text string, extract_status string, "
    "extracted_at string, extract_chars int, dup_cluster_id string, is_cluster_head int, mention_channels int"
)
SCORES = (
    "chat_id bigint, message_id bigint, rubric_version string, model string, direction int, magnitude int, confidence double, level string, "
    "sector_code string, ticker string, driver string, novelty string, horizon string, summary string, raw_response string, scored_at string"
)
PRICES = "date date, ticker string, close double"
TICKERS = "ticker string, name string"
GOLD = "chat_id bigint, message_id bigint, direction string, magnitude string, level string"
RESPONSE = (
    "items array<struct<item_id: string, direction: int, magnitude: int, confidence: double, level: string, sector_code: string, "
    "ticker: string, driver: string, novelty: string, horizon: string, summary: string>>"
)
ITEM_KEY, SCORE_KEY = ("chat_id", "message_id"), ("chat_id", "message_id", "rubric_version")
#: Columns that must hold one of a list, or null.
ALLOWED = {"level": LEVELS, "scope": LEVELS, "driver": DRIVERS, "novelty": NOVELTY, "horizon": HORIZONS, "extract_status": EXTRACT_STATUSES, "type": ITEM_TYPES}


def layout(text: str) -> StructType:
    return StructType.fromDDL(text)


def conform(df: DataFrame, text: str) -> DataFrame:
    """The columns of a layout in its order and types; those that an older table lacks are typed nulls."""
    return df.select(*[(df[f.name].cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in layout(text).fields])


def violations(df: DataFrame) -> Column:
    """Names of the columns whose value is outside its list, as an array (empty if all are valid)."""
    bad = [F.when(~F.col(c).isin(*ALLOWED[c]), F.lit(c)) for c in df.columns if c in ALLOWED]
    return F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")


def check_values(df: DataFrame) -> DataFrame:
    """The frame, failing at run time on the first row with a value outside its list."""
    wrong = violations(df)
    guard = F.when(F.size(wrong) > 0, F.raise_error(F.concat(F.lit("value outside its list in "), F.concat_ws(", ", wrong))).cast("boolean")).otherwise(F.lit(True))
    return df.filter(guard)
