"""Running scorers over items, and turning their answers into score rows. Scorers are functions; none is built in."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tonelake.functions.text import item_key, scoring_input
from tonelake.operators.scores import day
from tonelake.schemas import CLASSIFIER_RUBRIC, DRIVERS, HORIZONS, ITEM_KEY, LEVELS, NOVELTY, RESPONSE, RUBRIC, SCORES, SECTOR_CODES, conform, layout
from tonelake.session import small_batches

PROMPT_CHARS, LEGACY_CHARS, SUMMARY_CHARS, CHUNK_ROWS, CALL_ITEMS = 4000, 3000, 200, 200, 500
ENTRY = RESPONSE.removeprefix("items array<").removesuffix(">")
LEGACY_ENTRY = "struct<item_id: string, summary: string, sentiment_score: double, scope: string, topic: string>"
STRICT = {"level": LEVELS, "driver": DRIVERS, "novelty": NOVELTY, "horizon": HORIZONS}


def clamp(x: Column, low: int, high: int) -> Column:
    """Within bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def confidence_to_magnitude(label: Column, confidence: Column) -> Column:
    return F.when(label == "neutral", 0).when(confidence >= 0.9, 3).when(confidence >= 0.75, 2).when(confidence >= 0.5, 1).otherwise(0)


def label_to_direction(label: Column) -> Column:
    return F.when(label == "positive", 1).when(label == "neutral", 0).when(label == "negative", -1)


def prompts(items: DataFrame, instruction: str = "", chars: int = PROMPT_CHARS) -> DataFrame:
    """(day, prompt, item_ids): a listing of each day's items, oldest first, each text cut to ``chars``, behind the ``instruction``.

    One call a day; a day with more than ``CALL_ITEMS`` items is dealt to several calls by a hash of the item."""
    text = F.substring(scoring_input(F.col("text"), F.col("extracted_text")), 1, chars)
    key = item_key(F.col("chat_id"), F.col("message_id"))
    rows = items.select(day().alias("day"), F.struct("date", "chat_id", "message_id", key.alias("id"), F.concat(F.lit("["), key, F.lit("] ("), "chat_name", F.lit(")\n"), text).alias("line")).alias("x"))
    calls = rows.groupBy("day").agg(F.ceil(F.count("*") / CALL_ITEMS).alias("calls"))
    listed = rows.join(calls, "day").groupBy("day", F.pmod(F.xxhash64("x.id"), F.col("calls")).alias("call")).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    listing = F.array_join("xs.line", "\n\n")
    return listed.select("day", (F.concat(F.lit(instruction + "\n\n"), listing) if instruction else listing).alias("prompt"), F.col("xs.id").alias("item_ids"))


def ask(requests: DataFrame, scorer: Callable[[str], str], pause: float = 0.0) -> DataFrame:
    """The requests' columns without the prompt, and response and error: the scorer's answer to each prompt; an exception's text instead, if it fails. A task
    rests ``pause`` seconds after each call."""
    kept = requests.drop("prompt")
    small_batches(requests.sparkSession)  # a prompt lists up to CALL_ITEMS texts

    schema = StructType([*kept.schema.fields, *layout("response string, error string").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one prompt and its answer at a time are Python's
                answer = error = None
                try:
                    answer = scorer(batch.column(batch.num_columns - 1)[k].as_py())
                except Exception as e:  # noqa: BLE001  a failed call becomes rows that say so
                    error = f"REQUEST_ERROR: {e}"
                time.sleep(pause)
                columns = [c.slice(k, 1).cast(f.type) for c, f in zip(batch.columns[:-1], arrow, strict=False)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([answer], pa.string()), pa.array([error], pa.string())], schema=arrow)

    return requests.select(*kept.columns, "prompt").mapInArrow(run, schema)


def parse_responses(answers: DataFrame, rubric: str = RUBRIC, model: str = "external") -> DataFrame:
    """A score row for every item asked about. An entry that doesn't fit the layout, or a missing one, leaves only ``raw_response``.

    Entries are read one by one, so a bad one does not spoil the others; of several for one item the last of its list holds."""
    asked = answers.select(F.posexplode("item_ids").alias("n", "item_id"), "day", "response", "error")
    listed = answers.select("day", F.posexplode(F.from_json(F.get_json_object("response", "$.items"), "array<string>")).alias("n", "entry"))
    read = listed.select("day", "n", F.from_json("entry", ENTRY.replace("direction: int", "direction: double").replace("magnitude: int", "magnitude: double")).alias("e"), "entry")
    valid = F.col("e.item_id").isNotNull()
    for name, allowed in STRICT.items():
        valid &= F.col(f"e.{name}").isNull() | F.col(f"e.{name}").isin(*allowed)
    for name in ("direction", "magnitude", "confidence"):  # present, but not a number
        valid &= F.col(f"e.{name}").isNotNull() | F.get_json_object("entry", f"$.{name}").isNull()
    entries = read.filter(valid).select("day", "n", "e.*", "entry").groupBy("day", "item_id").agg(F.max_by(F.struct("direction", "magnitude", "confidence", "level", "sector_code", "ticker", "driver", "novelty", "horizon", "summary"), F.struct("n", "entry")).alias("s"))
    joined = asked.join(entries, ["day", "item_id"], "left")
    number = lambda name, low, high: clamp(F.bround(F.col(f"s.{name}")).cast("int"), low, high)
    ids = F.split("item_id", "_")
    out = joined.select(
        F.get(ids, F.lit(0)).cast("bigint").alias("chat_id"), F.get(ids, F.lit(1)).cast("bigint").alias("message_id"), F.lit(rubric).alias("rubric_version"), F.lit(model).alias("model"),
        number("direction", -1, 1).alias("direction"), number("magnitude", 0, 3).alias("magnitude"), F.col("s.confidence").alias("confidence"), F.col("s.level").alias("level"),
        F.when(F.col("s.sector_code").isin(*SECTOR_CODES), F.col("s.sector_code")).alias("sector_code"), *[F.col(f"s.{c}").alias(c) for c in ("ticker", "driver", "novelty", "horizon", "summary")],
        F.coalesce("error", "response").alias("raw_response"),
    )
    return conform(out, SCORES)


def classify(items: DataFrame, model: Callable[[list[str]], list[tuple[str, float]]], rubric: str = CLASSIFIER_RUBRIC, name: str = "classifier") -> DataFrame:
    """Score rows from a classifier of texts into (label, confidence), in chunks; a chunk that fails gives rows with the error.

    Items without text are left out."""
    text = scoring_input(F.col("text"), F.col("extracted_text"))
    rows = items.select(*ITEM_KEY, text.alias("input")).filter(F.length("input") > 0)

    schema = "chat_id bigint, message_id bigint, input string, label string, confidence double, error string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    small_batches(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK_ROWS):  # the texts of one chunk at a time are Python's
                part = batch.slice(a, CHUNK_ROWS).to_pandas()
                try:
                    found = [(label, float(p), None) for label, p in model(part["input"].tolist())]
                    if len(found) != len(part):
                        raise ValueError(f"{len(found)} answers to {len(part)} texts")
                except Exception as e:  # noqa: BLE001  a failed chunk becomes rows that say so
                    found = [(None, None, f"REQUEST_ERROR: {e}")] * len(part)
                labels, confidences, errors = zip(*found, strict=True)
                part = part.assign(label=list(labels), confidence=pd.Series(confidences, index=part.index, dtype="float64"), error=list(errors))
                yield pa.RecordBatch.from_pandas(part, schema=arrow, preserve_index=False)

    return classifier_rows(rows.mapInArrow(run, schema), rubric, name)


def no_scores(spark: SparkSession) -> DataFrame:
    """An empty table of scores."""
    return spark.createDataFrame([], SCORES)


def classifier_rows(found: DataFrame, rubric: str = CLASSIFIER_RUBRIC, name: str = "classifier") -> DataFrame:
    """Labels and confidences as score rows."""
    out = found.withColumns({
        "rubric_version": F.lit(rubric), "model": F.lit(name), "direction": label_to_direction(F.col("label")),
        "magnitude": F.when(F.col("label").isNotNull(), confidence_to_magnitude(F.col("label"), F.col("confidence"))),
        "summary": F.substring("input", 1, SUMMARY_CHARS), "raw_response": F.coalesce("error", F.concat_ws(":", "label", F.col("confidence").cast("string"))),
    })
    return conform(out, SCORES)


def parse_legacy(answers: DataFrame) -> DataFrame:
    """(item_id, summary, sentiment_score, scope, topic) from answers of the old layout; what doesn't fit it is left out, of several for one item the last of
    its call holds."""
    listed = answers.select("day", F.posexplode(F.from_json(F.get_json_object("response", "$.items"), "array<string>")).alias("n", "entry"))
    read = listed.select("n", F.from_json("entry", LEGACY_ENTRY).alias("e")).filter(F.col("e.item_id").isNotNull() & F.col("e.sentiment_score").isNotNull() & F.col("e.scope").isin(*LEVELS))
    return read.groupBy("e.item_id").agg(F.max_by("e", "n").alias("e")).select("e.*")


def legacy_scores(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Old single scores for the items that were answered: (ids, summary, sentiment_score within -5 to 5, scope, topic). Unknown ids are ignored."""
    keyed = items.select(*ITEM_KEY, item_key(F.col("chat_id"), F.col("message_id")).alias("item_id"))
    score = F.when(F.col("sentiment_score").isNotNull(), F.greatest(F.lit(-5.0), F.least(F.lit(5.0), "sentiment_score")))
    return keyed.join(answers, "item_id").select(*ITEM_KEY, "summary", score.alias("sentiment_score"), "scope", "topic")
