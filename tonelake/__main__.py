"""Command line: ``python -m tonelake index|dedupe|validate|calibration|market|migrate|pending|report|collect|extract|score ...``.

Tables are Parquet paths; results are printed, or written where ``--out`` says. What reaches outside (scorers, PDF readers) is a function of the caller's,
named as ``module:function``.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions import text as T
from tonelake.operators import calibration, dedupe, market, report, rubric, scoring, toneindex, validation
from tonelake.operators import scores as S
from tonelake.schemas import CLASSIFIER_RUBRIC, ITEM_KEY, ITEMS, LEVELS, METHODS, RUBRIC, conform
from tonelake.session import build_session, release, stored
from tonelake.sources import tables
from tonelake.streaming import durable


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tonelake", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, *needed: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for table in needed:
            p.add_argument(f"--{table}", required=True, help="Parquet path")
        p.add_argument("--out")
        return p

    def index_options(p: argparse.ArgumentParser) -> None:
        p.add_argument("--level", choices=LEVELS)
        p.add_argument("--method", choices=METHODS, default="shrinkage")
        p.add_argument("--shrink-k", type=float, default=toneindex.SHRINK_K)
        p.add_argument("--include-recap", action="store_true")

    p = command("index", "items", "scores")
    index_options(p)
    p.add_argument("--weights", help="e.g. macro=0.4,market=0.3")
    p.add_argument("--weight-by-consensus", action="store_true")
    p = command("dedupe", "items")
    p.add_argument("--date")
    p.add_argument("--since")
    p.add_argument("--hamming", type=int, default=dedupe.HAMMING)
    p.add_argument("--fuzzy-threshold", type=float, default=dedupe.RATIO)
    p = command("validate", "items", "scores", "prices")
    p.add_argument("check", choices=["contemporaneous", "leadlag", "eventstudy", "all"])
    p.add_argument("--start")
    p.add_argument("--pin-rubric", action="store_true", help="events of one rubric only")
    index_options(p)
    p = command("calibration", "scores")
    p.add_argument("--gold", help="CSV of labels; without it a template is made")
    p.add_argument("--rubric-version")
    p.add_argument("--compare")
    p.add_argument("--sample-size", type=int, default=60)
    p = command("market", "prices")
    p.add_argument("--start")
    p.add_argument("--min-coverage", type=float, default=market.MIN_COVERAGE)
    command("migrate", "items")
    p = command("pending", "items")
    p.add_argument("--force", action="store_true")
    p.add_argument("--channel")
    p.add_argument("--limit", type=int)
    p = command("report", "items", "scores")
    p.add_argument("--prices")
    p.add_argument("--ewma-span", type=int, default=9)
    p = command("collect", "messages")
    p.add_argument("--items", help="what has been collected so far; without it every channel goes back --backfill-days")
    p.add_argument("--channels", help="JSON file of channel names by id; others are left out")
    p.add_argument("--backfill-days", type=int, default=30)
    p.add_argument("--media", default="media", help="folder of downloaded media")
    p = command("extract", "items", "media")
    p.add_argument("--reader", required=True, help="module:function of (bytes, most pages), giving the pages' texts")
    p.add_argument("--max-pages", type=int, default=2)
    p.add_argument("--force", action="store_true")
    p.add_argument("--channel")
    p.add_argument("--limit", type=int)
    p = command("score", "items")
    p.add_argument("--scorer", required=True, help="module:function of a prompt, or of a list of texts for --kind classifier")
    p.add_argument("--kind", choices=["rubric", "classifier", "legacy"], default="rubric")
    p.add_argument("--scores", help="what has been scored so far")
    p.add_argument("--rubric-version")
    p.add_argument("--model", default="external")
    p.add_argument("--date")
    p.add_argument("--since")
    p.add_argument("--channel")
    p.add_argument("--limit", type=int)
    p.add_argument("--force", "--redo", action="store_true", help="also what has been scored before")
    p.add_argument("--answers", help="folder where every answer is kept as it comes; a run goes on where the last one ended")
    p.add_argument("--at-once", type=int, default=1, help="calls under way at the same time, with --answers")
    p.add_argument("--pause", type=float, default=0.0, help="seconds between two calls of a task")
    return out


def named_function(name: str) -> Callable:
    """A function of the caller's; its module goes to the executors with it, as they need not have it."""
    module, _, function = name.partition(":")
    found = importlib.import_module(module)
    cloudpickle.register_pickle_by_value(found)
    return getattr(found, function)


def emit(df: DataFrame, label: str, out: str | None) -> None:
    if out:
        print(f"[{label}] wrote {tables.write_csv(df, out, None)}")
    else:
        print(f"=== {label} ===")
        df.show(1000, truncate=False)


def run_index(spark: SparkSession, a: argparse.Namespace) -> None:
    items, scores = tables.read_items(spark, a.items), tables.read_scores(spark, a.scores)
    options = {"method": a.method, "shrink_k": a.shrink_k, "include_recap": a.include_recap, "by_consensus": a.weight_by_consensus}
    if a.weights:
        emit(toneindex.weighted_composite(items, scores, toneindex.parse_weights(a.weights), **options).orderBy("day"), f"weighted composite ({a.weights})", a.out)
        return
    every = stored(toneindex.level_indices(items, scores, **options), "levels")  # all levels from one pass
    for level in [a.level] if a.level else LEVELS:
        rows = every.filter(F.col("level") == level).drop("level").orderBy("day")
        target = a.out if a.level or not a.out else tables.labelled_path(a.out, level)
        emit(rows, f"level={level} method={a.method}", target)


def run_dedupe(spark: SparkSession, a: argparse.Namespace) -> None:
    items = tables.read_items(spark, a.items)
    clusters = stored(dedupe.cluster_items(dedupe.on_days(items, a.date, a.since), a.hamming, a.fuzzy_threshold), "clusters")
    if a.out:
        tables.update_clusters(items, clusters).write.parquet(a.out)
    emit(dedupe.cluster_summary(clusters), "clusters", None)
    emit(dedupe.size_histogram(clusters).orderBy("mention_channels"), "channels per cluster", None)


def run_validate(spark: SparkSession, a: argparse.Namespace) -> None:
    items, scores = tables.read_items(spark, a.items), tables.read_scores(spark, a.scores)
    prices = tables.read_prices(spark, a.prices, a.start)
    proxy = stored(market.market_proxy(prices), "proxy")
    index = {recap: toneindex.daily_index(items, scores, level=a.level, method=a.method, shrink_k=a.shrink_k, include_recap=recap) for recap in (False, True)}
    if a.check in ("contemporaneous", "all"):
        emit(validation.contemporaneous(index[False], index[True], proxy), "contemporaneous", a.out and tables.labelled_path(a.out, "contemporaneous"))
    if a.check in ("leadlag", "all"):
        emit(validation.lead_lag(index[a.include_recap], proxy).orderBy("k"), "leadlag", a.out and tables.labelled_path(a.out, "leadlag"))
        emit(validation.next_return_regression(index[a.include_recap], proxy), "regression", a.out and tables.labelled_path(a.out, "regression"))
    if a.check in ("eventstudy", "all"):
        events = S.tagged_events(items, scores, RUBRIC if a.pin_rubric else None)
        emit(validation.events_without_prices(events, prices), "events without prices", None)
        emit(validation.event_summary(validation.event_paths(events, prices, proxy)).orderBy("direction", "k"), "eventstudy", a.out and tables.labelled_path(a.out, "eventstudy"))


def run_calibration(spark: SparkSession, a: argparse.Namespace) -> None:
    scores = tables.read_scores(spark, a.scores)
    if not a.gold:
        emit(tables.gold_template(scores, a.sample_size), "template", a.out)
        return
    gold = tables.read_gold(spark, a.gold)
    for version in [v for v in (a.rubric_version, a.compare) if v] or [None]:
        pairs = calibration.matched(gold, S.latest_scores(scores, version))
        for name, df in (("agreement", calibration.agreement(pairs)), ("levels", calibration.confusion(pairs, wide=True)), ("spearman", calibration.spearman(pairs))):
            emit(df, f"{version or 'latest'}: {name}", None)


def run_market(spark: SparkSession, a: argparse.Namespace) -> None:
    prices = tables.read_prices(spark, a.prices, a.start)
    emit(market.proxy_summary(prices, a.min_coverage), "summary", None)
    proxy = market.market_proxy(prices, a.min_coverage)
    emit(proxy.orderBy("date") if a.out else market.last_rows(proxy), "market proxy", a.out)


def run_report(spark: SparkSession, a: argparse.Namespace) -> None:
    items, scores = tables.read_items(spark, a.items), tables.read_scores(spark, a.scores)
    broad, index = S.broad_set(items, scores), toneindex.daily_index(items, scores)
    datasets = {
        "stats": report.stat_strip(items, scores, S.index_set(items, scores), index), "scores": report.score_histogram(broad).orderBy("level", "score"),
        "weeks": report.level_weeks(broad).orderBy("week", "level"), "channels": report.channel_calibration(broad, items).orderBy("avg_score"),
        "stocks": report.stock_signs(broad), "rubrics": calibration.rubric_agreement(S.rubric_pairs(scores)), "recent": report.recent_items(items, scores),
    }
    if a.prices:
        prices = tables.read_prices(spark, a.prices)
        proxy = stored(market.market_proxy(prices), "proxy")
        paths = validation.event_paths(S.tagged_events(items, scores), prices, proxy)
        datasets |= {"index": validation.index_against_market(index, proxy, a.ewma_span).orderBy("date"), "leadlag": validation.lead_lag(index, proxy).orderBy("k"), "events": validation.mean_paths(paths).orderBy("direction", "k")}
    report.write_page(datasets, [a.out or "report.html"])


def emit_table(df: DataFrame, label: str, out: str | None) -> None:
    """A whole table as Parquet, or its size if nothing is to be written."""
    if out:
        df.write.parquet(out)
        print(f"[{label}] wrote {out}")
    else:
        print(f"=== {label}: {df.count()} rows ===")


def run_collect(spark: SparkSession, a: argparse.Namespace) -> None:
    """New messages become items; what was collected before stays."""
    items = tables.read_items(spark, a.items) if a.items else spark.createDataFrame([], ITEMS)
    messages = spark.read.parquet(a.messages)
    if a.channels:
        messages = messages.join(tables.load_channels(spark, a.channels).withColumnRenamed("chat_name", "__name"), "chat_id")
        messages = messages.withColumn("chat_name", F.col("__name")).drop("__name")
    new = tables.new_messages(messages, items, backfill_days=a.backfill_days)
    has_media = F.coalesce("has_photo", F.lit(False)) | F.coalesce("has_document", F.lit(False))
    name = F.col("file_name") if "file_name" in new.columns else F.lit(None).cast("string")
    url = T.first_url(F.col("text"))
    new = new.withColumn("file_name", name).withColumns({"file_path": F.when(has_media, tables.media_path(a.media)), "url": url, "type": T.item_type(F.col("has_photo"), F.col("has_document"), url)})
    new = stored(conform(new, ITEMS), "collected")
    emit(new.groupBy("chat_id", "type").agg(F.count("*").alias("n")).orderBy("chat_id", "type"), "collected", None)
    emit_table(tables.upsert_items(items, new), "items", a.out)


def run_extract(spark: SparkSession, a: argparse.Namespace) -> None:
    """Texts of downloaded documents; a file is found by channel, month and name, and an empty one counts as missing."""
    items = tables.read_items(spark, a.items)
    pending = tables.pending_media(items, force=a.force, channel=a.channel, limit=a.limit)
    place = lambda path: F.array_join(F.slice(F.split(path, "/"), -3, 3), "/")
    found = tables.pdf_texts(spark, f"{a.media}/*/*/*", named_function(a.reader), a.max_pages).select(place(F.col("path")).alias("place"), F.col("text").alias("found"), F.lit(True).alias("exists"))
    joined = pending.withColumn("place", F.when(F.size(F.split("file_path", "/")) >= 3, place(F.col("file_path")))).join(found, "place", "left")
    status = T.extract_status(F.col("file_path"), F.col("exists"), F.col("type"), F.col("found"))
    done = stored(joined.select(*ITEM_KEY, F.when(status.isin("ok", "scanned"), F.col("found")).alias("extracted_text"), status.alias("extract_status")), "extracted")
    emit(done.groupBy("extract_status").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "extract_status"), "extracted", None)
    emit_table(tables.update_extractions(items, done), "items", a.out)


def answered(spark: SparkSession, a: argparse.Namespace, requests: DataFrame, scorer: Callable[[str], str]) -> DataFrame:
    """Answers to the requests; with ``--answers`` each is kept there as it comes, and what is there already is not asked again."""
    if not a.answers:
        return scoring.ask(requests, scorer, a.pause)
    requests = stored(durable.named(requests), "requests")
    durable.add_requests(requests, a.answers)
    durable.answer_waiting(spark, a.answers, scorer, at_once=a.at_once, pause=a.pause)
    return durable.answers(spark, a.answers).join(requests.select("request_id"), "request_id", "left_semi")


def run_score(spark: SparkSession, a: argparse.Namespace) -> None:
    """Items not scored yet go to the scorer; the scores (for ``legacy`` the items) with the new ones taken in come out."""
    items, scorer = tables.read_items(spark, a.items), named_function(a.scorer)
    version = a.rubric_version or (CLASSIFIER_RUBRIC if a.kind == "classifier" else RUBRIC)
    scores = tables.read_scores(spark, a.scores) if a.scores else scoring.no_scores(spark)
    if a.kind == "legacy":
        old = tables.reset_summaries(items, a.date) if a.force else items
        days = S.unscored_days(old).filter(F.col("day") == a.date) if a.date else S.unscored_days(old)
        waiting = old.filter("text is not null").join(days, F.substring("date", 1, 10) == F.col("day"), "left_semi")
        new = stored(scoring.legacy_scores(waiting, scoring.parse_legacy(answered(spark, a, scoring.prompts(waiting, rubric.legacy_instruction(), scoring.LEGACY_CHARS), scorer))), "scored")
        emit(new.groupBy("scope").agg(F.count("*").alias("n")).orderBy("scope"), "scored", None)
        emit_table(tables.update_summaries(old, new), "items", a.out)
        return
    waiting = S.unscored(items, scores, version, force=a.force, on=a.date, since=a.since, channel=a.channel, limit=a.limit)
    if a.kind == "classifier":
        new = scoring.classify(waiting, scorer, version, a.model)
    else:
        new = scoring.parse_responses(answered(spark, a, scoring.prompts(waiting, rubric.instruction()), scorer), version, a.model)
    new = stored(new, "scored")
    emit(new.groupBy("direction").agg(F.count("*").alias("n")).orderBy("direction"), "scored", None)
    emit_table(tables.upsert_scores(scores, new), "scores", a.out)


def main(argv: Sequence[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = build_session()
    try:
        if a.command == "migrate":
            emit(S.migrate_legacy(tables.read_items(spark, a.items)), "migrated", a.out)
        elif a.command == "pending":
            emit(tables.pending_media(tables.read_items(spark, a.items), force=a.force, channel=a.channel, limit=a.limit), "pending", a.out)
        else:
            {"index": run_index, "dedupe": run_dedupe, "validate": run_validate, "calibration": run_calibration, "market": run_market, "report": run_report, "collect": run_collect, "extract": run_extract, "score": run_score}[a.command](spark, a)
    finally:
        release(spark)  # results are written or shown by now


if __name__ == "__main__":
    main()
