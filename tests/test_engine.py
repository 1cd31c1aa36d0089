"""Golden values and edge cases of indices, market, validation, tables, scorers, report and streaming."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from oracle import SF_SMALL
from pyspark.sql import functions as F

from tonelake import schemas
from tonelake.operators import market, report, scoring, toneindex, validation
from tonelake.operators import scores as S
from tonelake.session import build_session
from tonelake.sources import synthetic, tables
from tonelake.streaming import incremental


def index_rows(spark, rows):
    return spark.createDataFrame(rows, "day string, chat_id bigint, score int, mention_channels int, level string")


def test_shrinkage_golden(spark):
    rows = index_rows(spark, [("d", 1, 2, None, "macro"), ("d", 2, -1, 3, "macro")])
    r = toneindex.index_of(rows).first()
    assert (round(r.index_value, 6), r.n_items, r.n_channels, r.breadth) == (0.142857, 2, 2, 0.0)
    w = toneindex.index_of(rows, by_consensus=True).first()
    assert w.index_value == pytest.approx(2 / 7 * (2 - 3) / 4)


def test_null_scores_count(spark):
    rows = index_rows(spark, [("d", 1, 1, None, None), ("d", 1, None, None, None), ("d", 1, 3, None, None), ("e", 1, None, None, None)])
    got = {r.day: r.index_value for r in toneindex.index_of(rows, "shrinkage", 0.0).collect()}
    assert got["d"] == pytest.approx(4 / 3) and got["e"] == 0


def test_unknown_method_and_level(spark):
    with pytest.raises(ValueError):
        toneindex.index_of(index_rows(spark, []), "median")
    with pytest.raises(ValueError):
        toneindex.weighted_composite(*[None] * 2, {"galaxy": 1.0})


def test_empty_index(spark):
    assert toneindex.index_of(index_rows(spark, [])).count() == 0


def price_frame(spark, seed=1, days=40):
    rng = np.random.default_rng(seed)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(d), t, float(rng.uniform(10, 20))) for d in range(days) if d % 7 < 5 for t in "ABCD" if rng.random() < (0.97 if t != "D" else 0.5)]
    return spark.createDataFrame(rows, schemas.PRICES), pd.DataFrame(rows, columns=["date", "ticker", "close"])


def pandas_proxy(prices):
    wide = prices.pivot(index="date", columns="ticker", values="close").sort_index()
    wide = wide[wide.columns[wide.notna().mean() >= 0.9]]
    returns = wide.pct_change(fill_method=None)
    return returns.mean(axis=1).dropna(), returns


def test_market_proxy_like_pandas(spark):
    df, prices = price_frame(spark)
    mean, _ = pandas_proxy(prices)
    got = {r.date: r.market_return for r in market.market_proxy(df, 0.9).collect()}
    assert got.keys() == set(mean.index) and all(got[d] == pytest.approx(mean[d]) for d in got)


def test_event_paths_like_a_loop(spark):
    df, prices = price_frame(spark)
    mean, _ = pandas_proxy(prices)
    wide = prices.pivot(index="date", columns="ticker", values="close").sort_index().pct_change(fill_method=None)
    sessions = list(wide.index)
    days = [dt.date(2019, 12, 1), dt.date(2020, 1, 4), dt.date(2020, 1, 20), dt.date(2020, 2, 7), dt.date(2020, 3, 1)]
    events = [(1, i, "v", t, 1 if i % 2 else -1, d) for i, (t, d) in enumerate((t, d) for t in "ADZ" for d in days)]
    frame = spark.createDataFrame(events, "chat_id bigint, message_id bigint, rubric_version string, ticker string, direction int, event_date date")
    got = {(r.message_id, r.k): r.car for r in validation.event_paths(frame, df, market.market_proxy(df, 0.9)).collect()}
    wanted = {}
    for _, i, _, t, _, d in events:
        later = [s for s in sessions if s >= d]
        if t == "Z" or not later:
            continue
        pos, car = sessions.index(later[0]), 0.0
        for k in range(-5, 11):
            if 0 <= pos + k < len(sessions):
                s = sessions[pos + k]
                r, m = wide.loc[s, t], mean.get(s, np.nan)
                car += 0 if np.isnan(r) or np.isnan(m) else r - m
            wanted[i, k] = car
    assert got.keys() == wanted.keys() and all(got[x] == pytest.approx(wanted[x], abs=1e-12) for x in got)
    assert validation.events_without_prices(frame, df).first().skipped == 5


def test_lead_lag_like_shift(spark):
    df, prices = price_frame(spark)
    mean, _ = pandas_proxy(prices)
    rng = np.random.default_rng(2)
    index = pd.Series(rng.normal(size=len(mean)), index=mean.index).sample(frac=0.7, random_state=1)
    frame = spark.createDataFrame([(str(d), float(v)) for d, v in index.items()], "day string, index_value double")
    got = {r.k: (r.n, r.corr) for r in validation.lead_lag(frame, market.market_proxy(df, 0.9)).collect()}
    for k in range(-5, 6):
        both = pd.DataFrame({"i": index, "m": mean.shift(-k)}).dropna()
        assert got[k][0] == len(both) and got[k][1] == pytest.approx(both["i"].corr(both["m"]))


@pytest.mark.parametrize(("span", "values"), [(9, [1, 2, 3]), (3, [1, None, 3]), (5, [None, 2.0, 4.0])])
def test_ewma_like_pandas(spark, span, values):
    frame = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "o int, v double")
    got = [r.ewma for r in validation.ewma(frame, "o", "v", span).orderBy("o").collect()]
    wanted = pd.Series(values, dtype=float).ewm(span=span, min_periods=1).mean()
    assert [x if x is not None else np.nan for x in got] == pytest.approx(list(wanted), nan_ok=True)


@pytest.mark.parametrize("returns", [[0.1, -0.2, 0.3], [0.1, -1.5, 0.2, -3.0], [0.1, -1.0, 5.0]])
def test_compounded(spark, returns):
    frame = spark.createDataFrame([(dt.date(2020, 1, i + 1), r) for i, r in enumerate(returns)], "date date, market_return double")
    assert [r.level for r in validation.compounded(frame).orderBy("date").collect()] == pytest.approx(list(np.cumprod(1 + np.array(returns))))


def test_migration_rounds_half_to_even(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([2.5, -2.5, 0.5, 1.5, 4.0, 0.0])], "chat_id bigint, message_id bigint, sentiment_score double")
    out = S.migrate_legacy(schemas.conform(rows, schemas.ITEMS)).orderBy("message_id").collect()
    assert [(r.direction, r.magnitude) for r in out] == [(1, 2), (-1, 2), (1, 0), (1, 2), (1, 3), (0, 0)]


def test_clamp_keeps_null(spark):
    assert [r.x for r in spark.createDataFrame([(None,), (5,), (-5,)], "v int").select(scoring.clamp(F.col("v"), -1, 1).alias("x")).collect()] == [None, 1, -1]


def test_confidence_buckets(spark):
    rows = [("neutral", 0.99, 0), ("positive", 0.9, 3), ("positive", 0.75, 2), ("negative", 0.5, 1), ("negative", 0.49, 0)]
    out = spark.createDataFrame(rows, "l string, c double, w int").select("w", scoring.confidence_to_magnitude(F.col("l"), F.col("c")).alias("m")).collect()
    assert all(r.w == r.m for r in out)


def test_values_are_checked(spark):
    bad = schemas.conform(spark.createDataFrame([(1, 2, "galaxy")], "chat_id bigint, message_id bigint, level string"), schemas.SCORES)
    assert bad.select(schemas.violations(bad).alias("v")).first().v == ["level"]
    with pytest.raises(Exception, match="outside its list"):
        schemas.check_values(bad).collect()


def test_tables_round_trip(spark, tmp_path):
    scores = synthetic.scores(spark, SF_SMALL)
    tables.write_scores(scores, str(tmp_path / "scores"))
    back = tables.read_scores(spark, str(tmp_path / "scores"))
    assert back.columns == scores.columns and back.count() == scores.count()
    old = spark.createDataFrame([(1, "a", 2)], "chat_id int, chat_name string, message_id int")
    old.write.parquet(str(tmp_path / "items"))
    assert tables.read_items(spark, str(tmp_path / "items")).first().extracted_text is None


def test_channels_gold_and_csv(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"-100123": "one", "7": "zwei"}))
    assert {(r.chat_id, r.chat_name) for r in tables.load_channels(spark, str(tmp_path / "c.json")).collect()} == {(-100123, "one"), (7, "zwei")}
    assert tables.channel_map(str(tmp_path / "c.json"))[-100123] == "one"
    with pytest.raises(FileNotFoundError):
        tables.channel_map(str(tmp_path / "none.json"))
    (tmp_path / "g.csv").write_text("chat_id,message_id,direction,magnitude,level\n1,2,1,x,macro\n1,3,,2,\n1,4,-1,2,stock\n")
    assert [(r.message_id, r.direction, r.magnitude) for r in tables.read_gold(spark, str(tmp_path / "g.csv")).orderBy("message_id").collect()] == [(2, 1, None), (4, -1, 2.0)]
    path = tables.write_csv(spark.range(3), str(tmp_path / "out.csv"), "macro")
    assert path.endswith("out_macro.csv") and spark.read.csv(path, header=True).count() == 3


def test_report_page_and_records(spark, tmp_path):
    paths = [str(tmp_path / "a.html"), str(tmp_path / "docs" / "index.html")]
    report.write_page({"x": spark.createDataFrame([(1, "<b>"), (2, None)], "n int, s string")}, paths)
    assert all("&lt;b&gt;" in open(p).read() for p in paths)
    assert json.loads(tables.json_records(spark.createDataFrame([(1, None)], "n int, s string")).first().record) == {"n": 1, "s": None}


def test_pdf_reader_failures_are_null(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two|three")
    (tmp_path / "b.pdf").write_bytes(b"bad")

    def reader(content, pages):
        if content == b"bad":
            raise ValueError
        return content.decode().split("|")

    got = {r.path[-5:]: r.text for r in tables.pdf_texts(spark, str(tmp_path), reader).collect()}
    assert got == {"a.pdf": "one\ntwo", "b.pdf": None}


def test_failed_scorer_gives_error_rows(spark):
    items = schemas.conform(spark.createDataFrame([(1, "c", 2, "2020-01-01", "t"), (1, "c", 3, "2020-01-01", "u")], "chat_id bigint, chat_name string, message_id bigint, date string, text string"), schemas.ITEMS)

    def fail(_):
        raise RuntimeError("down")

    rows = scoring.parse_responses(scoring.ask(scoring.prompts(items), fail)).collect()
    assert len(rows) == 2 and all(r.direction is None and r.raw_response == "REQUEST_ERROR: down" for r in rows)
    rows = scoring.classify(items, fail).collect()
    assert len(rows) == 2 and all(r.direction is None and r.raw_response.startswith("REQUEST_ERROR") for r in rows)
    rows = scoring.parse_responses(scoring.ask(scoring.prompts(items), lambda p: "not json")).collect()
    assert len(rows) == 2 and all(r.raw_response == "not json" for r in rows)


def test_stream_takes_in_each_message_once(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()

    def put(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows))

    base = {"chat_id": 1, "chat_name": "c", "date": "2020-01-01T00:00:00+00:00"}
    put("1.json", [base | {"message_id": 1, "text": "see https://a.b"}, base | {"message_id": 2}, base | {"message_id": 3, "has_photo": True}])
    incremental.collect_into(incremental.message_stream(spark, source), out, check).awaitTermination()
    put("2.json", [base | {"message_id": 4, "text": "x", "has_document": True}])
    incremental.collect_into(incremental.message_stream(spark, source), out, check).awaitTermination()
    rows = {r.message_id: (r.type, r.url) for r in tables.read_items(spark, out).collect()}
    assert rows == {1: ("link", "https://a.b"), 3: ("photo", None), 4: ("document", None)}


def test_stream_counts_and_repeats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"chat_id": 1, "message_id": i % 2, "date": "2020-01-01T00:00:00+00:00", "text": "x"} for i in range(4)]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    stream = incremental.daily_counts(incremental.without_repeats(incremental.message_stream(spark, str(tmp_path / "in"))))
    query = stream.writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert [r.n for r in spark.table("counts").collect()] in ([], [2])


def test_session_settings(spark):
    assert build_session().conf.get("spark.sql.ansi.enabled") == "true"


def test_legacy_scores_and_media_paths(spark):
    items = schemas.conform(spark.createDataFrame([(1, 2), (1, 3)], "chat_id bigint, message_id bigint"), schemas.ITEMS)
    answers = spark.createDataFrame([("1_2", "s", 9.0, "macro", "t"), ("9_9", "s", 1.0, "macro", "t")], "item_id string, summary string, sentiment_score double, scope string, topic string")
    assert [(r.message_id, r.sentiment_score) for r in scoring.legacy_scores(items, answers).collect()] == [(2, 5.0)]
    messages = spark.createDataFrame([("c", 7, "2020-03-04T00:00:00", True, None), ("c", 8, "2020-03-04T00:00:00", None, "a.pdf")], "chat_name string, message_id bigint, date string, has_photo boolean, file_name string")
    assert [r.p for r in messages.select(tables.media_path("files").alias("p")).collect()] == ["files/c/2020-03/7.jpg", "files/c/2020-03/a.pdf"]
