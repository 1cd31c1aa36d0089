"""The command line over small tables."""

import json
import re

import pytest
from oracle import SF

from tonelake.__main__ import main
from tonelake.sources import synthetic, tables


@pytest.fixture(scope="module")
def paths(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    synthetic.items(spark, SF).filter("message_id < 400").write.parquet(str(base / "items"))
    tables.write_scores(synthetic.scores(spark, SF).filter("message_id < 400"), str(base / "scores"))
    synthetic.prices(spark, SF).write.parquet(str(base / "prices"))
    synthetic.gold(spark, SF).coalesce(1).write.csv(str(base / "gold"), header=True)
    return {n: str(base / n) for n in ("items", "scores", "prices", "gold")}


def args(paths, *names):
    return [x for n in names for x in (f"--{n}", paths[n])]


def test_index(spark, paths, tmp_path, capsys):
    main(["index", *args(paths, "items", "scores"), "--out", str(tmp_path / "i.csv")])
    for level in ("macro", "stock"):
        assert spark.read.csv(str(tmp_path / f"i_{level}.csv"), header=True).columns == ["day", "index_value", "n_items", "n_channels", "breadth"]
    main(["index", *args(paths, "items", "scores"), "--weights", "macro=0.5,stock=0.5", "--weight-by-consensus"])
    assert "weighted composite" in capsys.readouterr().out


def test_validate(paths, capsys):
    main(["validate", "all", *args(paths, "items", "scores", "prices")])
    out = capsys.readouterr().out
    assert all(x in out for x in ("contemporaneous", "leadlag", "regression", "eventstudy"))


def test_others(spark, paths, tmp_path, capsys):
    main(["calibration", *args(paths, "scores", "gold"), "--rubric-version", "v2", "--compare", "finbert-v1"])
    main(["calibration", *args(paths, "scores"), "--sample-size", "5", "--out", str(tmp_path / "t.csv")])
    assert spark.read.csv(str(tmp_path / "t.csv"), header=True).count() == 5
    main(["market", *args(paths, "prices"), "--start", "1998-03-01"])
    main(["migrate", *args(paths, "items"), "--out", str(tmp_path / "m.csv")])
    main(["pending", *args(paths, "items"), "--force", "--limit", "3"])
    main(["dedupe", *args(paths, "items"), "--since", "1998-06-20", "--out", str(tmp_path / "d")])
    assert tables.read_items(spark, str(tmp_path / "d")).count() == 400
    main(["report", *args(paths, "items", "scores", "prices"), "--out", str(tmp_path / "r.html")])
    assert "leadlag" in (tmp_path / "r.html").read_text() and "spearman" in capsys.readouterr().out


def answer(prompt):
    """Scores every listed item, behind the instruction."""
    head, _, listing = prompt.partition("A link without any text")
    assert "direction" in head and "ex8" in head
    return json.dumps({"items": [{"item_id": i, "direction": 1, "magnitude": 2, "confidence": 0.5, "level": "macro"} for i in re.findall(r"(?m)^\[(\d+_\d+)\] \(", listing)]})


def old_answer(prompt):
    return json.dumps({"items": [{"item_id": i, "summary": "s", "sentiment_score": 9, "scope": "macro", "topic": "t"} for i in re.findall(r"(?m)^\[(\d+_\d+)\] \(", prompt)]})


def classes(texts):
    return [("positive", 0.95)] * len(texts)


def pages(content, most):
    if not content:
        raise ValueError("empty")
    return [content.decode()] * 3


def test_score(spark, paths, tmp_path, capsys):
    items = tables.read_items(spark, paths["items"])
    with_text = items.filter("text is not null or extracted_text is not null").count()
    main(["score", *args(paths, "items"), "--scorer", "test_cli:answer", "--since", "1998-03-01", "--out", str(tmp_path / "a")])
    first = tables.read_scores(spark, str(tmp_path / "a"))
    assert 0 < first.count() < with_text and first.filter("direction <> 1 or magnitude <> 2 or rubric_version <> 'v2'").count() == 0
    main(["score", *args(paths, "items"), "--scores", str(tmp_path / "a"), "--scorer", "test_cli:answer", "--out", str(tmp_path / "b")])
    assert tables.read_scores(spark, str(tmp_path / "b")).count() == with_text
    main(["score", *args(paths, "items"), "--kind", "classifier", "--scorer", "test_cli:classes", "--limit", "7", "--model", "m", "--out", str(tmp_path / "c")])
    rows = tables.read_scores(spark, str(tmp_path / "c")).collect()
    assert len(rows) == 7 and {(r.direction, r.magnitude, r.model, r.rubric_version) for r in rows} == {(1, 3, "m", "finbert-v1")}
    main(["score", *args(paths, "items"), "--kind", "legacy", "--redo", "--scorer", "test_cli:old_answer", "--out", str(tmp_path / "d")])
    done = tables.read_items(spark, str(tmp_path / "d"))
    assert done.count() == items.count() and done.filter("sentiment_score = 5").count() == items.filter("text is not null").count()


def test_collect_and_extract(spark, tmp_path, capsys):
    schema = "chat_id bigint, chat_name string, message_id bigint, date string, text string, has_photo boolean, has_document boolean, file_name string"
    rows = [(1, "x", 1, "2024-05-01T00:00:00+00:00", "see https://a.b", False, False, None), (1, "x", 2, "2024-05-02T00:00:00+00:00", None, False, True, "d.pdf"), (1, "x", 3, "2024-05-02T00:00:00+00:00", "", False, False, None),
            (1, "x", 4, "2024-05-03T00:00:00+00:00", None, True, False, None), (1, "x", 5, "2024-05-03T00:00:00+00:00", None, False, True, "gone.pdf"), (2, "y", 1, "2024-05-03T00:00:00+00:00", "other", None, None, None)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "messages"))
    (tmp_path / "channels.json").write_text(json.dumps({"1": "x"}))
    media = str(tmp_path / "media")
    main(["collect", "--messages", str(tmp_path / "messages"), "--channels", str(tmp_path / "channels.json"), "--backfill-days", "100000", "--media", media, "--out", str(tmp_path / "items")])
    items = {r.message_id: r for r in tables.read_items(spark, str(tmp_path / "items")).collect()}
    assert {k: r.type for k, r in items.items()} == {1: "link", 2: "document", 4: "photo", 5: "document"}
    assert items[1].url == "https://a.b" and items[2].file_path == f"{media}/x/2024-05/d.pdf" and items[1].file_path is None
    folder = tmp_path / "media" / "x" / "2024-05"
    folder.mkdir(parents=True)
    (folder / "d.pdf").write_bytes(b"word " * 60)
    (folder / "4.jpg").write_bytes(b"x")
    main(["extract", "--items", str(tmp_path / "items"), "--media", media, "--reader", "test_cli:pages", "--out", str(tmp_path / "done")])
    done = {r.message_id: r for r in tables.read_items(spark, str(tmp_path / "done")).collect()}
    assert {k: r.extract_status for k, r in done.items()} == {1: None, 2: "ok", 4: "image_pending", 5: "no_file"}
    assert done[2].extracted_text.startswith("word") and done[2].extract_chars == len(done[2].extracted_text) and done[5].extracted_text is None
