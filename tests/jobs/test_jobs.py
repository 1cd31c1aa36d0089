import json
import logging

import pytest
from oracle import SF, connect, plain, spark_rows, sql_rows
from pyspark.sql import functions as F

from jobs import ingest, queries, settings, tone_index


def rows_of(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


@pytest.mark.parametrize("name", ["job1_ingest", "job2_tone_index"])
def test_query(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == sql_rows(connect(SF), queries.oracle_sql()[name])


def test_ingest_takes_only_what_is_new(spark, tmp_path, caplog):
    """Growing input in three runs gives what one run over all of it gives; a post that comes again changes nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    grown, whole = str(tmp_path / "grown"), str(tmp_path / "whole")
    near = ingest.Settings(near_days=True, files_per_batch=1)

    def add(part, path):
        part.coalesce(1).write.mode("append").parquet(path)

    add(docs.filter("doc_id < 400"), grown)
    with caplog.at_level(logging.INFO, "jobs.ingest"):
        assert ingest.run(spark, grown, str(tmp_path / "a"), str(tmp_path / "ca"), near) == 1
        before = rows_of(ingest.tables(spark, str(tmp_path / "a"))[0])
        assert ingest.run(spark, grown, str(tmp_path / "a"), str(tmp_path / "ca"), near) == 0
        assert rows_of(ingest.tables(spark, str(tmp_path / "a"))[0]) == before and len(before) == docs.filter("doc_id < 400").count()
        add(docs.filter("doc_id between 350 and 700"), grown)
        add(docs.filter("doc_id > 700"), grown)
        assert ingest.run(spark, grown, str(tmp_path / "a"), str(tmp_path / "ca"), near) == 2
    # What earlier batches wrote is as it was.
    assert set(before) <= set(rows_of(ingest.tables(spark, str(tmp_path / "a"))[0]))
    assert any("read 351 rows, wrote" in m or "read " in m for m in caplog.messages)
    add(docs, whole)
    ingest.run(spark, whole, str(tmp_path / "b"), str(tmp_path / "cb"), near)
    assert rows_of(ingest.result(spark, str(tmp_path / "a"))) == rows_of(ingest.result(spark, str(tmp_path / "b")))
    assert rows_of(ingest.tables(spark, str(tmp_path / "a"))[1]) == rows_of(ingest.tables(spark, str(tmp_path / "b"))[1])


def test_a_repeated_batch_leaves_the_same_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, near = str(tmp_path / "out"), ingest.Settings(near_days=True)
    ingest.begin(spark, out)
    ingest.take(docs.filter("doc_id % 2 = 0"), 0, out, near)
    ingest.take(docs, 1, out, near)
    once = rows_of(ingest.tables(spark, out)[0]), rows_of(ingest.tables(spark, out)[1])
    ingest.take(docs, 1, out, near)
    assert (rows_of(ingest.tables(spark, out)[0]), rows_of(ingest.tables(spark, out)[1])) == once


def test_ingest_of_odd_posts(spark, tmp_path):
    items = [(1, 1, "2024-01-01", "text", "same  text"), (2, 1, "2024-01-01", "text", "Same text!"), (1, 2, "2024-01-02", "text", None), (1, 3, None, "text", "x"), (None, 4, "2024-01-01", "text", "x"), (1, 1, "2024-01-01", "text", "same  text")]
    spark.createDataFrame(items, "chat_id bigint, message_id bigint, date string, type string, text string").write.parquet(str(tmp_path / "in"))
    ingest.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), ingest.Settings(layout="items"))
    got = {r.item_key: (r.n_posts, r.n_channels, r.first_key) for r in ingest.result(spark, str(tmp_path / "out")).collect()}
    assert got == {"1_1": (2, 2, "1_1"), "2_1": (2, 2, "1_1"), "1_2": (1, 1, "1_2")}


def test_ingest_of_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert ingest.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")) == 0
    assert ingest.result(spark, str(tmp_path / "out")).count() == 0


def test_index_reruns_replace_their_partitions_alone(spark, tmp_path):
    out = str(tmp_path / "out")
    n = tone_index.run(spark, SF, out)
    whole = rows_of(tone_index.result(spark, out))
    assert len(whole) == n
    few = tone_index.Settings(methods=["breadth"], levels=["market"], weights={})
    tone_index.run(spark, SF, out, few)
    assert rows_of(tone_index.result(spark, out)) == whole
    assert {r.level for r in tone_index.result(spark, out).select("level").distinct().collect()} == {"macro", "market", "sector", "stock", "composite"}
    for wrong in (tone_index.Settings(methods=["mean"]), tone_index.Settings(weights={"galaxy": 1.0}), tone_index.Settings(levels=["galaxy"])):
        with pytest.raises(ValueError, match="unknown"):
            tone_index.run(spark, SF, out, wrong)


def test_index_of_the_engines_own_tables(spark, tmp_path):
    from tonelake.sources import synthetic

    for name in ("items", "scores", "prices"):
        getattr(synthetic, name)(spark, SF).write.parquet(str(tmp_path / name))
    tone_index.run(spark, str(tmp_path), str(tmp_path / "a"), tone_index.Settings(layout="items"))
    tone_index.run(spark, SF, str(tmp_path / "b"))
    a, b = (sorted(tuple(plain(round(x, 9) if isinstance(x, float) else x) for x in r) for r in tone_index.result(spark, str(tmp_path / p)).collect()) for p in "ab")
    assert a == b


def test_settings(tmp_path):
    import jobs

    for kind, name in ((ingest.Settings, "ingest"), (tone_index.Settings, "tone_index")):
        assert settings.load(kind, f"{next(iter(jobs.__path__))}/{name}.json") == kind() == settings.load(kind, None)
    (tmp_path / "x.json").write_text(json.dumps({"colour": 1}))
    with pytest.raises(ValueError, match="colour"):
        settings.load(ingest.Settings, str(tmp_path / "x.json"))


def test_command_lines(spark, tmp_path, monkeypatch):
    """The command line reads its config, runs the job on the session it makes, and stops that alone."""
    stopped = []

    class Held:
        def __getattr__(self, name):
            return getattr(spark, name)

        def stop(self):
            stopped.append(True)

    for module in (ingest, tone_index):
        monkeypatch.setattr(module, "build_session", lambda app: Held())
        monkeypatch.setattr(module, "release", lambda s: 0)
    (tmp_path / "c.json").write_text('{"methods": ["shrinkage"], "levels": ["macro"], "weights": {}}')
    tone_index.main(["--tables", SF, "--output", str(tmp_path / "t"), "--config", str(tmp_path / "c.json")])
    assert {(r.method, r.level) for r in tone_index.result(spark, str(tmp_path / "t")).select("method", "level").distinct().collect()} == {("shrinkage", "macro")}
    ingest.main(["--documents", f"{SF}/documents.parquet*", "--output", str(tmp_path / "i"), "--checkpoint", str(tmp_path / "k")])
    assert ingest.tables(spark, str(tmp_path / "i"))[0].agg(F.count("*")).first()[0] == 1000 and stopped == [True, True]
