import json
import os
import re
import time

import pytest

from tonelake.__main__ import main
from tonelake.operators import rubric, scoring
from tonelake.schemas import DRIVERS, HORIZONS, LEVELS, NOVELTY, SECTOR_CODES
from tonelake.streaming import durable


def requests(spark, n):
    rows = [(f"2024-01-{i + 1:02}", f"prompt {i}", [f"1_{i}"]) for i in range(n)]
    return durable.named(spark.createDataFrame(rows, "day string, prompt string, item_ids array<string>"))


def scorer(folder, stop_at=None, fail_at=()):
    """Notes each call in a file of its own; ends the task where it is told to."""

    def call(prompt):
        n = int(prompt.split()[1])
        began = time.time()
        if n == stop_at:
            raise SystemExit("killed")
        time.sleep(0.2)
        with open(os.path.join(folder, f"{n}-{time.time_ns()}"), "w") as f:
            f.write(f"{began} {time.time()}")
        if n in fail_at:
            raise ValueError("no answer")
        return f"answer {n}"

    return call


def calls(folder):
    return sorted(int(f.split("-")[0]) for f in os.listdir(folder))


def test_goes_on_after_a_failure_without_asking_twice(spark, tmp_path):
    notes, folder = str(tmp_path / "notes"), str(tmp_path / "answers")
    os.mkdir(notes)
    assert durable.add_requests(requests(spark, 8), folder) == 8
    with pytest.raises(Exception):  # noqa: B017  the stream ends with the task
        durable.answer_waiting(spark, folder, scorer(notes, stop_at=5), at_once=1)
    before = calls(notes)
    kept = {r.response for r in durable.answers(spark, folder).collect()}
    assert kept == {f"answer {n}" for n in before} and 5 not in before
    assert durable.add_requests(requests(spark, 8), folder) == 0
    durable.answer_waiting(spark, folder, scorer(notes), at_once=1)
    assert calls(notes) == list(range(8))
    assert {(r.day, r.response, r.error) for r in durable.answers(spark, folder).collect()} == {(f"2024-01-{n + 1:02}", f"answer {n}", None) for n in range(8)}


def test_failed_calls_may_be_asked_again_and_new_ones_come_in(spark, tmp_path):
    notes, folder = str(tmp_path / "notes"), str(tmp_path / "answers")
    os.mkdir(notes)
    durable.add_requests(requests(spark, 3), folder)
    durable.answer_waiting(spark, folder, scorer(notes, fail_at=(1,)), at_once=2)
    assert {r.error for r in durable.answers(spark, folder).collect()} == {None, "REQUEST_ERROR: no answer"}
    assert durable.add_requests(requests(spark, 4), folder) == 2
    durable.answer_waiting(spark, folder, scorer(notes), at_once=2)
    assert calls(notes) == [0, 1, 1, 2, 3]
    assert {r.response for r in durable.answers(spark, folder).collect()} == {f"answer {n}" for n in range(4)}


def test_no_more_calls_at_once_than_allowed(spark, tmp_path):
    notes, folder = str(tmp_path / "notes"), str(tmp_path / "answers")
    os.mkdir(notes)
    durable.add_requests(requests(spark, 7), folder)
    durable.answer_waiting(spark, folder, scorer(notes), at_once=2, pause=0.05)
    spans = [tuple(map(float, (tmp_path / "notes" / f).read_text().split())) for f in os.listdir(notes)]
    assert len(spans) == 7 and max(sum(a <= t < b for a, b in spans) for t, _ in spans) <= 2


def entry(prompt):
    ids = re.findall(r"(?m)^\[(\d+_\d+)\] \(", prompt)
    return json.dumps({"items": [{"item_id": i, "direction": 1, "magnitude": 2} for i in ids]})


def test_command_line_keeps_answers(spark, tmp_path):
    from tonelake.schemas import ITEMS, conform
    from tonelake.sources import tables

    rows = [(1, "c", n, f"2024-01-0{1 + n % 3}T00:00:00", "text", f"text {n}") for n in range(9)]
    items = conform(spark.createDataFrame(rows, "chat_id bigint, chat_name string, message_id bigint, date string, type string, text string"), ITEMS)
    items.write.parquet(str(tmp_path / "items"))
    again = ["score", "--items", str(tmp_path / "items"), "--scorer", "test_durable:entry", "--answers", str(tmp_path / "answers"), "--at-once", "2"]
    main([*again, "--out", str(tmp_path / "a")])
    main([*again, "--scorer", "test_durable:missing_scorer", "--out", str(tmp_path / "b")])
    for name in "ab":
        assert tables.read_scores(spark, str(tmp_path / name)).filter("direction = 1 and magnitude = 2").count() == 9


def missing_scorer(prompt):
    raise AssertionError("nothing is left to ask")


def test_instructions(spark):
    text = rubric.instruction()
    for values in (LEVELS, SECTOR_CODES, DRIVERS, NOVELTY, HORIZONS):
        assert all(v in text for v in values)
    for _, e in rubric.EXAMPLES:
        assert list(e) == list(rubric.FIELDS) and json.dumps(e) in text
        assert all(e[k] is None or e[k] in allowed for k, allowed in (("level", LEVELS), ("sector_code", SECTOR_CODES), ("driver", DRIVERS), ("novelty", NOVELTY), ("horizon", HORIZONS)))
    assert all(name in rubric.legacy_instruction() for name in rubric.LEGACY_FIELDS)
    # The examples are answers that the parser takes whole.
    ids = [f"1_{n}" for n in range(len(rubric.EXAMPLES))]
    entries = [{**e, "item_id": i} for i, (_, e) in zip(ids, rubric.EXAMPLES, strict=True)]
    answers = spark.createDataFrame([("2024-01-01", ids, json.dumps({"items": entries}), None)], "day string, item_ids array<string>, response string, error string")
    got = {r.message_id: r for r in scoring.parse_responses(answers).collect()}
    assert [tuple(got[n][k] for k in rubric.FIELDS[1:]) for n in range(len(ids))] == [tuple(e[k] for k in rubric.FIELDS[1:]) for e in entries]


def test_old_listing_is_cut_shorter(spark):
    items = spark.createDataFrame([(1, "c", 1, "2024-01-01", "x" * 5000, None)], "chat_id bigint, chat_name string, message_id bigint, date string, text string, extracted_text string")
    for chars in (scoring.PROMPT_CHARS, scoring.LEGACY_CHARS):
        assert scoring.prompts(items, chars=chars).first().prompt.count("x") == chars


def test_last_entry_of_an_item_holds(spark):
    entries = [{"item_id": "1_1", "direction": d, "magnitude": 1} for d in (1, 0, -1)]
    answers = spark.createDataFrame([("2024-01-01", ["1_1"], json.dumps({"items": entries}), None)], "day string, item_ids array<string>, response string, error string")
    assert scoring.parse_responses(answers).first().direction == -1
