import hashlib
from collections import defaultdict

import pytest
from oracle import SF

from tonelake.llm import exact_dedup, queries

TEXTS = [(5, "a"), (2, "a"), (9, "b"), (1, None), (3, ""), (None, "a"), (7, "a" * 300_000), (8, "a" * 300_000), (4, "a" * 299_999 + "b"), (6, "é"), (6, "é"), (10, "solo"), (11, "a ")]


def brute(rows, keep):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        real = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(real) if real else None
        out += [(i, best, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(map(str, out))


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_groups(docs, keep, buckets):
    rows = TEXTS + [(100 + i, "hot text") for i in range(60)]
    got = exact_dedup.exact_groups(docs(rows), keep=keep, buckets=buckets).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == brute(rows, keep)
    assert sum(r.kept for r in got) == len({t or "" for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_rows_and_columns_pass_through(docs):
    df = docs(TEXTS)
    out = exact_dedup.deduplicate(df, buckets=7)
    assert out.columns == df.columns and sorted((r.text or "") for r in out.collect()) == sorted({t or "" for _, t in TEXTS})
    assert {r.id for r in out.collect()} == {"x"}


def test_empty(docs):
    assert exact_dedup.exact_groups(docs([])).count() == 0


def test_normalised(docs):
    from pyspark.sql import functions as F

    got = exact_dedup.exact_groups(docs([(1, "A "), (2, "a")]), normalise=F.lower(F.trim("text"))).collect()
    assert {r.keep_id for r in got} == {2}


def test_plan_is_native(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    plan = exact_dedup.exact_groups(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_query(spark):
    from oracle import connect, spark_rows, sql_rows

    assert spark_rows(queries.op1_exact_dedup(spark, SF)) == sql_rows(connect(SF), queries.OP1_SQL)


def test_very_long_texts(docs):
    long = "a" * 300_000
    rows = [(1, long), (2, long + "b"), (3, long), (4, long[:-1])]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs(rows)).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def test_texts_with_one_beginning_and_one_64_bit_hash(docs):
    """Two texts that xxhash64 does not tell apart keep their own groups, however many ranges each goes through."""
    twins = ["the same beginning here.S6zcwfvBand the same middle too.MWSEnuNf", "the same beginning here.m846zCHhand the same middle too.&#EX~~<p"]
    rows = [(2 * i + k, t) for i in range(200) for k, t in enumerate(twins)]
    got = exact_dedup.exact_groups(docs(rows), buckets=4).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == brute(rows, "largest")
    assert sum(r.kept for r in got) == 2
