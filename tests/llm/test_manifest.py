import hashlib
import zlib

import pytest
from oracle import SF
from pyspark.sql import functions as F

from tonelake.llm import manifest, queries

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
LOWER = str.maketrans(manifest.CAPITALS, manifest.SMALL)


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """The root and each node's runs of (left, right) siblings."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, pos in enumerate(at):
            run = nodes[pos // 8 * 8 : pos // 8 * 8 + 8]
            paths[k].append(("".join(run[: pos % 8]), "".join(run[pos % 8 + 1 :])))
        nodes = [h(nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [pos // 8 for pos in at]
    return nodes[0] if nodes else None, paths


def brute(rows):
    """Rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    members = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in names}
    trees = {g: tree([leaf(r) for r in members[g]]) for g in names}
    root, above = tree([trees[g][0] for g in names])
    out = []
    for g, high in zip(names, above):
        for row, low in zip(members[g], trees[g][1]):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None
            node = leaf((*row[:4], row[4].translate(LOWER) if tampered else row[4]))
            for l, r in low + high:
                node = h([l, node, r])
            out.append((row[0], leaf(row), trees[g][0], root, h([l + r for l, r in low + high]), node, node == root))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 3, "y") for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, `group` string, pos int, node string")
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    out = manifest.manifest(df, COLUMNS, changed={"text": F.when(picked, manifest.lowered(F.col("text"))).otherwise(F.col("text"))})
    return sorted([(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in out.collect()], key=str)


ODD = [
    (5, None, None, None, None), (None, "s", "en", 1, "A"), (None, "s", "en", 1, "B"), (7, "", "", 0, ""), (7, "", "", 0, ""), (7, "", "", 0, "Z"), (-3, "-", "-", -1, "-"),
    (8, "é", "Ω", 2, "É" * 300_000 + "Q"), (9, "1:a", "=", 3, "Mixed Case"), (2**62, "s", "en", 1, "X\nY"),
]


@pytest.mark.parametrize("parts", ["1", "4", "30"])
def test_like_brute_force(spark, parts):
    rows = ODD + [(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(100, 700)] + [(i, "s", "de", i, f"Text {i}") for i in range(64)] + [(i, "s", f"l{i}", i, None) for i in range(20)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = run(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_small_trees(spark):
    for rows in ([], [(1, "s", "en", 1, "A")], [(i, "s", "en", 1, "A") for i in range(9)], [(1, "s", None, 1, "A"), (2, "s", "en", 1, "b")]):
        assert run(spark, rows) == brute(rows)


def test_unchanged_rows_verify_and_paths_are_given(spark):
    df = spark.createDataFrame([(i, "s", "en", i, f"T{i}") for i in range(30)], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    rows = manifest.manifest(df, COLUMNS).collect()
    assert all(r.verified for r in rows) and {len(r.path) for r in rows} == {2}


def test_query(spark):
    from oracle import connect, spark_rows, sql_rows

    assert spark_rows(queries.op11_merkle_manifest(spark, SF)) == sql_rows(connect(SF), queries.OP11_SQL)
