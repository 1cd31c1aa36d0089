import random

import pytest
from oracle import SF

from tonelake.llm import queries, url_rules


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:at].translate(str.maketrans(url_rules.CAPITALS, url_rules.SMALL)), rest[at:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


def run(spark, urls, rules, **options):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df, url_rules.rule_frame(df, rules), **options).collect()}


EDGE = [None, "", "no scheme", "http://", "http://ORG/", "http://org", "http://a.org?x", "x://y://example.org/es/", "http://www.Example.ORG/es/1#f", "http://notexample.org/es/", "http://example.org./es/", "http://example.org:80/es/", "http://\n/es/", "http://É.example.org/en/1", "http://com/de/", "http://a..com/de/x"]


@pytest.mark.parametrize("parts", ["1", "4", "30"])
def test_like_brute_force(spark, parts):
    rng = random.Random(1)
    labels, paths = ["a", "b", "ab", "org", "com", "x-y", "a0"], ["", "/", "/a", "/a/", "/a/b", "/ab", "/A"]
    hosts = [".".join(rng.choice(labels) for _ in range(rng.randint(1, 4))) for _ in range(30)]
    rules = [(rng.choice(["allow", "block"]), h, p) for h in hosts[:15] for p in rng.sample(paths, 3)]
    urls = EDGE + [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q', 'x'])}" for _ in range(400)] + ["http://a.org/a/b"] * 50
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = run(spark, urls, rules + queries.URL_RULES)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {i: brute(u, rules + queries.URL_RULES) for i, u in enumerate(urls)}


def test_no_rules_and_no_urls(spark):
    assert run(spark, ["http://a/b"], [], default="block") == {0: ("a", "/b", None, "block")}
    assert run(spark, [], queries.URL_RULES) == {}


def test_query(spark):
    from oracle import connect, spark_rows, sql_rows

    assert spark_rows(queries.op4_url_rules(spark, SF)) == sql_rows(connect(SF), queries.OP4_SQL)


def test_clashing_columns_empty_table_and_long_urls(spark):
    names = "page_id bigint, url string, id string, host int, path string, rule string, verdict string, key string, bucket int, is_rule int"
    long = "http://a.org/" + "x" * 300_000
    urls = [(1, "http://a.org/p/q"), (2, long), (None, "http://a.org/p"), (3, None)]
    df = spark.createDataFrame([(i, u, "i", 1, "p", "r", "v", "k", 2, 3) for i, u in urls], names)
    rules = url_rules.rule_frame(df, [("block", "a.org", "/p"), ("allow", "a.org", "/p/"), ("allow", "a.org", "/p"), ("block", "org", "/x"), *[("allow", "a.org", f"/z{k}") for k in range(300)]])
    out = url_rules.judge(df, rules, default="none")
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert {(r.page_id, r.rule, r.verdict) for r in out.collect()} == {(1, "a.org/p/", "allow"), (2, "org/x", "block"), (None, "a.org/p", "block"), (3, None, "none")}
    assert url_rules.judge(df.limit(0), rules).count() == 0


@pytest.mark.parametrize("parts", ["1", "4", "30"])
def test_labels_that_sort_last(spark, parts):
    urls = [f"http://\U0010ffff{mark}{k}.com/de/x" for k in range(20) for mark in ("", "\U0010ffff")] + ["http://com/de/", "http://com.com/de/"]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = run(spark, urls, queries.URL_RULES)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {i: brute(u, queries.URL_RULES) for i, u in enumerate(urls)} and {v[3] for v in got.values()} == {"block"}
