"""URL filters by a sort-merge range join.

A url's key is its host's labels in reverse, each closed by a full stop, then its path. A rule for a host and all its
subdomains is then the interval of keys that begin with the rule's reversed host. Urls and rules are cut into the same
key ranges by sampled splitters; a rule goes to each range that its interval meets. In a range both are sorted and swept
once: a rule is pushed when its interval begins and popped when a key lies beyond it, so the stack holds the nested rules
of the current host, and the longest path of each host's rules is looked up for the url.

Defined results: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the
path goes on up to ``?``, ``#`` or the end. Null urls and urls without ``://`` have an empty host and path, to which no rule
with a host fits. Of the rules that fit, the longest (host and path together) wins, then the one with the longer host, then
``block``. Repeated rows are judged each; without rules all urls get the default verdict. Urls of any length are taken whole. Rows without an id are judged
like others and come back without one. An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions
from .ranges import bucket_of, sampled_splitters

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), CAPITALS, SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class HostRules:
    """The rules of one host: by path, and the lengths of the paths, longest first. Looking up costs the number of different lengths."""

    def __init__(self, reversed_name: str):
        self.reversed_name = reversed_name
        self.by_path: dict[str, tuple[str, str]] = {}  # rule and verdict; block before allow
        self.lengths: list[int] = []

    def add(self, path: str, rule: str, verdict: str) -> None:
        if path not in self.by_path or verdict > self.by_path[path][1]:
            self.by_path[path] = (rule, verdict)
            if len(path) not in self.lengths:
                self.lengths = sorted([*self.lengths, len(path)], reverse=True)

    def longest(self, path: str) -> tuple[str, str] | None:
        return next((self.by_path[path[:n]] for n in self.lengths if n <= len(path) and path[:n] in self.by_path), None)


def sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one range in key order, rules before the urls that they may fit; the stack outlives Arrow batches."""
    stack: list[HostRules] = []
    for frame in frames:
        ids, rules, verdicts = [], [], []
        hosts, paths = [], []
        for key, is_rule, ident, host, path, rule, verdict in zip(*[frame[c].tolist() for c in ("key", "is_rule", "id", "host", "path", "rule", "verdict")], strict=True):
            while stack and not key.startswith(stack[-1].reversed_name):
                stack.pop()
            if is_rule:
                if not stack or stack[-1].reversed_name != key:
                    stack.append(HostRules(key))
                stack[-1].add(path, rule, verdict)
                continue
            fits = [(len(found[0]), len(active.reversed_name), found[1], found[0]) for active in stack if (found := active.longest(path))]
            best = max(fits, default=None)
            ids.append(ident)
            hosts.append(host)
            paths.append(path)
            rules.append(best and best[3])
            verdicts.append(best and best[2])
        if ids:
            yield pd.DataFrame({"id": ids, "host": hosts, "path": paths, "rule": rules, "verdict": verdicts})


def judge(df: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row. ``rules`` has columns host, path and verdict (allow or block)."""
    spark = df.sparkSession
    urls = df.select(df[id_col].alias("id"), host_of(df[url_col]).alias("host"), path_of(df[url_col]).alias("path"))
    urls = urls.withColumn("key", reversed_host(F.col("host")))
    lead = F.struct(F.col("key").alias("k"), F.substring("path", 1, 32).alias("p"), F.coalesce(F.col("id").cast("bigint"), F.lit(0)).alias("i"))
    splitters = sampled_splitters(urls, lead, F.xxhash64("id", "path"), shuffle_partitions(spark))
    known = rules.select(F.translate(F.coalesce("host", F.lit("")), CAPITALS, SMALL).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct()
    known = known.withColumn("rule", F.concat("host", "path")).withColumn("key", reversed_host(F.col("host")))
    least = F.struct(F.col("key").alias("k"), F.lit("").alias("p"), F.lit(-(2**63)).alias("i"))
    # Keys that begin with the rule's end before the byte after its last full stop, which no host holds.
    most = F.struct(F.regexp_replace("key", r"\.$", "/").alias("k"), F.lit("").alias("p"), F.lit(-(2**63)).alias("i"))
    ranged = known.withColumn("bucket", F.explode(F.sequence(bucket_of(least, splitters, known), bucket_of(most, splitters, known))))
    columns = ["bucket", "key", "is_rule", "id", "host", "path", "rule", "verdict"]
    kind = urls.schema["id"].dataType
    merged = (
        urls.withColumns({"bucket": bucket_of(lead, splitters, urls), "is_rule": F.lit(False), "rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
        .select(columns)
        .unionByName(ranged.withColumns({"is_rule": F.lit(True), "id": F.lit(None).cast(kind)}).select(columns))
    )
    sorted_ranges = merged.repartitionById(len(splitters) + 1, F.col("bucket")).sortWithinPartitions("bucket", "key", F.col("is_rule").desc(), "path")
    out = sorted_ranges.mapInPandas(sweep, f"id {kind.simpleString()}, host string, path string, rule string, verdict string")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def rule_frame(df: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (verdict, host, path)."""
    return df.sparkSession.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, host string, path string")
