"""Exact top-k search by inner product: ball trees, branch and bound.

Candidates are dealt to shards by a hash of their id and queries to blocks, of a bounded number of rows and of components. A shard builds a ball tree over its
vectors: a node's ball has centre c and radius r, so no vector in it scores above <q, c> + |q| r. For each query, nodes
wait in a heap ordered by that bound; the search ends when the best bound falls below the current k-th score. Shards are searched in
rounds, each as many as all before it: a query's k-th score over the shards done is where all shards of the next round start, and they only send what can still count.

Components are integers and scores exact: products are taken in doubles while they are below 2**53 and in Python
integers beyond, in the same tree, whose bounds are widened by more than the doubles' error.

Defined results: rows whose vector is null, empty or holds null or non-finite components (also after scaling) take no part, nor do rows without an
id; scores beyond 38 digits are clipped to these, and in the result to 64 bits; vectors of another length than the query's are not its candidates; equal
scores go by the smaller id; of repeated ids each row takes part, but never as candidate of a query with its own id. Empty tables, and tables
without a query, give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Candidates of one shard and queries of one block, about, and components of either: bounds of what one task holds.
SHARD_ROWS, BLOCK_ROWS, MOST_COMPONENTS = 40_000, 8_192, 4_000_000
LEAF_ROWS = 256
EXACT = 2.0**53
#: Scores are ranked as decimals of 38 digits and clipped to them.
LARGEST = 10**38 - 1


class BallTree:
    """Balls over the rows of a matrix; leaves hold ranges of the reordered rows."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, whole: np.ndarray | None = None):
        """``whole``: the rows as Python integers, where doubles don't hold their products."""
        self.nodes: list[tuple] = []  # centre, radius, left, right, start, stop
        order = np.arange(len(rows))
        self._build(rows, order, 0, len(rows))
        self.rows, self.ids = (rows if whole is None else whole)[order], ids[order]
        self.centres = np.array([n[0] for n in self.nodes])
        self.radii = np.array([n[1] for n in self.nodes])

    def _build(self, rows: np.ndarray, order: np.ndarray, start: int, stop: int) -> int:
        mine = rows[order[start:stop]]
        centre = mine.mean(axis=0)
        far = np.linalg.norm(mine - centre, axis=1)
        node = len(self.nodes)
        self.nodes.append((centre, far.max(), -1, -1, start, stop))
        if stop - start > LEAF_ROWS:
            a = mine[far.argmax()]
            b = mine[np.linalg.norm(mine - a, axis=1).argmax()]
            along = mine @ (b - a)
            half = (stop - start) // 2
            order[start:stop] = order[start:stop][np.argpartition(along, half)]
            left = self._build(rows, order, start, start + half)
            right = self._build(rows, order, start + half, stop)
            self.nodes[node] = (centre, far.max(), left, right, start, stop)
        return node


def search(tree: BallTree, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray, whole: np.ndarray | None = None) -> Iterator[tuple[int, list[int], list]]:
    """(query's position, ids, scores) of each query's best k rows with scores of at least ``floor``. ``whole``: the queries as Python integers, if the
    tree's rows are."""
    lengths = np.linalg.norm(queries, axis=1)[:, None]
    bounds = queries @ tree.centres.T + lengths * tree.radii
    # Rounding only ever widens a ball.
    bounds = bounds + 1e-9 * lengths * (np.linalg.norm(tree.centres, axis=1) + tree.radii) + 1
    bounds = np.where(np.isfinite(bounds), bounds, np.inf)
    for i, query in enumerate(queries if whole is None else whole):
        best: list[tuple] = []  # (-score, id)
        current = floor[i]
        heap = [(-bounds[i, 0], 0)]
        while heap and -heap[0][0] >= current:
            _, node = heapq.heappop(heap)
            _, _, left, right, start, stop = tree.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if bounds[i, child] >= current:
                        heapq.heappush(heap, (-bounds[i, child], child))
                continue
            scores, ids = tree.rows[start:stop] @ query, tree.ids[start:stop]
            at = np.flatnonzero((scores >= current) & (ids != query_ids[i]))
            if len(at):
                best = heapq.nsmallest(k, [*best, *zip((-scores[at]).tolist(), ids[at].tolist(), strict=True)])
                if len(best) == k:
                    current = max(current, -best[-1][0])
        yield i, [v for _, v in best], [-s for s, _ in best]


def _integers(rows: np.ndarray) -> np.ndarray:
    """Doubles without a fraction as Python integers."""
    return np.array([[int(x) for x in r] for r in rows.tolist()], dtype=object).reshape(rows.shape)


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as doubles; null for vectors that take no part."""
    whole = F.transform(vector, lambda x: _floor(x, scale))
    return F.when((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * F.lit(float(scale))) == float("inf"))), whole)


def _floor(x: Column, scale: int) -> Column:
    y = x.cast("double") * F.lit(float(scale))
    # Beyond 2**52 every double is an integer, and Spark's floor() would overflow its long.
    return F.when(F.abs(y) < 4503599627370496.0, F.floor(F.when(F.abs(y) < 4503599627370496.0, y).otherwise(0.0)).cast("double")).otherwise(y)


def _numbers(first: int, last: int) -> Column:
    return F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint"))


def top_k(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", query: Column | None = None, k: int = 10, scale: int = 1024, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``query`` accepts (ids divisible by 100) its k best others.

    Work is queries times rows by nature of an exact search; a task holds one shard and one block, and only k rows a
    query leave it. Rows are copied once for each block of queries, queries once for each shard.
    """
    query = F.pmod(F.col("id"), F.lit(100)) == 0 if query is None else query
    rows = df.select(df[id_col].cast("bigint").alias("id"), quantised(df[vector_col], scale).alias("v")).filter("id is not null and v is not null").withColumn("is_query", query)
    n, asked, size, asked_size = rows.agg(F.count("*"), F.count_if("is_query"), F.sum(F.size("v")), F.sum(F.when(F.col("is_query"), F.size("v")))).first()
    shards = max(1, -(-n // shard_rows), -(-(size or 0) // MOST_COMPONENTS))
    blocks = max(1, -(-asked // block_rows), -(-(asked_size or 0) // MOST_COMPONENTS))
    kind = "bigint"
    one = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"))
    asking = rows.filter("is_query").select(F.col("id").alias("asker"), F.col("v").alias("asked"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).alias("block"))

    def task(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": [], "exact": []}
        if len(mine) and len(theirs):
            widths = mine["v"].map(len)
            for width, asked_here in theirs.groupby(theirs["asked"].map(len)):
                same = mine[widths == width]
                if not len(same):
                    continue
                q, x = np.array(asked_here["asked"].tolist(), float), np.array(same["v"].tolist(), float)
                qi, xi = asked_here["asker"].to_numpy(), same["id"].to_numpy()
                floor = asked_here["floor"].to_numpy(float, na_value=-np.inf)
                if np.abs(q).max() * np.abs(x).max() * width < EXACT:
                    found = search(BallTree(x, xi), q, qi, k, floor)
                else:
                    found = search(BallTree(x, xi, _integers(x)), q, qi, k, floor, _integers(q))
                for i, ids, scores in found:
                    out["query_id"] += [qi[i]] * len(ids)
                    out["vec_id"] += ids
                    out["score"] += [float(s) for s in scores]
                    out["exact"] += [str(max(-LARGEST, min(LARGEST, int(s)))) for s in scores]
        ids = {n: pd.Series(out[n], dtype="int64") for n in ("query_id", "vec_id")}
        return pd.DataFrame(ids | {"score": pd.Series(out["score"], dtype="float64"), "exact": pd.Series(out["exact"], dtype=object)})

    shape = f"query_id {kind}, vec_id {kind}, score double, exact string"

    def searched(candidates: DataFrame, askers: DataFrame, shard_ids: Column) -> DataFrame:
        mine = candidates.withColumn("block", F.explode(_numbers(0, blocks - 1)))
        theirs = askers.withColumn("shard", F.explode(shard_ids))
        return mine.groupBy("shard", "block").cogroup(theirs.groupBy("shard", "block")).applyInPandas(task, shape)

    found = searched(one.filter("shard = 0"), asking.withColumn("floor", F.lit(None).cast("double")), _numbers(0, 0))
    done = 1
    while done < shards:
        found = stored(found, "found")
        # A k-th score that at least k rows reach; big scores leave the exact range of doubles and give no floor.
        best = found.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))).filter(F.col("nth") == k)
        kth = best.select(F.col("query_id").alias("asker"), F.when(F.abs("score") < EXACT, F.col("score")).alias("floor"))
        led = asking.join(kth, "asker", "left")
        until = min(2 * done, shards)
        found = found.unionByName(searched(one.filter((F.col("shard") >= done) & (F.col("shard") < until)), led, _numbers(done, until - 1)))
        done = until
    whole = F.col("exact").cast("decimal(38,0)")
    order = Window.partitionBy("query_id").orderBy(whole.desc(), "vec_id")
    low, high = F.lit(str(-(2**63))).cast("decimal(38,0)"), F.lit(str(2**63 - 1)).cast("decimal(38,0)")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.least(F.greatest(whole, low), high).cast("bigint").alias("score"))
