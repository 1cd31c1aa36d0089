"""Connected components of an edge table: forests within partitions, then alternating large-star and small-star steps.

Before anything is shuffled, each task unites what its own edges connect and passes on a forest, every node with its smallest: a family that lies in one partition is a star
from then on, and circles are gone. Each step then sends every node one minimum, aggregated before the shuffle, and rewires edges towards it. A node with very many
edges is dealt over salted keys when its minimum goes back to its edges, so a hub is no single task. The number of edges never grows and stars are
reached after a logarithmic number of rounds. A round's edges are written to the shared folder, so plans stay short and rounds survive lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, ShortType, StringType

from tonelake.session import stored

#: Edges of a task that are united at once.
FOREST_EDGES = 500_000
#: Edges of a node for each of its salted keys, and keys of one node at most.
HUB_EDGES, MOST_SALTS = 100_000, 1_000
#: Hubs up to this many are sent to all tasks.
BROADCAST_HUBS = 100_000


def small_roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of the nodes 0 to n - 1 the smallest one that edges (u, v) connect it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while True:  # paths are halved until every node points to a root
            again = new[new]
            if (again == new).all():
                break
            new = again
        if (new == root).all():
            return root
        root = new


def _forests(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of each task as stars of what they connect; nothing is shuffled."""
    kind = edges.schema["u"].dataType

    def united(parts: list[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        if not table.num_rows:
            return
        both = pa.chunked_array(table.column(0).chunks + table.column(1).chunks).combine_chunks().dictionary_encode()
        order = pc.sort_indices(both.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        names, at = both.dictionary.take(pa.array(order)), place[both.indices.to_numpy()]
        root = small_roots(at[: table.num_rows], at[table.num_rows :], len(names))
        child = np.flatnonzero(root != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(child)), names.take(pa.array(root[child]))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= FOREST_EDGES:
                yield from united(held, batch.schema)
                held, size = [], 0
        if held:
            yield from united(held, held[0].schema)

    # Numbers, and strings by their bytes, have one order in both worlds; of other types only the rounds below take care.
    return edges.mapInArrow(run, edges.schema) if kind in (LongType(), IntegerType(), ShortType(), StringType()) else edges


def _back(edges: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """``edges`` with the minimum ``m`` of their node ``u``. ``least``: u, m, n (edges of the node, ``most`` at most)."""
    if most <= HUB_EDGES:
        return edges.join(least.drop("n"), "u")
    hubs = stored(least.filter(F.col("n") > HUB_EDGES).select("u", "m", F.least(F.ceil(F.col("n") / HUB_EDGES), F.lit(MOST_SALTS)).cast("int").alias("salts")), "hubs")
    if hubs.isEmpty():
        return edges.join(least.drop("n"), "u")
    few = hubs.limit(BROADCAST_HUBS + 1).count() <= BROADCAST_HUBS
    known = F.broadcast(hubs.select("u", "salts")) if few else hubs.select("u", "salts")
    salted = edges.join(known, "u", "left").withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("v"), F.col("salts"))).otherwise(F.lit(0)).cast("int")).drop("salts")
    spread = least.join(F.broadcast(hubs.select("u", "salts")) if few else hubs.select("u", "salts"), "u", "left")
    spread = spread.select("u", "m", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    return salted.join(spread, ["u", "salt"]).drop("salt")


def _stars(edges: DataFrame, large: bool, most: int) -> DataFrame:
    """One star step over edges (u, v), u > v, of which there are ``most`` at most."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")).select("u", F.least("u", "low").alias("m"), "n")
        out = _back(both.filter("v > u"), least, most).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        out = _back(edges, least, most).select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        out = out.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    return out.filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    """Tells edge sets apart without gathering them."""
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected_components(edges: DataFrame, a: str, b: str, *, most_rounds: int = 64) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that has an edge to another one.

    Nulls, loops and repeated edges have no effect. Without edges the result is empty."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    current = stored(_forests(pairs).distinct(), "edges")
    before = _mark(current)
    for _ in range(most_rounds):
        if not before[0]:
            break
        current = stored(_stars(stored(_stars(current, True, before[0]), "large"), False, before[0]), "edges")
        now = _mark(current)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
