"""A Merkle manifest of a dataset: one digest for the whole, one for each group, and for each row a proof that it belongs there.

A row's leaf is the digest of its columns. Within a group the leaves stand in the order of their ids; every ``FAN`` consecutive nodes of a level become one
node of the next, by the digest of their digests, until one is left, the group's root. The groups' roots, in the order of their names, become the
dataset's root in the same way.

1. Leaves are computed where the rows lie; texts are never shuffled. Positions come from sampled splitters: a range numbers its own rows, and ranges add what lies
   before them, so a group with a third of all rows is no single task.
2. A level is one window over (group, parent): the ordered list of the whole frame is both the parent's preimage and every child's siblings. Each parent is taken once, from its
   first child, and goes on to the next level.
3. Paths come down again, a join per level: a node's path is its siblings and then its parent's path. A row's proof is what its path holds, and folding the row's
   leaf along the path gives the root if the row is what it was.

Defined results: null values are told apart from empty ones and from every text. Rows without a group form a group of their own, which comes first. Rows without an id come first in their group; rows
that share an id stand in the order of their leaves, so repeated rows have neighbouring positions, in whatever order, and equal leaves. Rows of one id and one leaf
may have different siblings and proofs, but the set of them is always the same. A group with one row has that row's leaf as its root, a table
with one group that group's root. Texts of any length are digested whole. An empty table has an empty manifest. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sent, shuffle_partitions, stored
from .ranges import bucket_of, sampled_splitters

#: Nodes that become one.
FAN = 8
#: Leading characters of a group's name in the splitters.
LEAD = 64
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def leaf(values: Sequence[Column]) -> Column:
    """Digest of the values: each with its length in bytes before it, a dash where there is none."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def lowered(text: Column) -> Column:
    return F.translate(text, CAPITALS, SMALL)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (group, place, and others) with each row's position in its group, from 0, and the group's size. ``place`` is a struct of small columns
    that tells all rows of a group apart; ``rows`` must be stored."""
    key = F.struct(F.substring("group", 1, LEAD).alias("lead"), F.col("place").alias("place"))
    splitters = sampled_splitters(rows, key, F.col("place"), shuffle_partitions(rows.sparkSession))
    dealt = rows.withColumn("bucket", bucket_of(key, splitters, rows)).repartitionById(len(splitters) + 1, F.col("bucket"))
    within = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("bucket", "group").orderBy("place")))
    within = stored(within, "numbered")
    # One row for each group in each range.
    counts = within.groupBy("group", "bucket").agg(F.count("*").alias("many"))
    along = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("many").over(along), F.lit(0)).alias("before")
    offsets = stored(counts.select("group", "bucket", before, F.sum("many").over(Window.partitionBy("group")).alias("n")), "offsets")
    return within.join(sent(offsets), ["group", "bucket"]).withColumn("pos", F.col("before") + F.col("nth") - 1).drop("bucket", "nth", "before", "place")


def climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Levels of all trees from the leaves on, and the roots (group, level, node). ``nodes``: group, pos, n, node, and others, which stay with the
    leaves. A level has each node's siblings as ``left`` and ``right``."""
    levels: list[DataFrame] = []
    roots: DataFrame | None = None
    while True:
        run = Window.partitionBy("group", F.expr(f"pos div {FAN}")).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        at = (F.col("pos") % FAN).cast("int")
        wide = nodes.filter("n > 1").withColumn("run", F.collect_list("node").over(run))
        wide = wide.withColumns({"left": F.array_join(F.slice("run", F.lit(1), at), ""), "right": F.array_join(F.slice("run", at + 2, F.lit(FAN)), ""), "parent": F.when(at == 0, digest(F.array_join("run", "")))})
        alone = nodes.filter("n = 1").select("group", F.lit(len(levels)).alias("level"), "node")
        roots = alone if roots is None else roots.unionByName(alone)
        single = nodes.filter("n = 1").withColumns({"left": F.lit(""), "right": F.lit(""), "parent": F.lit(None).cast("string")})
        levels.append(stored(wide.drop("run").unionByName(single), "level"))
        # Each parent once, from its first child.
        nodes = levels[-1].filter("parent is not null").select("group", F.expr(f"pos div {FAN}").alias("pos"), F.ceil(F.col("n") / FAN).alias("n"), F.col("parent").alias("node"))
        if nodes.isEmpty():
            return levels, roots


STEP = "struct<left: string, right: string>"


def descended(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves with their paths and what ``tops`` holds of their group. ``tops``: group, level (of the group's root), path (above that root), and others."""
    carried = [c for c in tops.columns if c not in ("group", "level", "path")]
    above: DataFrame | None = None
    for k in reversed(range(len(levels))):
        level = levels[k]
        # A root of this level is alone in it.
        down = level.filter("n = 1").join(tops.filter(F.col("level") == k).drop("level"), "group")
        if above is not None:
            step = F.array(F.struct("left", "right").cast(STEP))
            inner = level.filter("n > 1").withColumn("up", F.expr(f"pos div {FAN}")).join(above.withColumnRenamed("pos", "up").withColumnRenamed("path", "rest"), ["group", "up"])
            down = down.unionByName(inner.withColumn("path", F.concat(step, "rest")).drop("up", "rest"))
        if k == 0:
            return down.drop("left", "right", "parent")
        above = down.select("group", "pos", "path", *carried)
    raise ValueError("no level")


def folded(node: Column, path: Column) -> Column:
    """The root that follows from a node and the siblings on its path."""
    return F.aggregate(path, node, lambda at, step: digest(step["left"], at, step["right"]))


def proof(path: Column) -> Column:
    """Digest of all siblings on a path, from the leaf's run up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def manifest(df: DataFrame, columns: Sequence[str], *, id_col: str = "doc_id", group_col: str = "lang", changed: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, path, proof_sha256, folded_root, verified) for every row. ``columns`` make the leaf.

    ``changed`` gives columns other values, as found now: then ``folded_root`` starts from the leaf of those, and ``verified`` tells whether the row
    is still the one in the manifest."""
    now = {c: df[c] for c in columns} | (changed or {})
    found = leaf([now[c] for c in columns]) if changed else leaf([df[c] for c in columns])
    group = F.when(df[group_col].isNull(), "").otherwise(F.concat(F.lit("="), df[group_col].cast("string")))
    # The last part of the place tells repeated rows apart; it is drawn once, as the table is stored.
    rows = df.select(df[id_col].alias("id"), group.alias("group"), leaf([df[c] for c in columns]).alias("node"), found.alias("now"), F.monotonically_increasing_id().alias("row"))
    placed = rows.withColumn("place", F.struct(F.col("id").isNotNull().alias("known"), F.coalesce(F.col("id"), F.lit(0).cast(rows.schema["id"].dataType)).alias("id"), "node", "row")).drop("row")
    levels, subroots = climbed(numbered(stored(placed, "leaves")))
    subroots = stored(subroots, "subroots")
    names = subroots.select(F.lit("").alias("group"), F.struct(F.col("group").alias("name")).alias("place"), F.col("group").alias("name"), "level", "node")
    upper, root = climbed(numbered(stored(names, "names")))
    tops = descended(upper, root.select("group", F.col("level"), F.col("node").alias("root"), F.array().cast(f"array<{STEP}>").alias("path")))
    out = descended(levels, tops.select(F.col("name").alias("group"), "level", "path", F.col("node").alias("subroot"), "root"))
    again = folded(F.col("now"), F.col("path"))
    return out.select(F.col("id").alias(id_col), F.col("node").alias("leaf"), "subroot", "root", "path", proof(F.col("path")).alias("proof_sha256"), again.alias("folded_root"), (again == F.col("root")).alias("verified"))
