"""N-gram Jaccard join: near-duplicate documents by word shingles, exactly, with a count-vector R-tree.

1. Every text becomes its set of shingle hashes, under a key drawn for the run. Equal sets (128 bits of the whole set under the key) are one class from here on, with its smallest id.
2. Two sets similar enough share one of the first tokens of each, in any order common to all (here: rare tokens first, as seen
   in a bounded sample, which only affects speed). The classes that share a token are a group. Groups with the same smallest class are one, so a
   family of copies that shares many tokens is dealt out once; only ids and sizes are shuffled until then.
3. A task indexes the count vectors of a group by an R-tree and joins it with itself. Pairs whose overlap bound, also by a finer vector (a quarter of a byte or more
   for each shingle), reaches what is needed are possible links; what they connect is a knot. Only ids leave the task, a row for each member.
4. The texts of a knot meet in one task, where every shingle is numbered letter by letter. The same tree gives the pairs, which are compared by their
   whole sets. A link gives both members one label, and pairs of one label are not compared, so the links that come out join each family
   without a circle: their number grows with the classes, not with the pairs.
5. Groups beyond ``BLOCK`` classes or ``BLOCK_SHINGLES`` are cut into blocks. Blocks are joined with themselves first, each together with the group's
   leaders (its smallest class, and the one with most of the tokens that made the group), which brings most large families together. Then every two
   blocks of what still lies in different components meet.
6. Components of all links.

Defined results: null and empty texts and texts without words have an empty set and link with nothing. Texts with fewer words
than a shingle have one shingle of all their words. Links between different sets go by letters. Very long texts
are taken whole, a batch holds one at a time. Rows are told apart by id and text, so an id may stand on
different texts, each with its own links. Rows without an id are left out of the components unless asked for; then they link like others, and a
component without any id has a null one. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.operators.components import connected_components

from .common import addressed, give_back, map_texts, new_salt, sent, shuffle_partitions, sliced, spot_of, stored, whole_groups
from .rtree import folded, linked, most_shared, packed_counts, unpacked
from .shingles import hashed_sets, mix, new_key, numbered_sets, shingle_sets

#: Groups that tokens are hashed into: the R-tree's dimensions, a power of two of 64 at most.
GROUPS = 64
#: Rows of the sample that tells frequent tokens, how often a token must be seen in it, and how many are told at most.
SAMPLE_ROWS, SEEN, MOST_FREQUENT = 2000, 3, 200_000
#: Share of the sample's rows from which on a token is hot.
HOT = 0.02
#: Classes and shingles of one group in one tree; beyond these it is cut into blocks.
BLOCK, BLOCK_SHINGLES = 4000, 3_000_000
#: Shingles of small groups that are taken together.
BATCH_SHINGLES = 400_000


def prefix_length(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    """How many first tokens of a set must be looked at so that similar sets share one."""
    return size - -(-percent * size // 100) + 1


def sampled_frequencies(docs: DataFrame, width: int, key: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens seen repeatedly in a bounded sample of rows, with their counts, sorted by token; and those that are hot."""
    n = docs.count()
    part = docs if n <= SAMPLE_ROWS else docs.filter(F.pmod(F.xxhash64("spot", F.lit("sample")), F.lit(1_000_000)) < F.lit(1_000_000.0 * SAMPLE_ROWS / n))

    def tokens(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in sliced(frames, "text"):
            sets = shingle_sets(frame["text"].tolist(), width, key)
            yield pd.DataFrame({"token": np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.int64)})

    seen = map_texts(part.select("text"), tokens, "token bigint").groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= SEEN)
    found = seen.orderBy(F.col("n").desc(), "token").limit(MOST_FREQUENT).toPandas()
    token = found["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    seen = found["n"].to_numpy(np.int64)[order]
    return token[order], seen, token[order][seen >= HOT * min(n, SAMPLE_ROWS)].view(np.int64)


SKETCH = "doc bigint, known boolean, spot bigint, n_shingles bigint, digest binary, tokens array<bigint>, fine binary"


def sketch(docs: DataFrame, width: int, percent: int, key: bytes, known: np.ndarray, seen: np.ndarray) -> DataFrame:
    """One small row per document: size and digest of its set, first tokens (rare ones first, as ``known`` ones were ``seen``), count vector."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in sliced(frames, "text"):
            rows = []
            for s, digest in hashed_sets(frame["text"].tolist(), width, key):
                n = len(s)
                if not n:
                    rows.append((0, b"", [], b""))
                    continue
                rank = np.zeros(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    hit = known[at] == s
                    rank[hit] = seen[at[hit]]
                first = np.lexsort((s, rank))[: prefix_length(n, percent)]  # rare first
                rows.append((n, digest, s[first].astype(np.int64), packed_counts(s)))
            out = pd.DataFrame(rows, columns=["n_shingles", "digest", "tokens", "fine"])
            for at, name in enumerate(("doc", "known", "spot")):
                out.insert(at, name, frame[name].to_numpy())
            yield out

    return map_texts(docs, run, SKETCH)


PLACE = ["low", "block", "other"]


def possible(rows: DataFrame, percent: int) -> DataFrame:
    """(low, block, other, knot, side, id, n_shingles, cluster): members of groups with a possible partner. ``rows``: the same with ``fine``
    for ``knot``, sorted by group. A knot is named by its first member's place in the group."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(frames, PLACE, "n_shingles", BATCH_SHINGLES):
            sizes, clusters, sides = (part[c].to_numpy() for c in ("n_shingles", "cluster", "side"))
            fine = [unpacked(f) for f in part["fine"]]
            # A vector that overflowed rules nothing out.
            points = np.array([folded(f, GROUPS) if len(f) else np.full(GROUPS, min(n, 2**31 - 1)) for f, n in zip(fine, sizes.tolist(), strict=True)], np.int32).reshape(-1, GROUPS)
            knot = np.full(len(part), -1)
            for a, b in group_bounds(part, PLACE):

                def shared(i: int, others: np.ndarray, a: int = a) -> np.ndarray:
                    out = np.minimum(sizes[a + others], sizes[a + i])
                    real = np.array([len(fine[a + i]) > 0 and len(fine[a + k]) > 0 for k in others.tolist()])
                    if real.any():
                        out[real] = np.minimum(out[real], most_shared(fine[a + i], [fine[a + k] for k in others[real].tolist()]))
                    return out

                root = list(range(b - a))
                # Rows of a knot meet again anyway, those of one component need not.
                pairs = linked(points[a:b], sizes[a:b], np.arange(b - a), clusters[a:b], sides[a:b], percent, shared)
                for i, j in pairs:
                    while root[i] != i:
                        i = root[i]
                    while root[j] != j:
                        j = root[j]
                    root[max(i, j)] = min(i, j)
                for k in sorted({k for pair in pairs for k in pair}):
                    i = k
                    while root[i] != i:
                        i = root[i]
                    knot[a + k] = i
            out = part[knot >= 0].drop(columns="fine")
            out.insert(3, "knot", knot[knot >= 0])
            if len(out):
                yield out
        give_back()

    return rows.mapInPandas(run, "low bigint, block bigint, other bigint, knot int, side int, id bigint, n_shingles bigint, cluster bigint")


def group_bounds(part: pd.DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    """First place and end of each group in sorted rows."""
    values = part[keys].to_numpy()
    cuts = (np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(values)], strict=True))


def confirmed(rows: DataFrame, width: int, percent: int, every: bool) -> DataFrame:
    """(a, b): links within knots by whole texts. ``rows``: as from ``possible``, with ``text``, sorted by knot and id."""
    keys = [*PLACE, "knot"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_groups(sliced(frames, "text"), keys, "n_shingles", BATCH_SHINGLES):
            part = part.drop_duplicates([*keys, "side", "id"], ignore_index=True)  # rows that repeat an id and its text
            sets, at, top = numbered_sets(part["text"].tolist(), width)
            sizes = np.diff(at)
            hashed = mix(sets.astype(np.uint64)) & np.uint64(GROUPS - 1)
            row = np.repeat(np.arange(len(part)), sizes)
            points = np.bincount(row * GROUPS + hashed.astype(np.int64), minlength=len(part) * GROUPS).reshape(-1, GROUPS).astype(np.int32)
            clusters, sides, ids = (part[c].to_numpy() for c in ("cluster", "side", "id"))
            mark = np.zeros(top, bool)
            found = []
            for a, b in group_bounds(part, keys):

                def shared(i: int, others: np.ndarray, a: int = a) -> np.ndarray:
                    mine = sets[at[a + i] : at[a + i + 1]]
                    mark[mine] = True
                    theirs = [sets[at[a + k] : at[a + k + 1]] for k in others.tolist()]
                    starts = np.concatenate([[0], np.cumsum([len(t) for t in theirs])[:-1]])
                    out = np.add.reduceat(mark[np.concatenate(theirs)].astype(np.int64), starts)
                    mark[mine] = False
                    return out

                found += [(ids[a + i], ids[a + j]) for i, j in linked(points[a:b], sizes[a:b], clusters[a:b], clusters[a:b], sides[a:b], percent, shared, every)]
            if found:
                pairs = np.array(found, np.int64)
                yield pd.DataFrame({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})

    return map_texts(rows, run, "a bigint, b bigint")


def numbered_classes(filled: DataFrame) -> tuple[DataFrame, bool]:
    """(digest, id, label, doc, spot) of each different set: its node, its smallest doc id and the row whose text stands for it.

    The node is the label where only this class has it. Classes without a label or with a shared one are numbered beside all labels, once, as
    the table is stored; the flag tells whether there are any."""
    first = F.min(F.struct((~F.col("known")).alias("unknown"), "doc", "spot")).alias("first")
    classes = stored(filled.groupBy("digest").agg(first).select("digest", "first.*"), "classes")
    shared = stored(classes.filter("not unknown").groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select("doc"), "shared")
    label = F.when(~F.col("unknown"), F.col("doc")).alias("label")
    if shared.isEmpty() and classes.filter("unknown").isEmpty():
        return classes.select("digest", F.col("doc").alias("id"), label, "doc", "spot"), False
    least, most = classes.agg(F.min("doc"), F.max("doc")).first()
    number = F.monotonically_increasing_id()
    number = F.lit(most + 1) + number if most < 2**62 else F.lit(least - 1) - number
    odd = F.col("unknown") | F.col("shared").isNotNull()
    marked = classes.join(shared.withColumn("shared", F.lit(True)), "doc", "left")
    return stored(marked.select("digest", F.when(odd, number).otherwise(F.col("doc")).alias("id"), label, "doc", "spot"), "classes"), True


def prepared(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, bool, np.ndarray]:
    """Sketches of all rows, classes of equal sets, where the text of each class is, one sketch of each class, whether any class is numbered, and the hot tokens."""
    key = new_key()
    known, seen, hot = sampled_frequencies(docs, width, key)
    sketches = stored(sketch(docs, width, percent, key, known, seen), "sketch")
    filled = sketches.filter("n_shingles > 0")
    classes, odd = numbered_classes(filled)
    heads = classes.select("id", "doc", "spot")
    small = sent(heads)
    reps = filled.join(small, ["doc", "spot"]).select("id", "n_shingles", "tokens", "fine")
    if small is heads:
        reps = stored(reps, "reps")  # shuffled once
    if reps.count() > classes.count():  # rows that repeat an id and its text; else the wide rows need no shuffle
        reps = stored(reps.dropDuplicates(["id"]), "reps")
    return sketches, classes, heads, reps, odd, hot


def smallest_partners(rows: DataFrame, percent: int) -> DataFrame:
    """(low, id, n, shared): each class with the smallest one on its token, for tokens of more than one class; counted within a task. ``rows``: token, id, n,
    sorted by token and id. Rows are looked at in passing, so a token may have any number of classes."""

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        table = pd.DataFrame(np.concatenate(parts), columns=["low", "id", "n"]).groupby(["low", "id"], as_index=False).agg(n=("n", "first"), shared=("n", "size"))
        return pa.RecordBatch.from_pandas(table.astype(np.int64), preserve_index=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, sent_on = None, False  # the first row of the last batch's last token, and whether it has been put out
        out: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            token, ident, n = (batch.column(k).to_numpy() for k in range(3))
            goes_on = begun is not None and token[0] == begun[0]
            if goes_on and not sent_on:
                token, ident, n = np.r_[begun[0], token], np.r_[begun[1], ident], np.r_[begun[2], n]
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            many = np.diff(np.r_[starts, len(token)])
            low = ident[starts]
            kept = many > 1
            # Of two classes alone on a token the sizes tell whether they can be similar.
            two = np.flatnonzero(many[:-1] == 2) if len(many) else starts[:0]
            two = two[two > 0] if goes_on else two
            a, b = n[starts[two]].astype(np.int64), n[starts[two] + 1].astype(np.int64)
            kept[two] = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
            if goes_on:
                low[0], kept[0] = begun[1], True
            at = np.repeat(kept, many)
            if at.any():
                out.append(np.column_stack([np.repeat(low, many)[at], ident[at], n[at].astype(np.int64)]))
            if not (goes_on and len(starts) == 1):
                last = starts[-1]
                begun, sent_on = (token[last], ident[last], n[last]), bool(kept[-1])
            else:
                sent_on = True
            if sum(map(len, out)) > 200_000:
                yield counted(out)
                out = []
        if out:
            yield counted(out)

    return rows.mapInArrow(run, "low bigint, id bigint, n bigint, shared bigint")


def grouped(reps: DataFrame, percent: int, hot: np.ndarray) -> DataFrame:
    """(low, id, n_shingles, shared): a row for each class in each group, with how many tokens put it there. Tokens are shuffled once; the ``hot`` ones, so
    called as many rows of the sample have them, not at all: only their smallest classes are gathered."""
    spark = reps.sparkSession
    tokens = reps.select(F.explode("tokens").alias("token"), "id", F.col("n_shingles").cast("int").alias("n"))
    few = F.broadcast(spark.createDataFrame(pd.DataFrame({"token": hot}), "token bigint"))  # at most MOST_FREQUENT numbers
    often = tokens.join(few, "token")
    lows = stored(often.groupBy("token").agg(F.min("id").alias("low"), F.count("*").alias("many")).filter("many > 1").select("token", "low"), "lows")
    from_hot = often.join(F.broadcast(lows), "token").groupBy("low", "id").agg(F.first("n").cast("bigint").alias("n"), F.count("*").alias("shared"))
    rest = tokens.join(few, "token", "left_anti").select("token", "id", "n").repartition(shuffle_partitions(spark), "token").sortWithinPartitions("token", "id")
    hits = smallest_partners(rest, percent).unionByName(from_hot).groupBy("low", "id").agg(F.first("n").alias("n_shingles"), F.sum("shared").alias("shared"))
    return stored(hits, "hits")


def links_within(dealt: DataFrame, docs: DataFrame, heads: DataFrame, reps: DataFrame, width: int, percent: int, every: bool, n: int) -> DataFrame:
    """(a, b): links of groups dealt to blocks. ``dealt``: low, block, other, side, id, n_shingles, cluster."""
    columns = [*PLACE, "side", "id", "n_shingles", "cluster"]
    rows = reps.select("id", "fine").join(sent(dealt), "id").select(*columns, "fine")
    knots = stored(possible(rows.repartition(n, *PLACE).sortWithinPartitions(*PLACE), percent), "knots")
    asks = stored(heads.join(sent(knots), "id"), "asks")
    texts = docs.select("doc", "spot", "text").join(sent(asks), ["doc", "spot"]).select(*PLACE, "knot", "side", "id", "n_shingles", "cluster", "text")
    keys = [*PLACE, "knot"]
    return stored(confirmed(texts.repartition(n, *keys).sortWithinPartitions(*keys, "id"), width, percent, every).distinct(), "links")


def all_links(docs: DataFrame, heads: DataFrame, reps: DataFrame, hot: np.ndarray, width: int, percent: int, n: int, every: bool = False) -> DataFrame:
    """(a, b): links between classes, enough for the components; with ``every`` all of them."""
    hits = grouped(reps, percent, hot)
    sizes = hits.groupBy("low").agg(F.count("*").alias("many"), F.sum("n_shingles").alias("total"), F.max_by("id", F.struct("shared", "id")).alias("central"))
    blocks = F.greatest(F.ceil(F.col("many") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES))
    large = stored(sizes.select("low", blocks.alias("blocks"), "central").filter("blocks > 1"), "large")
    placed = hits.join(sent(large), "low", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint"))).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    own = placed.select("low", "block", F.col("block").alias("other"), F.lit(2).alias("side"), "id", "n_shingles", F.col("id").alias("cluster"))
    if large.isEmpty():
        return links_within(stored(own, "dealt"), docs, heads, reps, width, percent, every, n)
    every_block = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    leading = placed.filter((F.col("id") == F.col("low")) | (F.col("id") == F.col("central"))).withColumn("b", every_block).filter("b <> block")
    leading = leading.select("low", F.col("b").alias("block"), F.col("b").alias("other"), F.lit(2).alias("side"), "id", "n_shingles", F.col("id").alias("cluster"))
    first = links_within(stored(own.unionByName(leading), "dealt"), docs, heads, reps, width, percent, every, n)
    # What is in one component by now needs no further link, unless all are asked for.
    placed = placed.filter("blocks > 1")
    if every:
        placed = placed.withColumn("cluster", F.col("id"))
    else:
        clusters = connected_components(first, "a", "b").select(F.col("node").alias("id"), "component")
        placed = stored(placed.join(clusters, "id", "left").withColumn("cluster", F.coalesce("component", "id")).drop("component"), "placed")
        open_ = placed.groupBy("low").agg(F.min("cluster").alias("a"), F.max("cluster").alias("z")).filter("a < z").select("low")
        placed = placed.join(sent(stored(open_, "open")), "low", "left_semi")
    pairs = placed.withColumn("b", every_block).filter("b <> block")
    across = pairs.select("low", F.least("block", "b").alias("block"), F.greatest("block", "b").alias("other"), (F.col("block") > F.col("b")).cast("int").alias("side"), "id", "n_shingles", "cluster")
    return first.unionByName(links_within(stored(across, "dealt"), docs, heads, reps, width, percent, every, n)).distinct()


def judged(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, bool]:
    """(doc, known, spot, n_shingles, node, component_id) for every row, where ``node`` names the component and is null for empty sets; the flag
    tells whether some component's node may not be its id."""
    n = shuffle_partitions(docs.sparkSession)
    sketches, classes, heads, reps, odd, hot = prepared(docs, width, percent)
    joined = connected_components(all_links(docs, heads, reps, hot, width, percent, n), "a", "b")

    # Back to rows: a class's component, then the smallest member of the component over all its classes (a class has its smallest id).
    by_class = classes.join(joined.withColumnRenamed("node", "id"), "id", "left").select("digest", "label", F.coalesce("component", "id").alias("node"))
    if odd:
        by_class = by_class.join(by_class.groupBy("node").agg(F.min("label").alias("component_id")), "node")
    else:
        by_class = by_class.withColumn("component_id", F.col("node"))
    out = sketches.select("doc", "known", "spot", "n_shingles", "digest").join(by_class.select("digest", "node", "component_id"), "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).when(F.col("known"), F.col("doc"))
    return out.select("doc", "known", "spot", "n_shingles", "node", component.alias("component_id")), odd


def jaccard_components(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, missing_ids: bool = False) -> DataFrame:
    """(id, n_shingles, component_id) for every row: the smallest id reachable by links of at least ``percent`` similarity.

    With ``missing_ids`` rows without an id take part too."""
    docs = addressed(df, id_col, text_col)
    found, _ = judged(docs if missing_ids else docs.filter("known"), width, percent)
    return found.select(F.when(F.col("known"), F.col("doc")).alias(id_col), "n_shingles", "component_id")


def jaccard_links(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, missing_ids: bool = False) -> DataFrame:
    """(a, b, rows_a, rows_b) of every two different sets that are similar enough: their smallest ids and numbers of rows.

    Nothing is skipped for lying in one cluster, so the work grows with the number of links. Pairs within a set are not listed."""
    n = shuffle_partitions(df.sparkSession)
    docs = addressed(df, id_col, text_col)
    docs = docs if missing_ids else docs.filter("known")
    sketches, classes, heads, reps, _, hot = prepared(docs, width, percent)
    links = all_links(docs, heads, reps, hot, width, percent, n, every=True)
    sizes = sketches.groupBy("digest").agg(F.count("*").alias("rows"))
    labels = classes.join(sizes, "digest").select("id", "label", "rows")
    for side in ("a", "b"):
        links = links.join(labels.select(F.col("id").alias(side), F.col("label").alias(f"label_{side}"), F.col("rows").alias(f"rows_{side}")), side)
    return links.select(F.col("label_a").alias("a"), F.col("label_b").alias("b"), "rows_a", "rows_b")


def near_deduplicate(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The input's rows without near copies: of each component the row with the smallest id stays, in the input's columns.

    Where no member has an id, one row stays all the same. Rows that repeat an id and its text stay together."""
    salt = new_salt()
    found, odd = judged(addressed(df, id_col, text_col, salt), width, percent)
    again = None
    if odd:
        found = stored(found.filter("n_shingles > 0"), "found")
        stays = found.groupBy("node").agg(F.min(F.struct(~F.col("known"), "doc", "spot")).alias("stays"))
        dropped = found.join(stays, "node").filter(F.struct(~F.col("known"), "doc", "spot") != F.col("stays"))
        again = stored(found.filter("not known").groupBy("doc", "spot").agg(F.count("*").alias("n")).filter("n > 1").select("doc", "spot"), "again")
    else:
        dropped = found.filter(F.col("doc") != F.col("component_id"))
    dropped = stored(dropped.select("doc", "spot").distinct(), "dropped")
    # The input's row in one column, so that no name can clash.
    ident = df[id_col].cast("bigint")
    full = df.select(F.coalesce(ident, F.lit(0).cast("bigint")).alias("doc"), spot_of(ident, df[text_col], salt).alias("spot"), F.struct(*[df[c] for c in df.columns]).alias("row"))
    kept = full.join(sent(dropped), ["doc", "spot"], "left_anti")
    if again is not None and not again.isEmpty():
        # Equal texts without an id are one component: one of these rows stays.
        one = kept.join(sent(again), ["doc", "spot"], "left_semi").dropDuplicates(["doc", "spot"])
        kept = kept.join(sent(again), ["doc", "spot"], "left_anti").unionByName(one)
    return kept.select(*[F.col("row")[c].alias(c) for c in df.columns])
