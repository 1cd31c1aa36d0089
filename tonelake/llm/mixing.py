"""Mixing sources to target weights by Poisson replication.

A source with n rows and target share w of a mixture of N rows is to be repeated w * N / n times in the mean. Each row
takes its own number of copies: the Poisson distribution with that mean, inverted at a uniform number hashed from the seed and
the row's id. A mean above ``MOST_MEAN`` is drawn in equal parts of at most that, each at a number of its own; their sum has the whole distribution. Copies are exploded and shuffled globally by a hash of seed, id and copy. Every decision depends on one row and
its source's count alone, so no source, however large, is gathered anywhere.

Defined results: a null source is a source of its own. Sources not named in ``weights`` share what the named ones leave
equally; shares are scaled to sum to 1 over the sources present. Rows with the same id in a source draw the same number. Rows without an id draw
as the empty id. Empty tables give empty results; texts, however long, are never looked at, and other columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored

#: Names of sources fit one broadcast up to this many; beyond it the join is left to Spark.
BROADCAST_SOURCES = 100_000
#: The largest mean inverted at once, well within the range of doubles.
MOST_MEAN = 256.0


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_steps(mean: Column) -> Column:
    """The distribution function at 0, 1, 2, ... up to twelve deviations above the mean, as an array."""
    most = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("steps"))

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), F.concat(acc["steps"], F.array(acc["sum"] + p)).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), most), start, add, lambda acc: acc["steps"])


def source_rates(df: DataFrame, weights: Mapping[str, float] | None, *, source_col: str, temperature: float = 1.0, size: float = 1.0) -> DataFrame:
    """(source, n, mean, parts, steps): how often each source's rows are to be repeated, and the distribution of each of equal parts.

    Without ``weights``, shares follow counts to the power ``temperature``. ``size`` is the mixture's size in input sizes."""
    counts = df.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        raw = counts.withColumn("raw", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        named = F.create_map(*[F.lit(x) for k in sorted(weights) for x in (k, float(weights[k]))]) if weights else None
        share = F.get(F.array(F.try_element_at(named, F.coalesce("source", F.lit("\0")))), F.lit(0)) if weights else F.lit(None).cast("double")
        raw = counts.withColumn("named", share)
        rest = max(0.0, 1.0 - sum(weights.values()))
        others = raw.agg(F.greatest(F.count_if(F.col("named").isNull()), F.lit(1)).alias("others"))
        raw = raw.crossJoin(F.broadcast(others)).withColumn("raw", F.coalesce("named", F.lit(rest) / F.col("others")))  # one row
    total = raw.agg(F.sum("raw").alias("sum_raw"), F.sum("n").alias("sum_n"))
    rates = raw.crossJoin(F.broadcast(total))  # one row
    rates = rates.withColumn("mean", F.coalesce(F.try_divide(F.col("raw"), F.col("sum_raw")), F.lit(0.0)) * F.col("sum_n") * F.lit(float(size)) / F.col("n"))
    parts = F.greatest(F.ceil(F.col("mean") / MOST_MEAN), F.lit(1)).cast("bigint")
    return rates.select("source", "n", "mean", parts.alias("parts"), poisson_steps(F.col("mean") / parts).alias("steps"))


def drawn_copies(seed: str, ident: Column, parts: Column, steps: Column) -> Column:
    """How many copies a row gets: for each part, how many steps of the distribution lie at or below its number."""

    def below(u: Column) -> Column:
        return F.size(F.filter(steps, lambda p: p <= u)).cast("bigint")

    first = below(uniform(seed, ident))
    more = F.aggregate(F.sequence(F.lit(1).cast("bigint"), parts - 1), F.lit(0).cast("bigint"), lambda n, part: n + below(uniform(seed, ident, part)))
    return F.when(parts > 1, first + more).otherwise(first)


def mix(df: DataFrame, weights: Mapping[str, float] | None = None, *, id_col: str = "doc_id", source_col: str = "source", seed: str = "mix", temperature: float = 0.5, size: float = 1.0) -> DataFrame:
    """Input rows, repeated and shuffled: column ``row`` (a struct of all input columns), ``copy`` (from 1), ``mean``, ``mix_key``. Beside the
    struct no name can clash; ``spread`` takes it apart."""
    spark = df.sparkSession
    # One row a source, stored so that the table is counted once.
    rates = stored(source_rates(df, weights, source_col=source_col, temperature=temperature, size=size), "rates").select(F.col("source").alias("s"), "mean", "parts", "steps")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[id_col].alias("id"), df[source_col].alias("source"))
    joined = rows.join(rates, F.col("source").eqNullSafe(F.col("s")))
    copies = drawn_copies(seed, F.col("id"), F.col("parts"), F.col("steps"))
    drawn = joined.withColumn("copies", copies).filter("copies > 0").select("row", "id", "mean", "copies")
    each = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    text = F.concat_ws("|", F.lit(seed), F.lit("order"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("copy").cast("string"))
    keyed = each.select("row", "copy", "mean", F.md5(text).alias("mix_key"))
    return keyed.repartition(shuffle_partitions(spark), "mix_key").sortWithinPartitions("mix_key")


def spread(mixed: DataFrame, *more: str) -> DataFrame:
    """The input's columns, then those of ``more``; one whose name the input has too gets underscores at its end."""
    names = mixed.schema["row"].dataType.names
    out = [F.col("row")[n].alias(n) for n in names]
    taken = {n.lower() for n in names}
    for name in more:
        free = name
        while free.lower() in taken:
            free += "_"
        out.append(F.col(name).alias(free))
    return mixed.select(*out)


def mixed_documents(df: DataFrame, weights: Mapping[str, float] | None = None, **options) -> DataFrame:
    """The mixture in the input's columns; a row repeated k times appears k times."""
    return spread(mix(df, weights, **options))
