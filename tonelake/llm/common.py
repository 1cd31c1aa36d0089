"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import secrets
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tonelake.session import shared_dir, stored  # noqa: F401  the operators take them from here

#: Tables of ids up to this many rows are sent to all tasks instead of shuffling the larger side.
BROADCAST_ROWS = 1_000_000
#: Bytes of one Arrow batch on its way to a Python worker: the setting, Spark's own value, and the one used instead.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 * 2**20
#: Texts handled together inside one Arrow batch, in characters; bounds the Python worker's memory.
SLICE_CHARS = 1_500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spot_of(ident: Column, text: Column, salt: str) -> Column:
    """Tells rows of different id or text apart; ``salt`` is drawn once a run, so nobody can write two texts that it doesn't."""
    return F.xxhash64(ident, F.sha2(F.concat(F.lit(salt), text), 256))


def addressed(df: DataFrame, id_col: str, text_col: str, salt: str | None = None) -> DataFrame:
    """(doc, known, spot, text): ``doc`` is the id, 0 where there is none, and (doc, spot) tells rows of different id or text apart in every scan."""
    ident = df[id_col].cast("bigint")
    doc = F.coalesce(ident, F.lit(0).cast("bigint"))
    spot = spot_of(ident, df[text_col], salt or new_salt())
    return df.select(doc.alias("doc"), ident.isNotNull().alias("known"), spot.alias("spot"), df[text_col].alias("text"))


def new_salt() -> str:
    return secrets.token_hex(16)


def sent(df: DataFrame) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast if it is small; else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def small_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes as well as rows: executors and workers each hold some copies of one, outside the heap. A bound set by the user stays."""
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(texts: Sequence[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of texts holding about ``limit`` characters; one text is never cut."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def sliced(frames: Iterable[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    """Arrow batches cut so that each holds a bounded amount of text."""
    for frame in frames:
        texts = frame[column].tolist()
        for a, b in slices(texts):
            yield frame.iloc[a:b]


def whole_groups(frames: Iterable[pd.DataFrame], keys: list[str], weight: str, limit: int) -> Iterator[pd.DataFrame]:
    """Frames of rows sorted by ``keys``, dealt anew so that each holds whole groups, ``limit`` in weight or a little more."""
    held: list[pd.DataFrame] = []
    size = 0
    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        size += int(frame[weight].sum())
        if size >= limit:
            rows = pd.concat(held, ignore_index=True)
            values = rows[keys].to_numpy()
            cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
            if len(cuts):
                yield rows.iloc[: cuts[-1]].reset_index(drop=True)
                rows = rows.iloc[cuts[-1] :]
            held, size = [rows], int(rows[weight].sum())
    if held:
        yield pd.concat(held, ignore_index=True)


def give_back() -> None:
    """Returns freed memory to the system. Python workers live on after a task, and what their allocators keep adds up beside the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def cut_batch(batch: pa.RecordBatch, column: int | str) -> Iterator[pa.RecordBatch]:
    """A batch in slices that hold a bounded amount of text each; one text is never cut."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = size = 0
    for i, n in enumerate(sizes.tolist()):
        size += n
        if size >= SLICE_CHARS or i == len(sizes) - 1:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0


def map_texts(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, column: str = "text") -> DataFrame:
    """``mapInPandas`` whose frames hold a bounded amount of text each: a batch becomes Python strings a slice at a time."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    small_batches(df.sparkSession)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in run(part.to_pandas() for batch in batches for part in cut_batch(batch, column)):
            yield pa.RecordBatch.from_pandas(frame, schema=arrow, preserve_index=False)
        give_back()

    return df.mapInArrow(mapped, schema)
