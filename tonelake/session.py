"""Session settings, and where intermediate tables are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tonelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume: ANSI mode, UTC, adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", **conf}
    return builder.config(map=settings).getOrCreate()


_local: dict[str, str] = {}
#: Folders handed out, by application.
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession, label: str, *, keep: bool = False) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which every executor can reach. With ``keep`` it is left alone by ``release``.

    Where the setting is absent, a local session gets one temporary folder for all; on a cluster that is an error, as executors would write to their own disks."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _local.get(app) or tempfile.mkdtemp(prefix="tonelake-")
        _local[app] = base
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if not keep:
        _made.setdefault(app, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Removes this application's intermediate tables, and says how many folders were there. For use when results have been written or shown: a frame that has
    not been computed yet may still read them."""
    context = spark.sparkContext
    removed = 0
    for name in _made.pop(context.applicationId, []):
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        removed += path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return removed


def spread(df: DataFrame) -> DataFrame:
    """The frame dealt out evenly if it comes in fewer pieces than there are cores, as small tables do; else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bytes of one Arrow batch on its way to a Python worker: the setting, Spark's own value, and the one used instead.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 * 2**20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes as well as rows, as workers hold several copies of one. A bound set by the user stays."""
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read back: lineage ends there, lost executors don't matter."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
