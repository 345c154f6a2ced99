"""Session settings, checkpoints and the partition counts operators derive from the session."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: int | str = 8, app: str = "corpusloom", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass your own session instead."""
    settings = {
        "spark.master": f"local[{cores}]",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.host": "127.0.0.1",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder (spark.checkpoint.dir); only where none is set, as in tests, a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not shared:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="corpusloom-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder, so a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, by: str | None = None, placed: bool = False, small: bool = False) -> DataFrame:
    """The rows as a table in the shared folder, for what several scans read: columns are compressed, and each scan reads its own only.
    With ``by``, it has a bucket for each task of a shuffle, so that windows, groups and joins by that column need none; ``placed`` says that
    the rows come from a shuffle by it already. ``small`` takes a smaller form that is slower to write.
    Tables of a local folder go when the process ends, others stay with the folder."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"corpusloom_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}"
    if by:
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        (df if placed else df.repartition(width, by)).write.bucketBy(width, by).sortBy(by).option("path", path).saveAsTable(name)
        return spark.table(name)
    (df.write.option("compression", "zstd") if small else df.write).parquet(path)
    if path.startswith(("file:", "/")):
        atexit.register(shutil.rmtree, path.removeprefix("file:"), ignore_errors=True)
    return spark.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Let the files of shuffles that nothing refers to any more go now: else they stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    """Tasks of a shuffle whose partitions are addressed by number: the session's setting, at least the cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def input_width(df: DataFrame) -> int:
    """Tasks of a shuffle of all rows of an input: as many as it is read in, so that they grow with it, at least the session's setting."""
    return max(shuffle_width(df.sparkSession), df.rdd.getNumPartitions())
