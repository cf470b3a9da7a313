"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the operators were tuned with. Shuffle width is left to the
# cluster: AQE coalesces small partitions and splits skewed join partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


RUN = "spark.vinculum.run"  # the folder of the run that is open
DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_tables: dict[str, list[str]] = {}  # bucketed tables of open runs, by run


def build_session(app: str = "vinculum", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the library's settings; ``extra`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """What is stored inside the block lies in a folder of its own, which is deleted at its end.

    Read the results inside the block.
    """
    outer = spark.conf.get(RUN, "")
    own = f"{outer}run-{uuid.uuid4().hex}/"
    spark.conf.set(RUN, own)
    try:
        yield own
    finally:
        spark.conf.set(RUN, outer)
        for table in _tables.pop(own, ()):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{_base(spark)}/vinculum/{own}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_dir(spark: SparkSession, name: str = "tmp") -> str:
    """A fresh path under the folder all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a local-mode session without
    the setting falls back to its warehouse folder.
    """
    return f"{_base(spark)}/vinculum/{spark.conf.get(RUN, '')}{name}-{uuid.uuid4().hex}"


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return base.rstrip("/")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs inside the block deletes its shuffle files as it ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(DROPPED)
    spark.conf.set(DROPPED, "true")
    try:
        yield
    finally:
        spark.conf.set(DROPPED, before)


def write_through(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: store ``df`` as parquet in the scratch folder and read it back.

    The stored table survives the loss of an executor, unlike a cached one.
    """
    return _stored(df, name, {})


def write_through_groups(df: DataFrame, name: str, group_bytes: int) -> DataFrame:
    """``write_through`` in row groups of about ``group_bytes``, beyond which no batch of a reader goes."""
    return _stored(df, name, {"parquet.block.size": group_bytes})


def _stored(df: DataFrame, name: str, options: dict[str, int]) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Delete the stored tables that ``frames`` read, as nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        ours = f"{_base(spark)}/vinculum/".split(":")[-1].lstrip("/")
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if ours in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], table: str | None = None) -> DataFrame:
    """Store ``df`` in the scratch folder, bucketed by ``keys``: joins and sums on them need no exchange of it.

    It has as many buckets as the session has shuffle partitions, and is a table of the catalog, as
    Spark knows buckets of such only; ``table`` names one to keep, another goes with its run.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = table or f"{name}_{uuid.uuid4().hex}"
    if table is None:
        _tables.setdefault(spark.conf.get(RUN, ""), []).append(own)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").bucketBy(buckets, *keys).option("path", scratch_dir(spark, name)).saveAsTable(own)
    return spark.table(own)
