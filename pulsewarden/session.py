"""Session helpers: shared scratch space and written intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Setting and value: the state store that stateful processors with several variables need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def get_spark(app: str = "pulsewarden", master: str | None = None, **conf) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config(*STATE_STORE)
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Functions that run in Python workers name it, and a worker need not have it installed.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="pulsewarden-")
    path = Path(folder) / "pulsewarden.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))


_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session, as in tests, may fall back to a folder of its own.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="pulsewarden-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/pulsewarden/{spark.sparkContext.applicationId}"
    if path not in _SCRATCH:
        _SCRATCH.add(path)
        atexit.register(_remove, spark, path)
    return path


_SCRATCH: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if spark.sparkContext._jsc is None or jvm is None:  # the session has ended before
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` has written, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        own = scratch_dir(spark).split("://")[-1].rstrip("/")
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if own.split(":", 1)[-1].lstrip("/") in folder:
                _remove(spark, folder)


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Hold a setting of the session for a while and give the caller's own back."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Bytes that go to a Python worker at once where rows are wide; Spark's own limit is 64 MB.
WIDE_BATCH = 4 << 20


@contextmanager
def wide_rows(spark: SparkSession) -> Iterator[None]:
    """For tables whose rows hold megabytes: read them one by one, and send few to a Python worker at once.

    A row larger than the limit goes alone. Holds for queries that run, and tables that are written, inside.
    """
    with (_setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(WIDE_BATCH)),
          _setting(spark, "spark.sql.parquet.columnarReaderBatchSize", "1")):
        yield


#: Lets a finished query give back its shuffle files at once, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder, in a folder per value of ``partition_by``, and read it back.

    Cuts the lineage, survives lost executors and, being columnar, lets later
    passes read only the columns they need. The shuffle files that led to the table
    are removed as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    with _setting(spark, _CLEANUP, "true"):
        df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame) -> DataFrame:
    """Write a reduced table, so that Spark plans by its written bytes.

    Before it has run, Spark can only guess an aggregate's size from its input, and
    would shuffle the large side of a join with it. Once written, a table below
    ``spark.sql.autoBroadcastJoinThreshold`` is broadcast and a larger one joined by key.
    """
    return materialize(df)


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of a table too small to fill the cores.

    For work that costs much per row. A table of at least one full split per core
    keeps its own splits and is not moved; nor is a stream.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    split = 128 << 20
    return df.repartition(cores) if int(str(size)) < cores * split else df
