"""Session and shared storage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch: as they hold whole texts, the usual 10,000 take too much memory on both sides.
ARROW_ROWS = 1000
#: Rows in a file of a table known to be small.
FILE_ROWS = 20_000

#: Rows of a table that may be broadcast, and bytes of files that may be without a count.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 4 << 20

#: Bytes of files whose rows a task may sort and group in memory.
TASK_BYTES = 4 << 20

_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()
_WRITTEN: list[tuple[SparkSession, str]] = []


def get_spark(app: str = "deltaloom", cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (UTC, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application, and have whole texts handed to them in small batches."""
    sc = spark.sparkContext
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    if sc.applicationId in _SHIPPED:
        return
    home = Path(__file__).resolve().parent
    path = f"{tempfile.mkdtemp(prefix='deltaloom-code-')}/{home.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f.relative_to(home.parent))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Where the setting is absent a temporary folder serves, but only in a
    single-process local session; a cluster must name a shared folder.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="deltaloom-")
    return _LOCAL[sc.applicationId]


def reserve(spark: SparkSession, tag: str) -> str:
    """A folder's name in the shared folder, which no other call gets; it goes with what materialize() writes."""
    path = f"{shared_root(spark)}/deltaloom/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts the lineage; the files survive the loss of an executor. rows: how many
    there are at most, if known, so that small tables don't become many files.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(rows // FILE_ROWS + 1)
    path = reserve(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, known: int | None = None, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df to be broadcast if it is small: by a known number of rows, by Spark's estimate from the files that it reads, or else counted. Otherwise as it is, for a join by shuffle."""
    if known is None:
        # without statistics Spark takes a filter, projection or aggregate to be as large as what it reads, and a join as the product
        if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES:
            return F.broadcast(df)
        known = df.limit(rows + 1).count()
    return F.broadcast(df) if known <= rows else df


def tasks_of(source: DataFrame) -> int:
    """How many tasks the rows of a table's files need, so that a task's memory doesn't grow with the table."""
    return -(-int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // TASK_BYTES)


def dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """df dealt out by keys to so many tasks.

    Left to itself Spark joins partitions up to a size in shuffle files, whose rows take many times as much in memory. It still does so here where cores are enough.
    """
    spark = df.sparkSession
    if tasks <= spark.sparkContext.defaultParallelism:
        return df.repartition(*keys)
    return df.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """What materialize() writes inside is deleted at the end; results made inside must be used there."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        release(before)


@atexit.register
def release(keep: int = 0) -> None:
    """Delete what materialize() has written in this process, but for the first tables."""
    while len(_WRITTEN) > keep:
        spark, path = _WRITTEN.pop()
        with contextlib.suppress(Exception):
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
