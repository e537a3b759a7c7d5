"""Session settings, checkpointing and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings that results depend on (time zone) or that plans rely on at scale.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Small partitions are put together up to this size. Rows take some ten times as much unpacked, and a task holds several sorts of them.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


ROWS_A_PARTITION = 200_000
_ROWS: dict[tuple[str, str], int] = {}  # rows of the large tables read, by application and source


def _partitions_needed(spark: SparkSession) -> int:
    app = spark.sparkContext.applicationId
    return max([-(-n // ROWS_A_PARTITION) for (a, _), n in _ROWS.items() if a == app], default=1)


def rows_known(spark: SparkSession, source: str) -> int | None:
    """Rows of a table that `sized` has counted."""
    return _ROWS.get((spark.sparkContext.applicationId, source))


def sized(table: DataFrame, source: str) -> DataFrame:
    """Raise the number of shuffle partitions to what the rows of a large table need, so that a task's share fits its memory however large the table is.

    The rows are counted once per application, from the files' footers.
    """
    spark = table.sparkSession
    key = (spark.sparkContext.applicationId, source)
    if key not in _ROWS:
        _ROWS[key] = table.count()
    need = _partitions_needed(spark)
    if int(spark.conf.get("spark.sql.shuffle.partitions")) < need:
        spark.conf.set("spark.sql.shuffle.partitions", str(need))
    return table


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A runtime setting for the jobs run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job of this package assumes.

    A cluster chooses its own number of shuffle partitions; a local master gets no more than it has cores or its tables need (`sized`).
    """
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    context = spark.sparkContext
    most = max(context.defaultParallelism, _partitions_needed(spark))
    if context.master.startswith("local") and int(spark.conf.get("spark.sql.shuffle.partitions")) > most:
        spark.conf.set("spark.sql.shuffle.partitions", str(most))
    return spark


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("freightloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the one the cluster names in spark.checkpoint.dir.

    Only a local master may fall back to a temporary folder of the machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return os.path.dirname(current.rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="freightloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative job with a reliable checkpoint."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table a job writes and reads back."""
    return f"{shared_folder(spark).rstrip('/')}/freightloom-work/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared folder and read it back: later jobs, and tasks run again after a lost executor, start from the files."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


_STORED: dict[tuple[str, str, str], str] = {}


def stored_table(spark: SparkSession, name: str, source: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A derived table several jobs read: written once per application to the shared folder, then read back."""
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _STORED:
        path = work_path(spark, name)
        make().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


_BUCKETS: dict[tuple[str, str, str], str] = {}


def stored_buckets(spark: SparkSession, name: str, source: str, column: str, make: Callable[[], DataFrame], values: Callable[[], int] = lambda: 1) -> DataFrame:
    """Like stored_table, with the rows of each value of `column` in one bucket: jobs that group or sort within its values need no shuffle of the rows.

    There are as many buckets as `values` says there are values, or as shuffle partitions if these are more: a task gets one value, or few that share a bucket.
    The files lie in the shared folder; the catalog of the application knows them as a table, as buckets are known to tables only.
    """
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _BUCKETS:
        path, rows = work_path(spark, name), make()  # reading the tables sets the partitions their rows need
        buckets, known_as = max(int(spark.conf.get("spark.sql.shuffle.partitions")), values()), "freightloom_" + path.rsplit("/", 1)[1].replace("-", "_")
        rows.repartition(buckets, column).write.format("parquet").bucketBy(buckets, column).option("path", path).saveAsTable(known_as)
        _BUCKETS[key] = known_as
    return spark.table(_BUCKETS[key])


def has_stored(spark: SparkSession, name: str, source: str) -> bool:
    """Whether the application has written the table."""
    key = (spark.sparkContext.applicationId, name, source)
    return key in _STORED or key in _BUCKETS
