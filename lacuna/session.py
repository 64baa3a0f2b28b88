"""Session set-up and tables written to cut lineage."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_own_folders: dict[str, str] = {}
#: Paths written inside each open ``scratch``, the innermost last.
_open_scratches: list[list[str]] = []


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A one-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lacuna")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder for written tables: the one the cluster names, else a local one.

    A machine-local folder is only ever made for a local master, where driver
    and tasks are one process on one machine.
    """
    named = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="lacuna-")
    return _own_folders[app]


def written_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    path = f"{shared_folder(spark).rstrip('/')}/lacuna/{name}-{uuid.uuid4().hex}"
    if _open_scratches:
        _open_scratches[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that are written inside it when it ends.

    Results that are still read from those tables have to be saved or collected
    inside. Only paths handed out by ``written_path`` are touched.
    """
    paths: list[str] = []
    _open_scratches.append(paths)
    try:
        yield
    finally:
        _open_scratches.remove(paths)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Batches that jobs inside it send to Python end after about ``size`` bytes.

    The session's limit, 64 MB by default, is held several times over by every
    task outside the heap. It is put back at the end.
    """
    before = spark.conf.get(_BATCH_KEY, None)
    spark.conf.set(_BATCH_KEY, str(size))
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(_BATCH_KEY, before)
        else:
            spark.conf.unset(_BATCH_KEY)


def write_and_reread(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage and pins the rows: a lost executor makes later stages
    read files again instead of repeating work that could come out otherwise.
    Being columnar, later readers fetch only the columns they use.

    Tasks hold a row group of up to thousands of rows while they write or read.
    Tables with rows of megabytes name the most rows of a group (``group_rows``).
    """
    path = written_path(df.sparkSession, name)
    options = {"parquet.block.row.count.limit": group_rows} if group_rows else {}
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
