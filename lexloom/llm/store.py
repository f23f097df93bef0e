"""The folder that the driver and all executors share.

``spark.checkpoint.dir`` names it on a cluster, where it must be set.  Where it
is unset and the master is ``local`` (one process, as in tests) a folder below
the temporary directory is used and written back to the session, so that
``DataFrame.checkpoint`` works too.  Files that Python
workers write go through :mod:`pyarrow.fs`, which resolves ``file:``,
``hdfs:``, ``s3:`` and ``gs:`` URIs alike.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder; sets one of our own only if none is set."""
    root = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexloom-shared-")
        spark.conf.set(SETTING, root)
        spark.sparkContext.setCheckpointDir(root)
    return root if "://" in root or root.startswith("file:") else f"file://{root}"


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run of an operator."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Sets what the session has not, for as long as the block runs."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Shuffle files go when the query that wrote them ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str) -> DataFrame:
    """Writes and rereads: cuts the lineage, and losing an executor costs nothing."""
    with settings(df.sparkSession, {CLEANUP: "true"}):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes what was written and nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _resolve(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, write) -> None:
    """Calls ``write(stream)`` on a private name, then moves it into place.

    Attempts of the same task write the same bytes, so whichever ends last
    wins; readers never see half a file.
    """
    system, path = _resolve(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(attempt) as out:
        write(out)
    system.move(attempt, path)


#: Files that a worker keeps open or mapped at a time.
MOST_OPEN = 4096


def open_file(uri: str):
    """A random-access file; memory-mapped where the folder is a local mount."""
    system, path = _resolve(uri)
    if isinstance(system, fs.LocalFileSystem):
        import pyarrow as pa

        return pa.memory_map(path)
    return system.open_input_file(path)


#: Most partitions of an exchange that is dealt by an explicit number.
MOST_PARTS = 500_000


def bytes_of(df: DataFrame) -> int:
    """Bytes of a table: what its plan states if that is one file scan, else what its texts and binaries hold."""
    plan = df._jdf.queryExecution().optimizedPlan()
    stated = int(str(plan.stats().sizeInBytes()))
    if plan.collectLeaves().size() == 1 and stated < 1 << 60:  # joins multiply, and some sources know nothing
        return stated
    sized = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    return df.agg(F.sum(sum(sized, F.lit(16)).cast("long"))).first()[0] or 0


def parts_for(df: DataFrame, part_bytes: int = 32 << 20) -> int:
    """Partitions of an exchange of what is derived from ``df``, by its bytes.

    At least the session's ``spark.sql.shuffle.partitions``; more where the
    input is large, so that a task's share doesn't grow with the input.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2, least, min(-(-bytes_of(df) // part_bytes), MOST_PARTS))


BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bounds the bytes of a batch that goes to a Python worker, unless the session bounds them itself.

    Spark's own bound of 64 MB stands in the JVM and in the worker, several
    times each, for every task at once.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(size))


def fits(df: DataFrame, rows: int) -> bool:
    """Whether a table that is already written has at most so many rows."""
    return df.limit(rows + 1).count() <= rows


def sized_join(big: DataFrame, small: DataFrame, on, how: str, rows: int) -> DataFrame:
    """Broadcasts ``small`` only after counting it; otherwise a shuffled join."""
    return big.join(F.broadcast(small) if fits(small, rows) else small.hint("merge"), on, how)
