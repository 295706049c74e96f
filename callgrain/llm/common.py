"""What the operators share: tables, stages in the shared folder, broadcasts of a checked size."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch, unless the session has a value of its own (Spark's is 10,000): texts of some KB fill no more than a few MB on either side.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Most bytes that a broadcast of the engine holds.
BROADCAST_BYTES = 64 << 20

_written: list = []


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, as texts in flight are memory that neither heap nor spilling bounds."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, rows: int = 512):
    """Arrow batches in pieces of at most ``rows`` rows, so that a worker holds few texts as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    Where it is unset, a local session (tests) gets a temporary folder; a
    cluster session is an error, as a machine-local folder would lose rows.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="callgrain-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    This cuts the lineage: later jobs reread the table, also after an executor
    was lost, and no stage below it is computed twice.  Once a quarter of the driver's heap is
    used, its garbage (plans, metrics, generated code) is collected here, or a long chain
    of stages would fill it.  :func:`cleanup` removes the tables; it runs when the
    interpreter ends.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/callgrain-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if 4 * (heap.totalMemory() - heap.freeMemory()) > heap.maxMemory():
        release(spark)
    if not _written:
        atexit.register(cleanup, spark)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of stages that nothing refers to any more.

    Its cleaner waits for a garbage collection of the driver, which a driver with
    little to do may never run while the executors' disks fill.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def mark() -> int:
    """A point in the order of staged tables, for :func:`sweep`."""
    return len(_written)


def sweep(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Remove the tables staged since a mark, but for those of ``keep``, and what shuffles they needed.

    For operators whose result is itself staged: nothing lazy may still read the others.
    """
    kept = {df._staged_path for df in keep}
    for path in [p for p in _written[since:] if p not in kept]:
        _delete(spark, path)
        _written.remove(path)
    release(spark)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cleanup(spark: SparkSession) -> None:
    """Delete every table that :func:`staged` wrote in this process."""
    while _written:
        with contextlib.suppress(Exception):  # the session may have ended
            _delete(spark, _written[-1])
        _written.pop()


def sized_broadcast(df: DataFrame, row_bytes=64) -> DataFrame:
    """Hint a broadcast only if ``df`` fits ``BROADCAST_BYTES``; else leave the join to the optimiser.

    row_bytes: bytes of a row, a number or a column of ``df`` where rows have lists.
    """
    total = df.agg(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df
