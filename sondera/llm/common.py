"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error elsewhere."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master.startswith("local") and not context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sondera-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def ceil_div(a: int, b: int) -> int:
    return max(1, math.ceil(a / b))


def finite(vector: Column) -> Column:
    """True for a vector without null or non-finite components that has at least one component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def unit_hash(key: str, seed: int) -> Column:
    """A number from 0 to 1 that a key and a seed decide; null keys have one too."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def hash_sample(df: DataFrame, key: str, seed: int, rows: int) -> DataFrame:
    """The first ``rows`` rows in the order of a hash of ``key``.

    Only about four times as many rows, whatever the table's size, get as far as the ordering.
    """
    share = 4 * rows / max(1, df.count())
    at = unit_hash(key, seed)
    return (df.where(at < share) if share < 1 else df).orderBy(at, key).limit(rows)


def slices(batch: pa.RecordBatch, at: int, size: int, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose column ``at``, of strings, has about ``size`` bytes and which have ``rows`` rows at most; a longer string is alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    low = 0
    while low < batch.num_rows:
        before = ends[low - 1] if low else 0
        high = min(low + rows, max(low + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(low, high - low)
        low = high


#: A key that more than one row in so many has is hot: there are no more hot keys than that.
HOT = 200


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, count: str = "n") -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row for each ``key`` and in ``count`` how many of the rows it has.

    The rows of hot keys, HOT at most, are joined with a broadcast of theirs, so no task gets all of a hot key's rows; the others are joined by shuffle.
    """
    total = keyed.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    is_hot = F.col(count) * F.lit(HOT) > F.lit(total)
    hot = keyed.where(is_hot)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.where(~is_hot), key))


def trim() -> None:
    """Return to the system what this process's Arrow and C library hold but do not use."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def collect_garbage(spark: SparkSession) -> None:
    """Garbage collection in the executors' JVMs, by a task for each of their cores: a heap that an earlier step has grown goes back to the system but for what lives."""
    n = parallelism(spark)
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows at most for what runs inside: JVM and Python hold each whole, several times."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back(spark: SparkSession) -> bool:
    """Return to the system what the driver's two processes and the executors' JVMs hold but do not use, between steps of a long job; True if the driver's JVM could do so too.

    Garbage first; then, in the driver, the C library's free memory, which many short-lived threads and compilers leave scattered.
    """
    gc.collect()
    trim()
    collect_garbage(spark)
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    try:  # by the interface, as the server's own class is not open to others
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = new_array(jvm.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:  # not every JVM has the command
        return False
    return True


def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that have rows; what Arrow holds of those before is given back to the system, and at the end what the C library holds, as workers outlive their tasks."""
    for batch in source:
        if batch.num_rows:
            yield batch
        del batch
        pa.default_memory_pool().release_unused()
    trim()
