"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import time
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.sources.tables import materialise, release, scratch_path

__all__ = ["bucket_count", "collect_garbage", "crc32", "forget_all", "forgetting", "give_back", "id_boundaries", "input_bytes", "materialise", "partition_id", "release", "scratch_path", "shuffle_partitions", "small_table", "worker_cache"]


#: Ranges that one quantile pass is asked for at most.
MOST_BUCKETS = 100_000


def input_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of df's size, from file sizes; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bucket_count(docs: DataFrame, target_bytes: int = 4 << 20, least_per_partition: int = 8) -> int:
    """How many buckets to deal a table into: they grow with the input, so a bucket doesn't.

    A table that isn't read from files has no known size; then the shuffle
    partitions alone count.  Buckets are streamed, so past MOST_BUCKETS they may grow.
    """
    size = input_bytes(docs)
    size = 0 if size >= 1 << 60 else size
    return max(least_per_partition * shuffle_partitions(docs.sparkSession), min(size // target_bytes, MOST_BUCKETS), 1)


def id_boundaries(docs: DataFrame, buckets: int, column: str = "doc_id") -> list[int]:
    """Ascending ids that cut the table into about equal buckets; reads the id column only."""
    if buckets < 2:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    cuts = docs.select(F.percentile_approx(column, shares, max(10_000, 20 * buckets)).alias("c")).first()["c"]
    return sorted(set(cuts or []))


def partition_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def small_table(spark: SparkSession, columns: dict[str, tuple[str, list]]) -> DataFrame:
    """Rows of the driver as a table, from name -> (Arrow type, values).

    They go to the JVM as Arrow: createDataFrame() of Python rows would start Python workers of a second kind, whose
    daemon then stays on each executor beside that of mapInArrow.
    """
    import pyarrow as pa

    return spark.createDataFrame(pa.table({name: pa.array(values, kind) for name, (kind, values) in columns.items()}))


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


#: What this process remembers between tasks: owner -> how to forget it.
_REMEMBERED: dict[str, Callable[[], None]] = {}


def worker_cache(owner: str, forget: Callable[[], None]) -> None:
    """Tell that this process remembers something for owner; what another operator remembered is forgotten first."""
    if owner not in _REMEMBERED:
        forget_all()
        _REMEMBERED[owner] = forget


def forget_all() -> None:
    """Forget what this process remembers, and give the memory back."""
    for forget in _REMEMBERED.values():
        forget()
    _REMEMBERED.clear()
    give_back()


def give_back() -> None:
    """Return freed memory to the system; else Arrow's pool and the C library keep it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def forgetting(run: Callable) -> Callable:
    """A function for mapInArrow that forgets at its task's end, and gives back what its batches took.

    Idle Python workers stay, so what they hold would pile up from stage to stage.
    """

    def task(batches):
        try:
            yield from run(batches)
        finally:
            forget_all()

    return task


def collect_garbage(spark: SparkSession) -> None:
    """Let the JVMs collect their garbage now, so that executors give back the heap that earlier work made them grow.

    The driver's comes first: Spark removes broadcasts and shuffle files when it finds there that nothing refers to
    them any more, and until then executors hold them.  An executor's JVM shrinks its heap only after a full
    collection.  One task for each core: where all are idle, as between two stages, every executor gets one.
    """
    gc.collect()  # Python's references to DataFrames keep those of the JVM
    spark._jvm.java.lang.System.gc()
    time.sleep(0.5)  # Spark's cleaner has a thread of its own
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()
