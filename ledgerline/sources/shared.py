"""Shared views: intermediate relations that several reports read, written once and bucketed by their key.

A report that reads another report's result as a view would compute it again each time. ``shared_view`` writes the view as
a table bucketed and sorted by its key into the folder that driver and executors share, and hands out the table: joins, aggregates and windows
by that key then read it without a shuffle, and the sources are read once for all reports of the session. The write also cuts
the lineage, so a lost executor costs a read of the table and not the view's whole plan.

A key with a large share of the rows would make one bucket, and so one task, as large. After the write the
sizes of the buckets are compared; where the largest is out of proportion, the same files are handed out as plain Parquet, and the
joins above shuffle as usual with adaptive execution splitting the skewed partitions. No rows differ between the two forms.

A view belongs to one ``Tables`` object, whose file listing is fixed when it is opened; ``forget`` drops it, so that changed sources are read anew.
The files go when the application ends.

A view whose source is narrower than its rows is dealt out by the builder itself (``dealt``), before the columns are derived, so that the
narrow rows are shuffled. The number of buckets grows with the sources (``bucket_count``), so that a bucket stays of one size. So does the
number of partitions with which the other shuffles start (``follow_sources``).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import Tables

UNEVEN = 4                   # times the mean, from which the largest bucket is out of proportion
UNEVEN_BYTES = 256 << 20     # a smaller bucket is never too large for a task
BUCKET_BYTES = 16 << 20      # of the source files behind a bucket
UNKNOWN_BYTES = 1 << 50      # the optimizer's word for a size that it does not know is larger
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_OURS = "spark.ledgerline.initialPartitionNum"
_MARK = "%"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local session without one gets a scratch folder, any other is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="ledgerline-shared-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def bucket_bytes(spark: SparkSession, path: str) -> list[int]:
    """Sizes of the buckets under ``path``, from the file listing alone."""
    at, fs = _hadoop(spark, path)
    sizes: dict[str, int] = {}
    for f in fs.listStatus(at):
        name = f.getPath().getName()
        if name.startswith("part-"):
            bucket = name.split("_")[-1].split(".")[0]
            sizes[bucket] = sizes.get(bucket, 0) + f.getLen()
    return list(sizes.values())


def bucket_count(*sources: DataFrame) -> int:
    """The session's number of shuffle partitions, or more where ``sources`` are large (by the optimizer's sizes; nothing is read)."""
    sizes = [int(str(s._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for s in sources]
    size = sum(x for x in sizes if x < UNKNOWN_BYTES)
    return max(int(sources[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def follow_sources(*sources: DataFrame) -> None:
    """Let the session's shuffles start with as many partitions as ``sources`` make buckets, and adaptive execution merge those that stay
    small up to the size of a bucket: a partition, and the memory of the task that joins, sorts or groups it, keeps its size when the tables
    grow. The number is only raised; what the operator has named is left alone."""
    spark = sources[0].sparkSession
    n, now = bucket_count(*sources), spark.conf.get(INITIAL, None)
    if now == spark.conf.get(_OURS, None) and n > int(now or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(INITIAL, n)
        spark.conf.set(_OURS, n)
        if spark.conf.get(ADVISORY, None) is None:
            spark.conf.set(ADVISORY, BUCKET_BYTES)


def write_bucketed(df: DataFrame, key: str, buckets: int | None = None, uneven_bytes: int = UNEVEN_BYTES, dealt: bool = False) -> DataFrame:
    """``df`` written once, bucketed and sorted by ``key``, and read back (module docstring). ``dealt``: its rows are in ``buckets``
    partitions by ``key`` already."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"ledgerline_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    (df if dealt else df.repartition(n, key)).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    at, fs = _hadoop(spark, path)
    fs.deleteOnExit(at)
    sizes = bucket_bytes(spark, path)
    if sizes and max(sizes) > max(uneven_bytes, UNEVEN * sum(sizes) / n):
        return spark.read.schema(df.schema).parquet(path)
    return spark.table(name)


def shared_view(t: Tables, name: str, key: str, build: Callable[[], DataFrame], buckets: int | None = None, dealt: bool = False) -> DataFrame:
    """The view ``name`` of these tables, bucketed by ``key``; built and written on first use."""
    mark = _MARK + name
    if mark not in t:
        t[mark] = write_bucketed(build(), key, buckets, dealt=dealt)
    return t[mark]


def has_view(t: Tables, name: str) -> bool:
    return _MARK + name in t


def forget(t: Tables) -> None:
    """Drop the views and the opened tables: the next use lists and reads the sources anew."""
    t.clear()
