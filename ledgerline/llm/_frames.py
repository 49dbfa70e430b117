"""Small DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAST_ID = (1 << 63) - 1
BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a scratch folder; any other session is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="ledgerline-shared-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage, and what was written survives the loss of any executor. The files go when
    the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/ledgerline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def partitions_for(df: DataFrame, text_col: str, target: int) -> int:
    """Shuffle partitions such that about ``target`` bytes of text stand behind each, at least the session's number."""
    size = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(shuffle_partitions(df.sparkSession), -(-size // target))


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` from here on, unless the session has a smaller bound: what a Python task holds
    at once then follows neither the rows nor the length of the texts (one text is the least)."""
    if int(spark.conf.get(_BATCH_KEY).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, f"{BATCH_BYTES}b")


def text_of(df: DataFrame, col: str) -> Column:
    """The text column as a string, to be handed to a Python function in bounded batches."""
    bounded_batches(df.sparkSession)
    return F.col(col).cast("string")


def order_id(col: str) -> Column:
    """Document id as a never-null sort key: null ids come last."""
    return F.coalesce(F.col(col).cast("long"), F.lit(LAST_ID))


def text_key(col: str) -> Column:
    """64 bits of the text, to tell rows apart that share a document id (all rows without one do)."""
    return F.xxhash64(F.col(col))


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or the first ``wish_N`` that no column of ``df`` has (ignoring case)."""
    taken = {c.lower() for c in df.columns}
    names = [wish, *(f"{wish}_{i}" for i in range(1, len(taken) + 2))]
    return next(n for n in names if n.lower() not in taken)
