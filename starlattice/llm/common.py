"""What the operators of this subpackage share: reading, durable intermediate tables, Arrow batch sizes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000, nbytes: int = 16 << 20) -> None:
    """Bound what one Arrow batch holds, as whole texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    with contextlib.suppress(Exception):  # older releases lack the byte bound
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(nbytes))


#: What operators keep in a reused Python worker between tasks, by operator.
_memories: dict[str, dict] = {}


def worker_memory(owner: str, store: dict) -> dict:
    """Register what an operator keeps in a worker."""
    return _memories.setdefault(owner, store)


def owns_worker(owner: str) -> None:
    """At the start of a task: empty what other operators left in this worker, and give freed pages back."""
    left = [m for name, m in _memories.items() if name != owner and m]
    for memory in left:
        memory.clear()
    if left:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # only where the C library is glibc
            ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one under the warehouse (local masters: a temporary one)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local"):
            found = "file://" + os.path.join(tempfile.gettempdir(), "starlattice-checkpoints")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_starlattice"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(stored: DataFrame) -> None:
    """Delete the files of a :func:`durable` table that nothing reads any more."""
    jvm = stored.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(stored.stored_at)
    path.getFileSystem(stored.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def row_key(doc_id: Column, text: Column) -> Column:
    """The id, or where it is null a negative key made from the text."""
    return F.coalesce(doc_id.cast("long"), -F.lit(1) - F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 1))


#: A key is hot if it holds more than one in HOT of all rows; there are HOT such keys at most.
HOT = 10_000


def hand_back(rows: DataFrame, found: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``found`` (one row a key, whose column ``weight`` counts the key's rows of ``total``).

    Rows of hot keys meet a broadcast of at most HOT keys where they lie, so that no task gets all of a key's rows; the
    rest is joined by shuffle. Both tables are read twice and should be stored.
    """
    hot = found.filter(F.col(weight) * HOT > F.lit(total))
    cold = found.filter(F.col(weight) * HOT <= F.lit(total))
    # A small table has few keys: then every key is hot, and nothing is left for the shuffle.
    spread = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return spread.unionByName(rest)
