"""What the operators share: durable intermediates, batch helpers, row ids."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and the
    master is local, as in tests on one machine, a temporary folder stands in.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    if not getattr(shared_folder, "local", None):
        shared_folder.local = tempfile.mkdtemp(prefix="driftline-")
    return f"file://{shared_folder.local}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours; without a session nothing happens."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: nothing is left to ask
        pass


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a read, never a recomputation,
    and nondeterministic row ids become fixed. The table goes when the driver's
    Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/driftline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(removed, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column | str) -> Column:
    """Number of words of a text (null: 0), as long."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def text_batches(df: DataFrame) -> DataFrame:
    """``df``, to be handed to Python in batches that fit beside it in an executor.

    Spark's default of 10,000 rows is meant for narrow rows. Whole texts come
    by a thousand rows and 8 MB at most. These are settings of the session.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)
    return df


def _give_back() -> None:
    """Return freed memory to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        total = pc.cumulative_sum(size.cast(pa.int64())).to_numpy()
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(total.searchsorted(base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    _give_back()


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names that clash with none of ``taken`` (compared without case)."""
    low, out = {x.lower() for x in taken}, []
    for n in names:
        while n.lower() in low:
            n += "_"
        low.add(n.lower())
        out.append(n)
    return out
