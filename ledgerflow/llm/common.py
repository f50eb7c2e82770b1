"""What the operators of this subpackage share: durable tables, Arrow helpers, hashing.

Intermediate results that are read more than once are written as Parquet below
``spark.checkpoint.dir``, the folder all executors share. That cuts lineage and
survives the loss of any executor.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch handed to Python. Spark's own bound of 64 MB costs a worker some 200 MB more.
BATCH_BYTES = 4 << 20
#: UTF-8 bytes that one step of a Python operator works on, long single texts aside.
CHUNK_BYTES = 2 << 20

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a session on a ``local`` master may leave it unset; it then gets a
    temporary folder. On a cluster an unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="ledgerflow-")
    return _local_dirs[app]


class Workspace:
    """Parquet tables of one operator call below the shared folder."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._paths: dict[int, str] = {}
        self._next = 0

    def path(self, name: str) -> str:
        self._next += 1
        return f"{self.root}/{self._next:03d}-{name}"

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``df`` and return the table read back."""
        path = self.path(name)
        df.write.options(**options).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = path
        return back

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        path = self._paths.pop(id(df), None)
        if path:
            jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes. A batch's bound is read when a plan runs, so there is no narrower place for it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's bytes, from file sizes; nothing is read. 0 where it has none (rows from the driver)."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 60 else 0


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as the cluster has cores.

    Only a plan of plain scans is looked at (its partitions follow from file sizes, nothing runs). Large inputs have more
    partitions than cores and pass untouched; a small file of one row group would otherwise be one task of a costly Python step.
    Batches for that step are bounded (see bound_batches).
    """
    bound_batches(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString() or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id (as long) and the text (null: empty), under fixed names."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def by_bytes(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about equal bytes in ``column``; no row is split or dropped."""
    ends = np.cumsum([0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()], dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and where each row begins and ends in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, ends - (ends[0] if len(ends) else 0)
