"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch where a row may hold a whole document, so that a batch stays far below a worker's memory.
TEXT_BATCH_ROWS = 256

_written: list[tuple[SparkSession, str]] = []
_hooked: list[bool] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session takes a
    temporary one; on a cluster, whose machines share none, that is an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all machines share")
        at = f"file://{tempfile.gettempdir()}/tidemark-checkpoints"
    return qualified(spark, at).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark reads it by."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return str(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the session's process ends, or by release()."""
    path = f"{shared_dir(spark)}/tidemark-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    if not _hooked:
        atexit.register(_clean)
        _hooked.append(True)
    _written.append((spark, path))
    return path


def mark() -> int:
    """Where release() may begin."""
    return len(_written)


def release(begin: int, keep: DataFrame | None = None) -> None:
    """Remove the tables written since a mark, but for the one that `keep` reads: for when nothing will read them again."""
    kept = {str(f).rsplit("/", 1)[0].removeprefix("file:").lstrip("/") for f in (keep.inputFiles() if keep is not None else [])}
    left = [(s, p) for s, p in _written[begin:] if p.removeprefix("file:").lstrip("/") in kept]
    for spark, path in _written[begin:]:
        if (spark, path) not in left:
            _remove(spark, path)
    _written[begin:] = left


def _remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended already: its folder is the cluster's to clear
            continue


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors, and is computed once."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The number of partitions that this session shuffles to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def long_rows(spark: SparkSession) -> None:
    """Keep Arrow batches of whole documents small; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > TEXT_BATCH_ROWS:
        spark.conf.set(key, TEXT_BATCH_ROWS)


def texts_of(column: pa.Array) -> Iterator[str]:
    """The strings of a column, one at a time; null counts as empty."""
    for x in column:
        yield x.as_py() or ""


def bytes_of(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, one at a time; null counts as empty."""
    for x in column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column:
        yield x.as_py() or b""


#: Ids that may be broadcast; beyond it, joins shuffle.
BROADCAST_IDS = 500_000


def semi_join(df: DataFrame, ids: DataFrame, on: str, anti: bool = False) -> DataFrame:
    """The rows of df whose `on` (a long) is among ids (or is not, with anti). ids are counted first: few are broadcast."""
    ids = materialize(ids.select(on).distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, on, "left_anti" if anti else "left_semi")


#: What this process remembers between tasks, with the operator that does; and the operator whose task came last.
_remembered: list[tuple[str, dict]] = []
_serving: list[str] = []


def remember(operator: str, store: dict) -> None:
    """Let serve() clear a store of the process when another operator's task comes."""
    _remembered.append((operator, store))


def serve(operator: str) -> None:
    """Called by a task before its first row. Python workers serve one operator after another: when another one comes, what
    those before it remember is cleared, and freed memory goes back to the system instead of adding up."""
    if _serving == [operator]:
        return
    _serving[:] = [operator]
    for owner, store in _remembered:
        if owner != operator:
            store.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)
