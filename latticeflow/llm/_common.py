"""What the operators of this subpackage share: the shared folder, written intermediate tables, Arrow helpers.

Intermediate tables go to the folder that the cluster names in ``spark.checkpoint.dir``; the driver and all
executors reach it, so a lost executor costs a re-read and nothing more. A folder of our own is made only
in local mode without that setting, as in tests; a cluster without a shared folder is refused.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

_OWN: dict[str, str] = {}
_OPENED: list[list[Scratch]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="latticeflow-")
    return _OWN[app]


class Scratch:
    """Tables written by one call of an operator, under one folder of the shared directory.

    ``put`` writes a frame and reads it back, which cuts its lineage; ``drop`` deletes a table that nothing
    reads any more. What is left goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/latticeflow/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)  # only what exists can be marked
        files.deleteOnExit(path)
        for own in _OPENED:
            own.append(self)

    def put(self, df: DataFrame, table: str, by: str | None = None) -> DataFrame:
        """``df`` as it was written; with ``by``, a folder for each value of that column."""
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.root}/{table}")
        return self.get(table, df.schema)

    def get(self, table: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")

    def close(self) -> None:
        """Deletes all tables, which nothing may read any more."""
        self._delete(self.root)

    def drop(self, *tables: str) -> None:
        for table in tables:
            self._delete(f"{self.root}/{table}")

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def opened() -> Iterator[list[Scratch]]:
    """The scratch folders that are opened meanwhile."""
    own: list[Scratch] = []
    _OPENED.append(own)
    try:
        yield own
    finally:
        _OPENED[:] = [x for x in _OPENED if x is not own]


def struct_of(schema: StructType | str) -> StructType:
    return _parse_datatype_string(schema) if isinstance(schema, str) else schema


#: Bytes that the JVM hands to a worker at once, and of which a worker takes a part at a time.
BATCH_BYTES, PART_BYTES = 8 << 20, 4 << 20


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``mapInArrow`` in batches bounded in bytes, as texts may be long; a worker gives its free memory back after a task.

    Sets the session's ``spark.sql.execution.arrow.maxBytesPerBatch``.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(trimmed, schema)


def release() -> None:
    """Gives freed memory back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def map_rows(df: DataFrame, schema: StructType | str, make: Callable[[], Callable[[pa.RecordBatch], Iterable[dict]]], most: int = PART_BYTES) -> DataFrame:
    """``mapInArrow`` with a function of a record batch that returns columns.

    ``make`` runs once per task and returns the function, so that a worker's tables are built where they are
    used. A batch is cut into parts of about ``most`` bytes, so that memory is bounded whatever the row lengths are.
    """
    struct = struct_of(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in cut(batch, most):
                for columns in work(part):
                    yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], (pa.Array, pa.ChunkedArray)) else columns[f.name] for f in arrow], schema=arrow)

    return map_batches(df, run, struct)


def cut(batch: pa.RecordBatch, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes; a slice has one row at least."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * most / max(batch.nbytes, 1)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; a null is the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def documents(df: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` (as a long), ``text`` (as a string) and the columns of ``more``: no other column can clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
