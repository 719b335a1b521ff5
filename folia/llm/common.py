"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of an Arrow batch that are Python objects at a time.
SLICE_ROWS = 512
_NULLABLE = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. A session of one machine without it gets a
    folder of its own in the warehouse; any other session without it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage with a table that outlives any executor: a lost executor
    costs a re-read of shared files, never a recomputation of what came before.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    with writing(df.sparkSession):
        df.write.parquet(path)
    if _due and time.monotonic() >= _due[-1]:
        give_back(df.sparkSession)
        _due[-1] = time.monotonic() + GIVE_BACK_S
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


#: Settings while an intermediate table is written: the shuffle files go with the execution, as only the
#: table is read later (else they stay until the driver happens to collect its garbage), and Arrow batches are small.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16777216"}


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """``WRITING`` holds inside, as far as the engine knows these settings."""
    before = {}
    for k, v in WRITING.items():
        try:
            before[k] = spark.conf.get(k)
            spark.conf.set(k, v)
        except PySparkException:
            before.pop(k, None)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: Seconds between two returns of memory inside ``giving_back``.
GIVE_BACK_S = 20
_due: list[float] = []


def give_back(spark: SparkSession) -> None:
    """Executors and their Python workers return the memory that is free to the machine.

    A heap that has grown for one table stays as large while the next ones need little; a full
    collection shrinks it to a few times what is in use. No data is touched. There is a task for
    each core, so that idle executors get theirs."""

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass

    many = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, many, 1, many).mapInArrow(trim, "id long").selectExpr("id", "reflect('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


@contextmanager
def giving_back(spark: SparkSession) -> Iterator[None]:
    """Memory is given back at the beginning, and then after a table is written, every ``GIVE_BACK_S`` seconds at most."""
    give_back(spark)
    _due.append(time.monotonic() + GIVE_BACK_S)
    try:
        yield
    finally:
        _due.pop()


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and whose every use has been written."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def map_slices(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], kind: str) -> DataFrame:
    """``df.mapInPandas(run, kind)``, but a worker holds the Python objects of ``SLICE_ROWS`` rows at a
    time instead of a whole batch, and whole numbers stay whole beside nulls."""
    schema = to_arrow_schema(StructType.fromDDL(kind))

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (b.slice(a, SLICE_ROWS).to_pandas(types_mapper=_NULLABLE.get) for b in batches for a in range(0, b.num_rows, SLICE_ROWS))
        for out in run(slices):
            if len(out):
                yield pa.RecordBatch.from_pandas(out, schema=schema, preserve_index=False)

    return df.mapInArrow(arrow, kind)


def keep_texts(docs: DataFrame, wanted: Callable[[str | None], bool]) -> DataFrame:
    """The rows whose text is ``wanted``, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            yield b.filter(pa.array([wanted(t.as_py()) for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
