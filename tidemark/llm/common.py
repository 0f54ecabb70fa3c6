"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch between Spark and a task's Python, where the session has Spark's own 64 MB.
BATCH_BYTES = 3 << 20


def small_batches(spark: SparkSession) -> None:
    """A batch of whole texts is held four times (on both sides, in and out), so its size decides over an executor's memory beside the heap."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the checkpoint folder set on the context; one machine alone may do with a temporary one."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-tidemark-"))
        root = context.getCheckpointDir()
    return root


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until df has no such column in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def saved(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/tidemark/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)).cast("int")


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 of a text column, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow(schema: str) -> pa.Schema:
    """The Arrow form of a DDL schema, for batches that tasks emit."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of counts, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def chunks(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Smaller slices, so that a task's Python holds few texts at once."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def by_bytes(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices with at most so many bytes of text, or of one row."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype="i8")
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield b.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()  # the worker serves other tasks after this one


class Marks:
    """A bit map of ids: tells that an id is not among them for certain, or that it may be, wrongly with a chance of ids / bits.

    It has some bits for each id, up to `most` bits in all (16 MB); with very many ids the test lets all pass, and the
    join that follows it does all the work.
    """

    def __init__(self, ids: DataFrame, column: str, bits: int | None = None, most: int = 1 << 27):
        if bits is None:
            bits = min(most, max(1 << 20, 1 << (16 * ids.count()).bit_length()))
        self.bits = bits
        set_bits = ids.select(self.place(column).alias("p")).selectExpr("p div 64 AS word", "shiftleft(1L, cast(p % 64 AS int)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
        table = np.zeros(bits // 64, "i8")
        table[set_bits.column("word").to_numpy()] = set_bits.column("bit").to_numpy()
        self.table = ids.sparkSession.sparkContext.broadcast(table)

    def place(self, column: str) -> Column:
        return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(self.bits))

    def may_have(self, column: str) -> Column:
        held = self.table

        @F.pandas_udf("boolean")
        def test(p: pd.Series) -> pd.Series:
            return pd.Series(marked(held.value, p.to_numpy()))

        return test(self.place(column))


def marked(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (table[places >> 6] >> (places & 63)) & 1 == 1
