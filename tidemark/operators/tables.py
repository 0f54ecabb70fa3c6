"""Tables on disk whose writes touch only what changes: rows lie in buckets by a hash of their key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.change import insert_missing, upsert, without

BUCKET = "__bucket"


class Keyed:
    """A Parquet table in `buckets` folders by a hash of `keys`; null is a value of a key like any other.

    A write reads and rewrites the buckets that its rows fall into, and no others; rows that are only added rewrite none.
    Spark puts new files of a bucket in place of the old ones when the whole write is done, so one that fails changes
    nothing. Several writers of one table at once are not for this class. Choose buckets of some 100 MB; a bucket is
    written by one task for each of `rows` rows of it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 256, rows: int = 2_000_000):
        self.spark, self.path, self.schema, self.keys, self.buckets, self.rows = spark, path, schema, keys, buckets, rows

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, touched: list[int] | None = None) -> DataFrame:
        """The table, or the rows of some buckets, whose folders alone are then read."""
        if not self._exists():
            return self.spark.createDataFrame([], self.schema)
        df = self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(self.path)
        return (df if touched is None else df.filter(F.col(BUCKET).isin(touched))).drop(BUCKET)

    def _write(self, df: DataFrame, mode: str, n: int) -> None:
        per_bucket = max(1, -(-n // (self.rows * self.buckets)))
        placed = df.select(*self.read().columns).withColumn(BUCKET, self.bucket())
        dealt = placed.repartition(BUCKET) if per_bucket == 1 else placed.repartition(BUCKET, F.pmod(F.xxhash64(*df.columns), F.lit(per_bucket)))
        dealt.write.partitionBy(BUCKET).mode(mode).option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def put(self, new: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """The buckets of new rows become merged(old rows of these buckets, new); merged keeps each row's key. Returns the buckets."""
        touched = sorted(r[0] for r in new.select(self.bucket().alias("b")).distinct().collect())
        if touched:
            old = self.read(touched)
            self._write(merged(old, new), "overwrite", new.count())
        return touched

    def upsert(self, new: DataFrame) -> list[int]:
        """new rows in place of old ones of their key; new has a key once."""
        return self.put(new, lambda old, rows: upsert(old, rows.select(*old.columns), self.keys))

    def insert_missing(self, new: DataFrame) -> None:
        """Adds the new rows whose key the table lacks, each key once, as further files; nothing is rewritten."""
        touched = sorted(r[0] for r in new.select(self.bucket().alias("b")).distinct().collect())
        if touched:
            once = new.dropDuplicates(self.keys)
            self._write(without(once, self.read(touched), self.keys), "append", once.count())

    def compact(self) -> None:
        """Each bucket in one file again, after many additions."""
        everything = list(range(self.buckets))
        old = self.read(everything)
        self._write(insert_missing(old.limit(0), old, self.keys), "overwrite", old.count())
