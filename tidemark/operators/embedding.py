"""Hash embeddings of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hash_embedding(df: DataFrame, text: str = "text", key: str = "id", size: int = 64) -> DataFrame:
    """key, place, value: the sparse unit vector of each text.

    A word of two or more letters or digits adds a sign at a place, both read from its SHA-256.
    """
    word = F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-zа-яіїєґ0-9]{2,}"), F.lit(0)))
    digest = F.sha2(F.col("word").cast("binary"), 256)
    place = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % size).cast("int")
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    sums = df.select(key, word.alias("word")).groupBy(key, "word").agg(F.count("*").alias("n")).select(key, place.alias("place"), (sign * F.col("n")).alias("n")).groupBy(key, "place").agg(F.sum("n").alias("n")).filter("n <> 0")
    return sums.withColumn("value", F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))).drop("n")
