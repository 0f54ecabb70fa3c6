"""Groups of records that links join."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """df, worked out once and written to the folder of spark.checkpoint.dir, or to the context's; one machine alone may do with a temporary one."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="spark-tidemark-"))
    return df.checkpoint()


def connected(edges: DataFrame) -> DataFrame:
    """id, root for edges (left_id, right_id): each round every record takes the least label around it, and that label's own label."""
    both = edges.select(F.col("left_id").alias("id"), F.col("right_id").alias("other")).union(edges.select("right_id", "left_id")).distinct()
    both = kept(both)
    labels = kept(both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("root").alias("near"))
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("jump"))
        after = kept(labels.join(near, "id").join(jump, "root").select("id", F.least("root", "near", "jump").alias("root"), (F.least("near", "jump") < F.col("root")).alias("moved")))
        labels = after.select("id", "root")
        if not after.filter("moved").limit(1).count():
            return labels
