"""Counts, audits and gates over record tables; one aggregate a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def counted(df: DataFrame, seen: Observation | None = None, *metrics: Column) -> DataFrame:
    """df, whose rows Spark counts on its way (`records` and the metrics, to be read from `seen` after an action that reads them once, such as a write).

    Filters set on the result stay behind it: long expressions of a chain of columns are not copied into them.
    """
    return df.observe(seen or Observation(), F.count(F.lit(1)).alias("records"), *metrics)


def counts(df: DataFrame, by: str, missing: str = "unknown") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(by), F.lit(missing)).alias(by)).agg(F.count("*").alias("n"))


def completeness(df: DataFrame, by: str, tests: dict[str, Column]) -> DataFrame:
    """by, field, populated, missing, total: one pass for all fields, then a row each."""
    wide = df.groupBy(by).agg(F.count("*").alias("total"), *(F.count_if(t).alias(n) for n, t in tests.items()))
    return wide.select(by, "total", F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).alias("populated")) for n in tests))).alias("f")).select(by, "f.field", "f.populated", (F.col("total") - F.col("f.populated")).alias("missing"), "total")


def quality_summary(df: DataFrame, by: str, low: int = 40) -> DataFrame:
    """Per source and in all (`*`): records, average score, low ones, ready ones."""
    return df.rollup(by).agg(F.grouping(by).alias("all"), F.count("*").alias("n"), F.round(F.avg("quality_score"), 1).alias("avg_score"), F.count_if(F.col("quality_score") < low).alias("low"), F.count_if("matching_ready").alias("ready")).withColumn(by, F.when(F.col("all") == 1, "*").otherwise(F.col(by))).drop("all")


def gate(df: DataFrame, by: str, approved: Column, required: int, names: DataFrame) -> DataFrame:
    """Per name: approved, total and whether enough are approved; a name without records fails."""
    own = df.groupBy(by).agg(F.count_if(approved).alias("approved"), F.count("*").alias("total"))
    return names.join(own, by, "left").select(by, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("approved", "total"))).withColumn("passed", F.col("approved") >= required)


def samples(df: DataFrame, by: str, order: list, k: int = 3) -> DataFrame:
    """The first k rows of each source."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("n") <= k)


def search(df: DataFrame, text: str | None = None, fields: tuple[str, ...] = ("title", "summary"), status: str | None = None, topic: str | None = None) -> DataFrame:
    """The rows in which a field has the text, with the status and the topic, whatever the case; all tests come before any limit."""
    if text:
        df = df.filter(F.exists(F.array(*fields), lambda f: F.coalesce(F.contains(F.lower(f), F.lit(text.lower())), F.lit(False))))
    if status:
        df = df.filter(F.col("status") == status)
    if topic:
        df = df.filter(F.exists("topics", lambda t: F.lower(t) == topic.lower()))
    return df


def run_summary(rows: DataFrame, status: str, failed: list[str], skipped: list[str], order: str, error: Column, kept: int = 20) -> DataFrame:
    """One row of a run's ledger: processed, failed, skipped, its status and the first `kept` errors in order.

    A run without failures is a success, one with only failures failed, any other partial; an empty one is a success.
    """
    own = rows.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col(status).isin(failed)).alias("failed"), F.count_if(F.col(status).isin(skipped)).alias("skipped"))
    first = rows.filter(F.col(status).isin(failed)).orderBy(order).limit(kept).select(F.col(order).alias("place"), error.alias("error"))
    both = own.unionByName(first, allowMissingColumns=True).groupBy().agg(
        *(F.max(c).alias(c) for c in ("processed", "failed", "skipped")), F.transform(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "error")))), lambda e: e["error"]).alias("errors"),
    )
    return both.withColumn("status", F.when(F.col("failed") == 0, "success").when(F.col("failed") == F.col("processed"), "failed").otherwise("partial"))
