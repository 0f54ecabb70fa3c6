"""Record tables in the operators' columns, from the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WANTED = [["ring", "blue"], ["bolt", "red", "small"], ["gear", "hot", "large"], ["widget", "cold"]]
UNWANTED = [["old"], ["plate"], ["new"], ["anvil"]]


#: Bytes of an Arrow batch between Spark and a task's Python, where the session has Spark's own 64 MB.
BATCH_BYTES = 3 << 20


def small_batches(spark: SparkSession) -> None:
    """Whole texts and pages go to Python in batches of so many bytes, however large the partition is: each Python step of a task holds its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it comes in fewer partitions, such as one small file, for long work on each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("id"), F.col("p_name").alias("title"), F.split("p_name", " ").alias("topics"), F.col("p_brand").alias("funder"), F.lower("p_type").alias("support_type"),
        F.col("p_retailprice").cast("decimal(14,2)").alias("amount_max"), F.date_add(F.lit("1998-01-01").cast("date"), F.col("p_size")).alias("deadline"), F.concat(F.lit("src"), (key % 5).cast("string")).alias("source"),
        F.when(key % 7 == 0, "closed").when(key % 11 != 0, "open").alias("status"), F.when(key % 3 != 0, F.concat_ws(" ", "p_name", "p_type")).alias("summary"),
        F.concat(F.lit("https://example.org/"), (key % 500).cast("string")).alias("source_url"), F.lit(None).cast("string").alias("program"), F.when(key % 2 == 0, "EUR").alias("currency"),
    )


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as clients."""
    lists = lambda values: F.element_at(F.array(*(F.array(*map(F.lit, v)) for v in values)), (F.col("c_custkey") % 4 + 1).cast("int"))
    nation = table(spark, sf_dir, "nation")
    return (
        table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_custkey").alias("client_key"), F.col("c_name").alias("client"), F.col("c_mktsegment").alias("sector"), F.col("n_name").alias("country"), lists(WANTED).alias("wanted"), lists(UNWANTED).alias("unwanted"))
    )


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the part of their first line."""
    first = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p"))
    return table(spark, sf_dir, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "part"), F.col("p") == F.col("p_partkey"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """client_key, topics, weight: a row for each application."""
    return _applied(spark, sf_dir).select(F.col("o_custkey").alias("client_key"), F.split("p_name", " ").alias("topics"), F.when(F.col("o_orderstatus") == "F", 120).otherwise(100).alias("weight"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("source"), F.col("event_type").alias("status"), F.col("ts").alias("started_at"), F.col("value").alias("processed"), F.get_json_object("props", "$.k").cast("int").alias("counter"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").withColumnRenamed("doc_id", "id")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opportunities with the fields that the contract and the gates read."""
    key = F.col("id")
    texts = lambda values: F.element_at(F.array(*(F.array(*map(F.lit, v)).cast("array<string>") for v in values)), (key % len(values) + 1).cast("int"))
    suffix = F.when(key % 17 == 0, " award fund").when(key % 17 == 1, " training course").when(key % 17 == 2, " digest ").otherwise("")
    return opportunities(spark, sf_dir).withColumns({
        "title": F.concat("title", suffix), "description": F.when(key % 23 == 0, "For civil society only"), "applicant_types": texts([["SME", "company"], ["NGO"], [], ["startup"]]),
        "countries": F.when(key % 3 == 0, F.array(F.concat(F.lit("NATION_"), (key % 25).cast("string")))).when(key % 3 == 1, F.array(F.lit("EU"))).otherwise(F.array().cast("array<string>")),
        "restrictions": F.when(key % 13 == 0, "A company is not eligible").when(key % 13 == 1, "Деякі не можуть"), "confidence": (F.lit(0.5) + (key % 5) * 0.1).cast("decimal(5,4)"),
        "quality_score": (key % 100).cast("int"), "amount_text": F.when(key % 2 == 0, "EUR 5 000"), "is_duplicate": key % 19 == 0, "primary_id": F.when(key % 19 == 0, key + 1),
    })


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients with the fields that the gates read."""
    key = F.col("client_key")
    pick = lambda values, n: F.element_at(F.array(*values), (key / 10 % n + 1).cast("int"))
    return clients(spark, sf_dir).withColumns({
        "organization_type": pick([F.lit("NGO"), F.lit("startup"), F.lit("small business"), F.lit("LLC company"), F.lit(None).cast("string")], 5), "product": F.lit(None).cast("string"),
        "technologies": pick([F.array(F.lit("Economy"), F.lit("ear")), F.array(F.lit("promo")), F.array().cast("array<string>")], 3), "sector": F.when(key % 60 == 0, "Standard").otherwise(F.col("sector")),
    })


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of the clients' applications, with the fields that the gates read; the latest has the least `order`."""
    return _applied(spark, sf_dir).select(
        F.col("o_custkey").alias("client_key"), F.struct((-F.unix_date(F.col("o_orderdate").cast("date"))).alias("d"), (-F.col("o_orderkey")).alias("k")).alias("order"),
        F.col("p_name").alias("title"), F.lit(None).cast("string").alias("program"), F.lit(None).cast("string").alias("source"), F.col("o_orderstatus").alias("result"),
        F.split("p_name", " ").alias("topics"), F.when(F.col("o_orderkey") % 2 == 0, "sme").alias("applicant_type"), (F.col("o_orderkey") % 4 == 0).alias("reusable"), F.when(F.col("o_orderstatus") == "F", 120).otherwise(100).alias("weight"),
    )


def named_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records whose names differ by their numbers; each fiftieth repeats the one before it."""
    key = F.col("c_custkey")
    of = F.when(key % 50 == 49, key - 1).otherwise(key)
    return spread(table(spark, sf_dir, "customer")).select(
        key.alias("id"), F.concat(F.lit("Regional Innovation Fund "), F.conv((of * 7919 + 104729).cast("string"), 10, 36), F.lit(" for "), F.lower("c_mktsegment")).alias("title"), F.concat(F.lit("https://Example.org/"), of.cast("string"), F.lit("/?utm_source=x")).alias("source_url"),
        F.col("c_mktsegment").alias("funder"), F.date_add(F.lit("1998-01-01").cast("date"), (of % 900).cast("int")).alias("deadline"), F.lit(None).cast("string").alias("program"), F.col("c_acctbal").cast("decimal(14,2)").alias("amount_max"), F.lit("EUR").alias("currency"), F.array(F.lower("c_mktsegment")).alias("topics"),
    )
