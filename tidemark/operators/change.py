"""Upserts, inserts and incremental actions on record tables, as new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def without(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key the other lacks; null is a value of a key like any other."""
    theirs = other.select(*(F.col(k).alias(f"__other_{k}") for k in keys)).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__other_{k}")) for k in keys]
    return df.join(theirs, same, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new in place of old rows with the same key (null equals null); both have the same columns and a key once."""
    return without(old, new, keys).unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those of new whose key it lacks (null equals null), each key once."""
    return old.unionByName(without(new.dropDuplicates(keys), old, keys))


def identify(items: DataFrame, known: DataFrame, keys: list[str], found: str = "id") -> DataFrame:
    """items with `found` of the known row that agrees on the first of the keys that any does: an equi-join a key."""
    out = items
    for k, key in enumerate(keys):
        one = known.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(found).alias(f"__{k}"))
        out = out.join(one, key, "left")
    return out.withColumn(found, F.coalesce(*(f"__{k}" for k in range(len(keys))))).drop(*(f"__{k}" for k in range(len(keys))))


def due_for_refresh(df: DataFrame, as_of: str, with_deadline: int = 7, without: int = 14) -> DataFrame:
    """Open records with a deadline after 7 days, open or unknown ones without after 14; in no order."""
    now = F.lit(as_of).cast("timestamp")
    due = ((F.col("status") == "open") & F.col("deadline").isNotNull() & (F.col("updated_at") <= now - F.expr(f"INTERVAL {with_deadline} DAYS"))) | (F.coalesce("status", F.lit("unknown")).isin("open", "unknown") & F.col("deadline").isNull() & (F.col("updated_at") <= now - F.expr(f"INTERVAL {without} DAYS")))
    return df.filter(due)


def actions(batch: DataFrame, state: DataFrame, due: DataFrame, key: str) -> DataFrame:
    """key, action: fetch_new, skip or refresh for the batch, and refresh for what is due but not in it."""
    marked = batch.select(key).distinct().join(state.select(key, F.lit(True).alias("known")).distinct(), key, "left").join(due.select(key, F.lit(True).alias("due")).distinct(), key, "left")
    listed = marked.select(key, F.when(F.col("known").isNull(), "fetch_new").when(F.col("due"), "refresh").otherwise("skip").alias("action"))
    return listed.unionByName(due.select(key).distinct().join(batch.select(key), key, "left_anti").withColumn("action", F.lit("refresh")))


def merge_items(state: DataFrame, drafts: DataFrame, as_of: str, keys: list[str], metadata: str = "metadata") -> DataFrame:
    """The state of listed items after a batch of drafts: known ones take the drafts' values, new ones are added.

    state has id, source, the keys, `metadata` (a map), discovery_status, detail_status, first_seen_at and last_seen_at besides
    other columns of drafts. A draft is known by the first of the keys that agrees within its source. Of drafts of one
    item, the one with the least `position` counts. Metadata is merged, the new values win; an item's first_seen_at and
    detail_status stay.
    """
    now = F.lit(as_of).cast("timestamp")
    found = drafts
    for k, key in enumerate(keys):
        one = state.filter(F.col(key).isNotNull()).groupBy("source", key).agg(F.min("id").alias(f"__{k}"))
        found = found.join(one, ["source", key], "left")
    found = found.withColumn("__known", F.coalesce(*(f"__{k}" for k in range(len(keys)))))
    identity = F.coalesce(F.concat(F.lit("i:"), F.col("__known").cast("string")), *(F.concat(F.lit(f"{k}:"), F.col(k)) for k in keys))
    found = latest(found.withColumn("__identity", identity), ["source", "__identity"], [F.asc_nulls_last("position"), *(F.asc_nulls_last(k) for k in keys)])
    taken = [c for c in drafts.columns if c in state.columns and c not in ("id", "source", metadata)]
    both = state.join(found.select(F.col("__known").alias("id"), "source", *(F.col(c).alias(f"__new_{c}") for c in [*taken, metadata]), F.lit(True).alias("__seen")), ["id", "source"], "left")
    merged_map = lambda old, new: F.map_from_entries(F.concat(F.map_entries(F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.coalesce(F.map_contains_key(F.coalesce(new, F.create_map().cast("map<string,string>")), k), F.lit(False)))), F.map_entries(F.coalesce(new, F.create_map().cast("map<string,string>")))))
    seen = F.coalesce("__seen", F.lit(False))
    known = both.select(
        *(F.when(seen, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in taken
          else F.when(seen, merged_map(F.col(metadata), F.col(f"__new_{metadata}"))).otherwise(F.col(metadata)).alias(metadata) if c == metadata
          else F.when(seen, "known").otherwise(F.col(c)).alias(c) if c == "discovery_status"
          else F.when(seen, now).otherwise(F.col(c)).alias(c) if c == "last_seen_at" else F.col(c) for c in state.columns)
    )
    fresh = found.filter("__known is null")
    own = {"id": F.xxhash64("source", "__identity").cast(dict(state.dtypes)["id"]), "discovery_status": F.lit("new"), "detail_status": F.lit("not_fetched"), "first_seen_at": now, "last_seen_at": now}
    added = fresh.select(*(own[c].alias(c) if c in own else F.col(c) if c in drafts.columns else F.lit(None).cast(t).alias(c) for c, t in state.dtypes))
    return known.unionByName(added)


def mark_details(state: DataFrame, marks: DataFrame) -> DataFrame:
    """state with the detail_status that marks (id, detail_status) give."""
    given = marks.groupBy("id").agg(F.max("detail_status").alias("__given"))
    return state.join(given, "id", "left").withColumn("detail_status", F.coalesce("__given", "detail_status")).select(*state.columns)


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the least by the order's columns, nulls last: partly aggregated before the shuffle, no sort."""
    place = F.struct(*(c for name in order for c in (F.col(name).isNull().alias(f"no_{name}"), F.col(name))))
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), place).alias("__row")).select(*keys, "__row.*")


def put_records(known: DataFrame, new: DataFrame) -> DataFrame:
    """new rows with the `id` to store them under and `change`, created or updated: known by the record id within a source first, else by the address.

    known has id, source, record_id and url, new the last three. Of new rows of one record, the one with the least `position`
    counts if new has that column, then the least by address, record id and all the rest as text.
    """
    by = lambda key, name: known.filter(F.col(key).isNotNull()).groupBy("source", key).agg(F.min("id").alias(name))
    found = new.join(by("record_id", "__by_record"), ["source", "record_id"], "left").join(by("url", "__by_url"), ["source", "url"], "left")
    found = found.withColumn("__known", F.coalesce("__by_record", "__by_url")).withColumn("__identity", F.coalesce(F.col("__known").cast("string"), F.concat(F.lit("r:"), "record_id"), F.concat(F.lit("u:"), "url")))
    found = found.withColumn("__rest", F.to_json(F.struct(*new.columns)))
    one = first_of(found, ["source", "__identity"], [*(["position"] if "position" in new.columns else []), "url", "record_id", "__rest"])
    made = F.coalesce(F.col("__known"), F.xxhash64("source", "__identity").cast(dict(known.dtypes)["id"])).alias("id")
    return one.select(made, *(c for c in new.columns if c != "id"), F.when(F.col("__known").isNull(), "created").otherwise("updated").alias("change"))


def merge_records(old: DataFrame, new: DataFrame) -> DataFrame:
    """old after an upsert of new by identity (put_records); `change` says created, updated or kept. An updated record keeps its id."""
    put = put_records(old, new).select("id", *(c for c in old.columns if c != "id"), "change")
    return without(old, put, ["id"]).withColumn("change", F.lit("kept")).unionByName(put)
