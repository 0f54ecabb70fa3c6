"""Ordered reads, lists of matches, and the reports that are put together from them. Every order ends with a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.change import latest
from tidemark.operators.quality import present


def ordered(df: DataFrame, order: list[Column], limit: int | None = None, **equal) -> DataFrame:
    """The rows with the given values, in the order, `limit` at most; a value of None asks for nothing."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    df = df.orderBy(*order)
    return df if limit is None else df.limit(limit)


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), "run_id").limit(1).select("run_id")


def matches(found: DataFrame, runs: DataFrame, client: Column | None = None, least: int | None = None, latest_only: bool = True, limit: int = 100) -> DataFrame:
    """The best matches of the latest run, or of all: score, then time of update, both the greatest first."""
    if latest_only:
        found = found.join(F.broadcast(latest_run(runs)), "run_id", "left_semi")  # a row
    if client is not None:
        found = found.filter(client)
    if least is not None:
        found = found.filter(F.col("score") >= least)
    return found.orderBy(F.col("score").desc(), F.col("updated_at").desc(), "run_id", "id", "client_key").limit(limit)


def top_by_client(found: DataFrame, runs: DataFrame, k: int = 3, most: int = 500) -> DataFrame:
    """Of the first `most` matches of the latest run, the first k of each client, as `place`."""
    order = Window.partitionBy("client_key").orderBy(F.col("score").desc(), F.col("updated_at").desc(), "id")
    return matches(found, runs, limit=most).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def to_check(found: DataFrame, runs: DataFrame, limit: int = 20, most: int = 300) -> DataFrame:
    """Of the first `most` matches of the latest run, the first with checks for a person."""
    return ordered(matches(found, runs, limit=most).filter(F.size("checks") > 0), [F.col("score").desc(), F.col("updated_at").desc(), "id", "client_key"], limit)


def for_explanation(found: DataFrame, run: DataFrame, limit: int = 20) -> DataFrame:
    """A run's matches by rank, those without one last, then by score."""
    mine = found.join(F.broadcast(run.select("run_id").limit(1)), "run_id", "left_semi")
    return mine.orderBy(F.asc_nulls_last("rank"), F.col("score").desc(), "id", "client_key").limit(limit)


def with_names(found: DataFrame, records: DataFrame, sources: DataFrame, clients: DataFrame) -> DataFrame:
    """Matches with title and source of the record and the client's name; those whose record or client is gone drop out."""
    named = records.join(sources.select("source_id", F.col("slug").alias("source")), "source_id", "left").select("id", "title", "source")
    return found.join(named, "id").join(clients.select("client_key", "client"), "client_key")


def save_matches(old: DataFrame, new: DataFrame) -> DataFrame:
    """old after new ones are saved, one for each run, record and client; the last of new by `updated_at` counts."""
    keys = ["run_id", "id", "client_key"]
    one = latest(new, keys, [F.col("updated_at").desc(), F.col("score").desc()])
    return old.join(one.select(*keys), keys, "left_anti").unionByName(one)


def match_totals(found: DataFrame, saved: DataFrame, n_clients: DataFrame, n_records: DataFrame, least: int) -> DataFrame:
    """One row: pairs evaluated (all), saved, and filtered (by a gate or by the least score; pairs cut by rank alone are neither)."""
    own = found.agg(F.count_if(F.col("passed") & (F.col("score") >= least)).alias("fit"))
    both = own.crossJoin(saved.agg(F.count("*").alias("saved"))).crossJoin(n_clients.agg(F.count("*").alias("clients"))).crossJoin(n_records.agg(F.count("*").alias("records")))  # a row each
    return both.select((F.col("clients") * F.col("records")).alias("evaluated"), "saved", (F.col("clients") * F.col("records") - F.col("fit")).alias("filtered"))


def source_report(sources: DataFrame, items: DataFrame, records: DataFrame, jobs: DataFrame) -> DataFrame:
    """A row a source: its listed items by state, its records, and its latest job; zeros where it has none."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    listed = items.groupBy("source_id").agg(
        F.count("*").alias("discovered_total"), *(is_("discovery_status", s).alias(f"discovery_{s}") for s in ("new", "known", "failed")),
        *(is_("detail_status", s).alias(f"detail_{s}") for s in ("not_fetched", "fetched", "failed", "skipped_known")), F.max("last_seen_at").alias("last_seen_at"),
    )
    own = records.groupBy("source_id").agg(F.count("*").alias("records_total"), is_("status", "open").alias("records_open"), is_("status", "unknown").alias("records_unknown"), F.count_if("needs_manual_review").alias("records_manual_review"))
    counters = ["processed", "created", "updated", "skipped", "failed", "refresh_due", "refreshed_known"]
    last = jobs.groupBy("source_id").agg(F.max_by(F.struct("status", *counters), F.struct("started_at", (-F.col("id")).alias("id"))).alias("job"))
    last = last.select("source_id", F.col("job.status").alias("job_status"), *(F.col(f"job.{c}").alias(f"job_{c}") for c in counters))
    out = sources.join(listed, "source_id", "left").join(own, "source_id", "left").join(last, "source_id", "left")
    zero = [c for d in (listed, own, last) for c in d.columns if c not in ("source_id", "last_seen_at", "job_status")]
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in zero})


def percent(n: Column, total: Column) -> Column:
    """`n/total (x.x%)`."""
    return F.when(total > 0, F.format_string("%d/%d (%.1f%%)", n, total, n / total * 100)).otherwise("0/0 (0.0%)")


def audit_totals(df: DataFrame, weak: Column, noise: Column) -> DataFrame:
    """One row over all sources: records, and those to review, weak and noisy as count and percent."""
    own = df.agg(F.count("*").alias("records"), F.count_if("needs_manual_review").alias("manual"), F.count_if(F.size(weak) > 0).alias("weak"), F.count_if(F.size(noise) > 0).alias("noise"))
    return own.select("records", *(percent(F.col(c), F.col("records")).alias(n) for c, n in (("manual", "manual_review"), ("weak", "weak_records"), ("noise", "noise_candidates"))))


def weakest_fields(complete: DataFrame, by: str, k: int = 5) -> DataFrame:
    """Of reports.completeness: the k fields of each source with the least share of records, with what is missing; ties by name."""
    share = F.when(F.col("total") > 0, F.col("populated") / F.col("total")).otherwise(1.0)
    ranked = complete.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(share, "field")))
    return ranked.filter((F.col("place") <= k) & (F.col("missing") > 0)).select(by, "place", "field", "missing")


def gate_summary(gates: DataFrame) -> DataFrame:
    """One row of a gate report with `required`: how many required sources passed, of how many, and passed or blocked."""
    own = gates.agg(F.count_if(F.col("required") & F.col("passed")).alias("passed_sources"), F.count_if("required").alias("required_sources"))
    return own.withColumn("status", F.when(F.col("passed_sources") == F.col("required_sources"), "passed").otherwise("blocked"))


def gate_report(sources: DataFrame, records: DataFrame, approved: Column, required: DataFrame, excluded: DataFrame, least: int) -> DataFrame:
    """slug, required, approved, rejected, total, passed for the required and the excluded sources; an excluded one passes, one that does not exist fails."""
    names = required.select("slug", F.lit(True).alias("required")).unionByName(excluded.select("slug", F.lit(False).alias("required"))).groupBy("slug").agg(F.max("required").alias("required"))
    own = records.groupBy("slug").agg(F.count_if(approved).alias("approved"), F.count("*").alias("total"))
    out = names.join(sources.select("slug", F.lit(True).alias("exists")), "slug", "left").join(own, "slug", "left")
    n = F.coalesce("approved", F.lit(0).cast("long"))
    return out.select("slug", "required", n.alias("approved"), (F.coalesce("total", F.lit(0).cast("long")) - n).alias("rejected"), F.coalesce("total", F.lit(0).cast("long")).alias("total"), (~F.col("required") | (F.col("exists").isNotNull() & (n >= least))).alias("passed"))


def overview(records: DataFrame, clients: DataFrame, found: DataFrame, sources: DataFrame, as_of: str) -> DataFrame:
    """One row: the counts of a front page, one aggregate a table."""
    week = F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 7 DAYS")
    own = records.agg(
        F.count("*").alias("records"), F.count_if(F.col("status").isin("open", "active", "upcoming")).alias("open"), F.count_if(F.col("created_at") >= week).alias("new"), F.count_if("needs_manual_review").alias("manual_review"),
        F.count_if(F.col("quality_tier").isin("match_ready", "usable_with_warnings")).alias("prepared"), F.count_if(F.col("quality_tier") == "noise_rejected").alias("noise"), F.count_if(F.col("quality_tier").isNull()).alias("unscored"),
    )
    return own.crossJoin(clients.agg(F.count_if("enabled").alias("clients"))).crossJoin(found.agg(F.count("*").alias("matches"), F.count("explanation").alias("explained"))).crossJoin(sources.agg(F.count_if("enabled").alias("sources")))  # a row each


def records_of_items(items: DataFrame, records: DataFrame) -> DataFrame:
    """Each listed item with the newest record of its source that has its record id, or its address in either form: three equi-joins, none for all at once."""
    one = lambda a, b: items.filter(F.col(a).isNotNull()).select("item_id", "source_id", F.col(a).alias("__k")).join(records.select("source_id", F.col(b).alias("__k"), "id", "updated_at"), ["source_id", "__k"]).select("item_id", "id", "updated_at")
    pairs = one("record_id", "record_id").unionByName(one("canonical_url", "url")).unionByName(one("url", "url"))
    return pairs.groupBy("item_id").agg(F.max_by("id", F.struct("updated_at", (-F.col("id")).alias("k"))).alias("id"))


def relevant_history(history: Column, titles: Column, k: int = 5) -> Column:
    """The first k applications whose title is among the matched ones, whatever the case; of all applications where none matched."""
    known = F.filter(F.transform(titles, lambda t: F.lower(F.trim(t))), lambda t: t != "")
    return F.slice(F.filter(history, lambda h: (F.size(known) == 0) | F.coalesce(F.array_contains(known, F.lower(F.trim(h["title"]))), F.lit(False))), 1, k)


def payloads(found: DataFrame, records: DataFrame, clients: DataFrame) -> DataFrame:
    """run_id, id, client_key, payload: a JSON text for an external explainer, of match, record, client and the relevant applications.

    clients has `history`, an array of its applications in order; found has `matched_history` with their titles.
    """
    of = lambda df, key, drop=(): df.select(key, F.struct(*(c for c in df.columns if c not in (key, *drop))).alias(f"__{key}"))
    both = found.join(of(records, "id"), "id").join(of(clients, "client_key", ("history",)), "client_key").join(clients.select("client_key", "history"), "client_key")
    own = F.struct(*(c for c in found.columns if c not in ("run_id", "id", "client_key")))
    titles = F.transform("matched_history", lambda h: h["title"])
    body = F.struct(
        F.lit("Explain existing match evidence. Do not override deterministic/vector scores.").alias("instruction"), own.alias("match"), F.col("__id").alias("record"), F.col("__client_key").alias("client"), relevant_history(F.col("history"), titles).alias("relevant_history")
    )
    return both.select("run_id", "id", "client_key", F.to_json(body).alias("payload"))


def populated(df: DataFrame, names: list[str]) -> dict[str, Column]:
    """Tests for reports.completeness, by field."""
    return {n: present(df, n) for n in names}
