"""The score of a record from 0 to 100, from the flags of its contract and from what it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import clean_text

# Names and points of the score, by flag that must be absent, by signal, and taken off by flag.
CORE_POINTS = {"weak_title": ("core_title", 10), "missing_source_url": ("core_source_url", 10), "missing_context_text": ("core_context_text", 10), "invalid_status": ("core_valid_status", 10)}
IMPORTANT_POINTS = {
    "missing_deadline": ("important_deadline", 8), "missing_funder": ("important_funder", 4), "missing_amount": ("important_amount", 4), "missing_currency": ("important_currency", 2), "missing_country": ("important_country", 4),
    "missing_region": ("important_region", 1), "missing_eligibility": ("important_eligibility", 4), "missing_application_url": ("important_application_url", 2), "missing_published_at": ("important_published_at", 1),
}
ADVANCED_FIELDS = ["program", "keywords", "restrictions", "amount_max", "documents"]
STATUS_POINTS = {"open": 5, "unknown": 2, "closed": 0}
FAMILY_POINTS = {"structured_direct": 10, "useful_incomplete": 7, "unknown": 5, "aggregator": 4, "digest_heavy": 2, "empty_or_problem": 0}
PENALTY_POINTS = {
    "noise_rejected": ("penalty_noise_classification", 60), "needs_manual_review": ("penalty_manual_review", 15), "source_classification_uncertain": ("penalty_classification_uncertain", 10),
    "low_extraction_confidence": ("penalty_low_extraction_confidence", 10), "possible_duplicate": ("penalty_possible_duplicate", 10), "broad_finance_program": ("penalty_broad_finance_program", 5),
}
MIN_MATCHING_SCORE = 40


def present(df: DataFrame, name: str) -> Column:
    """Not null, and not blank or empty; a column that the table lacks is never present."""
    if name not in df.columns:
        return F.lit(False)
    kind = dict(df.dtypes)[name]
    return (F.coalesce(F.size(name), F.lit(0)) > 0) if kind.startswith("array") else clean_text(F.col(name)).isNotNull() if kind == "string" else F.col(name).isNotNull()


def column(df: DataFrame, name: str, kind: str = "string") -> Column:
    """The column, or null of the kind where the table lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def score(df: DataFrame) -> DataFrame:
    """A table with the contract's columns, with quality_score, components, penalties (without zeros) and matching_ready; the tier stays the contract's."""
    has = lambda f: F.array_contains("flags", f)
    length = lambda c: F.coalesce(F.char_length(clean_text(column(df, c))), F.lit(0))
    pick = lambda table, c: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(0))
    plus = [(name, F.when(~has(flag), p)) for flag, (name, p) in (CORE_POINTS | IMPORTANT_POINTS).items()]
    plus += [
        ("advanced_fields", sum((present(df, c).cast("int") for c in ADVANCED_FIELDS), F.lit(0))), ("text_summary", F.when(length("summary") >= 80, 5)), ("text_description", F.when(length("description") >= 300, 5)),
        ("status", pick(STATUS_POINTS, F.coalesce(clean_text(column(df, "status")), F.lit("unknown")))), ("source_family", pick(FAMILY_POINTS, F.coalesce(column(df, "family"), F.lit("unknown")))),
    ]
    minus = [(name, F.when(has(flag), p)) for flag, (name, p) in PENALTY_POINTS.items()]
    listed = lambda parts: F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(p, F.lit(0)).cast("int").alias("points")) for n, p in parts)), lambda e: e["points"] != 0))
    total = lambda parts: sum((F.coalesce(p, F.lit(0)) for _, p in parts), F.lit(0))
    out = df.withColumns({"quality_score": F.greatest(F.lit(0), F.least(F.lit(100), total(plus) - total(minus))).cast("int"), "components": listed(plus), "penalties": listed(minus)})
    return out.withColumn("matching_ready", F.col("eligible") & (F.col("quality_score") >= MIN_MATCHING_SCORE))


def prepared(df: DataFrame, least: int | None = None, include_unscored: bool = True) -> DataFrame:
    """The records fit for matching, best first."""
    good = F.col("quality_tier").isin("match_ready", "usable_with_warnings") & (F.lit(least is None) | (F.col("quality_score") >= F.lit(least)))
    return df.filter(good | (F.col("quality_tier").isNull() & F.lit(include_unscored))).orderBy(F.col("quality_score").desc_nulls_last(), "id")
