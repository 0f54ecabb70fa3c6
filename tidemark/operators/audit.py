"""What is weak in a record, what looks like noise, and which records are approved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.functions.extraction import has_any
from tidemark.operators.quality import column, present


def weak_reasons(df: DataFrame) -> Column:
    some = lambda *names: F.greatest(*(present(df, n) for n in names), F.lit(False))
    text = lambda c: F.coalesce(F.trim(column(df, c)), F.lit(""))
    tests = {
        "weak_title": F.char_length(text("title")) < 8, "missing_source_url": ~F.startswith(text("source_url"), F.lit("http")), "status_unknown": ~text("status").isin("open", "closed"),
        "missing_summary": ~some("summary", "description"), "missing_deadline": ~some("deadline"), "missing_funder": ~some("funder"), "missing_amount": ~some("amount_text"), "missing_currency": ~some("currency"),
        "missing_geography": ~some("countries", "regions", "geography_text"), "missing_eligibility": ~some("eligibility"), "needs_manual_review": F.coalesce(column(df, "needs_manual_review", "boolean"), F.lit(False)),
        "low_extraction_confidence": F.coalesce(column(df, "confidence", "decimal(5,4)") < F.lit("0.5").cast("decimal(5,4)"), F.lit(False)),
    }
    return F.array_compact(F.array(*(F.when(t, n) for n, t in tests.items())))


def noise_reasons(df: DataFrame) -> Column:
    title = F.lower(column(df, "title"))
    text = F.lower(F.concat_ws(" ", *(column(df, c) for c in ("title", "summary", "description", "opportunity_type", "support_type"))))
    kind = lambda c, names: F.when(column(df, c).isin(names), F.concat(F.lit(f"unsupported_{c}:"), column(df, c)))
    return F.array_compact(F.array(
        *(F.when(has_any(text, words), name) for name, words in rules.NOISE_MARKS),
        F.when(has_any(title, rules.AUDIT_TRAINING_TITLES) & ~has_any(title, rules.AUDIT_OFFER_TITLES), rules.TRAINING_NOISE),
        kind("opportunity_type", ["training", "tender"]), kind("support_type", ["training", "procurement"]),
    ))


def audited(df: DataFrame) -> DataFrame:
    return df.withColumns({"weak_reasons": weak_reasons(df), "noise_reasons": noise_reasons(df)})


def approved(df: DataFrame) -> Column:
    """A fair title and address, no noise, a word of an offer or an official source, and a field that shows what it is about."""
    title = F.coalesce(F.lower(F.trim(column(df, "title"))), F.lit(""))
    some = F.greatest(*(present(df, n) for n in ("deadline", "deadline_text", "amount_text", "funder", "application_url", "documents", "topics", "applicant_types", "countries", "regions")))
    offered = has_any(title, rules.APPROVED_TITLE_WORDS) | has_any(F.lower(column(df, "summary")), rules.APPROVED_SUMMARY_WORDS) | F.coalesce(column(df, "source").isin(rules.OFFICIAL_SOURCES), F.lit(False))
    fair = (F.char_length(title) >= 8) & F.startswith(F.coalesce(F.trim(column(df, "source_url")), F.lit("")), F.lit("http"))
    return fair & ~title.isin(rules.UNAPPROVED_TITLES) & ~has_any(title, rules.UNAPPROVED_TITLE_WORDS) & offered & some
