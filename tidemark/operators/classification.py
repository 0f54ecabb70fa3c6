"""The class of a record, and the contract that says whether it can be matched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.functions.extraction import has_any, padded
from tidemark.functions.text import clean_text
from tidemark.operators.quality import column, present
from tidemark.operators.reports import counted

# Flags in order, and those that keep a record from matching or send it to review.
MISSING_FIELDS = [
    ("deadline", "missing_deadline", ["deadline", "deadline_text"]), ("funding_amount_text", "missing_amount", ["amount_text"]), ("currency", "missing_currency", ["currency"]),
    ("funder_name", "missing_funder", ["funder"]), ("country", "missing_country", ["countries"]), ("region", "missing_region", ["regions"]),
    ("eligibility_text", "missing_eligibility", ["eligibility"]), ("application_url", "missing_application_url", ["application_url"]), ("source_published_at", "missing_published_at", ["published_at"]),
]
CORE_BLOCKERS = ["weak_title", "missing_source_url", "missing_context_text", "invalid_status"]
REVIEW_FLAGS = ["needs_manual_review", "invalid_status", "missing_context_text", "weak_title", "missing_source_url", "low_extraction_confidence", "source_classification_uncertain"]
BLOCKERS = ["weak_title", "missing_source_url", "invalid_status", "closed_status", "missing_context_text", "needs_manual_review", "low_extraction_confidence", "noise_rejected", "source_classification_uncertain"]
REVIEW_RULES = {
    "invalid_status": "invalid_status", "missing_context_text": "core_context_missing", "needs_manual_review": "explicit_manual_review", "low_extraction_confidence": "low_extraction_confidence",
    "noise_rejected": rules.NOISE_RULE, "source_classification_uncertain": "source_classification_uncertain",
}
POSSIBLE = ["digest", "news", "event", "webinar", "training", "tender"]


def family(source: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in rules.FAMILY_BY_SOURCE.items() for x in kv]), source), F.lit("unknown"))


def classify(df: DataFrame) -> DataFrame:
    """df with `family`, `class` and `class_reason`.

    The first stated class that has a known name counts, unless it is `unknown`: then, and without one, the text
    decides. Words of a direct offer win over all others but a digest, save a tender whose title names no offer.
    """
    aliases = F.create_map(*[F.lit(x) for kv in rules.CLASS_ALIASES.items() for x in kv])
    named = lambda c: F.try_element_at(aliases, F.replace(F.replace(F.lower(clean_text(c)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_")))
    stated = F.coalesce(*(F.when(named(column(df, c)).isNotNull(), F.struct(named(column(df, c)).alias("class"), F.concat(F.lit(f"explicit:{c}:"), named(column(df, c))).alias("reason"))) for c in ("stated_class", "source_class", "opportunity_type", "support_type")))
    df = df.withColumns({
        "family": family(column(df, "source")), "__title": padded(column(df, "title")),
        "__text": padded(*(column(df, c) for c in ("title", "summary", "description", "deadline_text", "amount_text", "funder"))),
        "__fields": present(df, "deadline") | present(df, "deadline_text") | present(df, "amount_text") | present(df, "funder") | present(df, "application_url") | present(df, "documents"),
    })
    title, mark = F.col("__title"), rules.CLASS_MARKS
    say = lambda name, why: F.struct(F.lit(name).alias("class"), F.lit(why).alias("reason"))
    direct = has_any(F.col("__text"), rules.DIRECT_MARKS)
    read = (
        F.when(has_any(title, mark["digest"]), say("digest", "text:digest_marker"))
        .when(direct & has_any(title, mark["tender"]) & ~has_any(title, rules.DIRECT_TITLE_MARKS), say("tender", "text:tender_marker"))
        .when(direct, say(rules.DIRECT_CLASS, rules.DIRECT_REASON))
    )
    for name in ("webinar", "training", "event", "tender", "news", "article", "finance_program"):
        read = read.when(has_any(title, mark[name]), say(name, f"text:{name}_marker"))
    read = read.when(F.col("__fields") & F.col("family").isin(rules.STRUCTURED_FAMILIES), say("opportunity", "text:structured_opportunity_signal")).otherwise(say("unknown", "text:no_classification_signal"))
    df = df.withColumn("__c", F.when(stated["class"] != "unknown", stated).otherwise(read))
    return df.withColumns({"class": F.col("__c.class"), "class_reason": F.col("__c.reason")}).drop("__c", "__title", "__text", "__fields")


def contract(df: DataFrame) -> DataFrame:
    """A classified df with `flags`, `review_rules`, `blockers`, `missing_fields`, `core_complete`, `quality_tier`, `eligible`, all lists in a fixed order."""
    title, status = F.coalesce(clean_text(column(df, "title")), F.lit("")), F.coalesce(clean_text(column(df, "status")), F.lit("unknown"))
    some = lambda *names: F.greatest(*(present(df, n) for n in names), F.lit(False))
    context = some("summary", "description", "eligibility", "restrictions") | (
        (F.char_length(title) >= 8) & some("topics", "keywords", "applicant_types", "countries", "regions", "deadline_text", "amount_text", "funder", "program")
    )
    noise = F.col("class").isin(rules.NOISE_CLASSES)
    yes = lambda name: F.coalesce(column(df, name, "boolean"), F.lit(False))
    tests = {
        "weak_title": F.char_length(title) < 8, "missing_source_url": ~F.startswith(F.coalesce(clean_text(column(df, "source_url")), F.lit("")), F.lit("http")),
        "invalid_status": ~status.isin("open", "closed", "unknown"), "status_unknown": status == "unknown", "closed_status": status == "closed", "missing_context_text": ~context,
        **{flag: ~some(*names) for _, flag, names in MISSING_FIELDS}, "broad_finance_program": F.col("class") == "finance_program", **{f"possible_{c}": F.col("class") == c for c in POSSIBLE},
        "possible_duplicate": yes("duplicate_risk") | yes("is_duplicate") | yes("potential_duplicate"), "needs_manual_review": yes("needs_manual_review"),
        "low_extraction_confidence": F.coalesce(column(df, "confidence", "decimal(5,4)") < F.lit("0.5").cast("decimal(5,4)"), F.lit(False)), "noise_rejected": noise,
        "source_classification_uncertain": (F.col("class") == "unknown") & F.col("family").isin(rules.UNCERTAIN_FAMILIES),
    }
    pick = lambda names: F.array_compact(F.array(*(F.when(F.array_contains("flags", n), n) for n in names)))
    renamed = lambda table: F.array_compact(F.array(*(F.when(F.array_contains("flags", flag), name) for flag, name in table)))
    df = df.withColumn("flags", F.array_compact(F.array(*(F.when(t, n) for n, t in tests.items()))))
    df = df.withColumns({
        "review_rules": renamed(REVIEW_RULES.items()), "blockers": pick(BLOCKERS), "missing_fields": renamed([(flag, name) for name, flag, _ in MISSING_FIELDS]),
        "core_complete": ~F.arrays_overlap("flags", F.array(*map(F.lit, CORE_BLOCKERS))),
        "quality_tier": F.when(F.array_contains("flags", "noise_rejected"), "noise_rejected").when(F.arrays_overlap("flags", F.array(*map(F.lit, REVIEW_FLAGS))), "needs_review").when(F.size("flags") > 0, "usable_with_warnings").otherwise("match_ready"),
    })
    return counted(df.withColumn("eligible", F.col("quality_tier").isin("match_ready", "usable_with_warnings") & (F.size("blockers") == 0)))
