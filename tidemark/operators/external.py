"""The work list for an external reader of records, the check of its answers, and their merge into the records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.extraction import is_generic_title
from tidemark.functions.rules import CLASS_ALIASES
from tidemark.functions.text import clean_text, merge_lists

TEXTS, LISTS = ["summary", "eligibility", "restrictions"], ["applicant_types", "topics", "countries", "regions"]
MIN_CONFIDENCE = "0.55"


def work_list(records: DataFrame) -> DataFrame:
    """records of 80 characters or more that lack something, with `reasons`; see enrich for the columns."""
    none = lambda c: F.size(c) == 0
    reasons = F.array_compact(F.array(
        F.when(F.coalesce(F.char_length("summary"), F.lit(0)) < 80, "weak_summary"), F.when(F.col("eligibility").isNull(), "missing_eligibility"), F.when(none("applicant_types"), "missing_applicant_types"),
        F.when(none("topics"), "missing_topics"), F.when(none("countries") & none("regions") & F.col("geography_text").isNull(), "missing_geography"),
        F.when(is_generic_title(F.col("title")) | (none("topics") & none("applicant_types")), "manual_review_risk"),
    ))
    return records.filter(F.char_length("text") >= 80).withColumn("reasons", reasons).filter(F.size("reasons") > 0)


def checked(answers: DataFrame, body: str = "body") -> DataFrame:
    """answers with `result` (the fields that hold), `errors`, and `valid`: no errors and enough confidence.

    A body that is no JSON object has the one error that says so. Texts are cut at 1,200 characters, lists at 12
    values of 80 characters.
    """
    raw = F.col(body)
    get = lambda name: F.get_json_object(raw, f"$.{name}")
    parsed = F.try_parse_json(raw)
    is_object = F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False))
    array = lambda name: F.from_json(get(name), "array<string>")
    is_list = lambda name: F.startswith(get(name), F.lit("["))
    values = lambda name: F.array_distinct(F.filter(F.transform(F.slice(array(name), 1, 12), lambda v: F.left(clean_text(v), F.lit(80))), lambda v: v.isNotNull()))
    stated = F.replace(F.replace(F.lower(clean_text(get("classification"))), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    allowed = stated.isin(sorted(set(CLASS_ALIASES.values())))
    sure = get("confidence").try_cast("decimal(5,4)")
    result = F.struct(*(F.left(clean_text(get(n)), F.lit(1200)).alias(n) for n in TEXTS), *(F.when(is_list(n), values(n)).alias(n) for n in LISTS), F.when(allowed, stated).alias("classification"), sure.alias("confidence"))
    held = sum((result[n].isNotNull().cast("int") for n in [*TEXTS, *LISTS, "classification"]), F.lit(0))
    errors = F.array_compact(F.array(
        *(F.when(get(n).isNotNull() & ~is_list(n), f"{n} must be a list") for n in LISTS), F.when(stated.isNotNull() & ~allowed, "classification is not allowed"),
        F.when(~F.coalesce(sure.between(0, 1), F.lit(False)), "confidence must be a number between 0 and 1"), F.when(get("evidence").isNotNull() & ~F.startswith(get("evidence"), F.lit("{")), "evidence must be an object"),
        F.when(held == 0, "result has no supported extraction fields"),
    ))
    out = answers.withColumns({"result": F.when(is_object, result), "errors": F.when(is_object, errors).otherwise(F.array(F.lit("result must be a JSON object")))})
    return out.withColumn("valid", (F.size("errors") == 0) & F.coalesce(F.col("result.confidence") >= F.lit(MIN_CONFIDENCE).cast("decimal(5,4)"), F.lit(False)))


def merged(records: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """records with what valid answers (one a key) add: empty texts, summaries under 80 characters, list values, a class where none is stated; and `applied_fields`."""
    both = records.join(answers.filter("valid").select(key, F.col("result").alias("__r")), key, "left")
    if "stated_class" not in records.columns:
        both = both.withColumn("stated_class", F.lit(None).cast("string"))
    weak = {"summary": F.coalesce(F.char_length("summary"), F.lit(0)) < 80, "eligibility": F.col("eligibility").isNull(), "restrictions": F.col("restrictions").isNull()}
    new: dict[str, Column] = {n: F.when(weak[n], F.coalesce(F.col(f"__r.{n}"), F.col(n))).otherwise(F.col(n)) for n in TEXTS}
    new |= {n: F.when(F.col(f"__r.{n}").isNull(), F.col(n)).otherwise(merge_lists(F.col(n), F.col(f"__r.{n}"))) for n in LISTS}
    new["stated_class"] = F.coalesce("stated_class", "__r.classification")
    applied = F.array_compact(F.array(*(F.when(~c.eqNullSafe(F.col(n)), n) for n, c in new.items())))
    return both.withColumn("applied_fields", applied).withColumns(new).drop("__r")
