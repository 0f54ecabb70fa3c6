"""From a raw record with its text to one with its fields read, normalised and graded: a chain of projections without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions import extraction as x
from tidemark.functions import rules
from tidemark.functions import payload as payloads
from tidemark.functions.text import clean_text, currency, let, merge_lists, stretch, summary
from tidemark.operators import terms
from tidemark.operators.change import latest
from tidemark.operators.reports import counted

#: Columns of a record and their types; a table may lack any but `text`. `payload` is the record's JSON as it came, text or VARIANT.
FIELDS = {
    **dict.fromkeys(["source", "title", "summary", "status", "deadline_text", "funder", "amount_text", "currency", "geography_text", "support_type", "opportunity_type", "eligibility", "restrictions", "cofinancing", "consortium", "program", "source_url", "application_url", "review_reason", "payload"], "string"),
    **dict.fromkeys(["topics", "keywords", "applicant_types", "countries", "regions"], "array<string>"), "deadline": "date", "amount_min": "decimal(14,2)", "amount_max": "decimal(14,2)", "needs_manual_review": "boolean",
}
NORMALISED = ["status", "deadline_text", "deadline", "amount_text", "currency", "countries", "regions", "funder", "support_type", "opportunity_type", "eligibility"]
HELPERS = [f"__{n}" for n in ("title", "leaves", "attributes", "title_words", "summary", "deadline", "had", "budget", "stated", "unit", "geography", "eligibility", "restrictions", "cofinancing", "consortium", "money", "context", "first", "funding", "amount", "kind", "lasting", "types", "topics", "countries", "program")]

#: All lists of words that are sought in whole texts, in one pass; those of titles, places and kinds of support in short ones.
IN_TEXT = terms.reader(
    {"types": rules.APPLICANT_TYPES, "topics": rules.TOPICS, "countries": rules.COUNTRIES, "regions": rules.REGIONS},
    {"geography": rules.GEOGRAPHY_WORDS, "eligibility": rules.ELIGIBILITY_WORDS, "restrictions": rules.RESTRICTION_WORDS, "cofinancing": rules.COFINANCING_WORDS, "consortium": rules.CONSORTIUM_WORDS, "money": rules.MONEY_WORDS, "ended": rules.ENDED_WORDS, "lasting": rules.LASTING_WORDS},
)
IN_TITLE = terms.reader({}, {"training": rules.TRAINING_TITLES, "offer": rules.OFFER_TITLES, "tender": rules.TENDER_TITLES})
IN_PLACE = terms.reader({"countries": rules.COUNTRIES[:2], "regions": rules.REGIONS}, {})
SUPPORT = terms.reader({"kinds": rules.SUPPORT_TYPES}, {})


def complete(records: DataFrame) -> DataFrame:
    """records with each of FIELDS, null where it was not there; lists are never null, a payload is JSON text."""
    out = records.withColumns({n: F.lit(None).cast(t) for n, t in FIELDS.items() if n not in records.columns})
    kinds = dict(records.dtypes)
    if kinds.get("payload", "string") != "string":
        out = out.withColumn("payload", payloads.as_json(F.col("payload"), kinds["payload"]))
    return out.withColumns({n: F.coalesce(n, F.array().cast(t)) for n, t in FIELDS.items() if t.startswith("array")})


def told(confidence: str, evidence: Column, when: Column | None = None) -> Column:
    """What a rule found a value by: its method, confidence and passage, at most 500 characters; null where the rule did not apply."""
    made = F.struct(F.lit("deterministic").alias("method"), F.lit(f"{float(confidence):.4f}").alias("confidence"), F.left(clean_text(evidence), F.lit(500)).alias("evidence"))
    return made if when is None else F.when(when, made)


def _gathered(found: dict[str, Column]) -> Column:
    """field -> evidence of the rules that applied, in order; a later entry of a field takes the place of an earlier one."""
    entries = F.array_compact(F.array(*(F.when(c.isNotNull(), F.struct(F.lit(n).alias("key"), c.alias("value"))) for n, c in found.items())))
    return F.map_from_entries(entries)


def _both(first: Column, then: Column) -> Column:
    return let(then, lambda new: F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(new, k)), new))


def read_fields(df: DataFrame, as_of: str) -> DataFrame:
    """Fills the fields that the record lacks from its payload and its text; what it states stays. `fields` says how each was found.

    Deadlines: the payload's before the text's. Sums: where a source states them as attributes, those; then a budget in
    the payload; then what the record or its text says. Each text passes the words of all lists once, and each rule is
    worked out once, for the value and its evidence together.
    """
    now = F.lit(as_of).cast("date")
    df = df.withColumns({"text": F.coalesce(clean_text(F.col("text")), F.lit("")), "__title": F.col("title"), "title": x.repaired_title(F.col("title"), F.col("source_url")), "__leaves": payloads.leaves(F.col("payload")), "__attributes": payloads.attributes(F.when(F.col("source").isin(rules.ATTRIBUTE_SOURCES), F.col("payload")))})
    df = df.withColumns({
        "__words": IN_TEXT(F.concat(F.lit(" "), F.lower("text"), F.lit(" "))), "__title_words": IN_TITLE(x.padded(F.col("title"))),
        "__summary": F.when(F.coalesce(F.char_length("summary"), F.lit(0)) < 80, summary(F.col("text"))), "__deadline": F.when(F.col("deadline").isNull(), F.coalesce(payloads.deadline(F.col("__leaves"), now), x.deadline(F.col("text")))),
    })
    passage = lambda name, radius=240: stretch(F.col("text"), F.col(f"__words.{name}") - 1, radius)
    df = counted(df)  # a border: without it the columns' expressions are copied into each other
    df = df.withColumns({
        "__had": F.struct("deadline", "deadline_text", "amount_text", "opportunity_type", "program"), "__budget": payloads.budget(F.col("__leaves")),
        "__stated": F.coalesce("amount_text", payloads.attribute(F.col("__attributes"), rules.AMOUNT_ATTRIBUTES)), "__unit": F.coalesce("currency", payloads.attribute(F.col("__attributes"), rules.CURRENCY_ATTRIBUTES)),
        "summary": F.coalesce("__summary", "summary"), "deadline_text": F.when(F.col("deadline").isNull(), F.coalesce("deadline_text", F.col("__deadline.deadline_text"))).otherwise(F.col("deadline_text")), "deadline": F.coalesce("deadline", "__deadline.deadline"),
        **{f"__{n}": passage(n) for n in ("geography", "eligibility", "restrictions", "cofinancing", "consortium")},
    })
    attributed = F.col("source").isin(rules.ATTRIBUTE_SOURCES) & (F.col("__stated").isNotNull() | F.col("__unit").isNotNull())
    money = F.coalesce("__budget", F.concat_ws(" ", passage("money", 360), x.amount_text(F.col("text"))))
    df = df.withColumns({"status": x.status(F.col("status"), F.col("deadline"), now), "__money": clean_text(F.concat_ws(" ", F.when(attributed, F.col("__stated")).otherwise(F.col("amount_text")), "currency", money)), "__context": F.when(attributed, clean_text(F.concat_ws(" ", "__stated", "__unit")))})
    some = lambda f: F.coalesce(f["amount_min"], f["amount_max"]).isNotNull()
    named = lambda by: lambda f: F.when(some(f), F.struct(F.lit(by).alias("by"), f.alias("sums")))
    df = df.withColumn("__first", F.coalesce(*(let(x.funding(F.col(c), F.col("source")), named(by)) for by, c in (("attribute", "__context"), ("budget", "__budget")))))
    df = counted(df)
    df = df.withColumn("__funding", F.when(F.col("__first").isNotNull(), F.col("__first.sums")).otherwise(x.funding(F.col("__money"), F.col("source"))))
    sums, by = some(F.col("__funding")), F.coalesce(F.col("__first.by"), F.lit(""))
    shown = x.funding_text(F.col("__funding.amount_min"), F.col("__funding.amount_max"), F.coalesce("__funding.currency", "currency"))
    df = df.withColumn("__amount", F.when(sums, F.when(F.col("__budget").isNotNull(), shown).when(attributed & F.col("__stated").isNotNull(), F.col("__stated")).otherwise(x.amount_text(x.without_dates(F.when(by == "attribute", F.col("__context")).otherwise(F.col("__money")))))))
    intro = F.lower(F.left("text", F.lit(900)))
    holds = lambda name: F.col(name).isNotNull()
    training = holds("__title_words.training") | (F.regexp_like(intro, F.lit(f"(?iu){rules.TRAINING_INTRO}")) & ~holds("__title_words.offer"))
    tender = holds("__title_words.tender")
    topics = F.filter(F.transform("topics", clean_text), lambda t: t.isNotNull() & ~F.lower(t).isin(rules.GENERIC_TOPICS))
    lasting = (F.col("status") == "unknown") & F.col("deadline").isNull() & F.col("source").isin(rules.ATTRIBUTE_SOURCES) & ~holds("__words.ended") & (
        holds("__words.lasting") | (F.col("support_type").isin(rules.LASTING_SUPPORT) & (F.col("application_url").isNotNull() | F.coalesce(F.contains("source_url", F.lit(rules.LASTING_PAGE)), F.lit(False))))
    )
    df = df.withColumns({
        "__kind": F.when(training, "training").when(tender, "tender"), "__lasting": F.coalesce(lasting, F.lit(False)), "__types": F.col("__words.types"), "__topics": F.col("__words.topics"), "__countries": F.col("__words.countries"),
        "__program": F.when(F.col("source").isin(rules.PROGRAM_SOURCES) & F.coalesce(F.regexp_like("program", F.lit(r"^\d*$")), F.lit(True)), F.coalesce(*(first_text(F.get_json_object("payload", f"$.{k}")) for key in rules.PROGRAM_KEYS for k in (key, f"metadata.{key}")))),
    })
    df = counted(df)
    texts = {"eligibility": ("eligibility_text", "0.62"), "restrictions": ("restrictions_text", "0.58"), "cofinancing": ("cofinancing_text", "0.70"), "consortium": ("consortium_text", "0.70")}
    listed = lambda c: F.array_join(c, "; ")
    fields = {
        "title": told("0.90", F.col("title")), "title_from_url": told("0.60", F.col("source_url"), x.is_generic_title(F.col("__title")) & (F.col("title") != F.coalesce("__title", F.lit("")))), "summary": told("0.65", F.col("__summary"), F.col("__summary").isNotNull()),
        "deadline_at": F.coalesce(told("0.85", F.coalesce(F.col("__deadline.deadline_text"), F.col("deadline").cast("string")), F.col("__had.deadline").isNull() & F.col("deadline").isNotNull()), told("0.90", F.col("__had.deadline_text"), F.col("__had.deadline").isNotNull() & F.col("__had.deadline_text").isNotNull())),
        "status": F.when(F.col("__lasting"), told("0.68", F.lit("open-ended programme without a deadline"))).otherwise(told("0.80", F.col("status"))), "program_name": told("0.85", F.col("__program"), F.col("__program").isNotNull()), "funding_amount": told("0.70", F.left("__amount", F.lit(300)), F.col("__amount").isNotNull()),
        "opportunity_type": told("0.80", F.when(F.col("__kind") == "training", "training/course keyword").otherwise("tender/procurement keyword"), F.col("__kind").isNotNull()), "applicant_types": told("0.70", listed("__types"), F.size("__types") > 0), "topics": told("0.70", listed("__topics"), F.size("__topics") > 0),
        "countries": told("0.70", F.coalesce("__geography", listed("__countries")), F.size("__countries") > 0), **{name: told(sure, F.col(f"__{c}"), F.col(c).isNull() & F.col(f"__{c}").isNotNull()) for c, (name, sure) in texts.items()},
    }
    df = df.withColumns({
        "fields": _gathered(fields), **{c: F.coalesce(c, f"__funding.{c}") for c in ("amount_min", "amount_max", "currency")}, "amount_text": F.coalesce("amount_text", "__amount"), "status": F.when(F.col("__lasting"), "open").otherwise(F.col("status")), "program": F.coalesce("__program", "program"),
        "opportunity_type": F.coalesce("__kind", "opportunity_type"), "support_type": F.when(F.col("__kind") == "tender", "procurement").otherwise(F.coalesce("__kind", "support_type")),
        "applicant_types": merge_lists(F.col("applicant_types"), F.col("__types")), "topics": merge_lists(topics, F.col("__topics")), "countries": merge_lists(F.col("countries"), F.col("__countries")),
        "geography_text": F.coalesce("geography_text", "__geography"), **{c: F.coalesce(c, f"__{c}") for c in texts},
    })
    return df.withColumn("keywords", merge_lists(F.col("keywords"), F.col("topics"))).drop(*(c for c in df.columns if c in HELPERS))


def first_text(c: Column) -> Column:
    """The text of a JSON value: of a list its first, of an object that of its value, label, name, title or content; else the value itself."""
    one = F.coalesce(F.when(F.startswith(c, F.lit("[")), F.get_json_object(c, "$[0]")), c)
    inner = F.coalesce(F.when(F.startswith(one, F.lit("{")), F.coalesce(*(F.get_json_object(one, f"$.{k}") for k in ("value", "label", "name", "title", "content")))), F.when(~F.startswith(one, F.lit("{")), one))
    return F.when(~F.startswith(inner, F.lit("[")), clean_text(inner))


def normalise(df: DataFrame, as_of: str) -> DataFrame:
    """The fields in their normal forms, with `changed_fields` in a fixed order, their evidence, and a reason for money without a currency.

    df has the places of words that read_fields found; it is asked only for what stands in the place and at its border
    with the text besides.
    """
    before = counted(df).withColumns({f"__{c}": F.col(c) for c in NORMALISED})
    border = IN_PLACE(x.padded(F.col("geography_text"), F.left("text", F.lit(60))))
    df = before.withColumns({"deadline_text": x.clean_deadline_text(F.col("deadline_text")), "amount_text": x.clean_amount_text(F.col("amount_text")), "__place": border, "__kinds": SUPPORT(x.padded(F.col("support_type"), F.col("title"), F.col("summary"), F.left("text", F.lit(1000))))})
    df = counted(df)
    either = lambda n, table: F.filter(F.array(*(F.lit(label) for label, _ in table)), lambda v: F.array_contains(F.col(f"__place.{n}"), v) | F.array_contains(F.col(f"__words.{n}"), v))
    df = df.withColumns({
        "status": x.status(F.col("status"), F.col("deadline"), F.lit(as_of).cast("date")), "currency": F.coalesce(currency(F.col("currency")), currency(F.col("amount_text")), F.col("currency")),
        "countries": merge_lists(F.col("countries"), either("countries", rules.COUNTRIES[:2])), "regions": merge_lists(F.col("regions"), either("regions", rules.REGIONS)),
        "funder": F.coalesce(clean_text(F.col("funder")), F.try_element_at(F.create_map(*[F.lit(v) for kv in rules.FUNDERS_BY_SOURCE.items() for v in kv]), F.col("source")), x.funder_in_title(F.col("title"))),
        "support_type": F.coalesce(F.get("__kinds.kinds", 0), clean_text(F.col("support_type"))), "eligibility": x.clean_eligibility(F.col("eligibility")),
    })
    df = counted(df)
    df = df.withColumn("opportunity_type", F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in rules.OPPORTUNITY_TYPES.items() for v in kv]), F.col("support_type")), F.col("opportunity_type")))
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    changed = F.array_compact(F.array(*(F.when(differs(c), c) for c in NORMALISED)))
    doubt = F.when(F.col("amount_text").isNotNull() & currency(F.col("currency")).isNull(), "funding amount has no reliable currency")
    turned = lambda c: F.concat(F.coalesce(F.concat(F.lit("'"), f"__{c}", F.lit("'")), F.lit("None")), F.lit(" -> "), F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("None")))
    kept = lambda c: F.coalesce(F.col(c), F.col(f"__{c}"))
    evidence = {
        "status": ("0.82", turned("status")), "deadline_text": ("0.78", F.col("deadline_text")), "amount_text": ("0.76", kept("amount_text")), "currency": ("0.80", turned("currency")), "countries": ("0.72", F.array_join("countries", "; ")), "regions": ("0.68", F.array_join("regions", "; ")),
        "funder": ("0.60", kept("funder")), "support_type": ("0.72", turned("support_type")), "opportunity_type": ("0.72", turned("opportunity_type")), "eligibility": ("0.70", kept("eligibility")),
    }
    names = {"amount_text": "funding_amount_text", "funder": "funder_name", "eligibility": "eligibility_text"}
    normal = _gathered({f"{names.get(c, c)}_normalized": told(sure, said, differs(c)) for c, (sure, said) in evidence.items()})
    return df.withColumns({"changed_fields": changed, "__doubt": doubt, "fields": _both(F.col("fields"), normal)}).drop("__place", "__words", "__kinds", *(f"__{c}" for c in NORMALISED))


def judge(df: DataFrame) -> DataFrame:
    """`confidence` from what was found, `needs_manual_review` and the reasons for it."""
    some = lambda c: F.size(c) > 0
    points = [
        ("0.12", ~x.is_generic_title(F.col("title")) & F.col("title").isNotNull()), ("0.12", F.char_length("text") > 250), ("0.08", F.col("summary").isNotNull()), ("0.10", F.col("deadline").isNotNull()),
        ("0.08", F.col("amount_text").isNotNull() | F.col("amount_max").isNotNull()), ("0.10", some("applicant_types")), ("0.10", some("topics")), ("0.07", F.col("eligibility").isNotNull()),
        ("0.03", F.coalesce("restrictions", "cofinancing", "consortium").isNotNull()),
    ]
    number = lambda v: F.lit(v).cast("decimal(5,4)")
    total = sum((F.when(test, number(v)).otherwise(number("0")) for v, test in points), number("0.20"))
    reasons = F.array_compact(F.array(
        F.col("review_reason"), F.when(x.is_generic_title(F.col("title")), "generic title"), F.when(F.char_length("text") < 80, "very short extracted text"),
        F.when(~some("topics") & ~some("applicant_types"), "no applicant/topic taxonomy detected"), F.col("__doubt"),
    ))
    return df.withColumns({
        "confidence": F.least(total, number("0.95")).cast("decimal(5,4)"), "needs_manual_review": F.coalesce("needs_manual_review", F.lit(False)) | (F.size(reasons) > F.col("review_reason").isNotNull().cast("int")),
        "review_reason": F.nullif(F.array_join(F.array_distinct(reasons), "; "), F.lit("")),
    }).drop("__doubt")


def enrich(records: DataFrame, as_of: str, seen: Observation | None = None) -> DataFrame:
    """Records with all of FIELDS, changed_fields, confidence and `fields`: for each field that a rule filled or changed, method, confidence and evidence. A null text counts as empty, and then as very short.

    After an action `seen` holds the numbers of records, of those with changed fields and of those to review.
    """
    done = complete(records).transform(read_fields, as_of).transform(normalise, as_of).transform(judge)
    return counted(done, seen, F.count_if(F.size("changed_fields") > 0).alias("changed"), F.count_if("needs_manual_review").alias("to_review"))


#: What recompute reads again from the text; title, status, programme and funder stay as they are.
RECOMPUTED = ["summary", "deadline", "deadline_text", "amount_min", "amount_max", "amount_text", "currency", "geography_text", "countries", "regions", "eligibility", "applicant_types", "topics", "keywords", "restrictions", "cofinancing", "consortium", "needs_manual_review", "review_reason"]


def recompute(records: DataFrame, snapshots: DataFrame, as_of: str, seen: Observation | None = None) -> DataFrame:
    """Records as their latest snapshot (id, text, fetched_at) gives them: RECOMPUTED fields are emptied first, then read.

    A record without a snapshot, or whose latest has no text, keeps its own text. Ties in time go to the greater text.
    """
    newest = latest(snapshots.filter("id IS NOT NULL"), ["id"], [F.desc_nulls_last("fetched_at"), F.desc_nulls_last("text")])
    df = records.join(newest.select("id", F.col("text").alias("__snapshot")), "id", "left")
    df = df.withColumn("text", F.coalesce("__snapshot", "text")).drop("__snapshot", *RECOMPUTED)
    start = F.create_map(*[v for k, kinds in rules.RECOMPUTED_TYPES.items() for v in (F.lit(k), F.struct(*(F.lit(c).alias(n) for c, n in zip(kinds, ("opportunity", "support"), strict=True))))])
    source = F.coalesce("source", F.lit("")) if "source" in records.columns else F.lit("")
    kinds = F.coalesce(F.try_element_at(start, source), F.try_element_at(start, F.lit("")))
    return enrich(df.withColumns({"opportunity_type": kinds["opportunity"], "support_type": kinds["support"]}), as_of, seen)
