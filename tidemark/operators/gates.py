"""Matching with all its gates: which pairs of an opportunity and a client can suit, how well, and why. Scores are in ten-thousandths.

Opportunities are columns of classification.contract (with quality_score, and is_duplicate, primary_id,
potential_duplicate, is_primary where duplicates were sought). Clients have client_key, client, country, sector,
organization_type, product, wanted, unwanted and technologies. Their applications are rows of client_key, order,
title, program, source, result, topics, applicant_type, reusable, weight in per cent; or an array of such structs,
in order, as the clients' column history. A null list counts as empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.functions.extraction import has_any, labels, padded
from tidemark.functions.text import clean_text, cosine
from tidemark.operators import terms
from tidemark.operators.quality import column
from tidemark.operators.reports import counted

MIN_QUALITY, MIN_SCORE = 40, 2500
#: So many of a client's applications stand in one row at most while pairs are scored.
BLOCK = 64
PAST = ["title", "program", "source", "result", "topics", "applicant_type", "reusable", "weight"]


def normal_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(clean_text(x))), lambda x: x.isNotNull()))


def opportunity_gates(df: DataFrame, as_of: str, include_low_quality: bool = False, least_quality: int = MIN_QUALITY) -> DataFrame:
    """df with `reasons` that rule it out for every client, `checks` for a person to make, and what pairs compare."""
    yes = lambda c: F.coalesce(column(df, c, "boolean"), F.lit(False))
    title, text = padded(F.col("title")), padded(*(column(df, c) for c in ("title", "summary", "description", "eligibility")), *(F.array_join(F.coalesce(column(df, c, "array<string>"), F.array().cast("array<string>")), " ") for c in ("topics", "keywords", "applicant_types")))
    primary = column(df, "primary_id", "string").cast("string")
    other = yes("is_duplicate") & primary.isNotNull() & (primary != F.col("id").cast("string"))
    tier, score, kind, support = F.col("quality_tier"), column(df, "quality_score", "int"), column(df, "opportunity_type"), column(df, "support_type")
    df = df.withColumns({"body": text, "__title": title})
    course = has_any(F.col("__title"), rules.COURSE_TITLES) | (has_any(F.col("__title"), rules.ACADEMY_TITLES) & ~has_any(F.col("__title"), rules.ACADEMY_OFFER_TITLES)) | has_any(F.left("body", F.lit(900)), rules.COURSE_INTRO)
    unsupported = F.coalesce(kind.isin("training", "tender"), F.lit(False)) | F.coalesce(support.isin("training", "procurement"), F.lit(False)) | course
    late = F.col("deadline") < F.lit(as_of).cast("date")
    one = lambda test, value: F.when(test, F.array(value)).otherwise(F.array().cast("array<string>"))
    reasons = F.concat(
        one(other, F.concat(F.lit(rules.DUPLICATE_REASON), primary)), one(tier == "noise_rejected", F.concat(F.lit("quality_gate:noise_rejected:"), F.col("class"))), one(tier == "needs_review", F.lit("quality_gate:needs_review")),
        F.transform(F.array_remove("blockers", "closed_status"), lambda b: F.concat(F.lit("quality_gate:"), b)),
        one(F.coalesce(score < least_quality, F.lit(False)) & F.lit(not include_low_quality), F.concat(F.lit("quality_gate:low_quality_score:"), score.cast("string"))),
        one(F.col("status") == "closed", F.lit(rules.CLOSED_REASON)), one(unsupported, F.concat(F.lit("unsupported_opportunity_type:"), F.coalesce(kind, support, F.lit("")))), one(late, F.lit("deadline_passed")),
    )
    checks = F.concat(
        one(~other & yes("potential_duplicate") & ~yes("is_primary"), F.lit("potential duplicate requires review")),
        F.when(tier == "usable_with_warnings", F.transform("flags", lambda f: F.concat(F.lit("quality warning: "), f))).otherwise(F.array().cast("array<string>")),
        one(F.col("status") == "unknown", F.lit(rules.STATUS_CHECK)), one(F.col("deadline").isNull(), F.lit("deadline missing")),
    )
    return df.withColumns({
        "reasons": reasons, "checks": checks, "topic_set": normal_set(column(df, "topics", "array<string>")), "country_set": normal_set(column(df, "countries", "array<string>")), "type_set": normal_set(column(df, "applicant_types", "array<string>")),
        "restricted": padded(column(df, "restrictions")), "nonprofit_only": has_any(F.col("body"), rules.NONPROFIT_ONLY), "surety": (F.least(F.coalesce(column(df, "confidence", "decimal(5,4)"), F.lit(0)), F.lit(1)) * 10_000).cast("int"),
    }).drop("__title")


def client_sides(clients: DataFrame) -> DataFrame:
    """clients with their lists in normal form, the types that they are and the types that take them."""
    types = labels(F.lower(F.concat_ws(" ", "organization_type", "sector", "product")), rules.CLIENT_TYPES)
    accepted = F.create_map(*[v for k, kinds in rules.ACCEPTED_TYPES.items() for v in (F.lit(k), F.array(*map(F.lit, kinds)))])
    out = clients.withColumns({"client_types": types, "wanted": normal_set(F.col("wanted")), "unwanted": normal_set(F.col("unwanted")), "technologies": normal_set(F.col("technologies")), "sector": F.lower(clean_text(F.col("sector"))), "land": F.lower(clean_text(F.col("country")))})
    return out.withColumn("accepted_types", F.array_distinct(F.flatten(F.transform("client_types", lambda t: accepted[t]))))


def candidates(opportunities: DataFrame, clients: DataFrame, applications: DataFrame) -> DataFrame:
    """id, client_key, once, of the pairs that can reach MIN_SCORE.

    They share a topic, or the opportunity's text holds a technology, the sector or an application's title, program
    or source. Any other pair has at most 0.75 * 0.15 for its type, 0.25 * 0.25 * weight for its history and 0.05
    for its confidence: below 0.25 for weights below 140 per cent. A reusable application of a greater weight also pairs
    with its type; one of 230 per cent or more could do so with no type at all, and raises ValueError.
    """
    heavy = applications.filter(F.col("weight") >= 140).select("client_key", "weight", F.lower(clean_text(F.col("applicant_type"))).alias("kind")).distinct()
    most = heavy.agg(F.max("weight")).first()[0]
    if most is not None and most >= 230:
        raise ValueError(f"an application weighs {most} per cent; weights below 230 are supported")
    topics = clients.select("client_key", F.explode("wanted").alias("topic")).unionByName(applications.select("client_key", F.explode(normal_set(F.col("topics"))).alias("topic"))).distinct()
    words = clients.select("client_key", F.explode(normal_set(F.concat(F.col("technologies"), F.array("sector")))).alias("term"))
    told = applications.join(clients.select("client_key"), "client_key", "left_semi").select("client_key", F.explode(normal_set(F.array("title", "program", "source"))).alias("term"))
    by_topic = opportunities.select("id", F.explode("topic_set").alias("topic")).join(topics, "topic").select("id", "client_key")
    both = by_topic.unionByName(terms.in_texts(opportunities.select("id", "body"), words.unionByName(told)))
    if most is not None:
        both = both.unionByName(opportunities.select("id", F.explode("type_set").alias("kind")).join(heavy, "kind").select("id", "client_key"))
    return both.distinct()


def in_rows(clients: DataFrame) -> DataFrame:
    """The applications of the clients' column history as rows."""
    return clients.select("client_key", F.posexplode("history").alias("order", "h")).select("client_key", "order", *(F.col(f"h.{c}").alias(c) for c in PAST))


def in_blocks(applications: DataFrame, size: int = BLOCK) -> DataFrame:
    """client_key, block, past: all of a client's applications, about `size` in a row, dealt by a hash of their order where there are more."""
    many = applications.groupBy("client_key").agg(F.count("*").alias("n")).filter(F.col("n") > size)
    block = F.when(F.col("n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("order"), F.ceil(F.col("n") / size))).cast("int")
    placed = applications.join(many, "client_key", "left").withColumn("block", block)
    return placed.groupBy("client_key", "block").agg(F.array_sort(F.collect_list(F.struct("order", *PAST))).alias("past"))


def pair_gates(pairs: DataFrame) -> DataFrame:
    """pairs with the client's reasons and checks added, and `passed`: no reason but unwanted topics."""
    land, lands, types, kinds = F.col("land"), F.col("country_set"), F.col("client_types"), F.col("type_set")
    one = lambda test, value: F.when(test, F.array(value)).otherwise(F.array().cast("array<string>"))
    here, europe, placed = F.array_contains(lands, land), F.array_contains(lands, F.lit("eu")), F.size(lands) > 0
    mine = F.exists(F.array_compact(F.array_append(types, land)), lambda t: F.contains(F.col("restricted"), t))
    barred = has_any(F.col("restricted"), ["not eligible"]) & mine
    hard = F.concat(
        F.col("reasons"), one(land.isNotNull() & placed & ~here & ~europe, F.concat(F.lit("country_mismatch:"), F.col("country"))),
        one((F.size(types) > 0) & (F.size(kinds) > 0) & ~F.arrays_overlap("accepted_types", kinds), F.concat(F.lit("applicant_type_mismatch:"), F.coalesce("organization_type", F.lit("unknown")))),
        one(F.col("nonprofit_only") & ~F.array_contains(types, "ngo"), F.lit(rules.NONPROFIT_REASON)),
    )
    soft = F.transform(F.array_sort(F.array_intersect("unwanted", "topic_set")), lambda t: F.concat(F.lit("excluded_topic:"), t))
    checks = F.concat(
        F.col("checks"), one(land.isNotNull() & europe & ~here, F.lit("EU geography may require eligibility check")), one(land.isNotNull() & ~placed, F.lit(rules.COUNTRY_CHECK)),
        one((F.size(types) > 0) & (F.size(kinds) == 0), F.lit(rules.TYPE_CHECK)), one(~barred & has_any(F.col("restricted"), rules.RESTRICTION_CHECKS), F.lit(rules.RESTRICTION_CHECK)),
    )
    stop = one(barred, F.lit("restriction_conflict"))
    return pairs.withColumns({"passed": (F.size(hard) == 0) & ~barred, "reasons": F.concat(hard, soft, stop), "checks": checks})


def _rounded(c: Column, most: int = 10_000) -> Column:
    """Half to even, between 0 and the most."""
    return F.greatest(F.lit(0), F.least(F.lit(most), F.bround(c.cast("double"), 0))).cast("int")


def vector_score(offer: Column, client: Column, past: Column | None = None) -> Column:
    """0.8 of the likeness to the client and 0.2 of the best one to its applications, an array of vectors; null if there is none at all."""
    near = lambda a, b: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(a, b))) * 10_000).cast("int")
    own, best = F.when(cosine(offer, client).isNotNull(), near(offer, client)), F.lit(None).cast("int")
    if past is not None:
        best = F.array_max(F.filter(F.transform(past, lambda h: F.when(cosine(offer, h).isNotNull(), near(offer, h))), lambda v: v.isNotNull()))
    return F.when(own.isNotNull() | best.isNotNull(), _rounded((F.coalesce(own, F.lit(0)) * 8 + F.coalesce(best, F.lit(0)) * 2) / 10))


def vector_value(cosines: np.ndarray) -> np.ndarray:
    """vector_score of pairs without applications, from their cosines."""
    return np.rint(np.floor(np.clip(cosines, 0, 1) * 10_000 + 0.5) * 8 / 10)


def remembered(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """pairs with history_score, the best of all the client's applications, and matched_history, the first five that score."""

    def each(h: Column) -> Column:
        topics = normal_set(h["topics"])
        k = F.greatest(F.size(topics), F.lit(1))
        told = F.exists(F.array(h["title"], h["program"], h["source"]), lambda v: F.coalesce(F.contains(F.col("body"), F.lower(clean_text(v))), F.lit(False)))
        whole = told.cast("int") * 2500 + F.coalesce(h["reusable"], F.lit(False)).cast("int") * 1500 + F.coalesce(F.array_contains(F.col("type_set"), F.lower(clean_text(h["applicant_type"]))), F.lit(False)).cast("int") * 1000
        return F.least(F.lit(10_000.0), (F.size(F.array_intersect(F.col("topic_set"), topics)) * 5000 + whole * k) * F.coalesce(F.nullif(h["weight"], F.lit(0)), F.lit(100)) / (k * 100))

    own = [c for c in pairs.columns if c not in ("id", "client_key")]
    told = pairs.join(blocks, "client_key", "left").withColumn("past", F.transform("past", lambda h: F.struct(h["order"].alias("order"), h["title"].alias("title"), h["result"].alias("result"), each(h).alias("score"))))
    first = F.slice(F.filter("past", lambda h: h["score"] > 0), 1, 5)
    best = told.select("id", "client_key", F.struct(*own).alias("own"), F.array_max(F.transform("past", lambda h: h["score"])).alias("best"), F.when(F.col("block").isNotNull(), first).alias("first"))
    best = best.groupBy("id", "client_key").agg(F.first("own").alias("own"), F.max("best").alias("best"), F.collect_list("first").alias("first"))
    matched = F.transform(F.slice(F.array_sort(F.flatten("first")), 1, 5), lambda h: F.struct(h["title"].alias("title"), h["result"].alias("result"), h["score"].alias("score")))
    return best.select("id", "client_key", "own.*", _rounded(F.coalesce("best", F.lit(0.0))).alias("history_score"), matched.alias("matched_history"))


def scores(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """pairs with the hits, keyword, history and the blended score; `vector`, if there, is a likeness or null."""
    hits = pairs.withColumns({
        "topic_hits": F.array_sort(F.array_intersect("topic_set", "wanted")), "technology_hits": F.array_sort(F.filter("technologies", lambda t: F.contains(F.col("body"), t))),
        "type_hit": F.arrays_overlap("accepted_types", "type_set"), "sector_hit": F.coalesce(F.contains("body", "sector"), F.lit(False)), "unwanted_hit": F.arrays_overlap("unwanted", "topic_set"),
    })
    n, m = (F.greatest(F.size(c), F.lit(1)) for c in ("wanted", "technologies"))
    flat = F.col("type_hit").cast("int") * 1500 + F.col("sector_hit").cast("int") * 1000 - F.col("unwanted_hit").cast("int") * 2000
    keyword = (F.size("topic_hits") * 4500 * m + F.size("technology_hits") * 3000 * n + flat * n * m) / (n * m)

    hits = remembered(hits.withColumn("keyword", _rounded(keyword)), blocks)
    plain = F.col("keyword") * 75 + F.col("history_score") * 25
    if "vector" in pairs.columns:
        plain = F.greatest(plain, F.when(F.col("vector").isNotNull(), F.col("keyword") * 45 + F.col("vector") * 35 + F.col("history_score") * 20))
    warned = F.exists("checks", lambda c: ~F.startswith(c, F.lit("quality warning:")))
    return hits.withColumn("score", _rounded((plain + F.col("surety") * 5 - F.when(warned, 50_000).otherwise(0) - F.when(F.col("unwanted_hit"), 200_000).otherwise(0)) / 100))


def explanation(remembered: Column | None = None) -> Column:
    """Why a scored pair fits, in words; `remembered` says whether an application does, without matched_history."""
    join = lambda c: F.array_join(c, ", ")
    parts = F.array_compact(F.array(
        F.when(F.size("topic_hits") > 0, F.concat(F.lit("topic fit: "), join("topic_hits"))), F.when(F.size("technology_hits") > 0, F.concat(F.lit("technology fit: "), join("technology_hits"))),
        F.when(F.col("type_hit"), "applicant type fit"), F.when(F.size("matched_history") > 0 if remembered is None else remembered, "similar application history"),
    ))
    return F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise("basic shortlist score passed")


def report(scored: DataFrame) -> DataFrame:
    """scored with `explanation_text` and `risks`, as a person would be told."""
    reasons = F.array_compact(F.array(
        F.when(F.size("topic_hits") > 0, F.concat(F.lit("topic overlap: "), F.array_join("topic_hits", ", "))), F.when(F.size("technology_hits") > 0, F.concat(F.lit("technology overlap: "), F.array_join("technology_hits", ", "))),
        F.when(F.size("matched_history") > 0, "similar previous application history"),
    ))
    text = F.when(F.size(reasons) > 0, F.array_join(reasons, "; ")).otherwise("match passed deterministic shortlist filters")
    risks = F.concat_ws(" ", F.when(F.col("score") < 3000, "Low overall score; review fit before prioritising."), F.when(F.size("checks") > 0, "Some fields need manual verification."))
    return scored.withColumns({"explanation_text": F.concat(F.lit("Candidate match because "), text, F.lit(".")), "risks": F.when(risks == "", "No major deterministic risks detected.").otherwise(risks)})


def match(opportunities: DataFrame, clients: DataFrame, as_of: str, include_low_quality: bool = False, least_quality: int = MIN_QUALITY, least: int = MIN_SCORE, near: DataFrame | None = None, seen: Observation | None = None, applications: DataFrame | None = None) -> DataFrame:
    """The pairs that pass all gates and reach the least score, with hits, checks and explanation.

    Opportunities that no client can take leave before the join. An opportunity or a client without any list pairs
    with none; both tables may be empty. `near` adds pairs (id, client_key, vector) that are alike by embedding, such
    as each client's nearest opportunities; their vector_score then counts too. After an action `seen` holds the number of pairs scored (`records`) and
    of those under the least score (`low`).
    """
    open_to_some = opportunity_gates(opportunities, as_of, include_low_quality, least_quality).filter(F.size("reasons") == 0)
    kept = open_to_some.select("id", "reasons", "checks", "body", "topic_set", "country_set", "type_set", "restricted", "nonprofit_only", "surety")
    sides = client_sides(clients.drop("history"))
    past = in_rows(clients) if applications is None else applications
    both = candidates(kept, sides, past)
    if near is not None:
        both = both.join(near.select("id", "client_key", "vector").dropDuplicates(["id", "client_key"]), ["id", "client_key"], "full")
    pairs = both.join(kept, "id").join(sides, "client_key").transform(pair_gates).filter("passed")
    return counted(scores(pairs, in_blocks(past)), seen, F.count_if(F.col("score") < least).alias("low")).filter(F.col("score") >= least).withColumn("explanation", explanation())
