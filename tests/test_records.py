"""Field reading, classes, the contract, audits, external answers and full matching on small inline tables."""

from datetime import date
from decimal import Decimal

from pyspark.sql import Observation
from pyspark.sql import functions as F
from test_operators import values

from tidemark.functions import extraction as x
from tidemark.functions import rules, text
from tidemark.operators import audit, classification, dedup, enrich, external, gates, profiles, quality, reports


def d(v):
    return None if v is None else Decimal(v).quantize(Decimal("0.01"))


def test_deadlines(spark):
    texts = ["Apply now. Deadline: 5 March 2026 at noon", "x " * 200 + "дедлайн 12 березня 2026 року", "published 01.02.2026. Deadline soon. deadline 3/4/2026 final", "until 2026-05-06", "y " * 200 + "2026-05-06", "подати до 31.12.2026, deadline 1 May 2027", "", None]
    got = values(spark, x.deadline, texts)
    assert [r.deadline for r in got] == [date(2026, 3, 5), date(2026, 3, 12), date(2026, 4, 3), date(2026, 5, 6), None, date(2027, 5, 1), None, None]
    assert got[2].deadline_text.startswith("Deadline soon") and got[3].deadline_text is None
    assert values(spark, text.to_date, ["1st May 2026", "Sept. 3rd, 2026", "31 лютого 2026", "mayor 5, 2026"]) == [date(2026, 5, 1), date(2026, 9, 3), None, None]


def test_money(spark):
    assert values(spark, x.amount_text, ["from 100 and EUR 15 000 to spend", "1234 people", "none", None]) == ["EUR 15 000", "1234", None, None]
    assert values(spark, x.clean_amount_text, ["Budget: <b>EUR 5 000</b> 01.02.2026", "2026 EUR", '{"budgetTopicActionMap":{}}', None, "", "7" * 400]) == ["EUR 5 000", None, None, None, None, "7" * 300]
    sums = values(spark, x.amounts, ["up to €15,000.50 and 2.5 million", "NACE 01.11 EUR", "year 2026 award EUR 500", "funding 20000 for 30 people", "20 тис. грн, 5 March", "EUR " + "9" * 17, "", None])
    assert sums == [[d("15000.50"), d("2500000")], [], [d("500")], [d("20000")], [d("20000"), d("5")], [], None, None]
    got = values(spark, x.funding, ["up to €15,000", "EUR 1 000 - 5 000", '{"minContribution":"1000","maxContribution": 5000}', "budget 500", "award of $100", "plain", "{}", '{"a": [{"maxContribution": 100}, {"minContribution": 500, "maxContribution": 1000}]}', None])
    assert [r and (r.amount_min, r.amount_max, r.currency) for r in got] == [(None, d("15000"), "EUR"), (d("1000"), d("5000"), "EUR"), (d("1000"), d("5000"), "EUR"), (None, None, None), (d("100"), d("100"), "USD"), None, None, (d("100"), d("1000"), "EUR"), None]
    far = "word " * 5000 + "€ 70 000 " + "word " * 5000
    assert values(spark, x.amounts, [far]) == [[d("70000")]]


def test_titles_and_kinds(spark):
    assert values(spark, x.funder_in_title, ["Call (deadline 2026) (USAID)", "A (B C)", "none", None]) == ["USAID", "B C", None, None]
    assert values(spark, lambda c: x.repaired_title(F.lit("Login"), c), ["https://x.org/programs/green-energy_fund/?q=1", "https://x.org/all", None]) == ["Green energy fund", "Login", "Login"]
    assert values(spark, lambda c: x.support_type(c, F.lit("plain")), ["loan for an award", "odd kind", None, ""]) == ["loan", "odd kind", None, None]
    assert values(spark, lambda c: text.snippet(c, ["eligible"]), ["a" * 300 + " Eligible: all", "none", None]) == ["a" * 119 + " Eligible: all", None, None]


OFFICIAL = rules.OFFICIAL_SOURCES[1]
EMPTY = next(s for s, f in rules.FAMILY_BY_SOURCE.items() if f == "empty_or_problem")
RAW = [
    (1, OFFICIAL, "Funding for startups in Kyiv (USAID)", "Ukraine startups can apply. Deadline: 5 March 2026. Funding: up to EUR 50 000. Eligible applicants are small business. Not eligible: military.", "https://a.org/1"),
    (2, None, None, None, None), (3, EMPTY, "Дайджест новин", "коротко", "http://b"), (3, EMPTY, "Дайджест новин", "коротко", "http://b"),
]


def raw(spark, rows=RAW):
    return spark.createDataFrame(rows, "id int, source string, title string, text string, source_url string")


def test_enrich_and_grade(spark):
    seen = Observation()
    e = enrich.enrich(raw(spark), "2026-01-01", seen)
    one, none, digest, again = sorted(e.collect(), key=lambda r: r.id)
    assert (one.status, one.deadline, one.currency, one.amount_min, one.amount_max) == ("open", date(2026, 3, 5), "EUR", None, d("50000"))
    assert (one.funder, one.support_type, one.opportunity_type, one.countries, one.regions) == (rules.FUNDERS_BY_SOURCE[OFFICIAL], None, None, ["Ukraine"], [])
    assert one.applicant_types == ["SME", "startup", "company"] and not one.needs_manual_review and digest == again
    assert none.title == "Untitled opportunity" and none.needs_manual_review and none.confidence == Decimal("0.2000") and none.topics == []
    assert none.review_reason == "generic title; very short extracted text; no applicant/topic taxonomy detected"
    assert seen.get["records"] == 4 and seen.get["to_review"] == 3
    c = classification.contract(classification.classify(e)).orderBy("id").collect()
    assert [(r["class"], r.quality_tier, r.eligible) for r in c[:3]] == [(rules.DIRECT_CLASS, "usable_with_warnings", True), ("unknown", "needs_review", False), ("digest", "noise_rejected", False)]
    assert c[1].blockers == ["missing_source_url", "missing_context_text", "needs_manual_review", "low_extraction_confidence"] and not c[1].core_complete
    assert c[2].review_rules == ["explicit_manual_review", "low_extraction_confidence", rules.NOISE_RULE]
    assert enrich.enrich(raw(spark, []), "2026-01-01").count() == 0 and quality.score(classification.contract(classification.classify(e))).count() == 4
    a = audit.audited(e).withColumn("ok", audit.approved(e)).orderBy("id").collect()
    assert [r.ok for r in a[:3]] == [True, False, False] and a[0].weak_reasons == [] and a[2].noise_reasons == ["possible_digest", "possible_news"]
    assert [r.id for r in external.work_list(e).collect()] == []


def test_stated_classes(spark):
    rows = [("Tender of services", "Business-Support", None), ("Tender of services", "odd", None), ("An award for music", "unknown", "news"), ("Online webinar on law", None, None), ("A tender with funding", None, None), (None, None, None)]
    got = classification.classify(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, title string, opportunity_type string, support_type string")).orderBy("id").collect()
    assert [r["class"] for r in got] == ["business_support", "tender", rules.DIRECT_CLASS, "webinar", rules.DIRECT_CLASS, "unknown"]


def test_external_answers(spark):
    bodies = ['{"summary":"S","topics":["a","a","b"],"classification":"Business support","confidence":0.8}', '{"topics":"x","confidence":2}', "nope", None, "[1]", '{"summary":"S","confidence":0.3}', '{"confidence":0.9}']
    got = external.checked(spark.createDataFrame(list(enumerate(bodies, 1)), "id int, body string"))
    rows = got.orderBy("id").collect()
    assert [r.valid for r in rows] == [True] + [False] * 6 and rows[0].result.topics == ["a", "b"] and rows[0].result.classification == "business_support"
    assert rows[1].errors == ["topics must be a list", "confidence must be a number between 0 and 1", "result has no supported extraction fields"]
    assert [rows[k].errors for k in (2, 3, 4)] == [["result must be a JSON object"]] * 3 and rows[5].errors == [] and rows[6].errors == ["result has no supported extraction fields"]
    merged = external.merged(enrich.enrich(raw(spark, RAW[:3]), "2026-01-01"), got).orderBy("id").collect()
    assert merged[0].topics[-2:] == ["a", "b"] and merged[0].applied_fields == ["topics", "stated_class"] and merged[1].applied_fields == []


HISTORY = "array<struct<title:string,program:string,source:string,result:string,topics:array<string>,applicant_type:string,reusable:boolean,weight:int>>"


def test_gates(spark):
    offers = [
        (1, "Energy award", ["Energy"], ["SME"], ["EU"], None, "open", date(2026, 5, 1), False), (2, "Energy award closed", ["energy"], ["SME"], [], None, "closed", date(2026, 5, 1), False), (3, "Energy award late", ["energy"], [], [], None, "open", date(2025, 5, 1), False),
        (4, "Energy award here", ["energy"], ["NGO"], [], None, "open", None, False), (5, "Energy award barred", ["energy"], [], [], "An sme is not eligible", "open", None, False), (6, "Solar panel award", ["sun"], None, None, None, "open", None, False), (7, "Energy award again", ["energy"], [], [], None, "open", None, True),
    ]
    table = spark.createDataFrame([(*o, "http://a", 1 if o[8] else None) for o in offers], "id int, title string, topics array<string>, applicant_types array<string>, countries array<string>, restrictions string, status string, deadline date, is_duplicate boolean, source_url string, primary_id int")
    past = [("Solar panel", None, None, "won", ["solar"], None, True, None)]
    clients = [(1, "A", "Ukraine", "farming", "small firm", None, ["energy"], None, ["solar"], past), (2, "B", None, None, None, None, None, None, None, None)]
    people = spark.createDataFrame(clients, f"client_key int, client string, country string, sector string, organization_type string, product string, wanted array<string>, unwanted array<string>, technologies array<string>, history {HISTORY}")
    ready = classification.contract(classification.classify(table))
    reasons = {r.id: [c for c in r.reasons] for r in gates.opportunity_gates(ready, "2026-01-01").collect()}
    assert reasons[1] == [] and reasons[2] == [rules.CLOSED_REASON] and reasons[3] == ["deadline_passed"] and reasons[7] == [f"{rules.DUPLICATE_REASON}1"]
    got = {r.id: r for r in gates.report(gates.match(ready, people, "2026-01-01")).collect()}
    assert set(got) == {1, 6} and got[1].client == "A"
    # topic 0.45 and type 0.15, times 0.75; reusable material 0.15, times 0.25; a check for the EU takes 0.05
    assert (got[1].keyword, got[1].history_score, got[1].score) == (6000, 1500, 4375)
    assert got[1].explanation == "topic fit: energy; applicant type fit; similar application history" and got[1].explanation_text == "Candidate match because topic overlap: energy; similar previous application history."
    # technology 0.30, times 0.75; its history has the title in the text and reusable material, 0.40, times 0.25
    assert (got[6].keyword, got[6].history_score, got[6].score) == (3000, 4000, 2750) and got[6].risks.startswith("Low overall score")
    assert gates.match(ready.limit(0), people, "2026-01-01").count() == 0 and gates.match(ready, people.limit(0), "2026-01-01").count() == 0


def test_duplicate_marks(spark):
    rows = [(1, "Green energy fund", "https://x.org/1"), (2, "Green energy fund", "https://x.org/1"), (3, "Other thing here", "https://x.org/3"), (4, None, None)]
    records = spark.createDataFrame(rows, "id long, title string, source_url string").withColumns({"funder": F.lit(None).cast("string"), "program": F.lit(None).cast("string"), "currency": F.lit(None).cast("string"), "deadline": F.lit(None).cast("date"), "amount_max": F.lit(None).cast("decimal(14,2)"), "topics": F.array().cast("array<string>")})
    got = {r.id: r for r in dedup.annotate(records.select("id"), dedup.candidates(records), []).collect()}
    assert (got[1].is_duplicate, got[1].primary_id, got[2].is_primary, got[2].candidate_count) == (True, 2, True, 1)
    assert not got[3].is_duplicate and got[4].candidate_count == 0 and got[4].group_id is None


def test_vectors_profiles_and_ledger(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], [[0.0, 1.0], [1.0, 1.0]]), ([1.0, 0.0], [-1.0, 0.0], []), (None, [1.0, 0.0], None), ([0.0, 0.0], [1.0, 0.0], None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a array<double>, b array<double>, p array<array<double>>")
    assert [r.v for r in df.select("k", gates.vector_score(F.col("a"), F.col("b"), F.col("p")).alias("v")).orderBy("k").collect()] == [9414, 0, None, None]
    record = spark.createDataFrame([("T", None, "5 EUR", [], ["a", "b"]), (None, None, None, None, None)], "title string, summary string, amount_text string, countries array<string>, topics array<string>")
    assert [r.t for r in record.select(profiles.profile_text(record, profiles.RECORD).alias("t")).collect()] == ["Title: T Funding: 5 EUR Countries: Topics: a, b", "Countries: Topics:"]
    bodies = ['{"deadlineDates": ["2025-01-01", "2026-05-06", "2026-03-04"], "other": "2026-01-05"}', '{"a": {"deadline": "1 May 2024"}}', '{"date": "2026-01-01"}', "no json", None]
    assert values(spark, lambda c: x.payload_deadline(c, F.lit("2026-01-01")), bodies) == [date(2026, 3, 4), date(2024, 5, 1), None, None, None]
    jobs = spark.createDataFrame([(k, "failed" if k % 2 else "ok") for k in range(60)], "id int, status string")
    run = reports.run_summary(jobs, "status", ["failed"], ["skipped"], "id", F.col("id").cast("string")).first()
    assert (run.processed, run.failed, run.status, run.errors[:3], len(run.errors)) == (60, 30, "partial", ["1", "3", "5"], 20)
    assert reports.run_summary(jobs.limit(0), "status", ["failed"], [], "id", F.col("id").cast("string")).first().status == "success"
