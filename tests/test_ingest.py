"""Payloads, evidence, tables in buckets, saving of fetched records, and the stateful stream."""

import glob
import hashlib
import json
import os
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F
from test_operators import values

from tidemark.functions import payload, rules
from tidemark.operators import enrich, ingest
from tidemark.operators.tables import Keyed
from tidemark.streaming import incremental

SOURCE = rules.ATTRIBUTE_SOURCES[0]


def test_canonical_text_and_hash(spark):
    texts = ['{"b": 1, "a": {"d": [1, {"z": null, "y": "é"}], "c": 1.50}}', '{"a":{"c":1.5,"d":[1,{"y":"é","z":null}]},"b":1}', '{"a":{"c":1.5,"d":[{"y":"é","z":null},1]},"b":1}', "no json", "", None, "[" * 100_000]
    got = values(spark, payload.canonical, texts)
    assert got[0] == got[1] == '{"a":{"c":1.5,"d":[1,{"y":"é","z":null}]},"b":1}' and got[2] != got[0] and got[3:6] == ['"no json"', '""', None] and len(got[6]) == 100_002
    hashes = values(spark, payload.content_hash, texts)
    assert hashes[0] == hashes[1] == hashlib.sha256(got[0].encode()).hexdigest() and len({*hashes[1:]}) == 6 and hashes[5] is None
    variant = spark.createDataFrame([(texts[0],)], "t string").select(payload.as_json(F.parse_json("t"), "variant").alias("j"))
    assert [r.h for r in variant.select(payload.content_hash(F.col("j")).alias("h")).collect()] == [hashes[0]]


def test_leaves_deadlines_budgets_and_attributes(spark):
    body = {"a": [{"deadlineDates": ["2026-05-06", "2025-01-01"]}, {"x": True, "y": None}], "note": "the deadline is 01.02.2027 or 3/4/2026", "budgetOverview": '{"budgetTopicActionMap":{"1":[{"minContribution":1000,"maxContribution":5000}]}}'}
    texts = [json.dumps(body), '{"date": "2026-01-01"}', "deadline 2026-07-08", None]
    found = values(spark, payload.leaves, texts)
    assert [(x.path, x.value) for x in found[0]][:3] == [("a deadlineDates", "2026-05-06"), ("a deadlineDates", "2025-01-01"), ("a x", "True")] and found[3] is None
    dates = values(spark, lambda c: payload.deadline(payload.leaves(c), F.lit("2026-01-01")), texts)
    assert [d and d.deadline for d in dates] == [date(2026, 4, 3), None, date(2026, 7, 8), None]
    assert dates[0].deadline_text == rules.PAYLOAD_DEADLINES + "2025-01-01, 2026-04-03, 2026-05-06, 2027-02-01"
    assert values(spark, lambda c: payload.deadline(payload.leaves(c), F.lit("2030-01-01")), texts)[0].deadline == date(2027, 2, 1)
    assert values(spark, lambda c: payload.budget(payload.leaves(c)), texts) == [body["budgetOverview"], None, None, None]
    stated = {"serviceAttributes": [{"key": "other", "value": "x"}, {"categoryAttribute": {"attribute": {"translations": [{"title": "Сума"}], "name": "n"}}, "value": "15 000"}, {"key": "Currency", "value": " EUR "}, {"key": "amount"}, 5]}
    named = values(spark, payload.attributes, [json.dumps({"deep": [stated]}), "[]", None])
    assert [(a.name, a.value) for a in named[0]] == [("other", "x"), ("Сума", "15 000"), ("n", "15 000"), ("Currency", " EUR ")] or {(a.name, a.value) for a in named[0]} == {("other", "x"), ("Сума", "15 000"), ("n", "15 000"), ("Currency", " EUR ")}
    assert values(spark, lambda c: payload.attribute(payload.attributes(c), rules.AMOUNT_ATTRIBUTES), [json.dumps(stated)]) == ["15 000"]


ROWS = "id int, source string, title string, text string, source_url string, payload string, amount_text string, program string, support_type string, status string"


def test_sums_and_deadlines_by_precedence_with_evidence(spark):
    stated = json.dumps({"serviceAttributes": [{"key": rules.AMOUNT_ATTRIBUTES[0], "value": "up to 20 000"}, {"key": "currency", "value": "EUR"}]})
    budget = json.dumps({"metadata": {"frameworkProgramme": [{"label": "Horizon"}]}, "budgetOverview": '{"maxContribution": 7000}', "deadlineDates": ["2026-03-04"]})
    words = "Funding of EUR 1 000 for startups in Ukraine. Deadline: 5 March 2026. Eligible applicants are small business. " * 3
    rows = [
        (1, SOURCE, "Login", words, "https://x.org/green_energy-fund", stated, None, None, None, None), (2, rules.PROGRAM_SOURCES[0], "A call", words, "u", budget, None, "123", None, None), (3, "s", "A call for all", words, "u", None, None, None, None, None),
        (4, SOURCE, "A programme", "Програма: подати заявку постійно", "u", None, None, None, "loan", "unknown"), (5, SOURCE, "A programme", "архів, подати заявку", "u", None, None, None, "loan", None), (6, "s", None, None, None, "no json", None, None, None, None),
    ]
    got = {r.id: r for r in enrich.enrich(spark.createDataFrame(rows, ROWS), "2026-01-01").collect()}
    assert (got[1].amount_min, got[1].amount_max, got[1].currency, got[1].amount_text) == (None, Decimal("20000.00"), "EUR", "up to 20 000")
    assert (got[2].amount_max, got[2].amount_text, got[2].program, got[2].deadline) == (Decimal("7000.00"), "EUR 7 000", "Horizon", date(2026, 3, 4))
    assert (got[3].amount_max, got[3].currency, got[3].deadline, got[3].program) == (Decimal("1000.00"), "EUR", date(2026, 3, 5), None)
    assert [got[k].status for k in (4, 5, 6)] == ["open", "unknown", "unknown"]
    one = got[1].fields
    assert (one["title"].method, one["title"].confidence, one["title"].evidence) == ("deterministic", "0.9000", "Green energy fund") and one["title_from_url"].evidence == "https://x.org/green_energy-fund"
    assert one["applicant_types"].confidence == "0.7000" and one["eligibility_text"].confidence == "0.6200" and one["deadline_at"].confidence == "0.8500" and one["status_normalized"].evidence if "status_normalized" in one else True
    assert got[2].fields["program_name"].evidence == "Horizon" and got[2].fields["deadline_at"].evidence == rules.PAYLOAD_DEADLINES + "2026-03-04" and got[4].fields["status"].confidence == "0.6800"
    assert all(len(e.evidence or "") <= 500 and len(e.confidence) == 6 for r in got.values() for e in r.fields.values())
    filled = {"summary": "summary", "deadline": "deadline_at", "amount_text": "funding_amount", "eligibility": "eligibility_text"}
    assert all(name in r.fields for r in (got[1], got[2], got[3]) for c, name in filled.items() if r[c] is not None) and set(got[6].fields) <= {"title", "status", "support_type_normalized", "opportunity_type_normalized", "status_normalized"}


def files_of(path):
    return {os.path.relpath(f, path): os.path.getmtime(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_writes_touch_only_their_buckets(spark, tmp_path):
    table = Keyed(spark, str(tmp_path / "t"), "id long, name string, v string", ["id", "name"], buckets=16)
    assert table.read().count() == 0
    table.upsert(spark.range(200).select("id", F.when(F.col("id") % 7 > 0, "a").alias("name"), F.lit("old").alias("v")))
    before = files_of(table.path)
    assert len({os.path.dirname(f) for f in before}) == 16
    new = spark.createDataFrame([(3, "a", "new"), (7, None, "new"), (900, "a", "new")], "id long, name string, v string")
    touched = table.upsert(new)
    after = files_of(table.path)
    kept = {f for f in before if int(os.path.dirname(f).split("=")[1]) not in touched}
    assert 1 <= len(touched) <= 3 and all(after.get(f) == before[f] for f in kept) and not any(f in after for f in before.keys() - kept)
    rows = {(r.id, r.name): r.v for r in table.read().collect()}
    assert len(rows) == 201 and {k for k, v in rows.items() if v == "new"} == {(3, "a"), (7, None), (900, "a")}
    table.insert_missing(spark.createDataFrame([(3, "a", "x"), (7, None, "x"), (901, None, "x"), (901, None, "x")], "id long, name string, v string"))
    added = files_of(table.path)
    assert all(added.get(f) == t for f, t in after.items()) and len(added) == len(after) + 1 and table.read().count() == 202
    table.compact()
    assert len(files_of(table.path)) == 16 and table.read().count() == 202 and table.upsert(new.limit(0)) == []


def test_fetched_records_are_saved_once(spark, tmp_path):
    snapshots, records = Keyed(spark, str(tmp_path / "s"), ingest.SNAPSHOT, ["source", "source_url", "content_hash"], 4), Keyed(spark, str(tmp_path / "r"), ingest.RECORD, ["id"], 4)
    kind = "source string, source_url string, record_id string, title string, text string, payload string, position int"
    first = spark.createDataFrame([("a", "https://x/1", "r1", "Award for energy", "text " * 30, '{"k": 1, "j": 2}', 0), ("a", "https://x/1", "r1", "Later in the list", "t", None, 1), ("a", "https://x/2", None, "Second award", "t", None, 2), (None, "https://x/3", None, "No source", "t", None, 3), ("a", " ", None, "No address", "t", None, 4)], kind)
    assert ingest.save(first, snapshots, records, "2026-01-01") == {"created": 2, "updated": 0, "rejected": 2}
    ids = {r.url: (r.id, r.title) for r in records.read().collect()}
    assert ids["https://x/1"][1] == "Award for energy" and snapshots.read().count() == 3
    assert ingest.save(first, snapshots, records, "2026-01-02") == {"created": 0, "updated": 2, "rejected": 2} and snapshots.read().count() == 3
    again = spark.createDataFrame([("a", "https://x/moved", "r1", "Award for energy", "text " * 30, '{"j": 2, "k": 1}', 0), ("b", "https://x/2", None, "Other source", "t", None, 1)], kind)
    assert ingest.save(again, snapshots, records, "2026-01-03") == {"created": 1, "updated": 1, "rejected": 0}
    rows = records.read().collect()
    assert len(rows) == 3 and {r.id for r in rows if r.record_id == "r1"} == {ids["https://x/1"][0]} and snapshots.read().count() == 5
    assert ingest.save(first.limit(0), snapshots, records, "2026-01-04") == {"created": 0, "updated": 0, "rejected": 0}


def event(key, what, at, status=None, deadline=None):
    return {"source": "s", "key": key, "event": what, "at": f"2026-01-{at:02d}T00:00:00Z", "status": status, "deadline": deadline}


def test_stream_tells_items_apart_over_a_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    out = []

    def land(n, rows):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(r) for r in rows))
        query = incremental.run(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda df, _: out.extend((r.key, r.action, r["at"].day) for r in df.collect()))
        assert query.awaitTermination(120)

    land(0, [event("a", "listed", 1), event("b", "listed", 1), event("c", "listed", 1), event("a", "fetched", 2, "open", "2026-06-01"), event("b", "fetched", 2, "unknown"), event("c", "fetched", 2, "closed")])
    assert sorted(out) == [("a", "fetch_new", 1), ("b", "fetch_new", 1), ("c", "fetch_new", 1)]
    del out[:]
    land(1, [event("a", "listed", 5), event("b", "listed", 16), event("c", "listed", 16), event("d", "listed", 16)])
    found = {(k, a) for k, a, _ in out}
    assert {("a", "skip"), ("b", "refresh"), ("c", "skip"), ("d", "fetch_new")} <= found
    land(2, [event("d", "listed", 20)])
    assert ("a", "refresh") in {(k, a) for k, a, _ in out}  # due on the ninth and not listed since
    assert len([1 for k, a, _ in out if (k, a) == ("a", "refresh")]) == 1
