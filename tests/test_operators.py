"""Operators on small inline tables."""

import itertools
import json
import random
from datetime import date, datetime
from decimal import ROUND_HALF_UP, Decimal
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import rules, text
from tidemark.operators import blocks, change, classification, dedup, graph, quality
from tidemark.plans import list_queries
from tidemark.sources import files
from tidemark.streaming import ingest


def values(spark, function, inputs, kind="string"):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(inputs)], f"k int, x {kind}").select("k", function(F.col("x")).alias("y"))
    return [r.y for r in df.orderBy("k").collect()]


def test_texts(spark):
    assert values(spark, text.clean_text, ["  a  b\n", "", None, "x &amp; y"]) == ["a b", None, None, "x & y"]
    urls = ["HTTPS://Example.org/a/?b=2&utm_source=x&a=1&FBCLID=3#top", "http://x.org", "not an address", None, "https://x.org/?q="]
    assert values(spark, text.canonical_url, urls) == ["https://example.org/a?a=1&b=2", "http://x.org/", "not an address", None, "https://x.org/?q="]
    assert values(spark, text.normalized_title, ["The Call for Green Energy (2026)", None, "Конкурс для громад"]) == ["green energy", "", "громад"]
    assert values(spark, text.currency, ["100 eur", "C$ 5", "$5", "сто грн", "none"]) == ["EUR", "CAD", "USD", "UAH", None]
    assert values(spark, text.to_amount, ["1 234,50", "1.234,50", "1,234.50", "20.000", "x"]) == [Decimal("1234.50")] * 3 + [Decimal("20000.00"), None]
    dates = ["due 31.12.2026", "5.3.26", "2026-02-30", "March 5, 2026", "5 March 2026", "soon", None]
    assert values(spark, text.to_date, dates) == [date(2026, 12, 31), date(2026, 3, 5), None, date(2026, 3, 5), date(2026, 3, 5), None, None]
    assert values(spark, text.slug, ["Ab c--D!", "Її"]) == ["ab-c-d", ""]
    assert values(spark, lambda c: text.merge_lists(c, F.array(F.lit("B"), F.lit("c"))), [["a", "b", " A "], None], "array<string>") == [["a", "b", "c"], ["B", "c"]]


def graded(df):
    return quality.score(classification.contract(classification.classify(df))).orderBy("title").collect()


def test_grades(spark):
    """Scores by hand: every part of a full record, and a noisy one; the tier stays the contract's."""
    names = "title string, summary string, description string, status string, deadline date, funder string, amount_max decimal(14,2), amount_text string, currency string, countries array<string>, regions array<string>, eligibility string, application_url string, published_at date, source_url string, program string, keywords array<string>, restrictions string, documents array<string>, source string, confidence decimal(5,4), needs_manual_review boolean, stated_class string, is_duplicate boolean"
    structured = next(s for s, f in rules.FAMILY_BY_SOURCE.items() if f == "structured_direct")
    digest = next(s for s, f in rules.FAMILY_BY_SOURCE.items() if f == "digest_heavy")
    rich = ("A fine funding programme", "s" * 90, "d" * 300, "open", date(2026, 1, 1), "F", Decimal("5"), "EUR 5", "EUR", ["UA"], ["Kyiv"], "all", "http://a", date(2025, 1, 1), "http://b", "P", ["k"], "r", ["doc"], structured, Decimal("0.9"), False, None, False)
    noise = ("News of the day", None, None, "unknown", *[None] * 10, "http://c", *[None] * 4, None, None, True, "news", False)
    # no class in its text, from a source whose records are often none: to review, though it has all core fields
    unsure = ("Something unclear", "words", None, "closed", *[None] * 10, "http://d", *[None] * 4, digest, Decimal("0.4"), False, None, True)
    got = {r.title: r for r in graded(spark.createDataFrame([rich, noise, unsure], names))}
    one = got["A fine funding programme"]
    assert (one.quality_score, one.quality_tier, one.matching_ready, one.penalties) == (100, "match_ready", True, {})
    assert one.components["advanced_fields"] == 5 and one.components["source_family"] == 10 and sum(one.components.values()) == 100
    two = got["News of the day"]
    # 10 title, 10 address, 10 status, 2 unknown status, 5 family; 60 noise, 15 review
    assert (two.quality_score, two.quality_tier, two.matching_ready) == (0, "noise_rejected", False) and two.penalties == {"penalty_noise_classification": 60, "penalty_manual_review": 15}
    three = got["Something unclear"]
    # 40 core, 2 family; 10 uncertain, 10 confidence, 10 duplicate
    assert (three.quality_score, three.quality_tier, three.eligible) == (12, "needs_review", False)


FIELDS = "id long, title string, source_url string, application_url string, funder string, program string, deadline date, deadline_text string, amount_max decimal(14,2), amount_text string, currency string, topics array<string>, countries array<string>, source string, updated_at timestamp"


def record(id, title, source_url=None, **more):
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return tuple({"id": id, "title": title, "source_url": source_url, **more}.get(n) for n in names)


def all_pairs(spark, records):
    """Every pair scored without blocks."""
    ready = dedup.prepare(records)
    side = lambda s: ready.select(F.col("id").alias(f"{s}_id"), F.col("place").alias(f"{s}_place"), *(F.col(c).alias(f"{s}_{c}") for c in dedup.FEATURES))
    return dedup.score_pairs(side("left").crossJoin(side("right")).filter("left_place < right_place"))


def test_pair_scores_by_hand(spark):
    a, b = rules.LINKED_SOURCES
    rows = [
        record(1, "Green energy fund for rural towns", funder="Fund", program="P1", currency="EUR", topics=["Energy"], source="s"), record(2, "Green energy fund for rural towns", funder="fund ", program="p1", currency="EUR", topics=["energy", "x"], source="s"),
        record(11, "Solar roofs for schools", "https://x.org/1?utm_source=a"), record(12, "Wind parks", application_url="https://X.org/1/", deadline_text="Each  year", amount_text="5 EUR"), record(13, "Solar roofs in school", "https://y.org", deadline_text="each year", amount_text="5 eur"),
        record(21, "Water network repairs programme 2026", source=a, deadline=date(2026, 5, 1), amount_max=Decimal(5), currency="EUR"), record(22, "Water network repair 2026", source=b, deadline=date(2026, 5, 1), deadline_text="other", amount_max=Decimal(5)),
        record(31, "One", "https://z.org"), record(32, "Two", "https://z.org", countries=["UA"]), record(41, "Same word"), record(42, "Same thing"), record(51, None), record(52, ""),
    ]
    got = {(r.left_id, r.right_id): (str(r.score), r.reasons) for r in all_pairs(spark, spark.createDataFrame(rows, FIELDS)).collect()}
    # 0.45 title, 0.10 funder, 0.08 program, 0.03 currency, 0.04 topic, 0.05 source
    assert got[1, 2] == ("0.7500", ["exact_normalized_title", "same_funder", "same_program", "same_currency", "taxonomy_overlap:energy", "same_source_similar_title"])
    assert got[11, 12] == ("0.5500", ["same_canonical_or_application_url"]) and got[31, 32][0] == "0.5500"
    assert got[12, 13] == ("0.2300", ["same_deadline", "same_amount_and_currency"]) if (12, 13) in got else True
    # "water network repairs 2026" and "water network repair 2026": 0.40 title, 0.14 deadline, 0.09 amount (one currency unknown), 0.07 linked sources
    assert got[21, 22] == ("0.7000", ["very_similar_title:0.9804", "same_deadline", "same_amount_and_currency", "official_eu_aggregator_pair"])
    assert (51, 52) not in got and all(k[0] < k[1] for k in got)
    assert {(r.left_id, r.right_id) for r in dedup.candidates(spark.createDataFrame(rows, FIELDS)).collect()} == {(1, 2)}


def test_the_later_update_stands_left(spark):
    times = [datetime(2026, 1, k) for k in (1, 3, 2)]
    rows = [record(k, "Green energy fund for rural towns", "https://x.org/1", updated_at=t) for k, t in enumerate(times)] + [record(9, "Green energy fund for rural towns", "https://x.org/1")]
    got = {(r.left_id, r.right_id) for r in dedup.candidates(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got == {(1, 2), (1, 0), (2, 0), (1, 9), (2, 9), (0, 9)}


def test_blocked_duplicates_equal_all_pairs(spark):
    draw = random.Random(4)
    some = lambda *values: draw.choice([None, *values])
    topics = [["energy"], ["Energy", "x"], [], None]
    rows = [
        record(
            k, f"Green energy {draw.choice(['fund', 'funds', 'help'])} number {draw.randint(1, 3)} for {draw.choice(['towns', 'town', 'villages'])}", f"https://x.org/{draw.randint(0, 30)}", funder=some("F", "f "), program=some("P"), currency=some("EUR", "USD"),
            deadline=some(date(2026, 1, 1)), deadline_text=some("soon"), amount_max=some(Decimal(1)), amount_text=some("1 EUR"), topics=draw.choice(topics), countries=draw.choice(topics), source=some("s", *rules.LINKED_SOURCES),
        )
        for k in range(70)
    ] + [record(90, None), record(91, "Open call (2026)", "https://x.org/other")]
    records = spark.createDataFrame(rows, FIELDS)
    want = {(r.left_id, r.right_id): (r.score, r.reasons) for r in all_pairs(spark, records).filter("score >= 0.74").collect()}
    pairs = dedup.candidates(records)
    assert {(r.left_id, r.right_id): (r.score, r.reasons) for r in pairs.collect()} == want and len(want) > 20
    members = dedup.groups(pairs).collect()
    assert all(r.size > 1 for r in members) and len({r.group_id for r in members}) == len({r.root for r in members})


def test_primaries_candidates_and_totals(spark):
    rows = [record(k, "Green energy fund for rural towns", "https://x.org/1", updated_at=datetime(2026, 1, k + 1)) for k in range(8)] + [record(9, "Other thing here", "https://x.org/9")]
    records = spark.createDataFrame(rows, FIELDS).withColumns({"status": F.when(F.col("id") == 3, "open").otherwise("closed"), "summary": F.lit("text")})
    ready = classification.contract(classification.classify(records))
    pairs = dedup.candidates(records)
    marked = dedup.annotate(ready, pairs)
    got = {r.id: r for r in marked.collect()}
    assert {r.primary_id for r in got.values()} == {3, None} and got[3].is_primary and not got[3].is_duplicate and got[3].potential_duplicate and got[0].is_duplicate
    assert [c.other_id for c in got[0].candidates] == [1, 2, 3, 4, 5] and got[0].candidate_count == 7 and got[0].candidates[0].duplicate and got[9].candidates is None
    assert dedup.totals(marked, pairs).first().asDict() == {"processed": 9, "groups": 1, "duplicate_records": 7, "candidates": 28, "duplicate_pairs": 28}
    best = dedup.best_groups(marked, pairs).first()
    assert (best.size, best.primary_id, best.best_score) == (8, 3, Decimal("1.0000")) and len(dedup.best_pairs(pairs).collect()) == 10
    again = {r.id: r.quality_score for r in quality.score(classification.contract(marked.drop("flags", "quality_tier", "eligible", "blockers", "review_rules", "missing_fields", "core_complete"))).collect()}
    before = {r.id: r.quality_score for r in quality.score(ready).collect()}
    assert all(again[k] == max(0, before[k] - 10) for k in range(8)) and again[9] == before[9]


def test_connected_groups(spark):
    chain = [(k, k + 1) for k in range(12)] + [(30, 31), (40, 41), (41, 40)]
    got = {r.id: r.root for r in graph.connected(spark.createDataFrame(chain, "left_id long, right_id long")).collect()}
    assert got == {k: 0 for k in range(13)} | {30: 30, 31: 30, 40: 40, 41: 40}


def test_identity_and_upserts(spark):
    known = spark.createDataFrame([(1, "r1", "u1"), (2, None, "u2"), (3, "r3", None)], "id int, record string, url string")
    items = spark.createDataFrame([("r1", "u2"), (None, "u2"), ("r9", "u9")], "record string, url string")
    assert {(r.record, r.url): r.id for r in change.identify(items, known, ["record", "url"]).collect()} == {("r1", "u2"): 1, (None, "u2"): 2, ("r9", "u9"): None}
    nulls, more = (spark.createDataFrame(x, "id int, k string, v string") for x in ([(1, None, "a"), (2, "x", "b")], [(1, None, "c"), (3, None, "d")]))
    assert sorted(map(tuple, change.upsert(nulls, more, ["id", "k"]).collect()), key=str) == [(1, None, "c"), (2, "x", "b"), (3, None, "d")]
    assert sorted(map(tuple, change.insert_missing(nulls, more, ["id", "k"]).collect()), key=str) == [(1, None, "a"), (2, "x", "b"), (3, None, "d")]
    old, new = (spark.createDataFrame(x, "id int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(map(tuple, change.upsert(old, new, ["id"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, change.insert_missing(old, new, ["id"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_landed_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text('name,country,sector,organization_type,technologies,product_description,risks,target_topics,excluded_topics,source_documents,confidence,extraction_notes\nAcme,UA,energy,sme,a; b;,p,,t1;t2,,d1|d2,,\n,UA,,,,,,,,,,\n')
    got = files.clients(spark, str(tmp_path / "c.csv")).collect()
    assert got[0].slug == "acme" and got[0].technologies == ["a", "b"] and got[0].source_documents == ["d1", "d2"] and got[1].error == "name is missing"
    (tmp_path / "h.csv").write_text(",".join(rules.HISTORY_COLUMNS) + "\nAcme,G,,,2026-01-02,won,,,x;y,,,1.2,,,\nAcme,H,,,bad,,,,,,,,,,\nOther,I,,,,,,,,,,,,,\n")
    rows = files.history(spark, str(tmp_path / "h.csv"), files.clients(spark, str(tmp_path / "c.csv"))).orderBy(rules.HISTORY_COLUMNS[1]).collect()
    assert [r.row_status for r in rows] == ["ok", "failed", "skipped"] and rows[0].topics == ["x", "y"]
    posts = [{"id": 1, "date_gmt": "2026-01-02T03:04:05", "link": "https://x/1", "title": {"rendered": "A <b>fund</b>"}, "excerpt": {"rendered": ""}, "content": {"rendered": "<p>text</p>"}}, {"id": 1, "link": "https://x/2", "title": {"rendered": "fund again"}}, {"id": 2, "link": "https://x/3", "title": {"rendered": "News"}}]
    hits = {"results": [{"id": "7", "content": "T", "metadata": {"identifier": ["X-1"], "status": "OPEN", "keywords": ["a", "b", "a"]}}]}
    raw = spark.createDataFrame([("s", json.dumps(posts)), ("e", json.dumps(hits))], "source string, body string")
    assert [(r.title, r.url) for r in files.posts(raw.filter("source = 's'"), ["fund"]).collect()] == [("A fund", "https://x/1")]
    hit = files.search_results(raw.filter("source = 'e'")).first()
    assert (hit.record_id, hit.status, hit.topics) == ("X-1", "open", ["a", "b"])
    xml = "<rss><channel><item><title>One &amp; two</title><link>https://x/1</link><pubDate>Fri, 02 Jan 2026 10:00:00 +0000</pubDate></item></channel></rss>"
    gap = "<rss><item><title>A</title><link>https://x/a</link></item><item><title><![CDATA[B]]></title><link>https://x/b</link><pubDate>02 Jan 2026 10:00:00 +0000</pubDate></item><item><title>no link</title></item></rss>"
    rows = files.feed(spark.createDataFrame([("s", gap), ("t", ""), ("u", None)], "source string, body string")).orderBy("url").collect()
    assert [(r.title, r.url, r.published_at is None) for r in rows] == [("A", "https://x/a", True), ("B", "https://x/b", False)]
    item = files.feed(spark.createDataFrame([("s", xml)], "source string, body string")).first()
    assert item.title == "One & two" and item.published_at.year == 2026
    site = spark.createDataFrame([("s", "<urlset><url><loc>https://x/a</loc></url><url><loc>https://x/b</loc></url><url><loc>https://x/a</loc></url></urlset>")], "source string, body string")
    assert {(r.url, r.place) for r in files.sitemap(site).collect()} == {("https://x/a", 0), ("https://x/b", 1)}
    page = spark.createDataFrame([("<title>T &amp; U</title><meta property='og:title' content='O'><h1>H</h1><script>x</script><p>one<br>two <a href='/d.pdf'>D</a>", "https://x/y/")], "html string, url string")
    p = page.select(files.read_pages(F.col("html"), F.col("url")).alias("p")).first().p
    assert (p.title, p.heading, p.text, p.metas) == ("T & U", "H", "H one two D", {"og:title": "O"}) and p.links[0].url == "https://x/d.pdf"


def test_stream_lands_each_key_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: ingest.snapshots(spark, str(tmp_path / "in"), "url string, hash string", str(tmp_path / "out"), str(tmp_path / "cp"), ["url", "hash"]).awaitTermination(60)
    for k, rows in enumerate([[("u", "1"), ("u", "1"), ("v", "1")], [("u", "2"), ("v", "1")]]):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"url": u, "hash": h}) for u, h in rows))
        assert run()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("u", "1"), ("u", "2"), ("v", "1")]


def test_only_pairs_in_reach_are_handed_on(spark):
    rows = [record(k, f"Regional fund {k * 7919:08d} help", f"https://x.org/{k}", funder="F", deadline=date(2026, 1, 1), amount_max=Decimal(k), currency="EUR") for k in range(40)]
    rows += [record(40 + k, "Regional fund 10000000 help" + "s" * (k % 2), f"https://x.org/{40 + k}", funder="F", program="P", deadline=date(2026, 1, 1), amount_max=Decimal(1), currency="EUR", source="s") for k in range(6)]
    records = spark.createDataFrame(rows, FIELDS)
    want = {(r.left_id, r.right_id): r.score for r in all_pairs(spark, records).collect()}
    ready = dedup.prepare(records)
    for block in (4, 512):
        for least in (dedup.CANDIDATE, dedup.DUPLICATE):
            handed = [(r.left_id, r.right_id) for r in dedup.met(ready, least, block).select("left_id", "right_id").collect()]
            good = {k for k, score in want.items() if score >= Decimal(least)}
            assert good <= {*handed} and len(handed) == len({*handed}) and len(handed) < len(want) / 2
            assert len(good) >= 15
    sure = {(r.left_id, r.right_id): r.score for r in dedup.candidates(records, least=dedup.DUPLICATE).collect()}
    assert sure == {k: score for k, score in want.items() if score >= Decimal(dedup.DUPLICATE)}


def test_titles_match_as_sequence_matcher_has_them():
    draw = random.Random(5)
    texts = ["", "a", "ab ab ab", "енергія громад 12"] + ["".join(draw.choices("ab", k=draw.randint(1, 30))) for _ in range(60)] + [" ".join(draw.choices(["regional", "fund", "funds", "x1", "1x", "help"], k=draw.randint(1, 9))) for _ in range(60)]
    texts += ["".join(draw.choices("abcd ", k=k)) for k in (199, 200, 201, 450)]
    left, right = (np.array(x) for x in zip(*((i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if a and b), strict=True))
    sizes, kinds = np.array([len(t) for t in texts]), sorted(set("".join(texts)))
    flat = [(k, kinds.index(c)) for k, t in enumerate(texts) if len(t) < blocks.LONG for c in t]
    chars = blocks.padded(np.array([k for k, _ in flat]), np.array([c for _, c in flat], np.uint8), len(texts), 255)
    repeated = blocks.repeats(chars)
    assert (blocks.opening(chars, left, right, sizes, repeated) > 0).sum() > 100
    got = blocks.ratios(pa.array(texts), chars, left, right, sizes, repeated)
    want = [Decimal(str(SequenceMatcher(None, texts[i], texts[j]).ratio())).quantize(Decimal("0.0001"), ROUND_HALF_UP) for i, j in zip(left, right, strict=True)]
    assert got.tolist() == [int(w * 10_000) for w in want]


def test_only_candidates_leave_the_blocks(spark):
    """Titles with the same letters in another order are left out before pairs become rows, whatever the size of blocks and chunks."""
    codes = ["".join(p) for p in itertools.permutations("12345")]
    rows = [record(k, f"Regional innovation fund {c} for towns", funder="F", deadline=date(2026, 1, 1), deadline_text="soon", currency="EUR", topics=["energy"], amount_max=Decimal(k % 7), amount_text="EUR") for k, c in enumerate(codes)]
    rows += [record(200, "x" * 300, "https://a.org", application_url="https://b.org"), record(201, "x" * 299, "https://b.org", application_url="https://a.org", funder="F", deadline_text="soon"), record(202, None, "https://a.org")]
    records = spark.createDataFrame(rows, FIELDS)
    want = {(r.left_id, r.right_id): (r.score, r.reasons) for r in all_pairs(spark, records).filter("score >= 0.74").collect()}
    assert {(r.left_id, r.right_id): (r.score, r.reasons) for r in dedup.candidates(records).collect()} == want and len(want) > 1000
    ready = dedup.prepare(records)
    for block in (9, 512):
        assert sorted((r.left_id, r.right_id) for r in dedup.met(ready, dedup.CANDIDATE, block).collect()) == sorted(want)
    one = dedup.candidates(records.filter("id > 1000"))
    assert one.count() == 0 and one.columns == ["left_id", "right_id", "score", "reasons"]


def test_blocks_come_whole_from_any_batches(monkeypatch):
    monkeypatch.setattr(blocks, "PAIRS", 5)
    keys = ["a"] * 4 + ["b"] + ["c"] * 7 + ["d"] * 2
    rows = pa.RecordBatch.from_pydict({"key": keys, "low": [0] * 14, "high": [0] * 9 + [1] * 5})
    want = {(i, j) for i in range(14) for j in range(i + 1, 14) if keys[i] == keys[j] and (i < 9) == (j < 9)}
    for size in (1, 3, 14):
        got, begun = [], 0
        for some, starts in blocks.whole(rows.slice(k, size) for k in range(0, 14, size)):
            got += [(begun + i, begun + j) for left, right in blocks.met_in(np.arange(some.num_rows), starts, some.num_rows) for i, j in zip(left.tolist(), right.tolist(), strict=True)]
            begun += some.num_rows
        assert begun == 14 and len(got) == len(want) and set(got) == want


def test_totals_of_duplicates_write_no_candidates(spark, tmp_path, monkeypatch):
    """Candidates, many times the records here, are counted as they are found; what is written has a row a record at most."""
    rows = [(k, "BUILDING", 5.0) for k in range(0, 54_000, 900)]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    written, keep = [], dedup.kept
    monkeypatch.setattr(dedup, "kept", lambda df: written.append(keep(df)) or written[-1])
    got = list_queries.duplicate_totals(spark, str(tmp_path)).first()
    assert (got.processed, got.groups, got.duplicate_records, got.duplicate_pairs) == (60, 0, 0, 0) and got.candidates > 300
    assert max(df.count() for df in written) <= 60
