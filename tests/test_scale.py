"""Matching by kinds, terms in texts and nearest rows against plain forms of the same."""

import random
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions.extraction import padded
from tidemark.operators import gates, kindwise, matching, nearest, terms, threshold

OFFER = "id long, title string, topics array<string>, applicant_types array<string>, countries array<string>, restrictions string, summary string, status string, confidence decimal(5,4), quality_score int, quality_tier string, class string, flags array<string>, blockers array<string>, deadline date"
CLIENT = "client_key long, client string, country string, sector string, organization_type string, product string, wanted array<string>, unwanted array<string>, technologies array<string>"
PAST = "client_key long, order int, title string, program string, source string, result string, topics array<string>, applicant_type string, reusable boolean, weight int"


def made(spark, seed, offers=60, clients=20, most_weight=130):
    """Random opportunities, clients and applications, with copies, nulls, blanks and lists in any case."""
    r = random.Random(seed)
    topics, words = ["Energy", "water", "AI", "health", "farms"], ["solar panel", "pump", "robot", "Clinic", "seed"]
    some = lambda values, n: r.choice([None, [], r.sample(values, r.randint(1, n))])
    left = [
        (k, r.choice(["Award for energy", "Pump fund", "Robot and clinic support", "seed money"]) + r.choice(["", " again"]), some(topics, 3), some(["SME", "NGO", "startup"], 2), some(["Ukraine", "EU", "Poland"], 2),
         r.choice([None, None, "sme is not eligible", "Деякі не можуть"]), r.choice([None, "about " + r.choice(words)]), r.choice(["open", "unknown"]), r.choice([None, "0.5", "0.9"]), 60, r.choice(["match_ready", "usable_with_warnings"]), "award", ["missing_amount"], [], None)
        for k in range(offers)
    ]
    left = [(*x[:8], None if x[8] is None else Decimal(x[8]), *x[9:]) for x in left]
    right = [(k, f"c{k}", r.choice([None, "Ukraine", "Poland"]), r.choice([None, "", "Clinic", "farming"]), r.choice(["NGO", "startup", "small business", None]), None, some(topics, 3), some(topics, 1), some([*words, "", None], 2)) for k in range(clients)]
    past = [(r.randrange(clients + 2), n, r.choice(["Pump fund", "award", None, "x"]), r.choice([None, "robot"]), None, "won", some(topics, 2), r.choice([None, "sme", "NGO"]), r.choice([True, False, None]), r.choice([None, 0, 50, most_weight])) for n in range(150)]
    return spark.createDataFrame(left, OFFER), spark.createDataFrame(right, CLIENT), spark.createDataFrame(past, PAST)


def plain(offers, clients, past, near=None):
    """All pairs, scored one by one."""
    kept = gates.opportunity_gates(offers, "2026-01-01").filter(F.size("reasons") == 0)
    pairs = kept.crossJoin(gates.client_sides(clients).drop("reasons"))
    if near is not None:
        pairs = pairs.join(near, ["id", "client_key"], "left")
    scored = gates.scores(gates.pair_gates(pairs).filter("passed"), gates.in_blocks(past)).withColumn("explanation", gates.explanation())
    return scored.filter(F.col("score") >= gates.MIN_SCORE)


SHOWN = ["client", "rank", "id", "score", "keyword", "history_score", "explanation"]


def shown(df):
    return sorted(tuple(r[c] for c in SHOWN) + (tuple(r.checks), tuple(h.title for h in r.matched_history)) for r in df.collect())


def test_best_and_totals_equal_all_pairs(spark):
    offers, clients, past = (t.cache() for t in made(spark, 1))
    every = plain(offers, clients, past).cache()
    assert every.count() > 50
    got = threshold.best(offers, clients, past, "2026-01-01", top=4)
    assert shown(got) == shown(matching.shortlist(every, top=4))
    sums = {r.client: (r.n, r.total, r.best, r.unwanted) for r in threshold.totals(offers, clients, past, "2026-01-01").collect()}
    want = every.groupBy("client").agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.max("score").alias("best"), F.count_if("unwanted_hit").alias("unwanted")).collect()
    assert sums == {r.client: (r.n, r.total, r.best, r.unwanted) for r in want}
    kept = gates.match(offers, clients.withColumn("history", F.lit(None)), "2026-01-01", applications=past)
    assert sorted((r.id, r.client_key, r.score) for r in kept.select("id", "client_key", "score").collect()) == sorted((r.id, r.client_key, r.score) for r in every.select("id", "client_key", "score").collect())


def test_best_with_near_pairs(spark):
    offers, clients, past = made(spark, 7)
    near = spark.range(60 * 20).filter(F.xxhash64("id") % 5 == 0).select((F.col("id") % 60).alias("id"), (F.col("id") / 60).cast("long").alias("client_key"), (F.col("id") * 37 % 10_001).cast("int").alias("vector"))
    got = threshold.best(offers, clients, past, "2026-01-01", top=4, near=near)
    assert shown(got) == shown(matching.shortlist(plain(offers, clients, past, near), top=4))


def test_matching_of_empty_tables_and_great_weights(spark):
    offers, clients, past = made(spark, 1)
    none = lambda t: spark.createDataFrame([], t.schema)
    assert threshold.best(none(offers), clients, past, "2026-01-01").count() == 0 and threshold.totals(offers, none(clients), none(past), "2026-01-01").count() == 0
    every = plain(offers, clients, none(past))
    assert shown(threshold.best(offers, clients, none(past), "2026-01-01")) == shown(matching.shortlist(every))
    offers, clients, past = made(spark, 4, most_weight=200)
    with pytest.raises(ValueError):
        threshold.best(offers, clients, past, "2026-01-01")
    heavy = gates.match(offers, clients.withColumn("history", F.lit(None)), "2026-01-01", applications=past).select("id", "client_key", "score")
    assert sorted(map(tuple, heavy.collect())) == sorted(map(tuple, plain(offers, clients, past).select("id", "client_key", "score").collect()))
    with pytest.raises(ValueError):
        gates.match(offers, clients.withColumn("history", F.lit(None)), "2026-01-01", applications=past.withColumn("weight", F.lit(230)))


def test_a_client_of_very_many_applications_is_dealt_out(spark):
    past = spark.range(5000).select(F.lit(1).alias("client_key"), F.col("id").alias("order"), *(F.lit("t").alias(c) for c in ("title", "program", "source", "result")), F.array(F.lit("a")).alias("topics"), F.lit("sme").alias("applicant_type"), F.lit(True).alias("reusable"), F.lit(100).alias("weight"))
    blocks = gates.in_blocks(past).select(F.size("past").alias("n")).collect()
    assert sum(r.n for r in blocks) == 5000 and max(r.n for r in blocks) < 2 * gates.BLOCK and len(blocks) > 60


def test_terms_equal_contains_on_all_pairs(spark):
    r = random.Random(3)
    texts = [None, "", "abcabc", "ab\nc a", "дім ліс", "x" * 3000 + "needle"] + ["".join(r.choices("abc ", k=r.randint(1, 30))) for _ in range(60)]
    words = sorted({"a", "ab", "bca", " ", "ліс", "needle", "absent", "c a"} | {"".join(r.choices("abc", k=r.randint(1, 4))) for _ in range(30)})
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    given = spark.createDataFrame([(w,) for w in words] + [("",), (None,), ("a",)], "term string")
    want = {k: [w for w in words if t is not None and w in t] for k, t in enumerate(texts)}
    for most in (1000, 5):
        assert {r.id: r.found for r in frame.select("id", terms.finder(given, most)(F.col("body")).alias("found")).collect()} == want
    assert all(r.found == [] for r in frame.select(terms.finder(given.limit(0))(F.col("body")).alias("found")).collect())
    owned = given.withColumn("client_key", F.length("term"))
    got = sorted(map(tuple, terms.in_texts(frame, owned, 7).collect()))
    assert got == sorted({(k, len(w)) for k, ws in want.items() for w in ws})


def test_padded_text_holds_a_word_at_its_border(spark):
    frame = spark.createDataFrame([(1, "Solar")], "id int, text string").select("id", padded(F.col("text")).alias("body"))
    assert frame.select(terms.finder(spark.createDataFrame([(" solar ",)], "term string"))(F.col("body")).alias("f")).first().f == [" solar "]


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark, n=600, seed=5):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(12, 8))
    rows = [(k, (centers[k % 12] + 0.3 * r.normal(size=8)).astype("f4").tolist(), 1) for k in range(n)]
    rows += [(n + k, [1.0] + [0.0] * 7, 1) for k in range(40)] + [(5000, None, 1), (5001, [0.0] * 8, 1), (5002, [1.0, 2.0], 1), (5003, [1.0, None] + [0.0] * 6, 1), (5004, [float("nan")] * 8, 1), (None, [1.0] + [0.0] * 7, 1)]
    return rows, spark.createDataFrame(rows, VECTORS)


def brute(rows, asked, k):
    """(query, rank, id) by whole matrices."""
    good = [(i, np.array(v, "f8")) for i, v, _ in rows if v is not None and None not in v and len(v) == 8 and np.linalg.norm(v) > 0]
    out = []
    for q, v in [(i, v) for i, v in good if i in asked]:
        near = sorted((-round(float(v @ x / np.linalg.norm(v) / np.linalg.norm(x)), 6), i is None, i or 0, i) for i, x in good if i != q)
        out += [(q, n + 1, x[3]) for n, x in enumerate(near[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("part", [50_000, 20])
def test_nearest_rows_by_blocks_and_by_index(spark, monkeypatch, part):
    monkeypatch.setattr(nearest, "PART", part)
    rows, frame = vectors(spark)
    asked = {*range(0, 600, 50), 620, 5000, 5001, 5002}
    queries = frame.filter(F.col("vec_id").isin(*asked)).unionByName(frame.filter("vec_id = 50"))
    take = lambda df: sorted(((r.query_id, r["rank"], r.vec_id) for r in df.collect() if r.query_id != 5002), key=str)
    want = brute(rows, asked, 5)
    assert take(nearest.exact(queries, frame)) == want and take(nearest.exact(queries, frame, most=4)) == want
    index = nearest.build(frame)
    assert index.rows.count() == 641 and (part > 20 or index.parts.max() > 1)
    assert take(nearest.search(index, queries, whole=True)) == want and take(nearest.search(index, queries, whole=True, probes=1, most=5)) == want
    some = nearest.recall(nearest.search(index, queries), nearest.exact(queries.filter("vec_id <> 5002"), frame)).first()
    assert some.wanted == len(want) and some.recall >= 0.9


def test_nearest_of_empty_tables(spark):
    _, frame = vectors(spark, 20)
    none = frame.limit(0)
    for queries, rows in ((none, frame), (frame, none), (none, none)):
        assert nearest.exact(queries, rows).count() == 0 and nearest.search(nearest.build(rows), queries, whole=True).count() == 0
    assert nearest.recall(none.select(F.col("vec_id").alias("query_id"), "vec_id"), none.select(F.col("vec_id").alias("query_id"), "vec_id")).first().recall == 0


def test_few_kinds_make_no_rows_of_pairs(spark, monkeypatch):
    offers, clients, past = (t.cache() for t in made(spark, 3))
    every = plain(offers, clients, past).cache()
    columns = ["client_key", "client", "rank", "id", "score", "keyword", "history_score", "checks", "explanation"]
    rows = lambda df: sorted(map(tuple, ([*r[:7], tuple(r[7]), r[8]] for r in df.select(*columns).collect())))
    sums = lambda df: sorted(map(tuple, df.select("client", "n", "total", "best", "unwanted").collect()))
    want = every.groupBy("client").agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.max("score").alias("best"), F.count_if("unwanted_hit").alias("unwanted"))

    def none(self):
        raise AssertionError("a row for each pair of a client and a kind")

    with monkeypatch.context() as m:
        m.setattr(threshold.Matching, "pairs", none)
        m.setattr(kindwise, "GROUP", 3)  # clients of one gate in several groups
        assert rows(threshold.shown(offers, clients, past, "2026-01-01", top=4)) == rows(matching.shortlist(every, top=4))
        assert sums(threshold.totals(offers, clients, past, "2026-01-01")) == sums(want)
    monkeypatch.setattr(kindwise, "MOST", 1)  # joins, as for very many kinds
    assert rows(threshold.shown(offers, clients, past, "2026-01-01", top=4)) == rows(matching.shortlist(every, top=4))
    assert sums(threshold.totals(offers, clients, past, "2026-01-01")) == sums(want)
    assert shown(threshold.best(offers, clients, past, "2026-01-01", top=4)) == shown(matching.shortlist(every, top=4))


def test_clients_in_blocks_get_their_best_histories(monkeypatch):
    r, n = np.random.default_rng(5), 40
    values = [(a, p, int(r.integers(1, 10_000))) for a in range(9) for p in range(7) if r.random() < 0.6]
    table = lambda rows: type("T", (), {"toArrow": lambda self: pa.table(dict(zip("apv", map(list, zip(*rows, strict=True)), strict=True)))})()
    past, words = kindwise.Matrix(table(values)), kindwise.Matrix(table([(w, 1, 5) for w in range(3)]))
    lists = [r.integers(0, 12, r.integers(0, 6)).tolist() for _ in range(n)]
    wants = r.integers(0, 3, n)
    clients = pa.table({"want": pa.array(wants), "applications": pa.array(lists, pa.list_(pa.int64()))})
    monkeypatch.setattr(kindwise, "CELLS", 40)
    blocks, known = list(kindwise._blocks(clients, words, past)), {(a, p): v for a, p, v in values}
    assert len(blocks) > 10 and sorted(k for _, some, _ in blocks for k in some) == list(range(n))
    for want, some, histories in blocks:
        assert all(wants[k] == want for k in some)
        for k, own in zip(some, histories, strict=True):
            assert own[:-1].tolist() == [max((known.get((a, p), 0) for a in lists[k]), default=0) for p in past.columns]


def test_shortlist_of_few_kinds_makes_no_rows_of_pairs(spark, monkeypatch):
    from tidemark.plans import registry

    def none(*a):
        raise AssertionError("a row for each pair of a client and a list of topics")

    with monkeypatch.context() as m:
        m.setattr(matching, "best_history", none)
        got = sorted(map(tuple, registry.QUERIES["shortlist_history"](spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(kindwise, "MOST", 1)
    assert got and got == sorted(map(tuple, registry.QUERIES["shortlist_history"](spark, "/root/testdata/sf0.001").collect()))
