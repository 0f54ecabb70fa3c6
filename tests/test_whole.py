"""Parts of queries that do the whole job: all applications, whole texts, and pairs that share no topic."""

from tidemark.functions import rules
from tidemark.operators import gates, matching
from tidemark.plans import record_queries

def test_classes_read_the_whole_text(spark, tmp_path):
    far = "plain words " * 20
    texts = ["plain", far + "an award for towns", far, "Digest of news " + far, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["class"]: (r.n, r.first_id) for r in record_queries.record_classes(spark, str(tmp_path)).collect()}
    assert got == {"unknown": (3, 0), rules.DIRECT_CLASS: (1, 1), "digest": (1, 3)}


def test_all_applications_count_in_any_number_of_blocks(spark):
    pair = spark.createDataFrame([(7, 1, "body", ["a"], ["x"])], "id int, client_key int, body string, topic_set array<string>, type_set array<string>")
    past = [(1, n, f"t{n}", None, None, "won", ["a"] if n in (80, 90) else ["b"], None, False, 100 if n == 90 else 50) for n in range(100)]
    rows = spark.createDataFrame(past, "client_key int, order int, title string, program string, source string, result string, topics array<string>, applicant_type string, reusable boolean, weight int")
    for size in (3, 64, 1000):
        got = gates.remembered(pair, gates.in_blocks(rows, size)).collect()
        assert [(r.history_score, [h.title for h in r.matched_history]) for r in got] == [(5000, ["t80", "t90"])]
    assert gates.remembered(pair, gates.in_blocks(rows.limit(0))).first().history_score == 0


def test_pairs_are_found_by_text_sector_and_history_too(spark):
    opps = spark.createDataFrame([(1, ["a"], "a"), (2, ["z"], "some solar thing"), (3, ["z"], "farming"), (4, ["h"], "none"), (5, ["q"], "none")], "id int, topics array<string>, body string")
    clients = spark.createDataFrame([(1, "A", "Farming", ["a", "solar"]), (2, "A", "x", ["a"]), (3, "C", "", ["y"])], "client_key int, client string, sector string, wanted array<string>")
    best = matching.best_history(opps, spark.createDataFrame([(2, ["h"], 140), (2, ["q", "r", "s"], 100)], "client_key int, topics array<string>, weight int"))
    got = matching.pairs(opps, clients, matching.by_history(opps, best))
    assert sorted((r.client_key, r.id) for r in got.collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (2, 4)]  # client 3's blank sector counts as absent
