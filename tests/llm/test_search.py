"""Ranked search, vector codes and SentencePiece ids against SQL, brute force and the library."""

import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import codes, lexical, registry, sentence_pieces

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, n long, terms string, norm double, item string, score long, ids string, decoded string"


def documents(spark, texts):
    return spark.createDataFrame([(k, t, 1, None, None, "x", None, "y", None) for k, t in texts], DOCS)


def searched(docs, items, k=10):
    """The SQL of the query on two pandas tables."""
    con = duckdb.connect()
    con.register("documents", docs)
    con.register("benchmark", items)
    return sorted(con.sql(registry.OP11_SQL.replace("rank <= 10", f"rank <= {k}")).fetchall())


def ranked(spark, docs, items, **how):
    frame = lexical.rank(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), **how)
    return sorted((r.item_id, r.rank, r.doc_id, r.score) for r in frame.collect())


def test_search_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.op11_ranked_lexical_search(spark, SF).collect()
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got) == sorted(con.sql(registry.OP11_SQL).fetchall())


@pytest.mark.parametrize("how", [{}, {"first": 1, "growth": 2, "focus": 1}, {"block_terms": 5, "focus": 0, "first": 3}, {"k": 3, "focus": 100}])
def test_search_loses_nothing_in_waves_blocks_and_ties(spark, how):
    r = random.Random(5)
    words = [f"w{min(int(r.expovariate(0.1)), 90)}" for _ in range(9000)]
    docs = [(k, " ".join(r.choices(words, k=r.choice([1, 4, 30, 300])))) for k in range(150)]
    docs += [(1000 + k, "w1 w2, W3") for k in range(40)] + [(2000, None), (2001, ""), (2002, " ,;\t"), (2003, "É É ñ w88"), (2004, "w5 " * 40000)]
    r.shuffle(docs)
    items = [(k, " ".join(r.choices(words, k=r.choice([1, 5, 40])))) for k in range(12)] + [(50, "w1 w2 w3 w1"), (51, None), (52, "nowhere"), (53, "É w88")]
    frames = (pd.DataFrame(docs, columns=["doc_id", "text"]), pd.DataFrame(items, columns=["item_id", "text"]))
    assert ranked(spark, docs, items, **how) == searched(*frames, k=how.get("k", 10))


def test_search_of_repeated_rows_nulls_and_empty_tables(spark):
    docs = [(3, "a b"), (3, "a b"), (None, "a b"), (1, "a b"), (2, "c")]
    rows = lexical.rank(documents(spark, docs), spark.createDataFrame([(7, "a"), (7, "b"), (None, "c")], "item_id long, text string")).collect()
    assert [(r["rank"], r.doc_id) for r in sorted(rows, key=lambda r: r["rank"]) if r.item_id == 7] == [(1, 1), (2, 3), (3, 3), (4, None)]
    assert [(r["rank"], r.doc_id) for r in rows if r.item_id is None] == [(1, 2)]
    for d, i in (([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([], [])):
        assert ranked(spark, d, i) == []


VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, vector int, ids int"


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """The rounds on whole matrices; rows are (vec_id, label, vector) in order of ids."""
    x = np.floor(1024 * np.array([v for *_, v in rows], "f4").astype("f8")).astype("i8")
    width, out, error, books = x.shape[1], [], 0, []
    for p in range(parts):
        y = x[:, width * p // parts : width * (p + 1) // parts]
        book = y[:entries].copy()

        def near(y=y, book=book):
            return ((y[:, None] - book[None]) ** 2).sum(2).argmin(1)

        for _ in range(rounds):
            at = near()
            for e in set(at.tolist()):
                book[e] = y[at == e].sum(0) // (at == e).sum()
        at = near()
        out.append(at)
        error = error + ((y - book[at]) ** 2).sum(1)
        books.append(book)
    return ["".join(f"{c:02x}" for c in r) for r in zip(*out, strict=True)], error.tolist(), books


def coded(spark, rows, **how):
    frame = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v], label, "c", "e", 1, 2) for i, label, v in rows], VECTORS)
    got, books = codes.compress(frame, **how)
    return codes.with_label_errors(got).collect(), books


def test_codes_of_the_table_equal_whole_matrices(spark):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    code, error, books = plain_codes(rows)
    got = sorted(registry.op12_vector_code_compression(spark, SF).collect(), key=lambda r: r.vec_id)
    assert [(r.code, r.error) for r in got] == list(zip(code, error, strict=True))
    sums = {}
    for (_, label, _), e in zip(rows, error, strict=True):
        sums[label] = sums.get(label, 0) + e
    assert [r.label_error for r in got] == [sums[label] for _, label, _ in rows]
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1)).encode()).hexdigest()}


def test_codes_with_copies_ties_nulls_and_odd_widths(spark):
    r = np.random.default_rng(3)
    rows = [(k, [None, 1, 2][k % 3], r.integers(-3, 4, 6).astype("f4").tolist()) for k in range(120)]
    rows += [(200 + k, 1, [0.5] * 6) for k in range(60)]
    bad = [(-1, 1, None), (-2, 1, [1.0, None, 1, 1, 1, 1]), (-3, 1, [float("nan")] * 6), (-4, 1, [float("inf")] * 6), (999, 1, [1.0] * 5), (998, 1, [])]
    for entries in (1, 7, 200, 256):
        code, error, books = plain_codes(rows, entries=entries)
        got, own = coded(spark, rows[::-1] + bad, entries=entries)
        got = sorted(got, key=lambda x: x.vec_id)
        assert [(x.vec_id, x.code, x.error) for x in got] == [(i, c, e) for (i, *_), c, e in zip(rows, code, error, strict=True)]
        assert all((a == b).all() for a, b in zip(own.entries, books, strict=True))
        null = sum(e for (_, label, _), e in zip(rows, error, strict=True) if label is None)
        assert {x.label_error for x in got if x.label is None} == {null}
        salted = codes.with_label_errors(spark.createDataFrame(got).drop("label_error"), most=0).collect()
        assert sorted(map(str, salted)) == sorted(str(x) for x in spark.createDataFrame(got).select(*salted[0].asDict()).collect())


def test_codes_of_few_empty_and_huge_vectors(spark):
    assert coded(spark, [])[0] == [] and coded(spark, [(1, 1, None)])[0] == []
    got, books = coded(spark, [(1, None, []), (None, None, [])])
    assert [(x.code, x.error, x.label_error) for x in got] == [("00000000", 0, 0)] * 2 and books.digest() == hashlib.sha256(b"").hexdigest()
    got, _ = coded(spark, [(1, 1, [3e38, -3e38, 0, 1]), (1, 1, [3e38, -3e38, 0, 1]), (None, 1, [0.0, 0, 0, 1])], entries=2)
    # the codebook starts with two equal entries: the first takes all rows and moves, then the second has its own again
    assert sorted((x.vec_id or 0, x.code, x.error) for x in got) == [(0, "00000000", 0), (1, "01010000", 0), (1, "01010000", 0)]


def test_tree_assignment_equals_brute_force():
    r = np.random.default_rng(1)
    for t in range(200):
        n, m, w, high = r.integers(1, 300), r.integers(1, 257), r.integers(1, 9), r.choice([2, 5, 100, 10000])
        x, book = r.integers(-high, high, (n, w)), r.integers(-high, high, (m, w))
        if t % 3 == 0:
            x[: n // 2], book[m // 2 :] = x[0], book[0]
        tree = codes.Tree(x, 8)
        assert (codes.assign(tree, book) == ((x[tree.order][:, None] - book[None]) ** 2).sum(2).argmin(1)).all()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def own():
    words = sentence_pieces.vocabulary(MODEL)
    return sentence_pieces.Encoder(words, most=500, most_codes=3000), sentence_pieces.Decoder(words)


def ids_of(own, texts):
    """The ids of texts encoded side by side, after they were decoded side by side and alone alike."""
    ids, counts = own[0].encode(texts)
    rows = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []
    assert own[1].decode_all(ids, counts) == [own[1].decode(r) for r in rows]
    return rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab ▁\n\x00=étinhos.<0x>"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=30))
def test_pieces_of_any_texts_are_the_library_s(own, library, texts):
    ids = ids_of(own, texts)
    assert ids == library.encode(texts) and [own[1].decode(r) for r in ids] == [library.decode(r) for r in ids]


def test_rows_of_any_pieces_and_ids_are_the_library_s(own, library):
    r = random.Random(2)
    pieces = [library.id_to_piece(i) for i in range(259, 32000)]
    texts = ["".join(r.choices(pieces, k=r.randint(1, 10))).replace("▁", r.choice([" ", "▁", ""])) for _ in range(4000)]
    assert ids_of(own, texts) == library.encode(texts)
    for _ in range(4000):
        ids = [r.randrange(r.choice([3, 259, 32000])) for _ in range(r.randint(0, 9))]
        assert own[1].decode(ids) == library.decode(ids)
    long = ["aa" * 60000 + "ab", "=" * 70000, " " * 30001, "x▁" * 9000, "漢字ー" * 20000]
    assert ids_of(own, long) == library.encode(long)


def test_pieces_of_a_vocabulary_with_crossing_rare_and_unreachable_pieces():
    """Against plain merging: pieces over a mark, characters that only longer pieces have, no bytes, equal scores."""
    r = random.Random(4)
    for _ in range(30):
        names = {r.choice("abc▁") for _ in range(3)} | {"".join(r.choices("abcd▁", k=r.randint(2, 4))) for _ in range(9)}
        ranked = r.sample(sorted(names), len(names))
        words = {"pieces": {p: (k + 3, -float(k // 2)) for k, p in enumerate(ranked)}, "bytes": {}, "unknown": 0, "unknown_text": "?", "control": [1, 2]}
        encoder, plain = sentence_pieces.Encoder(words), sentence_pieces.Merges({p: s for p, (_, s) in words["pieces"].items()})
        texts = ["".join(r.choices("abcde ", k=r.randint(0, 12))) for _ in range(60)]
        ids, counts = encoder.encode(texts)
        want = [[words["pieces"].get(p, (0,))[0] for p in plain.merged(sentence_pieces.MARK + t.replace(" ", sentence_pieces.MARK))] if t else [] for t in texts]
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_pieces_query_equals_the_library(spark, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registry.op13_sentencepiece(spark, SF).collect()}
    want = {}
    for d, t in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(t or "")
        want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert got == want


def test_pieces_of_odd_rows(spark, library):
    texts = [(1, None), (1, ""), (None, "a b"), (2, "a b"), (2, "a b"), (3, "word " * 50000)]
    got = sentence_pieces.encode(documents(spark, texts), MODEL)
    assert sorted((r.doc_id or 0, len(r.ids)) for r in got.collect()) == sorted((d or 0, len(library.encode(t or ""))) for d, t in texts)
    assert sorted(r.decoded for r in sentence_pieces.decode(got, MODEL).collect()) == sorted(t or "" for _, t in texts)
    assert sentence_pieces.encode(documents(spark, []), MODEL, decoded=True).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [r.decoded for r in sentence_pieces.decode(none, MODEL).collect()] == [""]
