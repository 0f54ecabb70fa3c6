"""Classifiers, LM scoring, substring and near-duplicate removal, and the pipeline, against brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import components, lattice, near_duplicates, packing, quality, substrings, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, sketch int, label int, n int"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def docs_of(spark, texts):
    return spark.createDataFrame([(k, t, None, "s", None, 1, 2, 3) for k, t in texts], DOCS)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def words():
    draw = random.Random(5)
    return ["".join(draw.choices("abcdefgh", k=draw.randint(2, 7))) for _ in range(400)]


def prose(draw, words, n):
    return " ".join(draw.choice(words) + ("." if draw.random() < 0.15 else "") for _ in range(n))


def test_quality_and_edge_cases(spark, words):
    draw = random.Random(1)
    rows = [(k, prose(draw, words, draw.randint(20, 200)) if k % 3 else " | ".join(draw.choices(words, k=60))) for k in range(240)]
    rows += [(1000, None), (1001, ""), (1002, "x"), (5, rows[5][1]), (None, "a b"), (1003, "y" * 200_000)]
    docs, labels = docs_of(spark, rows), labels_of(spark, [(k, int(k % 3 > 0), 0) for k in range(240)] + [(3, 0, 0), (9, None, None), (None, 1, 1)])
    got = quality.classify(docs, labels).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    known = got[got.doc_id < 240]
    assert (known.held_out == [zlib.crc32(str(int(k)).encode()) % 5 == 0 for k in known.doc_id]).all()
    held = known[known.held_out]
    assert ((held.doc_id % 3 > 0) == (held.predicted == 1)).mean() > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    good = collections.Counter(got[got.predicted == 1].doc_id.fillna(-1).astype(int))
    assert collections.Counter(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == good
    assert quality.classify(docs, labels.limit(0)).filter("score <> 0.5").count() == 0
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_discriminant_is_the_log_density_difference():
    rng = np.random.default_rng(0)
    x = {0: rng.normal(0, 2, (300, 3)), 1: rng.normal(1, 1, (500, 3))}
    model = quality.Discriminant({k: (len(v), v.sum(0), v.T @ v) for k, v in x.items()}, 0.0, 0.0, 0.0)
    point = rng.normal(0, 1, (4, 3))
    dense = {}
    for k, v in x.items():
        c = np.cov(v.T, bias=True)
        d = point - v.mean(0)
        dense[k] = np.log(len(v) / 800) - 0.5 * (np.log(np.linalg.det(c)) + np.einsum("ni,ij,nj->n", d, np.linalg.inv(c), d))
    assert np.allclose(model.scores(point), 1 / (1 + np.exp(dense[0] - dense[1])))


def test_toxicity_and_its_place(spark, words):
    draw = random.Random(2)
    rows, bad = [], {}
    for k in range(300):
        sentences = [prose(draw, words, 9).replace(".", "") for _ in range(draw.randint(1, 12))]
        if k % 4 == 0:
            at = draw.randrange(len(sentences))
            sentences[at] = "you zorg" + draw.choice(["ax", "em", "ino"]) + " " + sentences[at]
            bad[k] = sentences[at]
        rows.append((k, ". ".join(sentences) + "."))
    rows += [(1000, None), (1001, ""), (1002, "..."), (1003, "fine words " * 9000)]
    docs, labels = docs_of(spark, rows), labels_of(spark, [(k, 0, int(k in bad)) for k in range(300)])
    got = toxicity.classify(docs, labels).toPandas().set_index("doc_id")
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    assert ((got.predicted[:300] == 1) == [k in bad for k in range(300)]).mean() > 0.97
    assert got.predicted[1000:].sum() == 0
    spans = toxicity.locate(docs, toxicity.fit(docs, labels)).collect()
    texts = dict(rows)
    assert sum(texts[s.doc_id][s.start_char : s.end_char].strip() == bad.get(s.doc_id) for s in spans) > 0.9 * len(spans) > 0
    assert toxicity.classify(docs, labels.limit(0)).filter("score <> 0.5").count() == 0


def test_noisy_or_loss_against_a_plain_loop():
    """The loss by its definition, and the gradient by differences; then what the steps reach."""
    draw = random.Random(8)
    docs = [(int(k < 6), [(draw.randint(1, 3), draw.sample(range(5), draw.randint(0, 3))) for _ in range(draw.randint(1, 5))]) for k in range(20)]
    weight = {0: 0.03, 1: 0.09}

    def plain(point):
        total = 0.0
        for y, lines in docs:
            clean = math.prod((1 - 1 / (1 + math.exp(-point[-1] - sum(point[w] for w in own)))) ** n for n, own in lines)
            total -= weight[y] * math.log(1 - clean if y else clean)
        return total

    bags = pa.RecordBatch.from_pydict({"label": [y for y, _ in docs], "times": [[n for n, _ in x] for _, x in docs], "sizes": [[len(w) for _, w in x] for _, x in docs], "words": [[w for _, own in x for w in own] for _, x in docs]})
    point = np.array([0.3, -0.2, 1.1, 0.0, -0.7, -1.2])
    value, slope = toxicity.bag_loss(bags, point, weight)
    assert math.isclose(value, plain(point), rel_tol=1e-9)
    assert np.allclose(slope, [(plain(point + d) - plain(point - d)) / 2e-6 for d in np.eye(6) * 1e-6], atol=1e-6)
    found = toxicity.minimised(lambda x: (float(((x - 3) ** 4).sum()), 4 * (x - 3) ** 3), np.zeros(4), 60)
    assert np.allclose(found, 3, atol=0.1)


def test_toxicity_edge_cases(spark, words):
    assert toxicity.forms("жовтня".encode()) == ("жовтня".encode(), "жовт-".encode(), "жовтн-".encode()) and toxicity.forms(b"ab") == (b"ab", b"ab-", b"ab-")
    draw = random.Random(12)
    rows = [(k, f"{prose(draw, words, 20)}. {'zorgax now' if k % 3 == 0 else 'fine'}.") for k in range(60)]
    rows += [(None, rows[0][1]), (5, rows[5][1]), (5, rows[5][1])]
    docs, labels = docs_of(spark, rows), labels_of(spark, [(k, 0, int(k % 3 == 0)) for k in range(60)] + [(None, 0, 1), (7, 0, None)])
    got = toxicity.classify(docs, labels).toPandas()
    assert len(got) == 63 and (got[got.doc_id == 5].score.nunique(), got.doc_id.isna().sum()) == (1, 1)
    assert got[got.doc_id.isna()].score.item() == got[got.doc_id == 0].score.item()
    assert toxicity.classify(docs.limit(0), labels).count() == 0 and toxicity.locate(docs.limit(0), toxicity.Model({}, 0.0)).count() == 0


def test_class_sums_of_spark_equal_plain_ones(spark, words):
    draw = random.Random(13)
    texts = [prose(draw, words, draw.randint(5, 80)) for _ in range(120)]
    docs, labels = docs_of(spark, list(enumerate(texts))), labels_of(spark, [(k, k % 2, 0) for k in range(120)])
    learn = [k for k in range(120) if zlib.crc32(str(k).encode()) % 5]
    x = {y: np.array([quality.statistics(texts[k].encode()) for k in learn if k % 2 == y], "f4").astype("f8") for y in (0, 1)}
    want = quality.Discriminant({y: (len(v), v.sum(0), v.T @ v) for y, v in x.items()}).scores(x[1])
    assert np.allclose(quality.fit(quality.features(docs), labels).scores(x[1]), want, atol=1e-9)


def test_lattice_sums_all_segmentations():
    pieces, logs = ["▁", "▁a", "a", "ab", "b", "<0x63>"], np.log([0.1, 0.2, 0.15, 0.25, 0.1, 0.2])
    p = dict(zip(pieces, np.exp(logs)))

    def brute(text):
        return 1.0 if not text else sum(p[x] * brute(text[len(x) :]) for x in pieces if text.startswith(x)) + (p["<0x63>"] * brute(text[1:]) if text[0] == "c" else 0)

    model = lattice.Lattice(pieces, logs)
    for word in ("a", "ab", "aab", "abac", "bcab"):
        assert math.isclose(math.exp(model.log(word)), brute("▁" + word))


def test_lm_scores(spark, words):
    draw = random.Random(3)
    shared = prose(draw, words, 12).replace(".", "") + "."
    rows = [(k, prose(draw, words[:200], 40) + " " + (shared if k % 4 == 0 else "")) for k in range(120)]
    rows += [(500, None), (501, ""), (7, rows[7][1]), (502, "É\u0085né! " * 3 + "\x1c unseenwordunseen"), (None, "a b c"), (503, f"{shared} {shared} rareone raretwo and more words that only this text has here. {shared}"), (504, "rareone raretwo and more words that only this text has here."), (505, "word " * 60_000)]
    docs = docs_of(spark, rows)
    count, ends = collections.Counter(), 0
    for k, t in rows:
        if zlib.crc32(("" if k is None else str(k)).encode()) % 5 != 1:
            count.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    base = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    want_score = plain_scores(rows)
    for hot, longest in ((10, 64), (10, 4), (100_000, 64)):
        got = lattice.score_documents(docs, PIECES, hot=hot, hot_bytes=longest).collect()
        want = collections.Counter((k, len(w := (t or "").encode().lower().split()) + 1, sum(count[x] > 0 for x in w) + 1, n, round(sum(base(count[x]) for x in w) + base(ends), 6)) for k, t in rows)
        assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(math.isclose(r.score, want_score[r.doc_id], rel_tol=1e-9) for r in got)
    clash = docs.withColumns({c: F.lit("x") for c in ("unit", "rare", "late", "score", "copies")})
    assert lattice.score_documents(clash, PIECES).count() == len(rows)
    assert lattice.score_documents(docs.limit(0), PIECES).count() == 0


def plain_scores(rows, floor=0.01):
    """The model by its definition, with probabilities of words by plain recursion over all segmentations."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    learn = [(t or "").encode().lower().split() for k, t in rows if zlib.crc32(("" if k is None else str(k)).encode()) % 5 != 1]
    cut = lambda w: re.split(rb"(?<=[.!?]) ", b" ".join(w)) if w else []
    words, said = collections.Counter(x for w in learn for x in w), [s for w in learn for s in cut(w)]
    long = collections.Counter(s for s in said if len(s.split()) >= 8)
    ends = len(learn)

    def discount(c):
        once, twice = (sum(n == k for n in c.values()) for k in (1, 2))
        return min(0.95, (once + 1) / (once + 2 * twice + 2))

    mass = collections.Counter(i for w in words for i in model.encode(w.decode()))
    all_mass = sum(mass.values()) + floor * model.get_piece_size() + len(words) + 1
    p = {model.id_to_piece(i): (mass[i] + floor) / all_mass for i in range(model.get_piece_size())}
    longest = max(map(len, p))
    total, starts = sum(words.values()) + ends + 1, len(said) + ends + 1
    d, dl = discount(words), discount(long)
    by_words = (starts - sum(long.values()) + dl * len(long)) / starts
    spelt = (d * len(words) + 0.5) / total * (len(words) + 1) / all_mass

    def spelling(text):
        got = [1.0] + [0.0] * len(text)
        for i, c in enumerate(text):
            for j in range(i + 1, min(len(text), i + longest) + 1):
                if text[i:j] in p and not text[i:j].startswith("<"):
                    got[j] += got[i] * p[text[i:j]]
            if c not in p or c == "<":
                got[i + 1] += got[i] * math.prod(p[f"<0x{b:02X}>"] for b in c.encode())
        return got[-1]

    word = {x: (words[x] - d) / total * (x in words) + spelt * spelling("\u2581" + x.decode()) for x in {x for _, t in rows for x in (t or "").encode().lower().split()}}
    out = {}
    for k, t in rows:
        own = (t or "").encode().lower().split()
        score = math.log10((ends + 0.5) / total) + (math.log10(by_words) if not own or own[-1][-1:] in b".!?" else 0)
        for s in cut(own):
            written = math.log10(by_words) + sum(math.log10(word[x]) for x in s.split())
            score += math.log10((long[s] - dl) / starts + 10**written) if s in long else written
        out[k] = score
    return out


def spans_and_runs(raw):
    """The byte spans of a text's stretches and its runs as (hash, first stretch, stretches)."""
    found = substrings.Stretches([b"before. text\n", raw, b"after"])
    first, size = found.runs()
    own = found.text[first] == 1
    return found.spans(1), list(zip(found.run_key(first, size)[own].tolist(), (first[own] - found.first[1]).tolist(), size[own].tolist(), strict=True))


def test_runs_are_the_shortest_ones():
    """From every stretch, and to every stretch that none of those ends at, by trying all; spans tile the text."""
    draw = random.Random(1)
    for _ in range(300):
        raw = "".join(draw.choice("ab .!?\n\té漢" + "c" * 3) for _ in range(draw.randint(0, 400))).encode() + draw.choice([b"", ("漢字x" * 40 + " ").encode() * 2])
        spans, got = spans_and_runs(raw)
        found = substrings.Stretches([raw])
        words, n, want = found.words.tolist(), len(spans), set()
        assert b"".join(raw[s:e] for s, e in spans) == raw.lstrip(b" \n\t") and all(0 < k <= 12 for k in words)
        for i in range(n):
            want |= {(i, j) for j in range(i + 3, n + 1) if sum(words[i:j]) >= 20 and not (j > i + 3 and sum(words[i : j - 1]) >= 20)}
        ends = {j for _, j in want}
        for e in range(min(ends, default=n + 1), n + 1):
            want |= {(max(i for i in range(e - 2) if sum(words[i:e]) >= 20), e)} if e not in ends else set()
        assert {(i, i + k) for _, i, k in got} == want
        plain = lambda i, k: tuple(tuple(raw.lower()[s:e].split()) for s, e in spans[i : i + k])
        assert len({h for h, _, _ in got}) == len({plain(i, k) for _, i, k in got})


def brute_removed(rows):
    seen, gone = {}, collections.defaultdict(set)
    for k, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for h, i, size in sorted(spans_and_runs((t or "").encode())[1], key=lambda r: r[1]):
            if seen.setdefault(h, (k, i)) != (k, i):
                gone[k] |= {*range(i, i + size)}
    return gone


def test_repeated_spans_go_but_for_the_first(spark, words):
    draw = random.Random(4)
    passage = " ".join(prose(draw, words, 14).replace(".", "") + "." for _ in range(5))
    rows = [(k, f"{prose(draw, words, 60)}. {passage if k % 3 == 0 else ''} {prose(draw, words, 30)}.") for k in range(30)]
    rows += [(40, None), (41, ""), (42, passage), (43, "short. line. here."), (44, "short. line. here."), (44, "short. line. here."), (None, passage), (None, passage), (45, "one two three four. " * 20_000)]
    docs = docs_of(spark, rows)
    out = substrings.remove_repeats(docs)
    assert out.columns == docs.columns
    found = out.collect()
    assert len(found) == len(rows) and [r.text for r in found if r.doc_id is None] == [passage, passage]
    got, gone = {r.doc_id: r.text for r in found}, brute_removed(rows)
    for k, t in rows:
        if k is None:
            continue
        spans = spans_and_runs((t or "").encode())[0]
        raw = (t or "").encode()
        want = "".join(chr(b) for b in b"".join([raw[: spans[0][0] if spans else 0], *(raw[s:e] for n, (s, e) in enumerate(spans) if n not in gone[k])]))
        assert (got[k] or "") == want
    assert sum(passage in (t or "") for k, t in got.items() if k is not None) == 1 and got[42] == "" and got[40] is None and got[44] == "short. line. here." and len(got[45]) < 500
    assert substrings.remove_repeats(docs.limit(0)).count() == 0
    clash = docs.withColumns({"__gone": F.lit(1), "__removed": F.lit(2), "__sentences": F.lit(3), "hash": F.lit(4), "salt": F.lit(5)})
    counted = substrings.remove_repeats(clash, counts=True)
    assert counted.columns == [*clash.columns, "__sentences_", "__removed_"] and collections.Counter(r.text for r in counted.collect()) == collections.Counter(r.text for r in found)


@pytest.mark.parametrize("shift", [0, 1, 5, 7, 11])
def test_passages_pasted_mid_sentence_are_found(words, shift):
    """Without sentence ends, after other words than before, and in text without spaces."""
    draw = random.Random(shift)
    plain = lambda n: " ".join(draw.choices(words, k=n)).replace(".", "").lower()
    letters = lambda n: "".join(chr(draw.randrange(0x4E00, 0x5E00)) for _ in range(n))
    for _ in range(10):
        passage, signs = plain(90), letters(300)
        for a, b, part in ((f"{plain(30)} {passage} {plain(9)}.", f"{plain(30 + shift)} {passage} {plain(20)}", passage), (letters(40) + signs, letters(40 + shift) + signs + letters(9), signs)):
            seen, (spans, found) = {h for h, _, _ in spans_and_runs(a.encode())[1]}, spans_and_runs(b.encode())
            gone = {s for h, i, k in found if h in seen for s in range(i, i + k)}
            cut = sum(spans[s][1] - spans[s][0] for s in gone)
            assert len(part.encode()) * 0.5 < cut <= len(part.encode()) + 40
            assert spans[0][0] == 0 and spans[-1][1] == len(b.encode()) and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))


def brute_classes(rows, threshold=0.8):
    """By sets of word tuples, apart from the operator's own hashes; rows may share ids."""
    def five(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [five(t) for _, t in rows]
    kinds = sorted(set(sets), key=lambda s: min((k is None, k or 0) for (k, _), x in zip(rows, sets, strict=True) if x == s))
    root = dict(zip(kinds, range(len(kinds)), strict=True))

    links = collections.Counter()
    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if a and b and len(a & b) >= threshold * len(a | b):
                links[a] += 1
                links[b] += 1
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {s: new if r == old else r for s, r in root.items()}
    n = collections.Counter(sets)
    least = {r: min((k for (k, _), s in zip(rows, sets, strict=True) if root[s] == r and k is not None), default=None) for r in root.values()}
    return collections.Counter((k, least[root[s]], links[s], n[s]) for (k, _), s in zip(rows, sets, strict=True))


def near_rows(draw, words):
    rows, k = [], 0
    for size in [1] * 20 + [2] * 10 + [5, 90]:
        base = prose(draw, words, 120).split()
        for _ in range(size):
            own = base[:]
            for _ in range(draw.randint(0, 3)):
                own[draw.randrange(len(own))] = draw.choice(words)
            rows.append((k, " ".join(own)))
            k += 1
    return rows


def test_near_duplicates_against_all_pairs(spark, words):
    rows = near_rows(random.Random(6), words)
    rows += [(900, None), (901, ""), (902, "..."), (903, "one two"), (904, "One, TWO!"), (905, "one two three"), (906, "One, TWO!"), (906, "One, TWO!")]
    rows += [(907, "long " * 90_000), (None, rows[3][1]), (None, rows[3][1]), (None, "alone and without an id")]
    docs = docs_of(spark, rows)
    want = brute_classes(rows)
    for lot in (40, 3):
        found = near_duplicates.classes(docs, small=8 if lot > 8 else 2, lot=lot, block=16)
        assert collections.Counter((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in found.collect()) == want
    kept = near_duplicates.keep_one(docs.withColumns({"gone": F.lit(1), "print": F.lit(2), "row": F.lit(3)}))
    assert kept.columns == [*docs.columns, "gone", "print", "row"]
    assert {r.doc_id for r in kept.collect()} == {c for _, c, _, _ in want} | {None} and kept.filter("doc_id is null").count() == 3
    assert near_duplicates.classes(docs.limit(0)).count() == 0 and near_duplicates.keep_one(docs.limit(0)).count() == 0


def test_texts_that_share_an_id_keep_their_links(spark, words):
    draw = random.Random(16)
    a, b = prose(draw, words, 400), prose(draw, words, 400)
    rows = [(1, a), (1, b), (2, f"{a} more"), (3, f"{b} more")]
    got = collections.Counter(map(tuple, near_duplicates.classes(docs_of(spark, rows)).collect()))
    assert got == brute_classes(rows) == {(1, 1, 1, 1): 2, (2, 1, 1, 1): 1, (3, 1, 1, 1): 1}
    assert sorted(r.doc_id for r in near_duplicates.keep_one(docs_of(spark, rows)).collect()) == [1, 1]


def test_runs_reach_the_target_recall(spark):
    assert near_duplicates.runs_for(0.999, 0.8) == 10 and near_duplicates.runs_for(0.9, 0.8) == 4
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, got = ({k: n for k, _, n, _ in x} for x in (brute_classes(rows), map(tuple, near_duplicates.classes(docs).collect())))
    assert sum(want.values()) and sum(min(n, got[k]) for k, n in want.items()) >= 0.99 * sum(want.values()) and all(got[k] <= n for k, n in want.items())


def test_components(spark):
    edges = [(k, k + 1) for k in range(20)] + [(50, 60), (60, 50), (70, 70)]
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {k: 0 for k in range(21)} | {50: 50, 60: 50} and got.count() == 23


def test_pipeline_against_plain_stages(spark, words, tmp_path):
    """Every stage of a small table with nulls, ties, repeated rows, long texts and clashing columns, against a plain version of it."""
    from test_texts import brute_contamination

    draw = random.Random(21)
    junk = lambda: " | ".join(draw.choices(words, k=60))
    rows = [(k, prose(draw, words, draw.randint(30, 150)) if k % 4 else junk()) for k in range(160)]
    passage = " ".join(prose(draw, words, 14).replace(".", "") + "." for _ in range(5))
    rows += [(k, f"{prose(draw, words, 60)}. {passage} {prose(draw, words, 60)}.") for k in range(200, 206)]
    items = [(k, " ".join(draw.choices(words, k=20))) for k in range(4)] + [(9, None), (10, "")]
    rows += [(k, f"{prose(draw, words, 60)}. {items[k % 4][1]} {prose(draw, words, 60)}.") for k in range(300, 306)]
    rows += [(400, rows[1][1]), (401, rows[2][1] + " more"), (402, None), (403, ""), (1, rows[1][1]), (None, prose(draw, words, 90)), (404, "the and of " * 9000)]
    clash = {c: F.lit(1) for c in ("label", "print", "hash", "length", "bucket", "__gone", "__hits", "__n_words", "__removed", "rep", "features")}
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns(clash)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels_of(spark, [(k, int(k % 4 > 0), 0) for k in range(160)]).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plain = lambda d: collections.Counter((r.doc_id, r.text) for r in d.select("doc_id", "text").collect())
    took = [spark.read.parquet(str(tmp_path / "documents.parquet"))]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, took[-1], str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{len(took)}"))
        took.append(spark.read.parquet(str(tmp_path / f"stage{len(took)}")))
    good, one, cut, clean, packed = took[1:]
    assert all(x.columns == docs.columns for x in took[:-1])

    stats = {t: np.array(quality.statistics((t or "").encode()), "f4").astype("f8") for _, t in rows}
    x = {y: np.array([stats[t] for k, t in rows if k is not None and k < 160 and int(k % 4 > 0) == y and zlib.crc32(str(k).encode()) % 5]) for y in (0, 1)}
    model = quality.Discriminant({y: (len(v), v.sum(0), v.T @ v) for y, v in x.items()})
    want = collections.Counter((k, t) for k, t in rows if model.scores(stats[t][None])[0] >= 0.3)
    assert plain(good) == want and 100 < sum(want.values()) < len(rows)

    kept = list(want.elements())
    class_of = {k: c for k, c, _, _ in brute_classes(kept)}
    want = collections.Counter((k, t) for k, t in kept if k is None or class_of[k] == k)
    assert plain(one) == want and sum(want.values()) < len(kept)

    kept = list(want.elements())
    gone, want = brute_removed(kept), collections.Counter()
    for k, t in kept:
        raw = (t or "").encode()
        spans = spans_and_runs(raw)[0] if k in gone else []
        want[k, None if t is None else b"".join([raw[: spans[0][0]] if spans else raw, *(raw[s:e] for n, (s, e) in enumerate(spans) if n not in gone[k])]).decode()] += 1
    assert plain(cut) == want and sum(passage in (t or "") for _, t in want) == 1

    flags = collections.Counter((k, n, hit) for k, n, hit, _, _, over in brute_contamination(list(want), [(str(i), t) for i, t in items]) if over)
    over = {k for k, _, _ in flags}
    want = collections.Counter({x: n for x, n in want.items() if x[0] not in over})
    assert plain(clean) == want and over

    whole = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json")).whole
    lengths = collections.Counter((k, len(whole.encode(t or "", add_special_tokens=False).ids) + 1) for k, t in want.elements())
    got = packed.groupBy("doc_id", F.col("start") - F.col("piece") * 4096).agg(F.sum("length").alias("n"), F.count_if(F.col("piece") == 0).alias("docs")).collect()
    assert collections.Counter((r.doc_id, r.n) for r in got if r.docs == 1) == collections.Counter({x: n for x, n in lengths.items() if n == 1})
    assert packed.groupBy("sequence_id").agg((F.sum("length") == F.max(F.col("offset") + F.col("length"))).alias("ok"), F.sum("length").alias("n")).filter("not ok or n > 4096").count() == 0


def test_pipeline_of_empty_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() == 0


def test_pipeline_stage_by_stage(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns and 0 < after.count() <= n
        docs, n = after, after.count()
    packed = corpus_pipeline.packed(spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == n
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
