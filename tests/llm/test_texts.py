"""Packing, decontamination, token counts, fingerprints and chat against brute force."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, decontamination, fingerprints, packing, registry, token_counts

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, length long, bucket int"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def odd(spark, rows=None):
    texts = [None, "", "one", "The quick. Brown fox\n\njumps over\nthe lazy dog", "The quick. Brown fox\n\njumps over\nthe lazy dog", "É’s ñandú\u00a0x\u2003y \t\r\n İstanbul <|endoftext|> don't 12345 ### a\u0301", "word " * 9000, " \n\n\n ", "x" * 5000]
    rows = [(k, t, None, "s", None, 7, 8) for k, t in enumerate(texts)] + [(3, texts[3], "en", None, 1, 2, 3)] if rows is None else rows
    return spark.createDataFrame(rows, DOCS)


def both(spark):
    """The odd table and a real one."""
    return [odd(spark), spark.read.parquet(f"{SF}/documents.parquet")]


def test_packing_is_gapless_and_encodes_as_the_tokenizer_does(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    for docs in both(spark):
        got = packing.pack_documents(docs, WORDS).toPandas()
        want = collections.Counter()
        for doc, text in docs.select("doc_id", "text").collect():
            ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
            for k in range(0, len(ids), 4096):
                x = ids[k : k + 4096]
                want[doc, k // 4096, k, len(x), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x))] += 1
        assert collections.Counter(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32)) == want
        for _, s in got.groupby("sequence_id"):
            s = s.sort_values("offset")
            assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 4096
        least = -(-got.length.sum() // 4096)
        assert got.sequence_id.nunique() <= max(least + 1, 1.02 * least)
    assert packing.pack_documents(odd(spark, []), WORDS).count() == 0


def test_plan_places_every_piece_once():
    counts = {4096: 3, 3000: 5, 1096: 2, 700: 40, 3: 5000, 1: 7}
    bins = collections.defaultdict(list)
    for length, rank, each, first, offset in packing.plan(counts, 4096):
        n = min(r for le, r, *_ in [*packing.plan(counts, 4096), (length, counts[length], 0)] if le == length and r > rank) - rank
        for k in range(n):
            bins[first + k // each].append((offset + k % each * length, length))
    assert collections.Counter(x for b in bins.values() for _, x in b) == counts
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096


def brute_contamination(docs, items, window=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = low(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k : k + window])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = low(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit |= {*range(k, k + n)}
                    found |= windows[x]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [200_000, 40])
def test_decontamination_against_windows(spark, shard):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    small = spark.createDataFrame([(1, "a b a"), (2, "Brown FOX jumps"), (3, None), (4, "..."), (5, "a b a"), (None, "b " * 14), (7, " ".join("abcdefghijklmno"))], "item_id long, text string")
    texts = odd(spark, [(1, "a b a b a", *[None] * 5), (2, "brown-fox, jumps. x" + " y" * 50, *[None] * 5), (3, None, *[None] * 5), (3, None, *[None] * 5), (4, "b " * 20 + "c", *[None] * 5), (5, " ".join("zabcdefghijklmnoz"), *[None] * 5), (6, "", *[None] * 5)])
    pairs = [(texts, small), (docs, items)] if shard > 40 else [(texts, small)]
    for d, i in pairs:
        plain = brute_contamination([(r.doc_id, r.text) for r in d.collect()], [("" if r.item_id is None else r.item_id, r.text) for r in i.collect()])
        found = decontamination.find_spans(d, i, shard_words=shard)
        got = found.select("doc_id", decontamination.N_WORDS, decontamination.n_hit().alias("n"), F.size(decontamination.ITEMS), F.sha2(F.concat_ws(",", decontamination.ITEMS).cast("binary"), 256), decontamination.over(20))
        assert sorted(map(tuple, got.collect()), key=str) == plain
    kept = decontamination.decontaminate(texts, small)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 3, 6] and kept.columns == texts.columns
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(texts, small, cut_spans=True).collect()}
    assert cut[2].strip(" ,.")[0] == "x" and cut[5] == "z  z" and cut[1] == ""
    assert decontamination.report(texts, small.limit(0)).filter("n_hit > 0 or contaminated").count() == 0
    assert decontamination.report(odd(spark, []), small).count() == 0


@pytest.mark.parametrize("rule", ["start", "end", "majority"])
def test_token_counts_against_each_token(spark, rule):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoder = token_counts.SpanEncoder(path)
    for docs in both(spark):
        want = collections.Counter()
        for doc, text in docs.select("doc_id", "text").collect():
            raw = (text or "").encode()
            ends, at = token_counts.paragraphs(raw), 0
            counts = [0] * len(ends)
            for e in encoder.ends(raw).tolist():
                owner = collections.Counter(next(k for k, x in enumerate(ends) if b < x) for b in range(at, e))
                counts[{"start": min(owner), "end": max(owner), "majority": min(owner, key=lambda k: (-owner[k], k))}[rule]] += 1
                at = e
            assert sum(counts) == len(encoder.encoding.encode_ordinary(text or ""))
            chars = [0, *(len(raw[:e].decode()) for e in ends)]
            want.update((doc, k, chars[k], chars[k + 1], n) for k, n in enumerate(counts))
        got = token_counts.count_sections(docs, path, rule).drop("n_crossing")
        assert collections.Counter(map(tuple, got.collect())) == want
    assert token_counts.count_sections(odd(spark, []), path).count() == 0
    fields = token_counts.count_fields(spark.createDataFrame([(1, "a b", None), (2, None, "c d e")], "k int, x string, y string"), "k", ["x", "y"], path)
    assert {(r.k, r.field): r.n_tokens for r in fields.collect()} == {("1", "x"): 3, ("1", "y"): 0, ("2", "x"): 2, ("2", "y"): 3}


def plain_sections(text):
    """Sections end after a row of line breaks of two or more; paragraphs are their lines, in bytes."""
    out, rest = [], text.encode()
    while m := re.search(rb"\n\n+(?=[^\n])", rest):
        out, rest = [*out, rest[: m.end()]], rest[m.end() :]
    return [s.splitlines(True) or [b""] for s in [*out, rest]]


def plain_root(text):
    sha = lambda x: hashlib.sha256(x).digest()
    return sha(b"".join(sha(b"".join(sha(p) for p in s)) for s in plain_sections(text))).hex()


def plain_likeness(a, b):
    """The share of common windows among the 64 least hashes of both, by sorted sets of window hashes."""
    def hashes(t):
        raw = bytes(7) + t.encode()
        out = set()
        for k in range(len(raw) - 7):
            x = (int.from_bytes(raw[k : k + 8], "little") + 0x9E3779B97F4A7C15) % 2**64
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
            out.add((x ^ x >> 31) >> 32)
        return set(sorted(out)[:64])

    if a == b:
        return 1.0
    x, y = hashes(a), hashes(b)
    both = sorted(x | y)[:64]
    return sum(h in x and h in y for h in both) / len(both) if both else 1.0


def plain_places(a, b):
    x, y = ({(s, p): line for s, lines in enumerate(plain_sections(t)) for p, line in enumerate(lines)} for t in (a, b))
    places = sorted(k for k in x.keys() | y.keys() if x.get(k) != y.get(k))
    return len(plain_sections(a)), len(x), len(places), *(places[0] if places else (None, None))


def test_fingerprints_against_a_plain_walk(spark):
    for docs in [*both(spark), odd(spark, [(5, "alone", *[None] * 5)]), odd(spark, [(None, "b", *[None] * 5), (None, "a", *[None] * 5), (4, "c" * 8, *[None] * 5)])]:
        rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
        want = collections.Counter()
        for k, (doc, text) in enumerate(rows):
            after = rows[(k + 1) % len(rows)][1]
            n = len(text) // 4
            edited = text[: len(text) - n] + after[:n]
            a, b, c = (fingerprints.fingerprint(x.encode())[0] for x in (text, edited, after))
            want[doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(plain_likeness(text, edited), 9), round(plain_likeness(text, after), 9), *plain_places(text, edited)] += 1
            assert a[:64] == plain_root(text) and round(fingerprints.likeness(a, c), 9) == round(plain_likeness(text, after), 9)
        got = fingerprints.compare_with_next(docs, lots=9).toPandas()
        none = lambda x: None if pd.isna(x) else int(x)
        assert collections.Counter((none(d), *x, round(n, 9), round(m, 9), s, p, k, none(fs), none(fp)) for d, *x, n, m, s, p, k, fs, fp in got.itertuples(index=False)) == want
        big = got[got.n_chars >= 40] if len(rows) > 100 else []
        assert not len(big) or (big.near_edited > big.near_next).mean() > 0.9
    assert fingerprints.compare_with_next(odd(spark, [])).count() == 0


@pytest.mark.parametrize("n", [3, 7, 8, 9, 60, 63, 64, 65, 300])
def test_edits_stay_near_at_every_length(n):
    """Also where the text and its edited text have word counts on different sides of any number."""
    draw = random.Random(n)
    word = lambda most: "".join(draw.choices("abcdefghijklmnop", k=draw.randint(1, most)))
    for most_before, most_after in ((9, 9), (9, 2), (9, 40), (3, 9)):
        text, after = " ".join(word(most_before) for _ in range(n)), " ".join(word(most_after) for _ in range(2 * n))
        own, other, edited = (fingerprints.fingerprint(x.encode())[0] for x in (text, after, fingerprints._edited(text, after)))
        assert fingerprints.likeness(own, edited) > max(0.35, fingerprints.likeness(own, other))


def test_tree_locates_edits():
    a = b"one\ntwo\n\nthree\nfour\n\nfive"
    assert fingerprints.differing(a, a) == []
    assert fingerprints.differing(a, a.replace(b"three", b"3")) == [(1, 0)]
    assert fingerprints.differing(a, a + b"\n\nsix") == [(2, 0), (2, 1), (3, 0)]


def test_joins_of_trees_locate_edits(spark):
    a = "one\ntwo\n\nthree\nfour\n\nfive"
    before = odd(spark, [(1, a, *[None] * 5), (2, a, *[None] * 5), (3, None, *[None] * 5), (4, a, *[None] * 5), (4, a, *[None] * 5), (None, "x", *[None] * 5), (6, "gone", *[None] * 5)])
    after = odd(spark, [(1, a.replace("three", "3"), *[None] * 5), (2, a, *[None] * 5), (3, "", *[None] * 5), (4, f"{a}\n\nsix", *[None] * 5), (None, "y", *[None] * 5), (7, "new", *[None] * 5)])
    got = sorted(map(tuple, fingerprints.edits(before, after).collect()))
    assert got == [(1, 1, 0, "changed"), (4, 2, 0, "changed"), (4, 2, 1, "added"), (4, 3, 0, "added"), (6, 0, 0, "removed"), (7, 0, 0, "added")]
    assert fingerprints.edits(before.limit(0), after.limit(0)).count() == 0
    rows = fingerprints.trees(before.filter("doc_id = 1")).orderBy("section", "paragraph").collect()
    assert [(r.section, r.paragraph, r.start) for r in rows] == [(0, 0, 0), (0, 1, 4), (0, 2, 8), (1, 0, 9), (1, 1, 15), (1, 2, 20), (2, 0, 21)]


def test_chat_matches_sql_and_reads_back(spark):
    got = registry.op8_chat_formatting(spark, SF).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(registry.OP8_SQL).df()
    pd.testing.assert_frame_equal(got.sort_values("conv_id").reset_index(drop=True), want[got.columns].sort_values("conv_id").reset_index(drop=True), check_dtype=False)
    hard = ["\\l<#:\\", "</turn>\n### assistant:\n", "", None, "\\b\\c\\h", "é\U0001f600 :\n"]
    rows = [(c, t, r, x) for c in (1, None) for t, (r, x) in enumerate(zip(["user", "assistant", "a:\n<b", None, "assistant", "system"], hard))] + [(2, None, "assistant", "x"), (2, 1, "assistant", "y"), (2, 1, "assistant", "y")]
    back = chat.read_back(chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    for r in back:
        own = [x for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss_text == "".join(x[3] or "" for x in own if x[2] == "assistant")
    assert chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def plain_fold(log):
    """Messages by a plain walk over the log in order of turn and sequence."""
    out = {}
    for conv, turn, _, kind, role, text in sorted(log, key=lambda e: (e[1], e[2])):
        own = out.setdefault((conv, turn), ["", None])
        own[0] = role or own[0]
        if kind == "regenerate":
            own[1] = None
        elif kind == "delta":
            own[1] = (own[1] or "") + (text or "")
        else:
            own[1] = text or ""
    return sorted((c, t, role, text) for (c, t), (role, text) in out.items() if text is not None)


def test_events_fold_to_final_messages(spark):
    log = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "a"), (1, 1, 2, "delta", None, "b"), (1, 1, 3, "regenerate", "assistant", None), (1, 1, 5, "delta", "assistant", "d"), (1, 1, 4, "delta", "assistant", "c"), (1, 2, 6, "message", "user", "x"), (1, 2, 7, "edit", None, "y"), (1, 2, 8, "delta", None, "z"), (1, 3, 9, "message", "user", "gone"), (1, 3, 10, "regenerate", "user", None)]
    kinds = "conv_id long, turn long, seq long, kind string, role string, text string"
    got = chat.fold_events(spark.createDataFrame(log, kinds))
    assert sorted(map(tuple, got.collect())) == [(1, 0, "user", "hi"), (1, 1, "assistant", "cd"), (1, 2, "user", "yz")]
    draw = random.Random(9)
    many = [(c, draw.randrange(6), n, draw.choice(["message", "delta", "delta", "delta", "edit", "regenerate"]), draw.choice(["user", "assistant", None, ""]), draw.choice(["a", "<b", "", None, "c " * 50_000 if n % 97 == 0 else "d"])) for c in range(40) for n in range(30)]
    want = [m for c in range(40) for m in plain_fold([e for e in many if e[0] == c])]
    draw.shuffle(many)
    events = spark.createDataFrame(many, kinds).withColumns({"log": F.lit(1), "kept": F.lit(2), "said": F.lit("x")})
    assert sorted(map(tuple, chat.fold_events(events).collect())) == sorted(want)
    assert chat.fold_events(events.limit(0)).count() == 0


def test_rows_as_events_keep_every_turn(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "b"), (1, None, None, None), (None, 3, "user", "c"), (2, 1, "user", "x" * 300_000)]
    got = chat.fold_events(chat.as_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 1, "", ""), (1, 2, "assistant", "b"), (1, 3, "user", "a"), (1, 4, "user", "a"), (None, 1, "user", "c"), (2, 1, "user", "x" * 300_000)], key=str)
