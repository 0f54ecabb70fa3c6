"""LM scoring with a subword lattice: the probability of a text summed over its segmentations.

A text is a row of sentences and an end. At its start a sentence is taken whole, if it has eight words or
more and training texts have it, or else written word by word. A word is taken whole, if training texts have
it, or else spelt by the pieces of an existing subword vocabulary; all its segmentations into pieces count,
added up by a forward recursion in log space. The end may stand for any word. Each choice is a distribution,
so the probabilities of all texts add up to one at most.

Counts: of words and sentences seen c times in the training texts, c - d goes to the unit itself and d to
what comes below it (d is estimated from how many are seen once and twice). The scores stored in the vocabulary
at hand are minus the ranks of its merges, not log probabilities, so they cannot weigh segmentations: a piece's
score is estimated anew, from how often the vocabulary's own tokenizer cuts it from the kinds of training words,
each taken once, as spelling is for words not seen. The pieces stay those of the vocabulary.

All words, sentences and their counts are kept. The `hot` most frequent words of at most `hot_bytes` bytes are
looked up in the tasks, all other words and all sentences by joins; which way a word goes changes no score.

Defined results: a null text is empty and scores the end alone; rows equal in id and text each get the same
result; without training texts words are spelt with equal scores; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import math
import re
import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow, batch_of, chunks, fold, saved, text_bytes

_BORDER = re.compile(rb"(?<=[.!?]) ")
MARK = "▁"
WORD, SENTENCE, ALL_SENTENCES = 0, 1, 2


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: A-Z only, and ASCII white space


def split(words: list[bytes]) -> list[bytes]:
    """The sentences of a row of words, single-spaced."""
    return _BORDER.split(b" ".join(words)) if words else []


def key(sentence: bytes) -> bytes:
    return struct.pack(">Q", xxhash.xxh3_64_intdigest(sentence))


def counts(docs: DataFrame, held_out: int, least_words: int = 8, flush: int = 400_000) -> DataFrame:
    """kind, unit, n: how often training texts have each word, each sentence of at least least_words, and any; words of other texts have 0."""
    schema = arrow("kind int, unit binary, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        sentences: Counter = Counter()
        every: Counter = Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            for kind, c in ((WORD, words), (SENTENCE, sentences), (ALL_SENTENCES, every)):
                if c:
                    yield batch_of(schema, np.full(len(c), kind, "i4"), list(c), list(c.values()))
                c.clear()

        for b in chunks(batches):
            for text, learn in zip(text_bytes(b), b.column("learn").to_pylist(), strict=True):
                own = tokens(text)
                if learn:
                    words.update(own)
                    said = split(own)
                    every[b""] += len(said)
                    sentences.update(key(s) for s in said if s.count(b" ") >= least_words - 1)
                else:
                    words.update(dict.fromkeys(own, 0))
            if len(words) + len(sentences) > flush:
                yield from rows()
        yield from rows()

    learn = (fold() != held_out).alias("learn")
    return docs.select("text", learn).mapInArrow(run, "kind int, unit binary, n long").groupBy("kind", "unit").agg(F.sum("n").alias("n"))


class Lattice:
    """Log probabilities of words by a vocabulary's pieces."""

    def __init__(self, pieces: list[str], logs: np.ndarray):
        """Pieces `<0xNN>` stand for bytes; a character without a piece is written by its bytes."""
        self.trie: dict = {}
        self.longest = max(map(len, pieces), default=1)
        self.bytes = [-math.inf] * 256
        for piece, p in zip(pieces, logs.tolist(), strict=True):
            if re.fullmatch("<0x[0-9A-F]{2}>", piece):
                self.bytes[int(piece[3:5], 16)] = p
            elif piece and not piece.startswith("<"):
                node = self.trie
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = p

    def log(self, word: str) -> float:
        """The natural log of the sum over all segmentations, by the forward recursion."""
        text = MARK + word
        into: list[list[float]] = [[] for _ in range(len(text) + 1)]
        into[0] = [0.0]
        alpha = 0.0
        for i in range(len(text)):
            terms = into[i]
            if not terms:
                continue
            if len(terms) == 1:
                alpha = terms[0]
            else:
                top = max(terms)
                alpha = top + math.log(sum([math.exp(t - top) for t in terms]))
            into[i] = terms[:0]
            node, j, single = self.trie, i, False
            for c in text[i : i + self.longest]:
                node = node.get(c)
                if node is None:
                    break
                j += 1
                if "" in node:
                    single |= j == i + 1
                    into[j].append(alpha + node[""])
            if not single:
                into[i + 1].append(alpha + sum(self.bytes[x] for x in text[i].encode()))
        terms = into[-1]
        top = max(terms)
        return top + math.log(sum(math.exp(t - top) for t in terms))


def _vocabulary(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _piece_counts(words: DataFrame, path: str) -> np.ndarray:
    """How many kinds of training words each piece cuts; as many numbers as the vocabulary has."""
    schema = arrow("piece int, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _vocabulary(path)
        n = np.zeros(model.get_piece_size(), "i8")
        for b in batches:
            ids = model.encode([w.decode() for w in b.column("unit").to_pylist()], num_threads=1)
            n += np.bincount(np.fromiter((i for x in ids for i in x), "i8"), minlength=len(n))
        at = np.flatnonzero(n)
        yield batch_of(schema, at, n[at])

    out = np.zeros(_vocabulary(path).get_piece_size())
    for r in words.select("unit").mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        out[r["piece"]] = r["n"]
    return out


def _seen(units: DataFrame) -> tuple[int, int, float]:
    """The sum of the counts, how many are not 0, and the discount."""
    r = units.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).first()
    return r["n"], r["v"], min(0.95, (r["once"] + 1) / (r["once"] + 2 * r["twice"] + 2))


def _add10(a, b):
    """log10(10**a + 10**b) of columns."""
    return F.greatest(a, b) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(a - b)))


def score_documents(docs: DataFrame, vocabulary: str, held_out: int = 1, least_words: int = 8, floor: float = 0.01, hot: int = 300_000, hot_bytes: int = 64) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    units = saved(counts(docs, held_out, least_words), "units")
    words = units.filter(F.col("kind") == WORD).select("unit", "n")
    sentences = units.filter(F.col("kind") == SENTENCE).select("unit", "n")
    ends = docs.filter(fold() != held_out).count()
    n_words, v_words, d_words = _seen(words)
    n_long, v_long, d_long = _seen(sentences)
    n_sentences = units.filter(F.col("kind") == ALL_SENTENCES).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    train, rest = n_words + ends, n_words + ends + 0.5 * (v_words + (ends > 0) + 1)
    log10 = math.log(10)
    whole = n_sentences + ends + 1  # choices at starts of sentences
    by_words = math.log10((whole - (n_long - d_long * v_long)) / whole)
    total = n_words + ends + 1
    end_score = math.log10((ends + 0.5) / total)
    spelt = math.log((d_words * v_words + 0.5) / total)

    model = _vocabulary(vocabulary)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    mass = _piece_counts(words.filter("n > 0"), vocabulary) + floor
    all_mass = mass.sum() + v_words + 1
    spelt += math.log((v_words + 1) / all_mass)  # the end of a spelt word
    lattice = context.broadcast((pieces, np.log(mass / all_mass)))
    scored_schema = arrow("unit binary, n long, score double")

    def word_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_pieces = Lattice(*lattice.value)
        for b in batches:
            out = []
            for w, n in zip(b.column("unit").to_pylist(), b.column("n").to_pylist(), strict=True):
                p = spelt + by_pieces.log(w.decode())
                if n:
                    own = math.log((n - d_words) / total)
                    p = max(p, own) + math.log1p(math.exp(-abs(p - own)))
                out.append(p / log10)
            yield pa.RecordBatch.from_arrays([b.column("unit"), b.column("n"), pa.array(out, pa.float64())], schema=scored_schema)

    scored = saved(words.mapInArrow(word_scores, "unit binary, n long, score double"), "words")
    most = scored.filter(F.length("unit") <= hot_bytes).orderBy(F.col("n").desc(), "unit").limit(hot).toArrow()  # `hot` rows of at most `hot_bytes` and two numbers
    lookups = context.broadcast((most.column("unit").to_pylist(), most.column("n").to_numpy(), most.column("score").to_numpy()))
    base_end = math.log10((ends + 0.5) / rest)

    # a row a long sentence, and one a document with all the rest of it; n_tokens is not 0 in the latter
    row = "unit binary, doc_id long, text_hash long, n_tokens long, n_known long, base_score double, score double, rare array<binary>"
    schema = arrow(row)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_units, n, scores = lookups.value
        known_base = np.log10((n + 0.5) / rest).tolist()
        table = dict(zip(hot_units, zip((n > 0).astype(int).tolist(), known_base, scores.tolist(), strict=True), strict=True))
        get = table.get
        for b in chunks(batches, 256):
            out: list[tuple] = []
            for doc, text in zip(b.column("doc_id").to_pylist(), text_bytes(b), strict=True):
                own = tokens(text)
                h = xxhash.xxh3_64_intdigest(text) - 2**63
                known, base_score, score, rare = int(ends > 0), base_end, end_score, []
                if not own or own[-1][-1:] in b".!?":
                    score += by_words
                for s in split(own):
                    these = s.split(b" ")
                    found = list(map(get, these))
                    k, x, y, missing = 0, 0.0, by_words, []
                    for w, f in zip(these, found, strict=True):
                        if f is None:
                            missing.append(w)
                        else:
                            k += f[0]
                            x += f[1]
                            y += f[2]
                    if len(these) >= least_words:
                        out.append((key(s), doc, h, 0, k, x, y, missing))
                    else:
                        known, base_score, score = known + k, base_score + x, score + y
                        rare += missing
                out.append((b"%d %d" % (doc or 0, h), doc, h, len(own) + 1, known, base_score, score, rare))
            if out:
                yield batch_of(schema, *zip(*out, strict=True))

    rows = docs.mapInArrow(look_up, row).join(sentences.select("unit", F.col("n").alias("c")), "unit", "left")
    own = F.log10((F.col("c") - d_long) / whole)
    seen = F.col("c").isNotNull() & (F.col("n_tokens") == 0)
    late = seen & (F.size("rare") > 0)  # by words too, once the rare ones are known
    said = rows.select(
        "doc_id", "text_hash", "n_tokens", "n_known", "base_score", F.when(late, 0.0).when(seen, _add10(own, F.col("score"))).otherwise(F.col("score")).alias("score"),
        F.when(F.size("rare") > 0, F.struct("rare", F.when(late, F.struct(own.alias("whole"), F.col("score").alias("words"))).alias("late"))).alias("rare"),
    )
    by_doc = said.groupBy("doc_id", "text_hash").agg(
        F.count_if(F.col("n_tokens") > 0).alias("copies"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"),
        F.collect_list("rare").alias("rare"),
    )
    # each rare word with the place of the sentence that waits for it, or -1
    rare = F.flatten(F.transform("rare", lambda r, k: F.transform(r["rare"], lambda w: F.struct(w.alias("unit"), F.when(r["late"].isNull(), -1).otherwise(k).alias("place")))))
    # the document's own row goes along with its rare words, under a unit that no word equals
    alone = F.struct(F.concat(F.lit(" "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.col("text_hash").cast("string")).cast("binary").alias("unit"), F.lit(-2).alias("place"))
    mine = F.col("word.place") == -2
    each = by_doc.withColumn("word", F.explode(F.concat(rare, F.array(alone)))).select(
        "doc_id", "text_hash", "word.unit", "word.place", *(F.when(mine, F.col(c)).alias(c) for c in ("copies", "n_tokens", "n_known", "base_score", "score")), F.when(mine, F.transform("rare", lambda r: r["late"])).alias("late")
    )
    found = each.join(scored.select("unit", F.col("n").alias("c"), F.col("score").alias("word_score")), "unit", "left")
    mine = F.col("place") == -2
    summed = found.groupBy("doc_id", "text_hash").agg(
        F.max("copies").alias("copies"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(mine, F.col("n_known")).otherwise((F.col("c") > 0).cast("long"))).alias("n_known"),
        F.sum(F.when(mine, F.col("base_score")).otherwise(F.log10((F.col("c") + 0.5) / F.lit(float(rest))))).alias("base_score"),
        F.sum(F.when(mine, F.col("score")).when(F.col("place") == -1, F.col("word_score")).otherwise(0.0)).alias("score"),
        F.collect_list(F.when(F.col("place") >= 0, F.struct("place", "word_score"))).alias("waited"), F.flatten(F.collect_list("late")).alias("late"),
    )
    words_of = lambda x, k: F.aggregate(F.filter("waited", lambda w: w["place"] == k), x["words"], lambda a, w: a + w["word_score"])
    waited = F.aggregate(F.transform("late", lambda x, k: F.when(x.isNull(), 0.0).otherwise(_add10(x["whole"], words_of(x, k)))), F.lit(0.0), lambda a, x: a + x)
    summed = summed.withColumn("score", F.col("score") + waited)
    one = lambda c: F.col(c) / F.col("copies")
    return summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "doc_id", (fold() == held_out).alias("held_out"), one("n_tokens").cast("long").alias("n_tokens"), one("n_known").cast("long").alias("n_known"),
        F.lit(int(train)).cast("long").alias("train_tokens"), one("base_score").alias("base_score"), one("score").alias("score"),
    )
