"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learnt from document labels.

A sentence's score is a logistic function of the words that it has; a document is toxic if any sentence is:
P = 1 - prod(1 - p). The words' weights are fitted so that P explains the documents' labels, and the
sentences' own scores then tell which ones offend.

The fit uses at most `sample` labelled documents outside the held-out fold, half of each label, those with
the least hashes of their ids; together the documents of either label weigh the same. A word has itself and
its first four and five code points as features, so that forms never seen count by their stems. Features are
those of at least `least` sample documents with the strongest association with toxic ones, `words` at most.
Loss and gradient are added up by the executors over the sample's bags of sentences; a row of sums for each of
`tasks` tasks comes to the driver a round, which takes the steps (L-BFGS).

Defined results: a null or empty text has no sentences and scores 0; without labelled rows of both kinds
every score is the share of toxic ones, 0.5 without any; a null id is an id of its own and has no labels; repeated rows are scored each by itself; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow, batch_of, chunks, fold, saved, text_bytes

#: A-Z to a-z, ends of sentences and lines to a line break, other ASCII but letters and digits to a space.
_TABLE = bytes(10 if chr(b) in ".!?\n" else b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))
SCORES = "doc_id long, score double, n_sentences long, n_offending long, worst_start long, worst_end long"


def sentences(text: bytes) -> list[bytes]:
    """The normalised sentences, as long as in the text; blank ones too, so that places can be counted."""
    return text.translate(_TABLE).split(b"\n")


def forms(word: bytes) -> tuple[bytes, ...]:
    """A word's features: itself, and its stems of code points, which end in a mark that no word has."""
    if word.isascii():
        return word, word[:4] + b"-", word[:5] + b"-"
    text = word.decode()
    return word, text[:4].encode() + b"-", text[:5].encode() + b"-"


class Model:
    """The words' weights, the bias of a sentence, and the score that all texts get where there is no model."""

    def __init__(self, weights: dict[bytes, float], bias: float, constant: float | None = None):
        self.weights, self.bias, self.constant = weights, bias, constant
        self.known: dict[bytes, float] = {}

    def weight(self, word: bytes) -> float:
        got = self.known.get(word)
        if got is None:
            got = sum(self.weights.get(f, 0.0) for f in forms(word))
            if len(self.known) > 500_000:
                self.known.clear()
            if len(word) <= 48:
                self.known[word] = got
        return got

    def scores(self, lines: list[bytes]) -> list[tuple[int, float]]:
        """Of the lines with words: number and logit. Those without any weighted word all have the bias."""
        split = [line.split() for line in lines]
        weighted = {w: x for w in {w for words in split for w in words} if (x := self.weight(w))}
        if not weighted:
            return [(k, self.bias) for k, words in enumerate(split) if words]
        return [(k, self.bias + sum(weighted[w] for w in weighted.keys() & words) if not weighted.keys().isdisjoint(words) else self.bias) for k, words in enumerate(split) if words]


def _softplus(a):
    return np.logaddexp(0, a)


def _sample(labels: DataFrame, label: str, held_out: int, sample: int) -> DataFrame:
    own = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").filter(fold() != held_out)
    own = own.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("h", F.xxhash64("doc_id"))
    return own.filter("label = 0").orderBy("h", "doc_id").limit(sample // 2).unionByName(own.filter("label = 1").orderBy("h", "doc_id").limit(sample // 2))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: int = 0, sample: int = 12_000, words: int = 4096, least: int = 4, rounds: int = 40, tasks: int = 12) -> Model:
    shares = {r["label"]: r["n"] for r in labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label in (0, 1)").filter(fold() != held_out).groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return Model({}, 0.0, 1.0 if shares.get(1) else 0.0 if shares else 0.5)
    chosen = saved(_sample(labels, label, held_out, sample).select("doc_id", "label"), "sample")  # sample rows of two numbers
    texts = saved(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "sample-texts")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_words
        for b in chunks(batches):
            n: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, y in zip(text_bytes(b), b.column("label").to_pylist(), strict=True):
                n[y].update({f for w in {*text.translate(_TABLE).split()} for f in forms(w)})
            own = list(n[0].keys() | n[1].keys())
            if own:
                yield batch_of(schema, own, [n[0][w] for w in own], [n[1][w] for w in own])

    arrow_words = arrow("word binary, clean long, toxic long")
    counted = texts.select("text", "label").mapInArrow(found, "word binary, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Model({}, 0.0, shares[1] / (shares[0] + shares[1]))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    strength = odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    vocabulary = [bytes(r["word"]) for r in counted.filter(F.col("clean") + F.col("toxic") >= least).filter(odds > 0).orderBy(strength.desc(), "word").limit(words).collect()]
    place = {w: k for k, w in enumerate(vocabulary)}
    bags_schema = arrow(BAGS)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            out = []
            for text, y in zip(text_bytes(b), b.column("label").to_pylist(), strict=True):
                kinds: Counter = Counter()
                for line in sentences(text):
                    if own := line.split():
                        kinds[tuple(sorted(place[f] for w in {*own} for f in forms(w) if f in place))] += 1
                out.append((y, list(kinds.values()), [len(k) for k in kinds], [w for k in kinds for w in k]))
            if out:
                yield batch_of(bags_schema, *zip(*out, strict=True))

    held = saved(texts.select("text", "label").mapInArrow(bags, BAGS).repartition(tasks), "bags")
    weight = {0: 0.5 / n0, 1: 0.5 / n1}
    sums_schema = arrow(SUMS)

    def loss(point: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, slope = 0.0, np.zeros(len(point))
            for b in batches:
                value, g = bag_loss(b, point, weight)
                total, slope = total + value, slope + g
            yield batch_of(sums_schema, [total], [slope])

        sums = held.mapInArrow(run, SUMS).collect()  # a row a task
        w = np.append(point[:-1], 0.0)
        return sum(r["loss"] for r in sums) + L2 / 2 * w @ w, np.sum([r["slope"] for r in sums], 0) + L2 * w

    start = np.zeros(len(vocabulary) + 1)
    mean = texts.select(F.avg(F.size(F.split("text", "[.!?\n]")))).first()[0]
    start[-1] = math.log(0.1 / max(1.0, mean or 1.0))
    *w, bias = minimised(loss, start, rounds).tolist()
    return Model({v: x for v, x in zip(vocabulary, w, strict=True) if abs(x) > 0.02}, bias)


BAGS = "label int, times array<int>, sizes array<int>, words array<int>"
SUMS = "loss double, slope array<double>"
L2 = 1e-4


def bag_loss(bags: pa.RecordBatch, point: np.ndarray, weight: dict[int, float]) -> tuple[float, np.ndarray]:
    """The weighted log loss of noisy-or over documents' bags of sentences, and its gradient by the words' weights and the bias."""
    y = bags.column("label").to_numpy()
    times, sizes, words = (bags.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("times", "sizes", "words"))
    doc = np.repeat(np.arange(len(y)), pc.list_value_length(bags.column("times")).to_numpy())
    sentence = np.repeat(np.arange(len(times)), sizes)
    each = np.where(y == 1, weight[1], weight[0])
    a = point[-1] + np.bincount(sentence, point[words], len(times))
    total = np.maximum(np.bincount(doc, times * _softplus(a), len(y)), 1e-12)
    value = each @ np.where(y == 1, -np.log(-np.expm1(-total)), total)
    slope = each * np.where(y == 1, -1 / np.expm1(np.minimum(total, 500)), 1.0)
    by_sentence = slope[doc] * times / (1 + np.exp(-np.clip(a, -500, 500)))
    return float(value), np.append(np.bincount(words, by_sentence[sentence], len(point) - 1), by_sentence.sum())


def minimised(loss, point: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """The point that L-BFGS reaches in so many evaluations of loss (value and gradient)."""
    value, slope = loss(point)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    length = 1.0
    for _ in range(rounds):
        way, kept = slope.copy(), []
        for s, g in reversed(steps):
            kept.append(s @ way / (s @ g))
            way -= kept[-1] * g
        if steps:
            s, g = steps[-1]
            way *= s @ g / (g @ g)
        else:
            way /= max(np.abs(way).max(), 1e-12)
        for (s, g), k in zip(steps, reversed(kept), strict=True):
            way += (k - g @ way / (s @ g)) * s
        after = point - length * way
        new, new_slope = loss(after)
        if not new <= value - 1e-4 * length * (slope @ way):
            length /= 4
            if length < 1e-4:
                break
            continue
        s, g = after - point, new_slope - slope
        if s @ g > 1e-12:
            steps = [*steps[1 - memory :], (s, g)]
        point, slope, length = after, new_slope, 1.0
        if value - new < 1e-7 * max(value, 1e-12):
            break
        value = new
    return point


def score(docs: DataFrame, model: Model, offending: float = 0.5) -> DataFrame:
    """Of each document: the noisy-or score, how many sentences reach `offending`, and the place in characters of the worst."""
    schema = arrow(SCORES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = math.log1p(math.exp(model.bias))
        limit = math.log(offending / (1 - offending))
        for b in chunks(batches):
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), text_bytes(b), strict=True):
                lines = sentences(text)
                if model.constant is not None:
                    out.append((doc, model.constant, len(lines), 0, None, None))
                    continue
                logits = model.scores(lines)
                total = sum(plain if a == model.bias else float(_softplus(a)) for _, a in logits)
                k, worst = max(logits, key=lambda x: x[1], default=(0, -math.inf))
                span = place(text, lines, k) if worst >= limit else (None, None)
                out.append((doc, -math.expm1(-total), len(logits), sum(a >= limit for _, a in logits), *span))
            if out:
                yield batch_of(schema, *zip(*out, strict=True))

    return docs.select("doc_id", "text").mapInArrow(run, SCORES)


def place(text: bytes, lines: list[bytes], k: int) -> tuple[int, int]:
    """The characters at which line k starts and ends."""
    start = sum(len(x) + 1 for x in lines[:k])
    return len(text[:start].decode()), len(text[: start + len(lines[k])].decode())


def locate(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, sentence, start_char, end_char, score: a row for each sentence that reaches the threshold."""
    schema = arrow("doc_id long, sentence int, start_char long, end_char long, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), text_bytes(b), strict=True):
                lines = sentences(text)
                for k, a in model.scores(lines):
                    if (p := 1 / (1 + math.exp(-max(a, -500)))) >= threshold:
                        out.append((doc, k, *place(text, lines, k), p))
            if out:
                yield batch_of(schema, *zip(*out, strict=True))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sentence int, start_char long, end_char long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and where the worst sentence stands."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_sentences", "n_offending", "worst_start", "worst_end")
