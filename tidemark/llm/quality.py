"""A quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text becomes a few statistics (shares of kinds of characters, word and sentence lengths, repetition),
taken through roots and logarithms so that the classes are nearer to normal. Each class has a mean and a
covariance that is shrunk towards the pooled one and towards its diagonal. A score is the logistic of the
difference of the classes' log densities, Mahalanobis distances by the Cholesky factors kept with the model.

The model needs only the classes' counts, sums and sums of products, which Spark adds up over all labelled
rows outside the held-out fold.

Defined results: a null text is empty; a document with several labels counts once for each; null labels are
no labels; without labelled rows every score is 0.5, and where one class has none, it is the other's share
with one half added to each count; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Marks, arrow, chunks, fold, marked, saved, text_bytes

_KINDS = ("letters", "upper", "digits", "marks", "ends", "signs", "bars", "spaces", "lines", "other")


def _masks() -> np.ndarray:
    out = np.zeros((256, len(_KINDS)))
    for b in range(256):
        c = chr(b)
        kind = "other" if b >= 128 else "lines" if c == "\n" else "spaces" if c.isspace() else "digits" if c.isdigit() else "letters" if c.isalpha() else "marks" if c in ".,;:'\"()-" else "ends" if c in "!?" else "bars" if c == "|" else "signs"
        out[b, _KINDS.index(kind)] = 1
        out[b, _KINDS.index("upper")] = b < 128 and c.isupper()
    return out


_MASKS = _masks()
STATISTICS = ("log_bytes", "upper", "digits", "marks", "ends", "signs", "bars", "lines", "other", "word_length", "distinct", "repeated", "top_word", "sentence_length", "worst_signs", "worst_repeated")


def statistics(text: bytes, stretches: int = 8) -> list[float]:
    """The transformed statistics of one text; those of the worst of its stretches find junk in a part."""
    raw = np.frombuffer(text, "u1")
    n = max(len(raw), 1)
    letters, upper, digits, marks, ends, signs, bars, spaces, lines, other = np.bincount(raw, minlength=256) @ _MASKS
    words = text.split()
    m = len(words)
    same = np.fromiter(map(eq, words, words[1:]), bool, max(m - 1, 0))
    top = max(Counter(words).values()) if words else 0
    odd = signs + bars + ends
    worst_signs, worst_same = odd / n, same.mean() if m > 1 else 0.0
    if m >= 16 * stretches:
        odd_at = _ODD[raw]
        edges = np.linspace(0, len(raw), stretches + 1).astype(int)
        worst_signs = max(odd_at[s:e].mean() for s, e in zip(edges[:-1], edges[1:], strict=True))
        edges = np.linspace(0, m - 1, stretches + 1).astype(int)
        worst_same = max(same[s:e].mean() for s, e in zip(edges[:-1], edges[1:], strict=True))
    return [
        np.log1p(len(raw)), np.sqrt(upper / max(letters, 1)), np.sqrt(digits / n), np.sqrt(marks / n), np.sqrt(ends / n), np.sqrt(signs / n), np.sqrt(bars / n), np.sqrt(lines / n), np.sqrt(other / n),
        np.log1p((n - spaces - lines) / max(m, 1)), np.log1p(len({*words})) / np.log1p(max(m, 1)), np.sqrt(same.mean() if m > 1 else 0.0), np.sqrt(top / max(m, 1)),
        np.log1p(m / (1 + text.count(b".") + ends)), np.sqrt(worst_signs), np.sqrt(worst_same),
    ]


_ODD = (_MASKS[:, [_KINDS.index(k) for k in ("signs", "bars", "ends")]].sum(1) > 0).astype("f4")
FEATURES = "doc_id long, features array<float>"


def features(docs: DataFrame, only: Marks | None = None) -> DataFrame:
    """The statistics of all documents, or of those whose ids `only` lets pass."""
    schema = arrow(FEATURES)
    held = only and only.table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            if held:
                b = b.filter(pa.array(marked(held.value, b.column("place").to_numpy())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array([np.array(statistics(t), "f4") for t in text_bytes(b)], schema.field(1).type)], schema=schema)

    place = [] if only is None else [only.place("doc_id").alias("place")]
    return docs.select("doc_id", "text", *place).mapInArrow(run, FEATURES)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype("f8")


class Discriminant:
    """The fitted classes 0 and 1: means, Cholesky factors of the inverse covariances, and log determinants."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = 0.2, to_diagonal: float = 0.05, floor: float = 1e-4):
        n = {k: moments[k][0] if k in moments else 0.0 for k in (0, 1)}
        self.prior = (n[1] + 0.5) / (n[0] + n[1] + 1)
        self.classes = []
        if min(n.values()) < 2:
            return
        total = sum(n.values())
        mean = {k: moments[k][1] / n[k] for k in n}
        scatter = {k: moments[k][2] - n[k] * np.outer(mean[k], mean[k]) for k in n}
        pooled = sum(scatter.values()) / total
        for k in (0, 1):
            own = (1 - to_pooled) * scatter[k] / n[k] + to_pooled * pooled
            own = (1 - to_diagonal) * own + to_diagonal * np.diag(np.diag(own))
            own += floor * np.eye(len(own))
            lower = np.linalg.cholesky(own)
            self.classes.append((mean[k], np.linalg.inv(lower).T, 2 * np.log(np.diag(lower)).sum(), np.log(n[k] / total)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.prior)
        log0, log1 = (p - 0.5 * (d + (((x - m) @ f) ** 2).sum(1)) for m, f, d, p in self.classes)
        return 1 / (1 + np.exp(np.clip(log0 - log1, -500, 500)))


def fit(feats: DataFrame, labels: DataFrame, label: str = "quality", held_out: int = 0) -> Discriminant:
    """From all labelled rows whose fold is not held_out; what comes to the driver is two rows of sums."""
    rows = feats.filter(fold() != held_out).join(labels.select("doc_id", F.col(label).cast("int").alias("label")).filter("label in (0, 1)"), "doc_id")
    out = arrow("label int, place int, value double")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            x, y = _matrix(b.column("features")), b.column("label").to_numpy()
            for k in np.unique(y).tolist():
                own = x[y == k]
                total[k] = total.get(k, 0) + np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        for k, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, "i4")), pa.array(np.arange(len(v), dtype="i4")), pa.array(v)], schema=out)

    added = rows.select("features", "label").mapInArrow(sums, "label int, place int, value double").groupBy("label", "place").agg(F.sum("value").alias("value")).collect()
    d, moments = len(STATISTICS), {}
    for k in {r["label"] for r in added}:
        v = np.zeros(1 + d + d * d)
        for r in added:
            if r["label"] == k:
                v[r["place"]] = r["value"]
        moments[k] = (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d))
    return Discriminant(moments)


def score(feats: DataFrame, model: Discriminant, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    schema = arrow("doc_id long, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(_matrix(b.column("features"))))], schema=schema)

    return feats.mapInArrow(run, "doc_id long, score double").select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """A row a document with its score; the statistics are written once, for fitting and scoring."""
    feats = saved(features(docs), "quality")
    return score(feats, fit(feats, labels), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without those scored below the threshold.

    The model is fitted on the statistics of labelled documents alone, which a bit map of their ids picks out;
    scores are then worked out beside the texts, which need no shuffle.
    """
    known = labels.filter(F.col("quality").cast("int").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"))
    model = fit(saved(features(docs, Marks(known, "doc_id")), "quality"), labels)  # written, so that no task needs two workers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            rows = np.array([statistics(t) for t in text_bytes(b)], "f4").astype("f8").reshape(-1, len(STATISTICS))
            yield b.filter(pa.array(model.scores(rows) >= threshold))

    return docs.mapInArrow(run, docs.schema)
