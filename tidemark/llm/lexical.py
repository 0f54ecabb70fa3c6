"""Ranked lexical search: the best documents for each item by integer BM25-like scores, over norm buckets.

A document is a vector with a coordinate for each term: root of the term's weight times what its occurrences are
worth in a document of this length; an item has the roots of its terms' weights. Their inner product is the score.
Vectors are kept ordered by length and searched from the longest on, in waves of ever more vectors. After each wave
the k-th score so far bounds what can still enter an item's list, and

* a bucket (a batch of vectors of nearly one length) is passed over for an item where the product of both lengths
  (Cauchy-Schwarz) is below the bound;
* inside, a vector stays only where the exact product on the item's `focus` heaviest coordinates and
  Cauchy-Schwarz on the others reach the bound;
* what is left is scored exactly, in 64-bit integers. Bounds have a margin for rounding, so nothing is lost.

Items are searched in blocks of about `block_terms` terms; a block's terms are broadcast and looked up in each text,
so documents are read once for each block. Nothing is grouped by a document's terms, and no task gets more than its
share of a hot group: the vectors stay where they were read, sorted by length within each task's file, and a wave
reads a range of lengths from all files. A task sends k rows an item at most.

Defined results: a null text has no terms; documents without terms count nowhere; an item has its distinct terms,
rows of one item id make one item; items without any scoring document have no rows; repeated documents are
documents of their own, and equal scores go by ascending doc_id, null last; empty tables give no rows; other
columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow, batch_of, by_bytes, chunks, ragged, saved, text_bytes
from tidemark.llm.decontamination import words

COUNTED = "n long, terms array<int>, tfs array<int>"
MARGIN = 1 + 1e-9


def lists(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    """int32 lists of so many values each, one after another."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, pa.int32()))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item."""
    kind = items.schema["item_id"].dataType.simpleString()
    schema = arrow(f"item_id {kind}, term binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1 << 20):
            terms = [sorted({*words(t)}) for t in text_bytes(b)]
            of = pa.array(np.repeat(np.arange(len(terms)), [len(t) for t in terms]))
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(of), pa.array([x for t in terms for x in t], pa.binary())], schema=schema)

    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term binary").distinct()


def count_terms(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the text), and for the given terms that it holds, ascending, their numbers and occurrences."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent, schema = docs.sparkSession.sparkContext.broadcast(terms), arrow(f"doc_id {kind}, {COUNTED}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in by_bytes(batches, 1 << 20):
            n, at, found, tfs = [], [], [], []
            for t in text_bytes(b):
                own = words(t)
                n.append(len(own))
                count = Counter(own)
                here = sorted((known[w], count[w]) for w in known.keys() & count.keys())
                at.append(len(here))
                found += [i for i, _ in here]
                tfs += [c for _, c in here]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), lists(at, found), lists(at, tfs)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {COUNTED}").filter("n > 0")


def as_vectors(counted: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """doc_id, norm, terms, worths: the impact vectors, ordered by length within each partition."""
    kind = counted.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, norm double, terms array<int>, worths array<int>"
    sent, schema = counted.sparkSession.sparkContext.broadcast(weights), arrow(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 4096):
            size, t, tf = flat(b, "terms", "tfs")
            m = 100 - 90 + (90 * b.column("n").to_numpy() * n_docs) // n_terms
            worth = (1_000_000_000 * tf.astype("i8")) // (1000 * tf.astype("i8") + 8 * np.repeat(m, size))
            norm = np.sqrt(np.bincount(np.repeat(np.arange(len(size)), size), sent.value[t] * worth.astype("f8") ** 2, len(size)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(norm), b.column("terms"), lists(size, worth)], schema=schema)

    return counted.filter("size(terms) > 0").mapInArrow(run, columns).filter("norm > 0").sortWithinPartitions(F.desc("norm"))


def flat(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    """The sizes of list columns of equal sizes, then the values of each."""
    return [b.column(names[0]).value_lengths().to_numpy().astype("i8"), *(b.column(n).flatten().to_numpy() for n in names)]


class Items:
    """Items as rows of term numbers, and the heaviest of these by term."""

    def __init__(self, rows: list[np.ndarray], weights: np.ndarray, focus: int):
        self.n, self.weights, self.root = len(rows), weights, np.sqrt(weights.astype("f8"))
        self.size, self.terms = np.array([len(r) for r in rows], "i8"), np.concatenate(rows)
        self.start = np.cumsum(self.size) - self.size
        heavy = [r[np.argsort(-weights[r], kind="stable")[:focus]] for r in rows]
        of = np.repeat(np.arange(self.n), [len(h) for h in heavy])
        by_term = np.argsort(np.concatenate(heavy), kind="stable")
        self.of = of[by_term]  # the items that have a term in focus, by term
        self.degree = np.bincount(np.concatenate(heavy), minlength=len(weights))
        self.first = np.cumsum(self.degree) - self.degree
        total = np.array([float(weights[r].sum()) for r in rows])
        self.norm = np.sqrt(total)
        self.rest = np.sqrt(np.maximum(0, total - [float(weights[h].sum()) for h in heavy]))


class Search:
    """The best of the batches that a task has seen."""

    def __init__(self, items: Items, least: np.ndarray, k: int):
        self.items, self.k, self.least = items, k, least.copy()
        self.best: list[list[tuple]] = [[] for _ in range(items.n)]

    def add(self, b: pa.RecordBatch) -> None:
        q, norm = self.items, b.column("norm").to_numpy()
        active = np.nonzero(q.norm * norm.max() * MARGIN >= self.least)[0]
        if not len(active):
            return
        size, t, worth = flat(b, "terms", "worths")
        n, d = len(size), np.repeat(np.arange(len(size)), size)
        degree = q.degree[t]
        entry = np.repeat(np.arange(len(t)), degree)
        cell = d[entry] * q.n + q.of[np.repeat(q.first[t], degree) + ragged(degree)]
        exact = worth.astype("f8")
        inner = np.bincount(cell, (q.weights[t] * exact)[entry], n * q.n).reshape(n, q.n)[:, active]
        used = np.bincount(cell, (q.weights[t] * exact**2)[entry], n * q.n).reshape(n, q.n)[:, active]
        bound = inner + q.rest[active] * np.sqrt(np.maximum(0, norm[:, None] ** 2 * MARGIN - used))
        doc, item = np.nonzero(bound * MARGIN + 1e-3 >= np.maximum(1, self.least[active]))
        if len(doc):
            self.rescore(b, doc, active[item], d * len(q.weights) + t, q.weights[t] * worth.astype("i8"))

    def rescore(self, b: pa.RecordBatch, doc: np.ndarray, item: np.ndarray, keys: np.ndarray, impact: np.ndarray) -> None:
        """Exact scores of pairs, some at a time; of the batch's, the k best of each item go on."""
        q, scores = self.items, np.zeros(len(doc), "i8")
        ends = np.cumsum(q.size[item])
        at = 0
        while at < len(doc):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 20), side="right")))
            size = q.size[item[at:to]]
            want = np.repeat(doc[at:to] * len(q.weights), size) + q.terms[np.repeat(q.start[item[at:to]], size) + ragged(size)]
            place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = keys[place] == want
            np.add.at(scores, np.repeat(np.arange(at, to), size)[hit], impact[place[hit]])
            at = to
        keep = scores >= np.maximum(1, self.least[item])
        doc, item, scores = doc[keep], item[keep], scores[keep]
        if not len(doc):
            return
        ids = b.column("doc_id")
        place = np.empty(len(ids), "i8")
        place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        order = np.lexsort((place[doc], -scores, item))
        doc, item, scores = doc[order], item[order], scores[order]
        count = np.bincount(item, minlength=q.n)
        keep = ragged(count[count > 0]) < self.k
        doc, item, scores = doc[keep], item[keep], scores[keep]
        rows = zip(item.tolist(), (-scores).tolist(), ids.take(pa.array(doc)).to_pylist(), strict=True)
        for i, s, x in rows:
            self.best[i].append((s, x is None, x))
        for i in np.unique(item).tolist():
            self.best[i] = heapq.nsmallest(self.k, self.best[i], key=lambda x: x if not x[1] else x[:2])
            if len(self.best[i]) == self.k:
                self.least[i] = max(self.least[i], -self.best[i][-1][0])


def _search(vectors: DataFrame, items: Items, least: np.ndarray, k: int) -> DataFrame:
    """item, doc_id, score: of each task's vectors, the k best of each item that reach its bound."""
    kind = vectors.schema["doc_id"].dataType.simpleString()
    columns = f"item int, doc_id {kind}, score long"
    sent, schema = vectors.sparkSession.sparkContext.broadcast((items, least)), arrow(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bound = sent.value
        search = Search(held, bound, k)
        for b in chunks(batches, max(16, min(1024, (1 << 18) // held.n))):
            search.add(b)
        found = [(i, x, -s) for i, rows in enumerate(search.best) for s, _, x in rows]
        if found:
            yield batch_of(schema, *map(list, zip(*found, strict=True)))

    return vectors.mapInArrow(run, columns)


def _top(found: DataFrame, k: int, *by: str) -> DataFrame:
    order: list[Column] = [F.desc("score"), F.asc_nulls_last("doc_id")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def _waves(vectors: DataFrame, first: int, growth: int) -> list[tuple[float, float]]:
    """Ranges (above, up to) of norms, descending: about `first` vectors, then `growth` times as many each time."""
    step = math.log(0.9)
    bins = vectors.groupBy(F.floor(F.log("norm") / F.lit(step)).alias("bin")).agg(F.count("*").alias("n"), F.min("norm").alias("low")).collect()
    out, high, held, size = [], float("inf"), 0, first
    for r in sorted(bins, key=lambda r: r["bin"]):
        held += r["n"]
        if held >= size:
            low = math.nextafter(r["low"], 0)
            out.append((low, high))
            high, held, size = low, 0, size * growth
    return [*out, (0.0, high)] if held else out


def rank(docs: DataFrame, items: DataFrame, k: int = 10, focus: int = 12, block_terms: int = 100_000, first: int = 4096, growth: int = 16) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each item."""
    terms = saved(item_terms(items), "item-terms")
    blocks = max(1, -(-terms.count() // block_terms))
    found = [_block(docs, terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k, focus, first, growth) for b in range(blocks)]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def _block(docs: DataFrame, terms: DataFrame, k: int, focus: int, first: int, growth: int) -> DataFrame:
    spark = docs.sparkSession
    held: dict = {}
    for item, term in terms.select("item_id", "term").toLocalIterator():
        held.setdefault(item, []).append(bytes(term))
    ids = [*held]
    number = {t: i for i, t in enumerate(sorted({t for own in held.values() for t in own}))}
    counted = saved(count_terms(docs, number), "terms")
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.full(len(number), math.floor(1000 * math.log(2 * n_docs + 2)), "i8")
    for t, df in counted.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    kind_of_doc, kind_of_item = docs.schema["doc_id"].dataType.simpleString(), terms.schema["item_id"].dataType.simpleString()
    top = spark.createDataFrame([], f"item int, doc_id {kind_of_doc}, score long, rank int")
    if ids and n_docs:
        vectors = saved(as_vectors(counted, weights, n_docs, n_terms), "vectors")
        searched = Items([np.array([number[t] for t in held[i]]) for i in ids], weights, focus)
        least = np.zeros(len(ids), "i8")
        for low, high in _waves(vectors, first, growth):
            rows = _search(vectors.filter((F.col("norm") > low) & (F.col("norm") <= high)), searched, least, k)
            top = saved(_top(top.drop("rank").unionByName(rows), k, "item"), "top")
            for i, s in top.filter(F.col("rank") == k).select("item", "score").toLocalIterator():
                least[i] = s
    names = spark.createDataFrame([(n, i) for n, i in enumerate(ids)], f"item int, item_id {kind_of_item}")
    return top.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
