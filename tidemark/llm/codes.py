"""Vector codes: product quantisation by Lloyd rounds, assigned through two trees, in integers.

Vectors become integers, floor(scale * x), and are cut into parts of consecutive components. Each part has a codebook,
which starts as the vectors of the least ids and is moved by some rounds of assigning and averaging. Tasks gather
vectors into blocks, written once; a block keeps for each part the order of a kd-tree over its distinct values, with
how often each occurs. In each round a task walks that tree and a tree of the codebook's entries level by level.
A pair of nodes goes when the least distance of their boxes is beyond the greatest distance that some other pair
guarantees; where one entry remains, a node's cached sum goes to it whole; leaves for which several entries remain
measure integer distances, ties to the lower index. Bounds are integers too, so they are exact. Equal entries count as
the first of them. What a task sends is a sum for each entry and component, whatever it read; the driver holds
codebooks (parts * entries * width integers) and nothing else. Copies of a hot vector are one value with a count.

Defined results: rows with a null vector, or with null or non-finite components, are dropped; so are vectors of
another length than the kept vector of the least id; a length that does not divide by the parts is cut at
length * part // parts; with fewer kept vectors than entries, codebooks are smaller, all entries of unequal parts
stay; rows without id are coded, last in order; rows of one id are rows of their own, in order of their vectors;
components are held within 2**26 after scaling, so that sums of squares fit in 64 bits; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow, batch_of, chunks, ragged, saved

MOST = 1 << 26
LEAF = 8


def kept(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, vector array<bigint> of the rows whose vectors are whole and finite."""
    x = F.col("embedding")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    value = F.transform(x, lambda v: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(v.cast("double") * scale))).cast("bigint"))
    return vectors.filter(x.isNotNull() & whole).select("vec_id", "label", value.alias("vector"))


class Codebooks:
    """entries[part]: an integer matrix, a row for each entry."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = entries

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.reshape(-1).tolist()).encode()).hexdigest()


def borders(width: int, parts: int) -> list[tuple[int, int]]:
    return [(width * p // parts, width * (p + 1) // parts) for p in range(parts)]


class Tree:
    """A kd-tree of rows with counts: level l has 2**l nodes, node i the rows n * i // 2**l up to n * (i + 1) // 2**l in `order`."""

    def __init__(self, rows: np.ndarray, leaf: int, order: np.ndarray | None = None, depth: int | None = None):
        n = len(rows)
        self.depth = max(0, (max(1, n) // leaf).bit_length() - 1) if depth is None else depth
        self.order = self._ordered(rows) if order is None else order
        self.rows = rows[self.order]
        self.n = n

    def _ordered(self, rows: np.ndarray) -> np.ndarray:
        order, n = np.arange(len(rows)), len(rows)
        for level in range(self.depth):
            for i in range(1 << level):
                s, e = n * i >> level, n * (i + 1) >> level
                m = n * (2 * i + 1) >> (level + 1)
                if s < m < e:
                    own = order[s:e]
                    x = rows[own]
                    x = x[:, np.argmax(x.max(0) - x.min(0))] if x.shape[1] else np.zeros(e - s)
                    order[s:e] = own[np.argpartition(x, m - s)]
        return order

    def borders(self, level: int) -> np.ndarray:
        return self.n * np.arange((1 << level) + 1) >> level

    def boxes(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """The least and greatest components by node, for each level; every node has rows."""
        starts = self.borders(self.depth)[:-1]
        low, high = np.minimum.reduceat(self.rows, starts), np.maximum.reduceat(self.rows, starts)
        out = [(low, high)]
        while len(low) > 1:
            low, high = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])
            out.append((low, high))
        return out[::-1]


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each of the distinct rows, and for each row which of these it equals."""
    if not len(rows) or not rows.shape[1]:
        return np.zeros(min(1, len(rows)), "i8"), np.zeros(len(rows), "i8")
    _, first, inverse = np.unique(np.ascontiguousarray(rows).view([("", rows.dtype)] * rows.shape[1]).reshape(-1), return_index=True, return_inverse=True)
    return first, inverse.reshape(-1)


def assign(points: Tree, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of each row of the tree in its order, ties to the lower index."""
    out = np.empty(points.n, "i8")
    first, _ = _distinct(entries)
    index = np.sort(first)  # an entry equal to an earlier one is never chosen
    index = np.append(index, np.repeat(index[-1:], (1 << (len(index) - 1).bit_length()) - len(index)))  # one entry a leaf
    book = Tree(entries[index], 1)
    index = index[book.order]
    sides, above = points.boxes(), book.boxes()
    p, e = np.zeros(1, "i8"), np.zeros(1, "i8")
    level, below = 0, 0
    while True:
        (low, high), (under, over) = sides[level], above[below]
        gap = np.maximum(0, np.maximum(low[p] - over[e], under[e] - high[p]))
        least = np.einsum("ij,ij->i", gap, gap)
        far = np.maximum(over[e] - low[p], high[p] - under[e])
        most = np.einsum("ij,ij->i", far, far)
        starts = np.nonzero(np.diff(p, prepend=-1))[0]
        stays = least <= np.repeat(np.minimum.reduceat(most, starts), np.diff(np.append(starts, len(p))))
        p, e = p[stays], e[stays]
        if below == book.depth:
            single = np.diff(np.nonzero(np.diff(p, prepend=-1, append=len(low)))[0]) == 1
            alone = np.repeat(single, np.diff(np.nonzero(np.diff(p, prepend=-1, append=len(low)))[0]))
            cut = points.borders(level)
            size = cut[p[alone] + 1] - cut[p[alone]]
            out[np.repeat(cut[p[alone]], size) + ragged(size)] = np.repeat(index[book.borders(below)[:-1][e[alone]]], size)
            p, e = p[~alone], e[~alone]
        if not len(p) or (level == points.depth and below == book.depth):
            break
        if level < points.depth:
            level += 1
            p, e = _children(p, e)
        if below < book.depth:
            below += 1
            e, p = np.stack([2 * e, 2 * e + 1], 1).reshape(-1), np.repeat(p, 2)
    if len(p):
        _leaves(points, book, index, p, e, out)
    return out


def _children(p: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of both children of each p, sorted by child."""
    p, e = np.concatenate([2 * p, 2 * p + 1]), np.concatenate([e, e])
    order = np.argsort(p, kind="stable")
    return p[order], e[order]


def _leaves(points: Tree, book: Tree, index: np.ndarray, p: np.ndarray, e: np.ndarray, out: np.ndarray) -> None:
    """Rows of leaves that several entries may be nearest to: each measures its leaf's entries, some leaves at a time."""
    cut, entry = points.borders(points.depth), book.borders(book.depth)[:-1][e]
    starts = np.nonzero(np.diff(p, prepend=-1))[0]
    leaves, n_entries = p[starts], np.diff(np.append(starts, len(p)))
    n_rows = cut[leaves + 1] - cut[leaves]
    work, at = np.cumsum(n_rows * n_entries), 0
    while at < len(leaves):
        to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + 32768, side="right")))
        per_row = np.repeat(n_entries[at:to], n_rows[at:to])
        row = np.repeat(cut[leaves[at:to]], n_rows[at:to]) + ragged(n_rows[at:to])
        which = np.repeat(np.repeat(starts[at:to], n_rows[at:to]), per_row) + ragged(per_row)
        x = points.rows[np.repeat(row, per_row)] - book.rows[entry[which]]
        far, i = np.einsum("ij,ij->i", x, x), index[entry[which]]
        begin = np.cumsum(per_row) - per_row
        least = np.repeat(np.minimum.reduceat(far, begin), per_row)
        out[row] = np.minimum.reduceat(np.where(far == least, i, np.iinfo("i8").max), begin)
        at = to




def blocks(vectors: DataFrame, width: int, parts: int, size: int = 4096) -> DataFrame:
    """A row for each `size` vectors of a task: ids and labels as lists, the integers, and by part the distinct values in tree order."""
    ids, labels = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    columns = f"ids array<{ids}>, labels array<{labels}>, vectors binary, first binary, inverse binary, n_distinct array<int>"
    schema, cuts = arrow(columns), borders(width, parts)

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        x = t.column("vector").combine_chunks().flatten().to_numpy().astype("i4").reshape(t.num_rows, width)
        first, inverse, n = [], [], []
        for s, e in cuts:
            f, i = _distinct(x[:, s:e])
            order = Tree(x[f, s:e], LEAF).order
            place = np.empty(len(order), "i4")
            place[order] = np.arange(len(order))
            first.append(f[order].astype("i4"))
            inverse.append(place[i])
            n.append(len(f))
        cells = [[t.column("vec_id").to_pylist()], [t.column("label").to_pylist()], [x.tobytes()], [np.concatenate(first).tobytes()], [np.concatenate(inverse).tobytes()], [n]]
        return batch_of(schema, *cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for b in chunks(batches, 1024):
            rows.append(b)
            n += b.num_rows
            if n >= size:
                yield block(rows)
                rows, n = [], 0
        if n:
            yield block(rows)

    return vectors.filter(F.size("vector") == width).select("vec_id", "label", "vector").mapInArrow(run, columns)


def _parts_of(b: pa.RecordBatch, width: int, cuts: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """For each block its row, vectors, and by part (distinct values in tree order, their counts, which one each vector has)."""
    for r in range(b.num_rows):
        x = np.frombuffer(b.column("vectors")[r].as_py(), "i4").astype("i8").reshape(len(b.column("ids")[r]), width)
        firsts, inverses = (np.frombuffer(b.column(c)[r].as_py(), "i4") for c in ("first", "inverse"))
        ends, out = np.cumsum(b.column("n_distinct")[r].as_py()), []
        for p, (s, e) in enumerate(cuts):
            inverse = inverses[p * len(x) : (p + 1) * len(x)]
            rows = x[firsts[ends[p - 1] if p else 0 : ends[p]], s:e]
            out.append((rows, np.bincount(inverse, minlength=len(rows)), inverse))
        yield r, x, out


def _sums(held: DataFrame, books: Codebooks, width: int, cuts: list[tuple[int, int]], n: int) -> dict[int, np.ndarray]:
    """For each part the counts (last column) and sums by entry, added up over all blocks."""
    schema = arrow("cell long, total long")
    sent = held.sparkSession.sparkContext.broadcast(books)
    offsets = np.cumsum([0, *(n * (e - s + 1) for s, e in cuts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((n, e - s + 1), "i8") for s, e in cuts]
        for b in batches:
            for _, _, parts in _parts_of(b, width, cuts):
                for (rows, counts, _), entries, total in zip(parts, sent.value.entries, totals, strict=True):
                    tree = Tree(rows, LEAF, order=np.arange(len(rows)))
                    near = assign(tree, entries)
                    order = np.argsort(near, kind="stable")
                    weighed = np.concatenate([rows, np.ones((len(rows), 1), "i8")], 1) * counts[:, None]
                    starts = np.nonzero(np.diff(near[order], prepend=-1))[0]
                    total[near[order][starts]] += np.add.reduceat(weighed[order], starts)
        flat = np.concatenate([t.reshape(-1) for t in totals])
        cells = np.nonzero(flat)[0]
        if len(cells):
            yield batch_of(schema, cells, flat[cells])

    flat = np.zeros(offsets[-1], "i8")
    for cell, total in held.mapInArrow(run, "cell long, total long").groupBy("cell").agg(F.sum("total").alias("total")).toLocalIterator():
        flat[cell] = total
    return {p: flat[offsets[p] : offsets[p + 1]].reshape(n, -1) for p in range(len(cuts))}


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error) of all kept vectors, and the codebooks; codes have two hex digits a part (entries up to 256)."""
    if entries > 256:
        raise ValueError("codes have two hex digits a part: at most 256 entries")
    whole = kept(vectors, scale)
    ids, labels = (whole.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    columns = f"vec_id {ids}, label {labels}, code string, error long"
    order = [F.asc_nulls_last("vec_id"), F.asc("vector")]
    head = whole.orderBy(*order).limit(1).collect()
    if not head:
        return vectors.sparkSession.createDataFrame([], columns), Codebooks([])
    width = len(head[0]["vector"])
    cuts = borders(width, parts)
    first = whole.filter(F.size("vector") == width).orderBy(*order).limit(entries).collect()
    seeds = np.array([r["vector"] for r in first], "i8").reshape(len(first), width)
    books = Codebooks([seeds[:, s:e] for s, e in cuts])
    held = saved(blocks(whole, width, parts), "vector-blocks")
    for _ in range(rounds):
        sums = _sums(held, books, width, cuts, len(seeds))
        books = Codebooks([np.where(t[:, -1:] > 0, t[:, :-1] // np.maximum(1, t[:, -1:]), old) for t, old in zip(sums.values(), books.entries, strict=True)])
    schema, sent = arrow(columns), vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, x, by_part in _parts_of(b, width, cuts):
                code, error = np.empty((len(x), len(cuts)), "u1"), np.zeros(len(x), "i8")
                for p, ((rows, _, inverse), book) in enumerate(zip(by_part, sent.value.entries, strict=True)):
                    near = assign(Tree(rows, LEAF, order=np.arange(len(rows))), book)
                    far = rows - book[near]
                    code[:, p], error = near[inverse], error + np.einsum("ij,ij->i", far, far)[inverse]
                digits = code.tobytes().hex()
                step = 2 * len(cuts)
                codes = [digits[k : k + step] for k in range(0, len(digits), step)]
                yield batch_of(schema, b.column("ids")[r].values, b.column("labels")[r].values, codes, error)

    return saved(held.mapInArrow(run, columns), "codes"), books


def with_label_errors(coded: DataFrame, most: int = 100_000) -> DataFrame:
    """With label_error, the error summed over equal labels, nulls together; the sums are broadcast if there are at most so many, else joined with hot labels dealt out."""
    sums = saved(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of_label")
    same = F.col("label").eqNullSafe(F.col("of_label"))
    if sums.count() <= most:
        return coded.join(F.broadcast(sums), same, "left").drop("of_label")
    salt, copies = F.pmod(F.xxhash64("vec_id", "code"), F.lit(16)), F.explode(F.sequence(F.lit(0), F.lit(15)))
    return coded.withColumn("salt", salt).join(sums.withColumn("of_salt", copies), same & (F.col("salt") == F.col("of_salt")), "left").drop("of_label", "salt", "of_salt")
