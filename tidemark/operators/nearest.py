"""Nearest rows by cosine: every row against a stated query set, or only the lists of an inverted index.

An index has centroids, fitted on a bounded sample, and every row in the list of its nearest centroid. A search reads
the `probes` lists whose centroids are nearest to a query. The exact search then reads all further lists that can hold
a row as near as the k-th found: none is nearer in angle than the centroid less the list's radius. Lists of many rows,
copies of one vector for instance, are cut into parts of about PART rows, which a search reads in tasks of their own.

Both work on unit vectors in numpy blocks, and a task hands on k rows a query, before anything is shuffled.

Null vectors, and those with nulls, of norm 0 or of another length than the query, are nearest to nothing, as their
cosine is null. A row is not near to the query of its own id. Queries of one id are one query, the least vector of
them; ties in similarity go by id, null last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Up to so many queries go to all tasks at once; more are taken in blocks of about that many, a pass over the rows each.
QUERIES = 5_000
PART = 50_000
#: Rows, at most about, that centroids are fitted on, and lists at most.
SAMPLE, LISTS = 20_000, 4096


def six_places(cosines: np.ndarray) -> np.ndarray:
    return np.round(cosines, 6)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _units(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of vectors of that width, without nulls and with a norm above 0, and these vectors at length 1."""
    at = np.nonzero(np.asarray(pc.fill_null(pc.list_value_length(column), -1)) == width)[0]
    x = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), width)
    norm = np.sqrt((x * x).sum(1))
    good = norm > 0  # not for NaN either
    return at[good], x[good] / norm[good, None]


class Best:
    """The k best rows of each query, over any number of blocks."""

    def __init__(self, ids: list, k: int, value: Callable[[np.ndarray], np.ndarray]):
        self.ids, self.k, self.value = pa.array(ids), k, value
        self.found: dict[int, list[tuple]] = {}

    def add(self, which: np.ndarray, asked: np.ndarray, names: pa.Array, x: np.ndarray) -> None:
        """which: numbers of the queries, asked: their unit vectors; names and unit vectors x of rows."""
        order = np.empty(len(names), "i8")
        order[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
        own = np.asarray(pc.fill_null(pc.index_in(names, value_set=self.ids.cast(names.type), skip_nulls=True), -1))
        for s in range(0, len(which), 256):
            scores = self.value(asked[s : s + 256] @ x.T)
            row, col = np.nonzero(which[s : s + 256, None] == own[None, :]) if (own >= 0).any() else ((), ())
            scores[row, col] = -np.inf
            if scores.shape[1] > self.k:
                q, j = np.nonzero(scores >= np.maximum(-np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1 : self.k], -1e300))
            else:
                q, j = np.nonzero(scores > -np.inf)
            sort = np.lexsort((order[j], -scores[q, j], q))
            q, j = q[sort], j[sort]
            count = np.bincount(q, minlength=len(scores))
            keep = np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count) < self.k
            q, j = q[keep], j[keep]
            for n, score, name in zip(which[s + q].tolist(), scores[q, j].tolist(), names.take(pa.array(j)).to_pylist(), strict=True):
                self.found.setdefault(n, []).append((-score, name is None, name))
        for n, rows in self.found.items():
            if len(rows) > 4 * self.k:
                self.found[n] = self._first(rows)

    def _first(self, rows: list[tuple]) -> list[tuple]:
        return sorted(rows, key=lambda r: r[:2] if r[1] else r)[: self.k]

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        rows = [(n, name, -s) for n, found in self.found.items() for s, _, name in self._first(found)]
        ids = self.ids.take(pa.array([r[0] for r in rows], pa.int64()))
        return pa.RecordBatch.from_arrays([ids.cast(schema.types[0]), pa.array([r[1] for r in rows], schema.types[1]), pa.array([r[2] for r in rows], pa.float64())], schema=schema)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, similarity of the k best of each query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "similarity")


def _asked(queries: DataFrame) -> DataFrame:
    return queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("query"))


def exact(queries: DataFrame, rows: DataFrame, k: int = 5, most: int = QUERIES, value: Callable[[np.ndarray], np.ndarray] = six_places) -> DataFrame:
    """query_id, rank, vec_id, similarity: the k nearest of all rows to each query (both vec_id, embedding), by `value` of their cosines."""
    asked = _asked(queries)
    blocks = max(1, -(-asked.count() // most))
    found = [_against(asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), rows, k, value) for b in range(blocks)]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return ranked(out, k)


def _against(asked: DataFrame, rows: DataFrame, k: int, value: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    held = [(r[0], np.array([np.nan if v is None else v for v in r[1] or []], "f8")) for r in asked.select("query_id", "query").collect()]
    held = [(q, v / np.sqrt(v @ v)) for q, v in held if v @ v > 0]
    sides = {w: (np.array([n for n, (_, v) in enumerate(held) if len(v) == w]), np.array([v for _, v in held if len(v) == w])) for w in {len(v) for _, v in held}}
    columns = f"query_id {asked.schema['query_id'].dataType.simpleString()}, vec_id {rows.schema['vec_id'].dataType.simpleString()}, similarity double"
    sent, schema = rows.sparkSession.sparkContext.broadcast(([q for q, _ in held], sides)), _arrow(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, by_width = sent.value
        best = Best(ids, k, value)
        for b in batches:
            for start in range(0, b.num_rows, 4096):
                part = b.slice(start, 4096)
                for width, (which, vectors) in by_width.items():
                    at, x = _units(part.column("embedding"), width)
                    if len(at):
                        best.add(which, vectors, part.column("vec_id").take(pa.array(at)), x)
        yield best.batch(schema)

    return rows.select("vec_id", "embedding").mapInArrow(run, columns)


class Index:
    """Rows by list and part, the lists' centroids, radii and sizes. `rows` may be written, by list, and read again."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray, radii: np.ndarray, sizes: np.ndarray):
        self.rows, self.centroids, self.radii = rows, centroids, radii
        self.parts = np.maximum(1, -(-sizes // PART))


def build(rows: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 7) -> Index:
    """An index of all rows (vec_id, embedding) whose vectors are as long as most are, without nulls and not 0.

    There are as many lists as the root of the number of rows, LISTS at most. Centroids are fitted by k-means on about
    `sample` unit vectors, chosen by a hash of their ids.
    """
    whole = rows.select("vec_id", "embedding").filter(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v)) & F.exists("embedding", lambda v: v != 0))
    widths = whole.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    kind = rows.schema["vec_id"].dataType.simpleString()
    columns = f"list int, part int, vec_id {kind}, embedding array<double>, angle double"
    if not widths:
        return Index(rows.sparkSession.createDataFrame([], columns), np.zeros((0, 0)), np.zeros(0), np.zeros(0, "i8"))
    width, n = widths[0]
    whole = whole.filter(F.size("embedding") == width)
    step, k = max(1, n // sample), lists or min(LISTS, max(1, round(n**0.5)))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    some = whole.filter(F.pmod(F.xxhash64("vec_id"), F.lit(step)) == 0).limit(4 * sample).select(array_to_vector(F.transform("embedding", lambda v: v / norm)).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=10, initMode="random").fit(some)
    centroids = np.array([c for c in model.clusterCenters() if c @ c > 0])
    centroids = centroids / np.sqrt((centroids * centroids).sum(1))[:, None]
    sent, schema = rows.sparkSession.sparkContext.broadcast(centroids), _arrow(columns.replace("part int, ", ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 4096):
                part = b.slice(start, 4096)
                at, x = _units(part.column("embedding"), width)
                cosines = x @ sent.value.T
                best = cosines.argmax(1) if len(at) else np.zeros(0, "i8")
                angle = np.arccos(np.clip(cosines[np.arange(len(at)), best], -1, 1))
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * width, pa.int32()), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(best, pa.int32()), part.column("vec_id").take(pa.array(at)), vectors, pa.array(angle)], schema=schema)

    listed = whole.mapInArrow(run, columns.replace("part int, ", ""))
    sizes, radii = np.zeros(len(centroids), "i8"), np.zeros(len(centroids))
    for r in listed.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).toLocalIterator():
        sizes[r["list"]], radii[r["list"]] = r["n"], r["radius"]
    parts = F.element_at(F.array(*(F.lit(int(max(1, -(-s // PART)))) for s in sizes)), F.col("list") + 1) if sizes.max() > PART else F.lit(1)
    return Index(listed.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts).cast("int")), centroids, radii, sizes)


def search(index: Index, queries: DataFrame, k: int = 5, probes: int = 8, whole: bool = False, most: int = QUERIES, value: Callable[[np.ndarray], np.ndarray] = six_places) -> DataFrame:
    """query_id, rank, vec_id, similarity: the k nearest rows in the `probes` lists nearest to each query; with whole, of all rows.

    `value` must not fall where cosines rise. Queries are taken in blocks of about `most`.
    """
    asked = _asked(queries)
    blocks = max(1, -(-asked.count() // most))
    out = _found(index, asked, k, probes, whole, value) if blocks == 1 else None
    for b in range(blocks if blocks > 1 else 0):
        own = _found(index, asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b), k, probes, whole, value)
        out = own if out is None else out.unionByName(own)
    return out


def _found(index: Index, asked: DataFrame, k: int, probes: int, whole: bool, value: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    key = asked.schema["query_id"].dataType.simpleString()
    if not len(index.centroids):
        return ranked(asked.sparkSession.createDataFrame([], f"query_id {key}, vec_id {index.rows.schema['vec_id'].dataType.simpleString()}, similarity double"), k)
    first = _read(index, _probed(index, asked, probes, None), k, value)
    if not whole:
        return ranked(first, k)
    found = ranked(first, k)
    bound = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("least"))
    rest = _probed(index, asked.join(bound, "query_id", "left"), probes, value)
    return ranked(found.drop("rank").unionByName(_read(index, rest, k, value)), k)


def _probed(index: Index, asked: DataFrame, probes: int, value: Callable[[np.ndarray], np.ndarray] | None) -> DataFrame:
    """query_id, query, list, part for the first `probes` lists of each query; with value, for all others that can reach its `least`."""
    key, held = asked.schema["query_id"].dataType.simpleString(), (index.centroids, index.radii, index.parts)
    columns = f"query_id {key}, query array<double>, list int, part int"
    sent, schema = asked.sparkSession.sparkContext.broadcast(held), _arrow(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, radii, parts = sent.value
        for b in batches:
            for start in range(0, b.num_rows, 512):
                rows = b.slice(start, 512)
                at, x = _units(rows.column("query"), centroids.shape[1])
                cosines = x @ centroids.T
                place = np.argsort(np.argsort(-cosines, axis=1, kind="stable"), axis=1, kind="stable")
                take = place < probes
                if value is not None:
                    least = np.asarray(pc.fill_null(rows.column("least").take(pa.array(at)), -np.inf))
                    reach = np.cos(np.maximum(0, np.arccos(np.clip(cosines, -1, 1)) - radii[None, :] - 1e-7))
                    take = ~take & (value(reach) >= least[:, None])
                q, lists = np.nonzero(take)
                n = parts[lists]
                q, lists = np.repeat(q, n), np.repeat(lists, n)
                part = np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * x.shape[1], pa.int32()), pa.array(x[q].reshape(-1)))
                yield pa.RecordBatch.from_arrays([rows.column("query_id").take(pa.array(at[q])), vectors, pa.array(lists, pa.int32()), pa.array(part, pa.int32())], schema=schema)

    return asked.mapInArrow(run, columns)


def _read(index: Index, probed: DataFrame, k: int, value: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """query_id, vec_id, similarity: of each part of a list the k nearest to each query that reads it."""
    kinds = [probed.schema["query_id"].dataType.simpleString(), index.rows.schema["vec_id"].dataType.simpleString()]
    columns = f"query_id {kinds[0]}, vec_id {kinds[1]}, similarity double"
    schema = _arrow(columns)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        best = Best(left.column("query_id").to_pylist(), k, value)
        if left.num_rows and right.num_rows:
            width = len(left.column("query")[0])
            asked, x = (t.column(c).combine_chunks().flatten().to_numpy().reshape(-1, width) for t, c in ((left, "query"), (right, "embedding")))
            names = right.column("vec_id").combine_chunks()
            for s in range(0, len(x), 4096):
                best.add(np.arange(len(asked)), asked, names.slice(s, 4096), x[s : s + 4096])
        return pa.Table.from_batches([best.batch(schema)])

    return probed.groupBy("list", "part").cogroup(index.rows.select("list", "part", "vec_id", "embedding").groupBy("list", "part")).applyInArrow(run, columns)


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """n_queries, wanted, hit, recall: how many of the true nearest rows of all queries were found."""
    both = true.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    sums = both.agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("wanted"), F.count("hit").alias("hit"))
    return sums.withColumn("recall", F.col("hit") / F.greatest(F.col("wanted"), F.lit(1)))
