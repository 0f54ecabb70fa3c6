"""Near duplicates: an n-gram Jaccard join by chosen paths.

A document's set has the runs of five words (lower case, letters and digits; all words of a shorter text as
one run). Documents with equal sets are one class of copies, which its least doc_id stands for. In each run
every set goes down a tree: at a node it follows one of its members, sampled by a hash that the node seeds,
so that sets which share most members mostly take the same branch. A bucket of at most `small` sets is
searched by brute force; a larger one splits on the next sampled member, three levels deep. What is larger
even then is still searched whole: above `lot` sets in pairs of blocks, each a task of its own.

A pair of similarity t follows one branch through `level` levels in a run with a chance of t ** level. The runs
are repeated until the target recall is reached even for a pair that ends at the deepest level: `runs_for`
gives their number, ten for 0.999 at a similarity of 0.8.

Sets in a bucket are compared by 128-byte sketches with a margin below the threshold, which only groups them.
The sets of each group then meet once, and all pairs in the group are compared exactly, in blocks; what
leaves a task are numbers of links and labels, never pairs. A group of n sets that all differ costs n * n / 2
comparisons in blocks, as its number of links does.

Sets are told apart by 128-bit hashes of their members, not by doc_id: documents that share an id and differ
in text keep their own sets and links, a row each.

Defined results: a text without words (null too) has the empty set; such documents are copies of each other;
repeated rows are copies; a null doc_id has a null id, and counts last where a class takes its least one; an empty
table gives no rows; other columns are not read by `classes` and pass through `keep_one`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Marks, arrow, chunks, marked, parts, saved, text_bytes, unused
from tidemark.llm.components import components
from tidemark.llm.decontamination import words

PRINTS = "doc_id long, print binary, sketch binary, tokens array<long>"
NO_ID = -(2**63)
_K = np.uint64(0x9E3779B97F4A7C15)
BINS, LEVELS = 128, 3


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """The 64-bit hashes of a text's runs of words, ascending and each once."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words(text)), "u8")
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - size + 1)
    out = np.zeros(n, "u8")
    for k in range(min(size, len(hashes))):
        out = _mix(out * _K + hashes[k : k + n])
    return np.unique(out)


def sketch(own: np.ndarray) -> bytes:
    """The least hash of each of 128 ranges, one byte each, 0 for an empty range."""
    at = np.searchsorted(own, np.arange(BINS, dtype="u8") << np.uint64(57))
    full = np.append(at[1:], len(own)) > at
    low = np.zeros(BINS, "u1")
    low[full] = own[at[full]] % np.uint64(255) + np.uint64(1)
    return low.tobytes()


def alike(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimates of the Jaccard similarity of a sketch with each of many."""
    either = ((one > 0) | (many > 0)).sum(1)
    return ((one == many) & (one > 0)).sum(1) / np.maximum(either, 1)


def runs_for(recall: float, threshold: float, levels: int = LEVELS) -> int:
    """So many runs find a pair at the threshold with a chance of `recall`, at the deepest level too."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**levels))


def prints(docs: DataFrame, runs: int) -> DataFrame:
    schema = arrow(PRINTS)
    seeds = _mix(np.arange(1, LEVELS * runs + 1, dtype="u8") * _K)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            names, sketches, tokens = [], [], []
            for text in text_bytes(b):
                own = shingles(text)
                names.append(xxhash.xxh3_128_digest(own.tobytes()))
                sketches.append(sketch(own))
                tokens.append(np.array([_mix(own ^ s).min() for s in seeds], "u8").view("i8") if len(own) else np.zeros(0, "i8"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip((names, sketches, tokens), list(schema)[1:], strict=True))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, PRINTS)


def _by_group(rows: DataFrame, keys: list[str], work: Callable, out: str) -> DataFrame:
    """work on the rows of each group of keys, gathered from sorted partitions; work gives tuples for out."""
    schema = arrow(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                columns = work(pa.Table.from_batches(held))
                held.clear()
                if columns and len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        last = None
        for b in batches:
            ks = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
            cuts = [0, *(i for i in range(1, len(ks)) if ks[i] != ks[i - 1]), len(ks)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if e > s:
                    if ks[s] != last:
                        yield from flush()
                    last = ks[s]
                    held.append(b.slice(s, e - s))
        yield from flush()

    return rows.repartition(parts(rows.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, out)


def _near(least: float) -> Callable:
    def work(group: pa.Table) -> tuple | None:
        """Edges from each set of a bucket to the least id of those that its sketch leads to."""
        ids = group.column("rep").to_numpy()
        if len(ids) < 2:
            return None
        sketches = np.frombuffer(b"".join(group.column("sketch").to_pylist()), "u1").reshape(len(ids), BINS)
        left, a, b = np.arange(len(ids)), [], []
        while len(left) > 1:
            front, found, left = [left[0]], [left[0]], left[1:]
            while front and len(left):
                near = alike(sketches[front.pop()], sketches[left]) >= least
                front += left[near].tolist()
                found += left[near].tolist()
                left = left[~near]
            root = min(ids[found])
            a += [i for i in ids[found] if i != root]
            b += [root] * (len(a) - len(b))
        return a, b

    return work


def _buckets(reps: DataFrame, runs: int, small: int, lot: int) -> DataFrame:
    """path, rep: for each run the bucket in which a set ends, if others do too."""
    at = reps.filter(F.size("tokens") > 0).select("rep", "tokens", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    token = lambda level: F.get("tokens", F.col("run") * LEVELS + level)
    at = at.select("rep", "run", *(token(k).alias(f"t{k}") for k in range(LEVELS))).withColumn("path", F.xxhash64("run", "t0"))
    ends = []
    for level in range(LEVELS):
        n = at.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
        at = at.join(n, "path")
        if level < LEVELS - 1:
            at = saved(at, "paths")
            ends.append(at.filter(F.col("n") <= small).select("path", "rep"))
            at = at.filter(F.col("n") > small).drop("n").withColumn("path", F.xxhash64("path", F.col(f"t{level + 1}")))
        else:
            # what no member splits: whole up to `lot` sets, beyond in pairs of blocks, so that every two sets still meet
            blocks = F.ceil(F.col("n") / lot)
            own = F.pmod(F.xxhash64("rep"), blocks)
            pair = at.select("path", "rep", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
            ends.append(pair.select(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")).alias("path"), "rep"))
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    return out


def _linked(threshold: float) -> Callable:
    def work(group: pa.Table) -> tuple | None:
        """Of each set of a block pair: its links there and the least id that it is joined to."""
        ids, side = group.column("rep").to_numpy(), group.column("side").to_numpy()
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        sizes = np.array([len(x) for x in group.column("shingles").to_pylist()])
        members = np.concatenate(group.column("shingles").to_pylist()) if len(ids) else np.zeros(0, "i4")
        row = np.repeat(np.arange(len(ids)), sizes)
        _, column, n = np.unique(members, return_inverse=True, return_counts=True)
        shared = n[column] > 1
        place = np.cumsum(n > 1) - 1
        row, column = row[shared], place[column[shared]]
        common = np.zeros((len(ids), len(ids)), "f4")
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        width = 4096
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            s, e = np.searchsorted(column, [start, start + width])
            part = np.zeros((len(ids), width), "f4")
            part[row[s:e], column[s:e] - start] = 1
            common += part @ part.T
        linked = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-4
        np.fill_diagonal(linked, False)
        if i != j:
            linked &= side[:, None] != side[None, :]
        label = ids.copy()
        while True:  # least id over links until nothing changes
            least = np.minimum(label, np.where(linked, label[None, :], np.iinfo("i8").max).min(1))
            if (least == label).all():
                break
            label = least
        return ids, label, linked.sum(1)

    return work


def classes(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999, small: int = 64, lot: int = 2048, block: int = 512) -> DataFrame:
    """doc_id, class_id (the least doc_id that links lead to), n_links (other sets linked with its own), n_copies (documents with its set)."""
    runs = runs_for(recall, threshold)
    printed = saved(prints(docs, runs).withColumn("row", F.monotonically_increasing_id()), "prints")
    copies = saved(printed.groupBy("print").agg(F.min("row").alias("rep"), F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies")), "copies")
    reps = printed.join(copies.select(F.col("rep").alias("row")), "row", "left_semi").withColumnRenamed("row", "rep")
    reps = saved(reps.select("rep", "sketch", "tokens"), "sets")
    buckets = _buckets(reps, runs, small, lot).join(reps.select("rep", "sketch"), "rep")
    groups = components(_by_group(buckets.select("path", "rep", "sketch"), ["path"], _near(threshold - 0.2), "a long, b long"))
    groups = groups.select(F.col("node").alias("rep"), F.col("root").alias("group")).join(copies.select("rep", "print", F.coalesce("first_id", F.lit(NO_ID)).alias("first_id")), "rep")
    groups = saved(groups, "groups")
    n = groups.groupBy("group").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = groups.join(n, "group").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks"))).drop("first_id")
    kinds = arrow("print binary, shingles array<int>")

    members_only = Marks(groups, "first_id")
    held = members_only.table

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            b = b.filter(pa.array(marked(held.value, b.column("place").to_numpy())))
            own = [shingles(t) for t in text_bytes(b)]
            names = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in own], kinds.field(0).type)
            yield pa.RecordBatch.from_arrays([names, pa.array([(x >> np.uint64(32)).astype("u4").view("i4") for x in own], kinds.field(1).type)], schema=kinds)

    # of each set in a group the text of its least id takes part in the shuffle, and few others that the bit map lets pass
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("first_id"), "text").withColumn("place", members_only.place("first_id"))
    small_sets = texts.mapInArrow(sets, "print binary, shingles array<int>").join(dealt, "print").dropDuplicates(["print"])
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    paired = small_sets.withColumn("other", other).select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("side"), "rep", "blocks", "shingles")
    links = saved(_by_group(paired, ["group", "i", "j"], _linked(threshold), "rep long, label long, links long"), "links")
    total = links.groupBy("rep").agg(F.sum("links").alias("n_links"))
    roots = components(links.select(F.col("rep").alias("a"), F.col("label").alias("b"))).withColumnRenamed("node", "rep")
    linked = saved(copies.join(total, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "linked")
    least = linked.filter("root <> rep or n_links > 0").groupBy("root").agg(F.min("first_id").alias("least"))
    named = linked.join(least, "root", "left").select("print", F.coalesce("least", "first_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.col("n_copies").cast("long").alias("n_copies"))
    return printed.select("doc_id", "print").join(named, "print").select("doc_id", "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs without those whose class has a document with a lesser id; documents without id stay.

    Rows that share an id go only where all of them do. Documents that are certainly not among those pass by the join.
    """
    (mark,) = unused(docs, "gone")
    found = classes(docs, threshold).filter("doc_id is not null").groupBy("doc_id").agg(F.max("class_id").alias("last"))
    gone = saved(found.filter("last < doc_id").select(F.col("doc_id").alias(mark)), "gone")
    may_go = Marks(gone, mark).may_have("doc_id")
    rest = docs.filter(may_go).join(gone, F.col("doc_id") == F.col(mark), "left_anti")
    return docs.filter(~may_go).unionByName(rest)
