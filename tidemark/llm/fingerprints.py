"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of paragraphs.

A document's sections stand apart by blank lines, a section's paragraphs by line breaks. The digest of a
paragraph is that of its text, the digest of a section that of its paragraphs' digests, and the root that of
the sections' digests. Roots are equal exactly for equal texts; where they differ, going down the branches
that differ finds the edited paragraphs, from texts (`differing`) or from the trees as rows (`trees`, `edits`).

A text of one paragraph has one branch, so branches alone would call it wholly different after any edit. The
fingerprint therefore has a level below the paragraphs: their pieces, the windows of eight bytes, of which a
bottom-k sample of hashes stands beside the root. The likeness of two documents is 1 for equal roots and else
the share of pieces that the samples have in common, so it can be told from the fingerprints alone.

Defined results: a null text is empty; documents are in the order of doc_id, null first, then of text, and
the last is followed by the first; repeated rows follow each other; rows without id form one lot, which a task
goes through in order; an empty table gives no rows; other columns are not read. In `edits`, rows that share
an id count as one document with the paragraphs of all.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow, batch_of, chunks, parts, text_bytes

PRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_sections long, n_paragraphs long, n_differing long, first_section int, first_paragraph int"
TREE = "doc_id long, section int, paragraph int, digest binary, section_digest binary, root binary, start long"
WINDOW = 8


def tree(text: bytes) -> tuple[bytes, list[tuple[bytes, list[bytes]]]]:
    """The root, and each section's digest with those of its paragraphs. Separators count to what is before them."""
    sections = []
    for section in re.split(rb"(?<=\n\n)(?!\n)", text):
        leaves = [hashlib.sha256(p).digest() for p in section.splitlines(keepends=True)] or [hashlib.sha256(b"").digest()]
        sections.append((hashlib.sha256(b"".join(leaves)).digest(), leaves))
    return hashlib.sha256(b"".join(s for s, _ in sections)).digest(), sections


def differing(a: bytes, b: bytes) -> list[tuple[int, int]]:
    """The (section, paragraph) places at which two texts' trees differ; a place that one lacks differs."""
    return _differing(tree(a), tree(b))


def _differing(a: tuple, b: tuple) -> list[tuple[int, int]]:
    (root_a, left), (root_b, right) = a, b
    if root_a == root_b:
        return []
    out = []
    for s in range(max(len(left), len(right))):
        (da, la), (db, lb) = (x[s] if s < len(x) else (b"", []) for x in (left, right))
        if da != db:
            out += [(s, p) for p in range(max(len(la), len(lb))) if la[p : p + 1] != lb[p : p + 1]]
    return out


def trees(docs: DataFrame) -> DataFrame:
    """A row a paragraph: its place in the tree, its digest and those above it, and the byte at which it starts."""
    schema = arrow(TREE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 256):
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), text_bytes(b), strict=True):
                root, sections = tree(text)
                starts = iter([0, *np.cumsum([len(p) for p in text.splitlines(keepends=True)]).tolist()])
                out += [(doc, s, p, digest, own, root, next(starts)) for s, (own, leaves) in enumerate(sections) for p, digest in enumerate(leaves)]
            if out:
                yield batch_of(schema, *zip(*out, strict=True))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TREE)


def edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc_id, section, paragraph, change (added, removed or changed): where the trees of two versions of documents differ.

    Documents with equal roots drop out first, then sections with equal digests; only the branches left are compared.
    """
    both = [trees(d).filter("doc_id is not null") for d in (before, after)]

    def apart(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
        return x.join(y.select(*keys).distinct(), keys, "left_anti")

    for keys in (["doc_id", "root"], ["doc_id", "section", "section_digest"]):
        both = [apart(*both, keys), apart(*both[::-1], keys)]
    old, new = (d.groupBy("doc_id", "section", "paragraph").agg(F.array_sort(F.collect_list("digest")).alias(n)) for d, n in zip(both, ("old", "new"), strict=True))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return old.join(new, ["doc_id", "section", "paragraph"], "full").filter(~F.col("old").eqNullSafe(F.col("new"))).select("doc_id", "section", "paragraph", change.alias("change"))


def pieces(text: bytes) -> np.ndarray:
    """The eight bytes that end at each byte of a text, as numbers; zeros stand before it, so that the shortest text has pieces too."""
    return np.ndarray((len(text),), "<u8", bytes(WINDOW - 1) + text, strides=(1,)) if text else np.empty(0, "u8")


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of numbers (the finalizer of splitmix64), the high half."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(32)


def _least(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k least distinct hashes in order; most texts need only the least few to be sorted."""
    for few in (4 * k, 32 * k):
        if len(hashes) > few:
            found = np.unique(np.partition(hashes, few)[:few])
            if len(found) >= k:
                return found[:k]
    return np.unique(hashes)[:k]


def fingerprint(text: bytes, k: int = 64) -> tuple[str, np.ndarray, tuple]:
    """The root and the k least piece hashes as text, the hashes as numbers, and the tree."""
    sketch = _least(_mixed(pieces(text)), k).astype(">u4")
    whole = tree(text)
    return f"{whole[0].hex()}:{sketch.tobytes().hex()}", sketch, whole


def likeness(a: str, b: str, k: int = 64) -> float:
    """The share of pieces that two fingerprints have in common, from their samples; 1 for equal roots."""
    if a[:64] == b[:64]:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s[65:]), ">u4") for s in (a, b))
    return _shared(x, y, k)


def _shared(x: np.ndarray, y: np.ndarray, k: int = 64) -> float:
    both = np.union1d(x, y)[:k]
    return float(np.isin(both, x).astype(int) @ np.isin(both, y)) / len(both) if len(both) else 1.0


def _edited(text: str, after: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def compare_with_next(docs: DataFrame, lots: int | None = None) -> DataFrame:
    """Of each document: its fingerprint, that of the text whose last quarter comes from the next document, their likenesses, and where the two trees differ.

    The ids' quantiles deal the documents out in order, into as many lots as a shuffle has partitions, and each lot
    also gets the first document after it. Tasks then go through their sorted lots and hold two documents at a
    time, so a lot may have any size. The lots' first ids, a row each, are all that the driver sees.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lots = lots or parts(spark)
    bounds = docs.agg(F.percentile_approx("doc_id", [k / lots for k in range(1, lots)] or [0.5], max(10_000, 10 * lots)).alias("q")).first()["q"]
    edges = np.unique(np.array([x for x in bounds or [] if x is not None], "i8"))

    @F.pandas_udf("int")
    def lot(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        return pd.Series(np.where(known, np.searchsorted(edges, ids.fillna(0).astype("i8"), side="right") + 1, 0)).astype("int32")

    # lot 0 has the null ids, lots 1.. the others in order; an id is in one lot only
    firsts = docs.select("doc_id", lot("doc_id").alias("lot")).groupBy("lot").agg(F.min("doc_id").alias("doc_id")).orderBy("lot").collect()
    if not firsts:
        return spark.createDataFrame([], PRINTS)
    before = spark.createDataFrame([(r["doc_id"], firsts[k - 1]["lot"]) for k, r in enumerate(firsts)], "first_id long, lot int")
    held = docs.withColumn("lot", lot("doc_id")).withColumn("ahead", F.lit(False))
    ahead = docs.join(F.broadcast(before), F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "text", "lot", F.lit(True).alias("ahead"))
    dealt = held.unionByName(ahead).repartitionById(lots + 1, "lot").sortWithinPartitions("lot", "ahead", F.asc_nulls_first("doc_id"), "text")
    return dealt.mapInArrow(_walk(arrow(PRINTS)), PRINTS)


def _walk(schema: pa.Schema):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document before: id, text and fingerprint
        done = None  # the lot whose document ahead has been used
        for b in chunks(batches, 256):
            out = []
            for doc, raw, lot, ahead in zip(b.column("doc_id").to_pylist(), text_bytes(b), b.column("lot").to_pylist(), b.column("ahead").to_pylist(), strict=True):
                if ahead and done == lot:
                    continue
                text, own = raw.decode(), fingerprint(raw)
                if held:
                    out.append(_row(*held, text, own))
                held = None if ahead else (doc, text, own)
                done = lot if ahead else done
            if out:
                yield batch_of(schema, *zip(*out, strict=True))

    return walk


def _row(doc: int | None, text: str, own: tuple, after: str, following: tuple) -> tuple:
    edited = _edited(text, after).encode()
    other = fingerprint(edited)
    near = [1.0 if own[0][:64] == p[0][:64] else _shared(own[1], p[1]) for p in (other, following)]
    sections = own[2][1]
    places = _differing(own[2], other[2])
    return doc, len(text), hashlib.sha256(edited).hexdigest(), own[0], other[0], *near, len(sections), sum(len(x) for _, x in sections), len(places), *(places[0] if places else (None, None))
