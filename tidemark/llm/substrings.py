"""Substring deduplication over sliding spans of sentences.

A text is cut into sentences, compared in lower case and with single spaces. A sentence of more than 12 words is
cut further after each word whose hash is the least among the three words before and after it, and after 12 words
at most, so that copies are cut alike a few words from where they begin. A word of more than 64 bytes is cut in
the same way by characters, of which four count as a word. Every run of at least three consecutive sentences with at least 20 words, as short
as that allows, is hashed to 64 bits; so are the shortest runs that end at a sentence where none of these
ends. Of the runs with one hash, wherever they are, the first (by doc_id, then place) stays; the sentences of
all others go.

Defined results: a null text is empty and stays null; a text that loses all its sentences becomes empty and
its row stays; rows that share an id count as one document, so a run at the same place in both is one
occurrence; a document without id keeps its text, and no other loses to it; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Marks, arrow, batch_of, by_bytes, marked, ragged, saved, text_bytes, unused

_LETTER = re.compile(rb"(?s)[^\x80-\xbf][\x80-\xbf]*\s*|.")
_SPACE, _STOP = (np.array([chr(b) in chars for b in range(256)]) for chars in (" \t\n\r\v\f", ".!?"))
#: Words, and characters, of a stretch at most, and how far its last one is compared.
MOST_WORDS, NEAR_WORDS, MOST_LETTERS, NEAR_LETTERS = 12, 3, 32, 8
LONG_WORD = 64
_BASE = 0x9E3779B97F4A7C15
#: Bytes of text that a task's Python holds as arrays at once, but for longer texts.
AT_ONCE = 1 << 20
RUNS = "hash long, doc_id long, place int, size int"
REMOVED, COUNTED = "__removed", "__sentences"


def _least_around(hashes: np.ndarray, near: int) -> np.ndarray:
    """Whether a unit's hash is the least of the `near` before and after it, the first of equal ones; false near both ends."""
    out = np.zeros(len(hashes), bool)
    if len(hashes) > 2 * near:
        own = hashes[near : len(hashes) - near]
        least = np.ones(len(own), bool)
        for k in range(1, near + 1):
            least &= (own < hashes[near - k : len(hashes) - near - k]) & (own <= hashes[near + k : len(hashes) - near + k])
        out[near : len(hashes) - near] = least
    return out


def _at_most(borders: np.ndarray, most: int) -> np.ndarray:
    """The borders, with more of them where two are further apart than `most`."""
    gaps = np.diff(borders)
    n = -(-gaps // most)
    return np.append(np.repeat(borders[:-1], n) + most * ragged(n), borders[-1])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _row_hashes(values: np.ndarray, starts: np.ndarray, size: np.ndarray, at_once: int = 1 << 15) -> np.ndarray:
    """A 64-bit hash of each row values[start : start + size], of one value or more."""
    powers = np.cumprod(np.full(int(size.max(initial=1)), _BASE, "u8"), dtype="u8")
    out = np.zeros(len(starts), "u8")
    for k in range(0, len(starts), at_once):
        own = size[k : k + at_once]
        place = ragged(own)
        terms = (values[np.repeat(starts[k : k + at_once], own) + place].astype("u8") + np.uint64(1)) * powers[place]
        out[k : k + at_once] = _mixed(np.add.reduceat(terms, np.cumsum(own) - own))
    return out


class Stretches:
    """The sentences of texts, and the stretches of long ones, as arrays: start and end in the joined texts, number of words, key and text.

    A sentence ends with the first word that ends in a full stop or that a line break follows. Keys are 64-bit
    hashes of the stretches' words in lower case. The stretches of text k are those from first[k] to first[k + 1].
    """

    def __init__(self, texts: list[bytes]):
        self.joined = b"".join([t + b"\n" for t in texts]).lower()
        self.origin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        raw = np.frombuffer(self.joined, "u1")
        edge = np.diff(np.concatenate([[True], _SPACE[raw]]).astype("i1"))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        n = len(starts)
        size, long = ends - starts, ends - starts > LONG_WORD
        lines = np.flatnonzero(raw == 10)
        over = _STOP[raw[ends - 1]]
        over[:-1] |= np.searchsorted(lines, ends[:-1]) < np.searchsorted(lines, starts[1:])
        borders = np.zeros(n + 1, bool)
        borders[[0, n]] = True
        borders[1:] |= over
        borders[:-1] |= long
        borders[1:] |= long
        borders = np.flatnonzero(borders)
        hashes = _row_hashes(raw, starts, np.minimum(size, LONG_WORD))
        words = np.diff(borders)
        least = np.flatnonzero(_least_around(hashes, NEAR_WORDS))
        part = np.searchsorted(borders, least, side="right") - 1
        inside = (words[part] > MOST_WORDS) & (least - borders[part] >= NEAR_WORDS) & (borders[part + 1] - least > NEAR_WORDS)
        borders = _at_most(np.union1d(borders, least[inside] + 1), MOST_WORDS)
        words = np.diff(borders)
        start = starts[borders[:-1]]
        text = np.searchsorted(self.origin, start, side="right") - 1
        end = np.minimum(np.append(start[1:], len(raw)), self.origin[text + 1] - 1)
        key = _row_hashes(hashes, borders[:-1], words)
        if long.any():
            k = np.searchsorted(borders, np.flatnonzero(long))
            pieces = [(s, e, w, xxhash.xxh3_64_intdigest(b" ".join(self.joined[s:e].split())), t) for j in k.tolist() for (s, e, w), t in ((x, text[j]) for x in self._letters(int(start[j]), int(end[j])))]
            rest = np.ones(len(start), bool)
            rest[k] = False
            start, end, words, key, text = (np.concatenate([old[rest], np.array(new, old.dtype)]) for old, new in zip((start, end, words, key, text), zip(*pieces, strict=True), strict=True))
            order = np.argsort(start, kind="stable")
            start, end, words, key, text = (x[order] for x in (start, end, words, key, text))
        self.start, self.end, self.words, self.key, self.text = start, end, words, key, text
        self.first = np.searchsorted(text, np.arange(len(texts) + 1))

    def _letters(self, start: int, end: int) -> list[tuple[int, int, int]]:
        """A long word in stretches of characters, of which four count as a word; a character is hashed with the two before it."""
        at = np.array([m.start() for m in _LETTER.finditer(self.joined, start, end)] + [end])
        hashes = np.array([zlib.crc32(self.joined[at[max(0, i - 2)] : at[i + 1]].strip()) for i in range(len(at) - 1)])
        cuts = _at_most(np.concatenate([[0], np.flatnonzero(_least_around(hashes, NEAR_LETTERS)) + 1, [len(hashes)]]), MOST_LETTERS)
        return [(int(at[i]), int(at[j]), -(-int(j - i) // 4)) for i, j in zip(cuts, cuts[1:], strict=False)]

    def spans(self, k: int) -> list[tuple[int, int]]:
        """The byte spans of the stretches of text k, in that text."""
        own, origin = slice(self.first[k], self.first[k + 1]), self.origin[k]
        return list(zip((self.start[own] - origin).tolist(), (self.end[own] - origin).tolist(), strict=True))

    def run_key(self, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The hashes of runs of stretches, as signed numbers."""
        return _row_hashes(self.key, first, size).view("i8")

    def runs(self, least_sentences: int = 3, least_words: int = 20) -> tuple[np.ndarray, np.ndarray]:
        """First stretch and length of the shortest run from each stretch, and of that to each stretch where none of those ends."""
        n = len(self.start)
        if not n:
            return np.zeros(0, "i8"), np.zeros(0, "i8")
        words = np.concatenate([[0], np.cumsum(self.words)])
        at, last = np.arange(n), self.first[self.text + 1]
        to = np.maximum(at + least_sentences, np.searchsorted(words, words[:-1] + least_words))
        whole = to <= last
        ends = np.zeros(n + 1, bool)
        ends[to[whole]] = True
        earliest = to[self.first[self.text]]  # where the first run of a stretch's text ends; a run that would leave the text is later than all its stretches
        others = np.flatnonzero((earliest <= at + 1) & ~ends[1:]) + 1
        since = np.minimum(others - least_sentences, np.searchsorted(words, words[others] - least_words, side="right") - 1)
        first, to = np.concatenate([at[whole], since]), np.concatenate([to[whole], others])
        return first, to - first


def all_runs(docs: DataFrame) -> DataFrame:
    schema = arrow(RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, AT_ONCE):
            found = Stretches(text_bytes(b))
            first, size = found.runs()
            text = found.text[first]
            ids = b.column("doc_id").cast(pa.int64()).take(pa.array(text))
            yield batch_of(schema, found.run_key(first, size), ids, (first - found.first[text]).astype("i4"), size.astype("i4"))

    return docs.select("doc_id", "text").mapInArrow(run, RUNS)


def repeats(docs: DataFrame, hot: int = 1000) -> DataFrame:
    """hash, doc_id, place, size, kept_doc_id: the runs that are not the first with their hash.

    Equal runs are first added up by hash (within tasks, then across). Of all runs, only those that a bit map of
    the repeated hashes lets pass meet the firsts again. A hash with more than `hot` runs, or a ten-thousandth of
    all if that is more, is dealt out by salts; there are ten thousand such hashes at most, which are broadcast.
    """
    found = saved(all_runs(docs.filter("doc_id is not null")), "runs")
    limit = max(hot, found.count() // 10_000)
    first = found.groupBy("hash").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = saved(first.withColumn("salts", F.ceil(F.col("n") / limit)).drop("n"), "repeated")
    again = found.filter(Marks(first, "hash").may_have("hash"))
    again = again.join(F.broadcast(first.filter("salts > 1").select("hash", "salts")), "hash", "left")
    again = again.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", "place"), F.col("salts")), F.lit(0).cast("long"))).drop("salts")
    salted = first.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    later = again.join(salted, ["hash", "salt"]).filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("place") != F.col("first.place")))
    return later.select("hash", "doc_id", "place", "size", F.col("first.doc_id").alias("kept_doc_id"))


def remove_repeats(docs: DataFrame, counts: bool = False) -> DataFrame:
    """docs with the repeated sentences cut from text; with counts also __sentences and __removed (with more underscores where docs has these names).

    Documents that certainly lose nothing pass by the join.
    """
    gone_, place_, counted, removed_ = unused(docs, "__gone", "__place", COUNTED, REMOVED)
    gone = repeats(docs).groupBy("doc_id").agg(F.collect_set(F.struct("hash", "place", "size")).alias(gone_))
    gone = saved(gone.filter("doc_id is not null"), "repeats")
    marks = Marks(gone, "doc_id")
    held = marks.table
    # all documents, of which the tasks leave out those that may lose something and come by the join
    rest = docs.withColumns({gone_: F.lit(None).cast(gone.schema[gone_].dataType), place_: marks.place("doc_id")})
    joined = docs.filter(marks.may_have("doc_id")).join(gone, "doc_id", "left").select(*docs.columns, gone_, F.lit(-1).cast("long").alias(place_)).unionByName(rest)
    schema = joined.select(*docs.columns, F.lit(0).cast("int").alias(counted), F.lit(0).cast("int").alias(removed_)).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, AT_ONCE):
            place = b.column(place_).to_numpy()
            b = b.filter(pa.array((place < 0) | ~marked(held.value, np.maximum(place, 0))))
            texts, raw = b.column("text").to_pylist(), text_bytes(b)
            found = Stretches(raw)
            n, removed = np.diff(found.first).astype("i4"), np.zeros(len(texts), "i4")
            for k, gone in enumerate(b.column(gone_).to_pylist()):
                if not gone:
                    continue
                first, size = np.array([g["place"] for g in gone]), np.array([g["size"] for g in gone])
                # a row that shares its id with others may lack the run
                inside = first + size <= n[k]
                first, size, keys = first[inside], size[inside], np.array([g["hash"] for g in gone])[inside]
                same = found.run_key(found.first[k] + first, size) == keys
                bad = np.unique(np.repeat(first[same], size[same]) + ragged(size[same])).tolist()
                spans, out, at = found.spans(k), [], 0
                for s in bad:
                    out.append(raw[k][at : spans[s][0]])
                    at = spans[s][1]
                texts[k] = b"".join([*out, raw[k][at:]]).decode()
                removed[k] = len(bad)
            columns = [pa.array(texts, pa.string()) if f.name == "text" else b.column(f.name) for f in schema if f.name not in (counted, removed_)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int32()), pa.array(removed, pa.int32())], names=schema.names)

    whole = joined.mapInArrow(cut, schema)
    return whole if counts else whole.select(*docs.columns)
