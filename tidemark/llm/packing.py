"""Best-fit packing of documents into fixed-length token sequences, planned on the histogram of lengths.

Documents are encoded and cut into pieces of at most `size` tokens. The plan needs only how many pieces
there are of each length (`size` numbers at most): best-fit decreasing works on groups of equally filled
sequences instead of single ones. Each piece then takes the slot that the plan holds for its rank among
the pieces of its length.

Defined results: a null text is empty and becomes one piece that holds the end token; repeated rows are
packed once each (a tie in rank is between equal rows, so either order gives the same result); an empty
table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow, batch_of, by_bytes, ragged, saved

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_SPACE = re.compile(rb"\s")


class WordEncoder:
    """Token ids of texts by way of their distinct words, for a BPE vocabulary with word ends that never joins tokens over white space.

    Arrow cuts the texts of a batch at white space and gives each distinct word once; words of plain Latin
    characters are put in lower case and cut into runs by the vocabulary's own pattern. Only runs that are not
    remembered are encoded, a thousand in a line, and told apart by the tokens that end a run. All other words go
    through the whole tokenizer one by one. The ids of the texts are then gathered by offsets.
    """

    #: No white space and no marks; lower case is one character for one, and the same in every library.
    PLAIN = "^[\x21-\x7e\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]+$"
    LINE = 1000

    def __init__(self, path: str, remember: int = 200_000, most_bytes: int = 1 << 20):
        from tokenizers import Tokenizer

        self.remember, self.most_bytes = remember, most_bytes
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        parts = json.loads(Path(path).read_text())
        split, to_bytes = parts["pre_tokenizer"]["pretokenizers"]
        self.pattern = f"(?:{split['pattern']['Regex']})"
        at_spaces = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
        parts |= {"normalizer": None, "added_tokens": [], "post_processor": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [at_spaces, to_bytes]}}
        self.runs = Tokenizer.from_str(json.dumps(parts))
        vocabulary, suffix = parts["model"]["vocab"], parts["model"]["end_of_word_suffix"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known, self.flat, self.size, self.start, self.held = {"": 0}, np.zeros(0, "<u4"), np.zeros(1, "i8"), np.zeros(1, "i8"), 0

    def _encoded(self, lines: list[str]) -> np.ndarray:
        return np.fromiter((i for e in self.runs.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids), "<u4")

    def _learn(self, units: list[str], plain: np.ndarray) -> None:
        """Remembers the ids of units: runs where plain, other words as a whole."""
        runs, others = [u for u, p in zip(units, plain, strict=True) if p], [u for u, p in zip(units, plain, strict=True) if not p]
        ids = self._encoded([" ".join(runs[k : k + self.LINE]) for k in range(0, len(runs), self.LINE)])
        stops = np.flatnonzero(self.ends[ids]) + 1
        apart = [e.ids for e in self.whole.encode_batch_fast(others, add_special_tokens=False)]
        sizes = np.concatenate([np.diff(stops, prepend=0), np.array(list(map(len, apart)), "i8")]).astype("i8")
        self.known.update(zip([*runs, *others], range(len(self.known), len(self.known) + len(sizes)), strict=True))
        self.flat = np.concatenate([self.flat, ids, *(np.array(x, "<u4") for x in apart)])
        self.size = np.concatenate([self.size, sizes])
        self.start = np.cumsum(self.size) - self.size
        self.held += sum(map(len, units))

    def _units(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: how many remembered units it has, and their places one after another."""
        plain = pc.match_substring_regex(words, self.PLAIN)
        cut = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(words), self.pattern, "\\0 "), " ")
        one = pa.LargeListArray.from_arrays(pa.array(np.arange(len(words) + 1)), words)
        lists = pc.if_else(plain, cut.cast(one.type), one)
        units = lists.flatten().dictionary_encode()
        names = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        fresh = [u for u in names if u not in self.known]
        if fresh:
            self._learn(fresh, pc.match_substring_regex(pa.array(fresh, pa.large_string()), self.PLAIN).to_numpy(zero_copy_only=False))
        place = np.fromiter(map(self.known.__getitem__, names), "i8", len(names))
        return np.diff(lists.offsets.to_numpy()), place[units.indices.to_numpy()]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        if len(self.known) > self.remember or self.held > 32 * self.remember:
            self._forget()
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        n_units, units = self._units(words.dictionary)
        size = self.size[units]
        held = _gathered(self.flat, self.start[units], size)  # the ids of each distinct word
        n = np.bincount(np.repeat(np.arange(len(n_units)), n_units), size, len(n_units)).astype("i8")
        at = words.indices.to_numpy()
        total = np.concatenate([[0], np.cumsum(n[at])])[lists.offsets.to_numpy()]
        return _gathered(held, (np.cumsum(n) - n)[at], n[at]), np.diff(total)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ids; a text above most_bytes is cut at white space and taken a stretch at a time."""
        if len(texts) > 1 or len(raw := (texts[0].as_py() if len(texts) else "").encode()) <= self.most_bytes:
            return self.ids(texts)
        cuts = [0]
        while cuts[-1] < len(raw):
            found = _SPACE.search(raw, cuts[-1] + self.most_bytes)
            cuts.append(found.start() if found else len(raw))
        out = np.concatenate([self.ids(pa.array([raw[s:e].decode()], pa.large_string()))[0] for s, e in zip(cuts, cuts[1:], strict=False)])
        return out, np.array([len(out)])


def _gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start : start + size] of each pair, one after another."""
    return values[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One a worker process, as its memory of words serves all its tasks."""
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already, and each thread would hold memory
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """The pieces of each document: where they start in its ids, their length and the CRC-32 of their ids."""
    schema = arrow(PIECES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for b in by_bytes(batches, words.most_bytes):
            ids, n = words.encode(pc.fill_null(b.column("text").cast(pa.large_string()), ""))
            ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
            k = -(-n // size)
            piece = ragged(k)
            length = np.minimum(size, np.repeat(n, k) - piece * size)
            ends, raw = (4 * np.cumsum(length)).tolist(), memoryview(ids.tobytes())
            sums = [zlib.crc32(raw[s:e]) for s, e in zip([0, *ends[:-1]], ends, strict=True)]
            yield batch_of(schema, b.column("doc_id").take(pa.array(np.repeat(np.arange(len(n)), k))), piece.astype("i4"), piece * size, length, sums)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, pieces a sequence, first sequence, offset): best-fit decreasing over counts.

    A group is a run of consecutive sequences that are filled alike. Pieces of one length go to the group
    with the least room that takes one; each of its sequences takes as many as fit, which is what best fit
    would do with them one by one. A group is split at most once a length, so there are few thousand rows
    for any number of pieces.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    room: list[int] = []  # the distinct amounts of room, ascending
    groups: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, sequences)
    next_sequence = 0

    def free(r: int, first: int, n: int) -> None:
        if r and n:
            if r not in groups:
                insort(room, r)
                groups[r] = []
            groups[r].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            k = bisect_left(room, length)
            if k == len(room):
                each = size // length
                r, first, n = size, next_sequence, -(-left // each)
                next_sequence += n
            else:
                r = room[k]
                first, n = groups[r].pop()
                if not groups[r]:
                    del groups[r], room[k]
            each = r // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, each, first, size - r))
                free(r - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n:
                if 0 < left < each:
                    rows.append((length, rank, left, first + full, size - r))
                    free(r - left * length, first + full, 1)
                    full, left = full + 1, 0
                free(r, first + full, n - full)
    return rows


def pack(parts_: DataFrame, size: int = 4096, bucket_rows: int = 50_000) -> DataFrame:
    """The pieces with sequence_id and offset: gapless from 0 in each sequence.

    The rank within a length is the sum of the counts of the buckets before (buckets by hash, so a length
    that a third of the pieces share is still ranked by many tasks) and the rank within the bucket.
    """
    spark = parts_.sparkSession
    histogram = {r["length"]: r["n"] for r in parts_.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `size` rows at most
    rows = sorted(plan(histogram, size))
    buckets = max(1, -(-sum(histogram.values()) // bucket_rows))
    dealt = parts_.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    before = (
        dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n"))
        .drop("n")
    )
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = dealt.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside") - 1)
    slots = spark.sparkContext.broadcast(np.array(rows, "i8").reshape(-1, 5))
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    schema = arrow(out)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        keys = (table[:, 0] << 44) + table[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            found = table[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            since, each = rank - found[:, 1], found[:, 2]
            columns = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found[:, 3] + since // each), pa.array(found[:, 4] + since % each * length)], schema=schema)

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, out)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """Encode, cut, plan and place: one row a piece."""
    return pack(saved(pieces(docs, tokenizer, size, end_id), "pieces"), size)
