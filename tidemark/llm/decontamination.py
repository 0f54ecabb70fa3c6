"""Benchmark decontamination with a generalised suffix automaton of the benchmark items' words.

The automaton accepts every run of words that occurs within an item. A document streams through it; at each
word the automaton gives the longest run ending there that some item holds. A run of `window` words or more
ends a window there; so does a whole item that is shorter than the window. The words inside any occurrence
are hit.

Defined results: a null text has no words; an item without words has no windows; repeated items and documents
count each by itself (equal item ids once); an empty benchmark hits nothing; other columns pass through.

The automaton is broadcast, at most `shard_words` item words at a time: a larger benchmark is split into
shards by item (long items into overlapping stretches, which hold the same windows), and the documents pass
one shard after another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, saved, text_bytes, unused

#: A-Z to a-z; ASCII that is neither digit nor letter to a space; the bytes of other code points as they are.
_WORDS = bytes(32 if b < 128 and not chr(b).isalnum() else ord(chr(b).lower()) if b < 128 else b for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
N_WORDS, HITS, ITEMS = "__n_words", "__hits", "__items"


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Automaton:
    """A suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes], bool]], window: int):
        """items: (id, words, whole): whole if the words are the whole item, so that a short one is a window."""
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        for _, item, _ in items:
            self._insert([self.ids.setdefault(w, len(self.ids)) for w in item])
        n = len(self.len)
        by_len = sorted(range(1, n), key=self.len.__getitem__)
        self.base = [0] * n  # the state whose strings of `window` words end the strings of a state
        for v in by_len:
            if self.len[v] >= window:
                self.base[v] = v if self.len[self.link[v]] < window else self.base[self.link[v]]
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, dict[int, set[str]]] = {}  # state -> length -> whole items
        for name, item, whole in items:
            v = 0
            for k, w in enumerate(item, 1):
                v = self.next[v][self.ids[w]]
                if k >= window:
                    self.items.setdefault(self.base[v], set()).add(name)
            if whole and 0 < len(item) < window:
                self.short.setdefault(v, {}).setdefault(len(item), set()).add(name)
        self.ends_short = bytearray(n)  # whether a whole short item may end here
        for v in by_len:
            self.ends_short[v] = v in self.short or self.ends_short[self.link[v]]

    def _insert(self, item: list[int]) -> None:
        nexts, link, length, last = self.next, self.link, self.len, 0
        for w in item:
            if w in nexts[last]:
                q = nexts[last][w]
                last = q if length[q] == length[last] + 1 else self._split(last, w, q)
                continue
            cur = len(length)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            p, last = last, cur
            while p >= 0 and w not in nexts[p]:
                nexts[p][w] = cur
                p = link[p]
            if p >= 0:
                q = nexts[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of the strings that come by p, apart from the longer ones of q."""
        nexts, link, length = self.next, self.link, self.len
        copy = len(length)
        nexts.append(dict(nexts[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nexts[p].get(w) == q:
            nexts[p][w] = copy
            p = link[p]
        return copy

    def scan(self, text: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The stretches of words that are hit, ascending and apart, and the items that they come from."""
        hits: list[tuple[int, int]] = []
        items: set[str] = set()
        nexts, link, length, window, ends_short = self.next, self.link, self.len, self.window, self.ends_short
        v = matched = 0
        for k, w in enumerate(map(self.ids.get, text), 1):
            if w is None:
                v = matched = 0
                continue
            to = nexts[v].get(w)
            while to is None and v:
                v = link[v]
                matched = length[v]
                to = nexts[v].get(w)
            if to is None:
                continue
            v = to
            matched += 1
            if matched >= window:
                items |= self.items.get(self.base[v], ())
                self._hit(hits, k - window, k)
            if ends_short[v]:
                u, longest = v, 0
                while u > 0 and ends_short[u]:
                    for n, names in self.short.get(u, {}).items():
                        if n <= matched:
                            items |= names
                            longest = max(longest, n)
                    u = link[u]
                if longest:
                    self._hit(hits, k - longest, k)
        return hits, items

    @staticmethod
    def _hit(hits: list[tuple[int, int]], start: int, end: int) -> None:
        while hits and hits[-1][1] >= start:
            start = min(start, hits.pop()[0])
        hits.append((start, end))


def _shards(benchmark: DataFrame, window: int, shard_words: int) -> Iterator[list[tuple[str, list[bytes], bool]]]:
    """The items in lots of about shard_words words."""
    size = F.length(F.coalesce("text", F.lit("")))
    total = benchmark.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"] / 5
    n = int(total // shard_words) + 1
    stretch = max(window, shard_words // 4)
    lots = benchmark.select(F.col("item_id").cast("string").alias("item"), "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("lot"))
    for k in range(n):
        out = []
        for r in lots.filter(F.col("lot") == k).toLocalIterator():
            item = words((r["text"] or "").encode())
            for at in range(0, max(1, len(item)), stretch):
                out.append((r["item"] or "", item[at : at + stretch + window - 1], at == 0 and len(item) <= stretch))
        yield out


def find_spans(docs: DataFrame, benchmark: DataFrame, window: int = 13, shard_words: int = 200_000) -> DataFrame:
    """docs with __n_words, __hits (stretches of word numbers, ascending and apart) and __items (ids, sorted as strings).

    Where docs has columns of these names, the new ones get more underscores.
    """
    context = docs.sparkSession.sparkContext
    names = unused(docs, N_WORDS, HITS, ITEMS)
    none = F.array().cast("array<struct<start:long,end:long>>")
    state = docs.withColumns(dict(zip(names, (F.lit(0).cast("long"), none, F.array().cast("array<string>")), strict=True)))
    schema = state.schema
    for k, lot in enumerate(_shards(benchmark, window, shard_words)):
        state = (saved(state, "hits") if k else state).mapInArrow(_pass(context.broadcast(Automaton(lot, window)), names), schema)
    return state


def _pass(automaton, columns: list[str]):
    _, hits_, items_ = columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton.value
        for b in chunks(batches):
            n, hits, items = [], [], []
            for text, old, names in zip(text_bytes(b), b.column(hits_).to_pylist(), b.column(items_).to_pylist(), strict=True):
                own = words(text)
                new, which = found.scan(own)
                n.append(len(own))
                hits.append([{"start": s, "end": e} for s, e in merged([*new, *((h["start"], h["end"]) for h in old)])])
                items.append(sorted({*names, *which}))
            for name, values in zip(columns, (n, hits, items), strict=True):
                k = b.schema.names.index(name)
                b = b.set_column(k, b.schema.field(k), pa.array(values, b.schema.field(k).type))
            yield b

    return run


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(stretches):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def n_hit(hits: str = HITS) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])


def over(coverage: int, n_words: str = N_WORDS, hits: str = HITS) -> Column:
    """Whether one word in `coverage` or more is hit."""
    return (n_hit(hits) > 0) & (n_hit(hits) * coverage >= F.col(n_words))


def report(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: int = 20) -> DataFrame:
    """A row a document: its words, those hit, the items, and whether it is over the limit."""
    return find_spans(docs.select("doc_id", "text"), benchmark, window).select(
        "doc_id", F.col(N_WORDS).alias("n_words"), n_hit().alias("n_hit"), F.size(ITEMS).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ITEMS).cast("binary"), 256).alias("items_sha256"), over(coverage).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: int = 20, cut_spans: bool = False) -> DataFrame:
    """docs without those of which one word in `coverage` or more is hit; the others stay as they are.

    With cut_spans, those over the limit stay, without the hit stretches.
    """
    n_words, hits, _ = unused(docs, N_WORDS, HITS, ITEMS)
    found = find_spans(docs, benchmark, window)
    if not cut_spans:
        return found.filter(~over(coverage, n_words, hits)).select(*docs.columns)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([without(t, [(h["start"], h["end"]) for h in own]) if len(own) else t for t, own in zip(texts, hits, strict=True)], dtype="object")

    kept = F.when(over(coverage, n_words, hits), F.col(hits)).otherwise(F.array().cast("array<struct<start:long,end:long>>"))
    return found.withColumn("text", cut("text", kept)).select(*docs.columns)


def without(text: str, hits: list[tuple[int, int]]) -> str:
    """The text without the words numbered by hits and what stands between them."""
    raw = (text or "").encode()
    spans = [m.span() for m in _WORD.finditer(raw.translate(_WORDS))]
    out, at = [], 0
    for start, end in hits:
        out.append(raw[at : spans[start][0]])
        at = spans[end - 1][1]
    return b"".join([*out, raw[at:]]).decode()
