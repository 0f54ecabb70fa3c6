"""Token counts of a document's fields or sections from one encoding of the whole document.

The text is encoded once. Each token keeps the span of bytes that it stands for (the vocabulary is
byte-level, so spans follow from the tokens' lengths), and the spans are joined to the sections' intervals
by binary search. A token that crosses a boundary goes, by rule, to the section of its first byte ("start"),
of its last byte ("end"), or to the one that holds most of its bytes, the earlier at a tie ("majority").

Defined results: every token belongs to exactly one section, so a document's counts add up to its whole
encoding; a null or empty text is one empty section without tokens; repeated rows are counted each by
itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow, batch_of, chunks, text_bytes

COUNTS = "doc_id long, section int, start_char long, end_char long, n_tokens long, n_crossing long"
#: How a text is split before pairs are merged; a fixed part of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class SpanEncoder:
    """The ends of a text's tokens, in bytes."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("spans", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, "i8")
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def ends(self, text: bytes) -> np.ndarray:
        return np.cumsum(self.lengths[self.encoding.encode_ordinary(text.decode())])


_ENCODERS: dict[tuple, SpanEncoder] = {}


def paragraphs(text: bytes) -> list[int]:
    """The byte offsets at which sections end: after each line break, and at the end."""
    ends = (np.flatnonzero(np.frombuffer(text, "u1") == 10) + 1).tolist()
    return ends if ends and ends[-1] == len(text) else [*ends, len(text)]


def attributed(token_ends: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Of each section, the tokens that the rule gives to it, and those that begin in it and cross its end."""
    n = len(section_ends)
    starts = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    first = np.minimum(np.searchsorted(section_ends, starts, side="right"), n - 1)
    last = np.minimum(np.searchsorted(section_ends, token_ends - 1, side="right"), n - 1)
    crossing = np.bincount(first[first != last], minlength=n)
    owner = {"start": first, "end": last}.get(rule)
    if owner is None:
        owner = first.copy()
        section_starts = np.concatenate([[0], section_ends[:-1]])
        for k in np.flatnonzero(first != last):
            inside = range(first[k], last[k] + 1)
            owner[k] = max(inside, key=lambda s: (min(token_ends[k], section_ends[s]) - max(starts[k], section_starts[s]), -s))
    return np.bincount(owner, minlength=n), crossing


def count_sections(docs: DataFrame, vocabulary: str, rule: str = "start", sections: Callable[[bytes], list[int]] = paragraphs) -> DataFrame:
    """A row a section: its place in characters, the tokens that the rule gives it, and those that cross its end."""
    if rule not in ("start", "end", "majority"):
        raise ValueError(f"unknown rule: {rule}")
    schema = arrow(COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (vocabulary, PATTERN) not in _ENCODERS:
            _ENCODERS[vocabulary, PATTERN] = SpanEncoder(vocabulary)
        encoder = _ENCODERS[vocabulary, PATTERN]
        for b in chunks(batches, 256):
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), text_bytes(b), strict=True):
                ends = np.array(sections(text), "i8")
                n, crossing = attributed(encoder.ends(text), ends, rule)
                # a character counts where its first byte stands
                heads = np.cumsum(np.concatenate([[0], (np.frombuffer(text, "u1") & 0xC0) != 0x80]))[np.concatenate([[0], ends])]
                out.append((np.full(len(ends), doc, "O"), np.arange(len(ends)), heads[:-1], heads[1:], n, crossing))
            if out:
                yield batch_of(schema, *(np.concatenate(c) for c in zip(*out, strict=True)))

    return docs.select("doc_id", "text").mapInArrow(count, COUNTS)


def count_fields(rows: DataFrame, key: str, fields: list[str], vocabulary: str, rule: str = "start", separator: str = "\n\n") -> DataFrame:
    """Tokens of each field of a row, where the fields are encoded as one text with separators after all but the last.

    Returns key, field, n_tokens. A null field is empty. The tokens of a separator count for the field before it.
    """
    schema = arrow("key string, field string, n_tokens long")
    joiner = separator.encode()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = SpanEncoder(vocabulary)
        for b in chunks(batches, 256):
            out = []
            columns = [text_bytes(b, f"f{k}") for k in range(len(fields))]
            for name, *values in zip(b.column("key").to_pylist(), *columns, strict=True):
                pieces = [v + joiner * (k < len(fields) - 1) for k, v in enumerate(values)]
                n, _ = attributed(encoder.ends(b"".join(pieces)), np.cumsum([len(p) for p in pieces]), rule)
                out += zip([name] * len(fields), fields, n.tolist(), strict=True)
            if out:
                yield batch_of(schema, *zip(*out, strict=True))

    chosen = [F.col(key).cast("string").alias("key"), *(F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(fields))]
    return rows.select(*chosen).mapInArrow(count, "key string, field string, n_tokens long").withColumnRenamed("key", key)
