"""SentencePiece encoding and decoding of merge-type (BPE) models, exactly as the library's own.

A text is escaped (a mark before it, marks for its spaces) and cut before each run of marks, which no piece of such
a vocabulary crosses; were there one that does, the whole text would be one unit. Distinct units are encoded by
backtracking, many side by side as arrays: each takes the longest piece that starts where it is (Aho-Corasick, or its
goto function alone, walked from all places at once), or the next shorter one, if it is compatible with the piece
before it; where none is, the place is marked in a field of failed positions, and the unit goes back by one piece.
Two pieces are compatible if merging the characters of both anew gives these two; the merges are followed backwards.
That is enough for the whole text: the first merge across a border of two pieces would happen between these two alone
as well. For the same reason a piece that merging its own characters does not give can never come up, and is left out.

Merges go by score, the leftmost first among equals; a character without piece becomes its UTF-8 bytes' pieces, or
the unknown id in a vocabulary without these. Decoding joins pieces, turns marks to spaces, drops the mark that the
encoder put first, and gives U+FFFD for each byte that is part of no character.

Defined results: a null text is empty, an empty text has no ids; rows of equal id or text each get their own result;
an empty table gives no rows; other columns are not read. Texts of any length are encoded whole. Models with other
normalisation than described, with unused or user-defined pieces, or of another type are refused with ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import arrow, by_bytes, ragged

MARK = "▁"
FEW = 12  # so few units are finished one by one
_PROBE = "  a\t ﬁ  "


def vocabulary(model: str) -> dict:
    """What encoding and decoding need of a model file, as plain values to broadcast."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = range(sp.get_piece_size())
    kinds = [(i, sp.id_to_piece(i)) for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    if sp.normalize(_PROBE) != MARK + _PROBE.replace(" ", MARK) or any(sp.is_unused(i) for i in ids):
        raise ValueError(f"{model}: only models without normalisation and without unused pieces")
    names = {i: sp.id_to_piece(i) for i in ids if sp.is_byte(i)}
    merges = Merges({p: sp.get_score(i) for i, p in kinds})
    some = [MARK + p.strip(MARK) for _, p in kinds[:: max(1, len(kinds) // 500)] if p.strip(MARK)]
    if any(sp.encode(p[1:], out_type=str) != merges.merged(p) for p in some):
        raise ValueError(f"{model}: its type is not BPE")
    return {
        "pieces": {p: (i, sp.get_score(i)) for i, p in kinds},
        "bytes": {int(n[1:-1], 16): i for i, n in names.items()},
        "unknown": sp.unk_id(),
        "unknown_text": sp.decode([sp.unk_id()]),
        "control": [i for i in ids if sp.is_control(i)],
    }


class Merges:
    """The plain merge procedure on short strings."""

    def __init__(self, score: dict[str, float]):
        self.score = score

    def merged(self, text: str, until: int = 1) -> list[str]:
        """Merge the adjacent two of the highest score, the leftmost of equals, until none make a piece or so few are left."""
        row, score, none = list(text), self.score, float("-inf")
        gains = [score.get(a + b, none) for a, b in zip(row, row[1:], strict=False)]
        while len(row) > until:
            best = max(gains)
            if best == none:
                break
            k = gains.index(best)
            row[k : k + 2] = [row[k] + row[k + 1]]
            del gains[k]
            if k:
                gains[k - 1] = score.get(row[k - 1] + row[k], none)
            if k < len(gains):
                gains[k] = score.get(row[k] + row[k + 1], none)
        return row


class Table:
    """Distinct int64 keys (none below 0) to int32 values, looked up many at a time; absent ones give -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, "i8"), np.full(1 << self.bits, -1, "i4")
        left, slot = np.arange(len(keys)), self.slots(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]
            placed = self.keys[slot] == keys[left]
            self.values[slot[placed]] = values[left[placed]]
            left, slot = left[~placed], slot[~placed] + 1 & (1 << self.bits) - 1

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype("u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype("i8")

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slots(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], -1)
        left = np.nonzero((held != keys) & (held >= 0))[0]
        while len(left):
            slot = slot[left] + 1 & (1 << self.bits) - 1 if len(slot) != len(left) else slot + 1 & (1 << self.bits) - 1
            held = self.keys[slot]
            same = held == keys[left]
            out[left[same]] = self.values[slot[same]]
            on = ~same & (held >= 0)
            left, slot = left[on], slot[on]
        return out


class Pieces:
    """A vocabulary as arrays by id. Characters that only longer pieces have get ids of their own, `other` stands for all that no piece has; both are spelt in bytes."""

    def __init__(self, words: dict):
        score = {p: s for p, (_, s) in words["pieces"].items()}
        self.bytes, self.unknown, self.merges = words["bytes"], words["unknown"], Merges(score)
        name = {i: p for p, (i, _) in words["pieces"].items()}
        self.own = 1 + max([words["unknown"], *self.bytes.values(), *words["control"], *name])
        name |= dict(enumerate(sorted({c for p in name.values() for c in p} - {*name.values()}), self.own))
        ids = {p: i for i, p in name.items()}
        n = self.other = max(self.own, 1 + max(name))
        self.size, self.shorter = np.ones(n + 1, "i4"), np.full(n + 1, -1, "i4")
        self.left, self.right, self.rank, self.odd = np.full(n + 1, -1, "i4"), np.full(n + 1, -1, "i4"), np.full(n + 1, -np.inf), np.zeros(n + 1, bool)
        self.name, reached = name, ahocorasick.Automaton()
        for p, i in sorted(ids.items(), key=lambda x: len(x[0])):
            if len(p) > 1:
                row = self.merges.merged(p, until=2)
                if len(row) > 2:
                    continue  # its own merges do not give it
                a, b = ids[row[0]], ids[row[1]]
                self.left[i], self.right[i], self.rank[i] = a, b, -score[p]
                self.odd[i] = max(self.rank[a], self.rank[b]) >= self.rank[i] or self.odd[a] or self.odd[b]
            self.size[i] = len(p)
            reached.add_word(p, i)
        for p, i in reached.items():
            self.shorter[i] = next((ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in reached), -1)
        self._goto(dict(reached.items()))
        both = {ids[p[:k]] << 32 | ids[p[k:]]: i for p, i in reached.items() for k in range(1, len(p)) if p[:k] in reached and p[k:] in reached}
        self.joined = Table(np.fromiter(both, "i8", len(both)), np.fromiter(both.values(), "i4", len(both)))
        self.remember = 1 << 21
        self.size_list, self.shorter_list, self.few_pairs = self.size.tolist(), self.shorter.tolist(), {}
        self.pairs, self.fit = np.full(self.remember, -1, "i8"), np.zeros(self.remember, bool)

    def _goto(self, pieces: dict[str, int]) -> None:
        """The trie: a node for each beginning of a piece, `ends` with the piece that it is, or -1."""
        chars = sorted({c for p in pieces for c in p})
        self.chars, number = np.array([ord(c) for c in chars], "i8"), {c: k + 1 for k, c in enumerate(chars)}
        nodes, ends, self.width = {}, [-1], len(chars) + 1
        for p, i in pieces.items():
            at = 0
            for c in p:
                key = at * self.width + number[c]
                if key not in nodes:
                    nodes[key] = len(ends)
                    ends.append(-1)
                at = nodes[key]
            ends[at] = i
        self.nodes, self.ends = Table(np.fromiter(nodes, "i8", len(nodes)), np.fromiter(nodes.values(), "i4", len(nodes))), np.array(ends, "i4")

    def longest(self, codes: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The longest piece that starts at each place and does not pass a stop; `other` where there is none."""
        place = np.minimum(np.searchsorted(self.chars, codes), len(self.chars) - 1)
        kind = np.where(self.chars[place] == codes, place + 1, 0)
        kind[stops] = 0
        out, at, node = np.full(len(codes), self.other, "i4"), np.nonzero(kind)[0], 0
        begin = at
        while len(at):
            node = self.nodes.get(node * self.width + kind[at])
            on = node >= 0
            begin, at, node = begin[on], at[on], node[on].astype("i8")
            piece = self.ends[node]
            whole = piece >= 0
            out[begin[whole]] = piece[whole]
            at = at + 1
            on = kind[np.minimum(at, len(kind) - 1)] > 0
            begin, at, node = begin[on], at[on], node[on]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of both pieces gives these two; answers are remembered by pair, newer ones over older."""
        key = a.astype("i8") << 32 | b
        slot = (key.astype("u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype("i8")
        out, new = self.fit[slot], np.nonzero(self.pairs[slot] != key)[0]
        if len(new):
            _, first, again = np.unique(key[new], return_index=True, return_inverse=True)
            fits = self._undone(a[new[first]], b[new[first]])
            out[new] = fits[again.reshape(-1)]
            self.pairs[slot[new[first]]] = key[new[first]]
            self.fit[slot[new[first]]] = fits
            clash = self.pairs[slot[new[first]]] != key[new[first]]  # two new pairs in one slot: only the last is remembered
            self.pairs[slot[new[first]][clash]] = -1
        return out

    def _undone(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merges happen by rank, so they are undone from the last one: no pair that meets at the border may make a piece
        before the merge that took one of the two further (of equals, the left one is first). Pieces whose merges do not
        go by rank are merged anew."""
        out, plain = np.ones(len(a), bool), (a != self.other) & (b != self.other)
        for k in np.nonzero(plain & (self.odd[a] | self.odd[b]))[0].tolist():
            pair = [self.name[int(a[k])], self.name[int(b[k])]]
            out[k] = self.merges.merged("".join(pair)) == pair
        at = np.nonzero(plain & ~self.odd[a] & ~self.odd[b])[0]
        a, b, limit, left = a[at].astype("i8"), b[at].astype("i8"), np.full(len(at), np.inf), np.zeros(len(at), bool)
        while len(at):
            both = self.joined.get(a << 32 | b)
            rank = np.where(both >= 0, self.rank[both], np.inf)
            crossed = (rank < limit) | ((rank == limit) & ~left & (both >= 0))
            out[at[crossed]] = False
            left = self.rank[a] > self.rank[b]
            on = ~crossed & (left | (self.left[b] >= 0))
            at, a, b, left = at[on], a[on], b[on], left[on]
            limit = np.where(left, self.rank[a], self.rank[b])
            a, b = np.where(left, self.right[a], a), np.where(left, b, self.left[b])
        return out

    def backtracked(self, codes: np.ndarray, begin: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places where pieces start, and these pieces, of units that begin and stop (on a place of their own) in `codes`."""
        longest, n = self.longest(codes, stops), len(codes)
        failed, starts, piece_at, before = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, "i4"), np.zeros(n, "i8")
        first = np.zeros(n, bool)
        first[begin] = True
        at, stop = begin[begin < stops], stops[begin < stops]
        last, piece = np.full(len(at), -1, "i4"), longest[at]
        while len(at):
            if len(at) <= FEW:
                for k in range(len(at)):
                    self._alone(int(at[k]), int(stop[k]), int(last[k]), int(piece[k]), longest, failed, starts, piece_at, before, first)
                break
            end = at + self.size[piece]
            good = ~failed[end]
            ask = np.nonzero(good & (last >= 0))[0]
            good[ask] = self.compatible(last[ask], piece[ask])
            starts[at[good]], piece_at[at[good]], before[end[good]] = True, piece[good], at[good]
            less = self.shorter[piece]
            back = np.nonzero(~good & (less < 0))[0]
            last, at, piece = np.where(good, piece, last), np.where(good, end, at), np.where(good, longest[end], less)
            if len(back):
                failed[at[back]] = True
                to = before[at[back]]
                at[back], piece[back], starts[to] = to, piece_at[to], False  # tried again, it now ends at a failed place
                last[back] = np.where(first[to], -1, piece_at[before[to]])
            on = at < stop
            if not on.all():
                at, last, piece, stop = at[on], last[on], piece[on], stop[on]
        place = np.nonzero(starts)[0]
        return place, piece_at[place]

    def _alone(self, at: int, stop: int, last: int, piece: int, longest, failed, starts, piece_at, before, first) -> None:
        """The rest of one unit, step by step."""
        base, size, shorter, pairs = at, self.size_list, self.shorter_list, self.few_pairs
        ahead = longest[at : stop + 1].tolist()
        while at < stop:
            end = at + size[piece]
            if not failed[end]:
                fits = last < 0
                if not fits:
                    key = last << 32 | piece
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) > self.remember // 8:
                            pairs.clear()
                        fits = pairs[key] = bool(self.compatible(np.array([last], "i4"), np.array([piece], "i4"))[0])
                if fits:
                    starts[at], piece_at[at], before[end] = True, piece, at
                    last, at = piece, end
                    piece = ahead[at - base]
                    continue
            piece = shorter[piece]
            if piece < 0:
                failed[at] = True
                at = int(before[at])
                piece, starts[at] = int(piece_at[at]), False
                last = -1 if first[at] else int(piece_at[before[at]])
                if at < base:
                    base, ahead = at, longest[at : stop + 1].tolist()

    def spelt(self, ids: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece gives, and these ids: bytes for what has no id of its own."""
        count, odd = np.ones(len(ids), "i8"), np.nonzero(ids >= self.own)[0]
        if not len(odd):
            return count, ids
        chars, which = np.unique(codes[odd], return_inverse=True)
        rows = [[self.bytes.get(b, self.unknown) for b in chr(c).encode()] if self.bytes else [self.unknown] for c in chars.tolist()]
        size = np.array([len(r) for r in rows], "i8")
        count[odd] = size[which]
        out, start = np.repeat(ids, count), np.cumsum(count) - count
        flat = np.array([x for r in rows for x in r], "i4")
        out[np.repeat(start[odd], size[which]) + ragged(size[which])] = flat[np.repeat((np.cumsum(size) - size)[which], size[which]) + ragged(size[which])]
        return count, out


class Encoder:
    """Encodes texts; distinct units are remembered until there are `most` of them, then all are forgotten."""

    def __init__(self, words: dict, most: int = 400_000, most_codes: int = 1 << 20):
        self.pieces, self.most, self.most_codes = Pieces(words), most, most_codes
        crossing = any(MARK in p.lstrip(MARK) for p in words["pieces"])
        self.cut: Callable[[str], list[str]] = (lambda text: [text]) if crossing else re.compile(f"{MARK}+[^{MARK}]*").findall
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.size, self.start, self.flat, self.held = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i4"), 0

    def _learn(self, units: list[str]) -> None:
        """Encode new units, as many side by side as have most_codes characters."""
        lengths = np.fromiter(map(len, units), "i8", len(units))
        ends, at, sizes, flats = np.cumsum(lengths + 1), 0, [self.size], [self.flat[: self.held]]
        while at < len(units):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + self.most_codes, side="right")))
            codes = np.frombuffer(("\n".join(units[at:to]) + "\n").encode("utf-32-le"), "u4").astype("i8")
            stops = np.cumsum(lengths[at:to] + 1) - 1
            begin = stops - lengths[at:to]
            place, ids = self.pieces.backtracked(codes, begin, stops)
            count, ids = self.pieces.spelt(ids, codes[place])
            sizes.append(np.bincount(np.searchsorted(stops, place), count, to - at).astype("i8"))
            flats.append(ids)
            at = to
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))
        self.size, self.flat = np.concatenate(sizes), np.concatenate(flats)
        self.start, self.held = np.cumsum(self.size) - self.size, len(self.flat)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        if len(self.known) > self.most or self.held > 16 * self.most:
            self._forget()
        rows = [self.cut(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        units = [u for r in rows for u in r]
        new = [u for u in dict.fromkeys(units) if u not in self.known]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, units), "i8", len(units))
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *map(len, rows)])]
        return gathered(self.flat, self.start[at], size), np.diff(ends)


def gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start : start + size] of each pair, one after another."""
    return values[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class Decoder:
    def __init__(self, words: dict):
        self.text = {i: p.replace(MARK, " ").encode() for p, (i, _) in words["pieces"].items()}
        self.bytes = {i: bytes([b]) for b, i in words["bytes"].items()}
        self.control = set(words["control"])
        self.surface = self.text | self.bytes | {words["unknown"]: words["unknown_text"].encode()} | dict.fromkeys(words["control"], b"")
        top = 1 + max(self.surface)
        self.size = np.array([len(self.surface.get(i, b"")) for i in range(top)], "i8")
        self.start, self.flat = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(self.surface.get(i, b"") for i in range(top)), "u1")
        self.risky = np.array([i in self.control or self.bytes.get(i, b"") >= b"\x80" for i in range(top)])

    def decode(self, ids: list[int]) -> str:
        first = next((i for i in ids if i not in self.control), None)
        return self._joined(ids)[first in self.text and self.text[first].startswith(b" ") :]

    def _joined(self, ids: list[int]) -> str:
        """Bytes that stand together make characters as far as they can."""
        out, k = [], 0
        while k < len(ids):
            run = k
            while run < len(ids) and ids[run] in self.bytes:
                run += 1
            raw = b"".join(self.bytes[i] for i in ids[k:run])
            while raw:
                for n in range(1, 5):
                    try:
                        out.append(raw[:n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    n = 1
                raw = raw[n:]
            if run < len(ids):
                out.append(self.surface[ids[run]].decode())
            k = run + 1
        return "".join(out)

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of rows of ids; rows with bytes that may make no character, or control ids, are decoded by themselves."""
        size, ends = self.size[ids], np.cumsum(counts)
        raw, cut = gathered(self.flat, self.start[ids], size).tobytes(), np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])].tolist()
        alone = np.concatenate([[0], np.cumsum(self.risky[ids])])
        alone = np.diff(alone[np.concatenate([[0], ends])]) > 0
        out = []
        for k, (s, e) in enumerate(zip(cut, cut[1:], strict=False)):
            if alone[k]:
                out.append(self.decode(ids[ends[k] - counts[k] : ends[k]].tolist()))
            else:
                i = int(ids[ends[k] - counts[k]]) if counts[k] else -1
                out.append(raw[s + (i in self.text and raw[s : s + 1] == b" ") : e].decode())
        return out


_HELD: dict[str, tuple[Encoder, Decoder]] = {}


def held(key: str, words: dict) -> tuple[Encoder, Decoder]:
    """One a worker process, as its memory of units serves all its tasks."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Encoder(words), Decoder(words)
    return _HELD[key]


def encode(docs: DataFrame, model: str, decoded: bool = False, most_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, ids array<int> of each text; with decoded, also the text that decoding these ids gives."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded
    words, out = docs.sparkSession.sparkContext.broadcast(vocabulary(model)), arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = held(model, words.value)
        for b in by_bytes(batches, most_bytes):
            ids, counts = encoder.encode(b.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
            columns = [b.column("doc_id"), lists]
            if decoded:
                columns.append(pa.array(decoder.decode_all(ids, counts), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, decoded: the text of each row's ids; null ids are none."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, decoded string"
    words, out = encoded.sparkSession.sparkContext.broadcast(vocabulary(model)), arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = held(model, words.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([decoder.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], schema=out)

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)
