"""Scores that hang on kinds alone, for each client in one row: its best offers, or totals over all of them.

In hundredths, a score is the base of a kind of wishes and a kind of offers, and 25 times the history (the best that
any of the client's applications gives to the past kind of the offers), and the bonus of the offers. Clients stand with
their kinds of applications in one row each and meet the offers of their gate in a cogroup; what two kinds give to each
other goes to all tasks as two matrices of at most `MOST` cells each. So no row is made for a pair of a client and a kind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a matrix that goes to all tasks, at 4 bytes; callers join kinds and clients as rows beyond it.
MOST = 2_000_000
#: About so many clients stand in a group, and so many scores at most are held at a time.
GROUP, CELLS = 4096, 1_000_000
MOST_HISTORY = 10_000


def even(sums: np.ndarray) -> np.ndarray:
    """Scores from sums in hundredths, half to even, from 0 to 10,000."""
    return np.clip(np.rint(sums / 100), 0, 10_000).astype(np.int32)


def down(sums: np.ndarray) -> np.ndarray:
    return sums // 100


def fits(*sides: tuple[DataFrame, DataFrame]) -> bool:
    """Whether the kinds of each two sides make a matrix within the bound."""
    return all(a.count() * b.count() <= MOST for a, b in sides)


class Matrix:
    """Values of pairs of keys (long), 0 for absent ones, with a last row and a last column of zeros for keys that it lacks."""

    def __init__(self, df: DataFrame):
        rows, columns, *values = (c.to_numpy() for c in df.toArrow().columns)
        self.rows, r = np.unique(rows.astype(np.int64), return_inverse=True)
        self.columns, c = np.unique(columns.astype(np.int64), return_inverse=True)
        self.cells = [np.zeros((len(self.rows) + 1, len(self.columns) + 1), np.int32) for _ in values]
        for cells, v in zip(self.cells, values, strict=True):
            cells[r, c] = v

    @staticmethod
    def _of(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(keys, wanted)
        known = keys[np.minimum(at, len(keys) - 1)] == wanted if len(keys) else np.zeros(len(wanted), bool)
        return np.where(known, at, len(keys))

    def row(self, keys: np.ndarray) -> np.ndarray:
        return self._of(self.rows, keys)

    def column(self, keys: np.ndarray) -> np.ndarray:
        return self._of(self.columns, keys)


def _lists(c: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists without nulls, and the place where each list begins, with the end."""
    lists = c.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), ends


def _many(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of stretches, one after another."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())


def _blocks(clients: pa.Table, words: Matrix, past: Matrix) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """row of the wish, places of some clients, their histories by past kind; a block has one wish and bounded cells."""
    want = words.row(clients["want"].to_numpy())
    own, ends = _lists(clients["applications"])
    own, zero = past.row(own.astype(np.int64)), len(past.rows)
    wide, order = past.cells[0].shape[1], np.argsort(want, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(want[order])) + 1):
        cost = np.cumsum((ends[at + 1] - ends[at] + 1) * wide) // CELLS
        for some in np.split(at, np.flatnonzero(np.diff(cost)) + 1):
            lengths = ends[some + 1] - ends[some]
            first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
            flat = np.full(int((lengths + 1).sum()), zero)
            flat[_many(first, lengths)] = own[_many(ends[some], lengths)]
            yield int(want[some[0]]), some, np.maximum.reduceat(past.cells[0][flat], first, axis=0)


def _parts(histories: np.ndarray, at: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, CELLS // max(1, width))
    for k in range(0, len(at), step):
        yield at[k : k + step], histories[k : k + step]


class Offers:
    """The offers of a gate as arrays, by kind and bonus."""

    def __init__(self, table: pa.Table, words: Matrix, past: Matrix, score: Callable, least: int):
        self.content, self.bonus, self.n = table["content"].to_numpy(), table["bonus"].to_numpy().astype(np.int32), table["n"].to_numpy()
        self.kind, self.column = words.column(self.content), past.column(table["past_content"].to_numpy())
        self.ids, self.ends = _lists(table["ids"]) if "ids" in table.column_names else (None, None)
        self.words, self.score, self.least, self.held = words, score, least, {}

    def of(self, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """places, sums without history: the rows that can reach the least score for a wish."""
        sums = self.words.cells[0][want][self.kind] + self.bonus
        at = np.flatnonzero(self.score(sums + 25 * MOST_HISTORY) >= self.least)
        return at, sums[at]

    def equal(self, want: int) -> tuple[np.ndarray, ...]:
        """sum, column, number of rows of the offers that score alike for each client with the wish, with where each group's places begin and the places."""
        if want not in self.held:
            at, sums = self.of(want)
            order = np.lexsort((sums, self.column[at]))
            at, sums, column = at[order], sums[order], self.column[at[order]]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(sums) != 0) | (np.diff(column) != 0)])) if len(at) else np.zeros(0, np.int64)
            self.held = {want: (sums[first], column[first], at, np.append(first, len(at)))}
        return self.held[want]


def _grouped(people: DataFrame, offers: DataFrame) -> tuple:
    """Both sides of the cogroup by gate; clients of a gate are dealt over parts of about GROUP, each of which gets the gate's offers."""
    parts = people.groupBy("gate").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    left = people.join(F.broadcast(parts), "gate").withColumn("part", F.pmod(F.xxhash64("client_key"), F.col("parts")).cast("int")).drop("parts")
    right = offers.join(F.broadcast(parts), "gate").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return left.groupBy("gate", "part"), right.groupBy("gate", "part")


def totals(people: DataFrame, offers: DataFrame, words: DataFrame, past: DataFrame, score: Callable = even, least: int = 2500) -> DataFrame:
    """client_key, n, total, best, unwanted: the offers that reach the least score, for clients with any.

    people: client_key, gate, want, applications (array of long, not null); offers: gate, content, past_content, bonus, n; words: want,
    content, base, unwanted (0 or 1); past: application, past_content, history. Keys are long.
    """
    sent = people.sparkSession.sparkContext.broadcast((Matrix(words), Matrix(past)))
    names = ["client_key", "n", "total", "best", "unwanted"]

    def each(clients: pa.Table, found: pa.Table) -> pa.Table:
        words, past = sent.value
        offers, keys, out = Offers(found, words, past, score, least), clients["client_key"].to_numpy(), []
        for want, block, histories in _blocks(clients, words, past) if len(clients) and len(found) else ():
            sums, column, at, first = offers.equal(want)
            if not len(sums):
                continue
            n = np.add.reduceat(offers.n[at], first[:-1])
            bad = np.add.reduceat(offers.n[at] * words.cells[1][want][offers.kind[at]], first[:-1])
            for some, own in _parts(histories, block, len(sums)):
                points = score(sums + 25 * own[:, column])
                good = points >= least
                counted = good.astype(np.float64) @ np.stack([n, bad], 1).astype(np.float64)
                kept = counted[:, 0] > 0
                value = np.where(good, points, 0)
                out.append(np.stack([keys[some], counted[:, 0].astype(np.int64), (value.astype(np.float64) @ n.astype(np.float64)).astype(np.int64), value.max(1), counted[:, 1].astype(np.int64)])[:, kept])
        rows = np.concatenate(out, 1) if out else np.zeros((5, 0), np.int64)
        return pa.table(dict(zip(names, rows.astype(np.int64), strict=True)))

    left, right = _grouped(people.select("gate", "client_key", "want", "applications"), offers.select("gate", "content", "past_content", "bonus", "n"))
    return left.cogroup(right).applyInArrow(each, ", ".join(f"{c} long" for c in names))


def best(people: DataFrame, offers: DataFrame, words: DataFrame, past: DataFrame, top: int = 10, score: Callable = even, least: int = 2500) -> DataFrame:
    """client_key, gate, want, content, id, score, history, rank: each client's best, ties to the lesser id.

    Tables as in `totals`; offers have `ids`, an array of the `top` least ids of theirs, too, for no other can be among the best.
    """
    sent = people.sparkSession.sparkContext.broadcast((Matrix(words), Matrix(past)))
    names = ["client_key", "gate", "want", "content", "id", "score", "history", "rank"]

    def each(clients: pa.Table, found: pa.Table) -> pa.Table:
        words, past = sent.value
        offers, out = Offers(found, words, past, score, least), []
        keys, wants = clients["client_key"].to_numpy(), clients["want"].to_numpy()
        gate, held = (clients["gate"][0].as_py() if len(clients) else 0), {}
        for want, block, histories in _blocks(clients, words, past) if len(clients) and len(found) else ():
            sums, column, at, first = offers.equal(want)
            if not len(sums):
                continue
            if want not in held:
                held = {want: _least_ids(offers, at, first, top)}
            ids, content, starts = held[want]
            for some, own in _parts(histories, block, len(sums)):
                points = score(sums + 25 * own[:, column])
                limit = np.full(len(some), least) if points.shape[1] <= top else np.maximum(np.partition(points, -top, axis=1)[:, -top], least)
                who, which = np.nonzero(points >= limit[:, None])
                lengths = starts[which + 1] - starts[which]
                place, who, which = _many(starts[which], lengths), np.repeat(who, lengths), np.repeat(which, lengths)
                got = points[who, which]
                order = np.lexsort((ids[place], -got, who))
                place, who, which, got = place[order], who[order], which[order], got[order]
                rank = np.arange(len(who)) - np.searchsorted(who, who) + 1
                k = rank <= top
                place, who, which = place[k], who[k], which[k]
                out.append(np.stack([keys[some[who]], np.full(len(who), gate), wants[some[who]], content[place], ids[place], got[k], own[who, column[which]], rank[k]]))
        rows = np.concatenate(out, 1) if out else np.zeros((len(names), 0), np.int64)
        return pa.table(dict(zip(names, rows.astype(np.int64), strict=True)))

    left, right = _grouped(people.select("gate", "client_key", "want", "applications"), offers.select("gate", "content", "past_content", "bonus", "n", "ids"))
    return left.cogroup(right).applyInArrow(each, ", ".join(f"{c} long" for c in names))


def _least_ids(offers: Offers, at: np.ndarray, first: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `top` least ids of each group of rows that score alike, their kinds, and where each group's begin, with the end."""
    group, lengths = np.repeat(np.arange(len(first) - 1), np.diff(first)), offers.ends[at + 1] - offers.ends[at]
    ids, group, content = offers.ids[_many(offers.ends[at], lengths)], np.repeat(group, lengths), np.repeat(offers.content[at], lengths)
    order = np.lexsort((ids, group))
    ids, group, content = ids[order], group[order], content[order]
    k = np.arange(len(group)) - np.searchsorted(group, group) < top
    return ids[k], content[k], np.searchsorted(group[k], np.arange(len(first)))


def least_ids(ids: Column, top: int) -> Column:
    """The `top` least of lists of ids that an aggregation collects."""
    return F.slice(F.array_sort(F.flatten(F.collect_list(ids))), 1, top)
