"""Which of very many terms a text holds: one automaton over all terms, one pass over each text."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

#: So many terms at most go to the tasks in one automaton (some 100 bytes a character there); more are cut into several.
MOST = 200_000

_BUILT: dict[int, object] = {}


def _automaton(key: int, terms: list[str]):
    """The automaton of a broadcast list, kept by the worker process with a few others."""
    if key not in _BUILT:
        import ahocorasick

        if len(_BUILT) >= 4:
            _BUILT.clear()
        built = ahocorasick.Automaton()
        for t in terms:
            built.add_word(t, t)
        if terms:
            built.make_automaton()
        _BUILT[key] = built
    return _BUILT[key]


def _finder(df: DataFrame) -> Callable[[Column], Column]:
    terms = sorted(r[0] for r in df.collect())
    sent = df.sparkSession.sparkContext.broadcast(terms)
    key = sent._jbroadcast.id() if sent._jbroadcast is not None else id(sent)

    @F.pandas_udf(ArrayType(StringType()))
    def find(texts: pd.Series) -> pd.Series:
        held = _automaton(key, sent.value)
        return texts.map(lambda t: sorted({w for _, w in held.iter(t)}) if t and len(held) else [])

    return find


def finder(terms: DataFrame, most: int = MOST) -> Callable[[Column], Column]:
    """A function from a text column to the distinct terms (column term) that a text holds as parts, in order.

    Null and empty terms are in no text; a null text holds none. The distinct terms are counted first; beyond `most`
    they are dealt by a hash of their first character and the rest into lists of about that many, each with an
    automaton of its own, and a text passes one after another within its one read.
    """
    distinct = terms.select("term").filter("term <> ''").distinct()
    lists = max(1, -(-distinct.count() // most))
    finders = [_finder(distinct if lists == 1 else distinct.filter(F.pmod(F.xxhash64("term"), F.lit(lists)) == k)) for k in range(lists)]
    if lists == 1:
        return finders[0]
    return lambda text: F.array_sort(F.flatten(F.array(*(f(text) for f in finders))))


def reader(tables: dict[str, list[tuple[str, list[str]]]], lists: dict[str, list[str]]) -> Callable[[Column], Column]:
    """A function from a text column to a struct: for each table the labels whose words the text holds, in the table's order, and for each list the place of its earliest word, from 1, or null.

    The words of all of them are sought in one pass. A null text holds none.
    """
    kind = StructType()
    for n in tables:
        kind.add(n, ArrayType(StringType()))
    for n in lists:
        kind.add(n, IntegerType())
    labels = [(n, label, words) for n, table in tables.items() for label, words in table]
    ends: dict[str, tuple[list[int], list[str]]] = {}
    for k, (_, _, words) in enumerate(labels):
        for w in words:
            ends.setdefault(w, ([], []))[0].append(k)
    for n, words in lists.items():
        for w in words:
            ends.setdefault(w, ([], []))[1].append(n)

    @F.pandas_udf(kind)
    def read(texts: pd.Series) -> pd.DataFrame:
        held, rows = _automaton(id(ends), [*ends]), []
        for t in texts:
            seen, first = set(), dict.fromkeys(lists)
            for end, w in held.iter(t) if t else ():
                own, named = ends[w]
                seen.update(own)
                for n in named:
                    at = end - len(w) + 2
                    if first[n] is None or at < first[n]:
                        first[n] = at
            found = {n: [] for n in tables}
            for k in sorted(seen):
                found[labels[k][0]].append(labels[k][1])
            rows.append(found | first)
        out = pd.DataFrame(rows, columns=[*tables, *lists], dtype=object)
        return out.astype({n: "Int32" for n in lists})

    return read


def in_texts(texts: DataFrame, terms: DataFrame, most: int = MOST) -> DataFrame:
    """id, client_key, once, of the texts (id, body) that hold a term (client_key, term)."""
    found = texts.select("id", F.explode(finder(terms, most)(F.col("body"))).alias("term"))
    return found.join(terms.select("client_key", "term").distinct(), "term").select("id", "client_key").distinct()
