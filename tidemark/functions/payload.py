"""Columns over JSON payloads of any shape and depth: canonical text and hash, leaves with their paths, named attributes.

A payload is a JSON text or a VARIANT. Depth and order decide what these give, which no fixed schema expresses, so each
text passes once through an Arrow-batched function that only parses and walks; all that is read out of the leaves is
plain columns. A text that is no JSON is a payload of itself, one string; null is null.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from tidemark.functions import rules
from tidemark.functions.text import clean_text, let, to_date

LEAF = ArrayType(StructType().add("path", StringType()).add("value", StringType()))
ATTRIBUTE = ArrayType(StructType().add("name", StringType()).add("value", StringType()))


def _parsed(text: str):
    try:
        return json.loads(text)
    except (ValueError, RecursionError):  # no JSON, or nested deeper than a parser goes
        return text


def _said(value) -> str:
    return value if isinstance(value, str) else str(value)


def _walk(root) -> Iterator[tuple[str, object, list]]:
    """All leaves and, with the path of their list, all objects in lists: in document order, without recursion."""
    stack = [("", root)]
    while stack:
        path, value = stack.pop()
        if isinstance(value, dict):
            stack += [(f"{path} {key}".strip(), item) for key, item in reversed(value.items())]
        elif isinstance(value, list):
            stack += [(path, item) for item in reversed(value)]
        elif value is not None:
            yield path, value


def _dumped(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _dumped(_parsed(t)), na_action="ignore")


@F.pandas_udf(LEAF)
def _leaves(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"path": p, "value": _said(v)} for p, v in _walk(_parsed(t))], na_action="ignore")


def _named(root) -> list[dict]:
    """Entries of lists whose objects have a value: under their key and every name or title that is nested in them."""
    out, stack = [], [root]
    while stack:
        value = stack.pop()
        if isinstance(value, list):
            for entry in value:
                if isinstance(entry, dict) and isinstance(entry.get("value"), str | int | float):
                    names = [entry.get("key")] + [v for p, v in _walk({k: v for k, v in entry.items() if k != "value"}) if p.rsplit(" ", 1)[-1] in ("name", "title")]
                    out += [{"name": n, "value": _said(entry["value"])} for n in dict.fromkeys(filter(None, map(_said, filter(None, names))))]
            stack += reversed(value)
        elif isinstance(value, dict):
            stack += reversed(value.values())
    return out


@F.pandas_udf(ATTRIBUTE)
def _attributes(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _named(_parsed(t)), na_action="ignore")


@F.pandas_udf(StringType())
def _record_text(payload: pd.Series, html: pd.Series, text: pd.Series, url: pd.Series) -> pd.Series:
    rows = zip(payload, html, text, url, strict=True)
    return pd.Series([_dumped({"payload": p if p is None else _parsed(p), "html": h, "text": t, "source_url": u}) for p, h, t, u in rows], dtype=object)


def as_json(c: Column, kind: str = "string") -> Column:
    """The payload as JSON text, whatever its type."""
    return F.to_json(c) if kind == "variant" or kind.startswith(("struct", "array", "map")) else c.cast("string")


def canonical(c: Column) -> Column:
    """The JSON text with keys sorted at every depth, without spaces, other characters as they are."""
    return _canonical(c)


def content_hash(c: Column) -> Column:
    """SHA-256 of the canonical text: equal for equal content in any order of keys, different for any changed value."""
    return F.sha2(canonical(c).cast("binary"), 256)


def record_hash(payload: Column, html: Column, text: Column, url: Column) -> Column:
    """SHA-256 of the canonical text of a fetched record: an object of its payload, page, text and address, nulls too."""
    return F.sha2(_record_text(payload, html, text, url).cast("binary"), 256)


def leaves(c: Column) -> Column:
    """An array of (path, value): all values but nulls in document order, the keys above each joined by spaces."""
    return _leaves(c)


def attributes(c: Column) -> Column:
    """An array of (name, value) of all objects in lists that have a value, in document order, a row for each of their names."""
    return _attributes(c)


def attribute(attributes: Column, names: list[str]) -> Column:
    """The first value whose name is, by its letters and digits in lower case, one of the names."""
    plain = lambda n: F.regexp_replace(F.lower(n), "[^a-zа-яіїєґ0-9]+", "")
    return F.get(F.filter(F.transform(F.filter(attributes, lambda a: plain(a["name"]).isin(names)), lambda a: clean_text(a["value"])), lambda v: v.isNotNull()), 0)


def deadlines(leaves: Column) -> Column:
    """All dates of the payload that a deadline names, sorted, each once: values under a key with the word, and dates in values that say it."""
    under = F.filter(leaves, lambda x: F.contains(F.lower(x["path"]), F.lit("deadline")))
    saying = F.filter(leaves, lambda x: F.contains(F.lower(x["value"]), F.lit("deadline")))
    said = F.flatten(F.transform(saying, lambda x: F.regexp_extract_all(x["value"], F.lit(rules.PAYLOAD_DATES), 0)))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.concat(F.transform(under, lambda x: x["value"]), said), to_date))))


def deadline(leaves: Column, as_of: Column) -> Column:
    """struct(deadline, deadline_text): the nearest deadline from as_of on, else the latest one, and all of them in words; null without any."""

    def chosen(found: Column) -> Column:
        day = F.coalesce(F.array_min(F.filter(found, lambda d: d >= as_of.cast("date"))), F.array_max(found))
        text = F.concat(F.lit(rules.PAYLOAD_DEADLINES), F.array_join(F.transform(found, lambda d: d.cast("string")), ", "))
        return F.when(day.isNotNull(), F.struct(day.alias("deadline"), text.alias("deadline_text")))

    return let(deadlines(leaves), chosen)


def budget(leaves: Column) -> Column:
    """The first value under a key with "budget" that is itself a budget in JSON; null without any."""
    marked = lambda v: F.exists(F.array(*map(F.lit, rules.BUDGET_KEYS)), lambda k: F.contains(v, k))
    return F.get(F.transform(F.filter(leaves, lambda x: F.contains(F.lower(x["path"]), F.lit("budget")) & marked(x["value"])), lambda x: x["value"]), 0)
