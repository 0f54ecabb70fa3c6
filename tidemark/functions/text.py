"""Column functions over the text, address, money and date fields of opportunity records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.rules import CURRENCY_ALIASES, MONTHS, MONTHS_UK, TITLE_STOP_WORDS, TRACKING_KEYS

ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]


def clean_text(c: Column) -> Column:
    """Common entities read, white space (Unicode's too) made single and trimmed, blank as null."""
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def canonical_url(c: Column) -> Column:
    """Lower-case scheme and host, no tracking keys, sorted query, no fragment, no slash at the end; text without scheme and host is only cleaned."""
    name = lambda p: F.lower(F.substring_index(p, "=", 1))

    def parts(u: Column) -> Column:
        address = F.substring_index(u, "?", 1)
        query = F.when(F.contains(u, F.lit("?")), F.regexp_extract(u, r"\?(.*)$", 1)).otherwise("")
        kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).isin(TRACKING_KEYS) & ~F.startswith(name(p), F.lit("utm_"))))
        return F.struct(
            F.lower(F.regexp_extract(address, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)).alias("scheme"), F.lower(F.regexp_extract(address, r"^[^:]+://([^/]*)", 1)).alias("host"),
            F.regexp_replace(F.regexp_extract(address, r"^[^:]+://[^/]*(.*)$", 1), "/+$", "").alias("path"), F.array_join(kept, "&").alias("query"), (F.size(kept) > 0).alias("asked"),
        )

    whole = lambda p: F.concat(p["scheme"], F.lit("://"), p["host"], F.when(p["path"] == "", "/").otherwise(p["path"]), F.when(p["asked"], F.concat(F.lit("?"), p["query"])).otherwise(""))
    return let(clean_text(c), lambda text: let(let(F.substring_index(text, "#", 1), parts), lambda p: F.when((p["scheme"] != "") & (p["host"] != ""), whole(p)).otherwise(text)))


def normalized_title(c: Column) -> Column:
    """A title's telling words: lower case, no short parentheses, letters and digits, without stop words."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(clean_text(c)), r"\([^)]{1,80}\)", " "), "[^0-9a-zа-яіїєґ]+", " ")), " ")
    return F.coalesce(F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(TITLE_STOP_WORDS)), " "), F.lit(""))


def currency(c: Column) -> Column:
    up, out = F.upper(c), F.when(F.lit(False), "")
    for alias, code in CURRENCY_ALIASES:
        out = out.when(F.contains(up, F.lit(alias)), code)
    return out


def to_amount(number: Column, multiplier: Column | None = None) -> Column:
    """A number with thousands and decimal marks of either kind, times thousand or million, at two places; null if it is none or has over 12 figures."""
    n = F.regexp_replace(number, r"[\s ']", "")
    both = F.contains(n, F.lit(",")) & F.contains(n, F.lit("."))
    comma_last = F.locate(",", F.reverse(n)) < F.locate(".", F.reverse(n))
    plain = (
        F.when(both & comma_last, F.replace(F.replace(n, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(both, F.replace(n, F.lit(","), F.lit("")))
        .when(F.regexp_like(n, F.lit(r"^\d{1,3}([.,]\d{3})+$")), F.regexp_replace(n, "[.,]", ""))
        .otherwise(F.replace(n, F.lit(","), F.lit(".")))
    )
    times = F.lit(1) if multiplier is None else F.when(F.lower(multiplier).isin("k", "тис", "thousand"), 1_000).when(F.lower(multiplier).isin("m", "млн", "million"), 1_000_000).otherwise(1)
    return F.round(plain.try_cast("decimal(20,4)") * times, 2).try_cast("decimal(14,2)")


def to_date(c: Column) -> Column:
    """The first that reads as a date: `D month YYYY` in Ukrainian, `Month D, YYYY`, `D Month YYYY`, D.M.YYYY, D.M.YY, YYYY-M-D; null for days that are not."""
    months = F.create_map(*[F.lit(x) for name, k in (MONTHS | MONTHS_UK).items() for x in (name, k)])
    part = lambda pattern, k: F.regexp_extract(F.lower(c), pattern, k)
    made = lambda y, m, d: F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
    name, local = (f"({'|'.join(sorted(table, key=len, reverse=True))})" for table in (MONTHS, MONTHS_UK))
    uk = rf"(?U)\b(\d{{1,2}})\s+{local}\s+(20\d{{2}})\b"
    mdy, dmny = rf"\b{name}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(20\d{{2}})\b", rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+{name}\.?,?\s+(20\d{{2}})\b"
    dmy, dm2, ymd = r"\b(\d{1,2})[./-](\d{1,2})[./-](\d{4})\b", r"\b(\d{1,2})\.(\d{1,2})\.(\d{2})\b", r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
    return F.coalesce(
        made(part(uk, 3), F.try_element_at(months, part(uk, 2)), part(uk, 1)),
        made(part(mdy, 3), F.try_element_at(months, part(mdy, 1)), part(mdy, 2)),
        made(part(dmny, 3), F.try_element_at(months, part(dmny, 2)), part(dmny, 1)),
        made(part(dmy, 3), part(dmy, 2), part(dmy, 1)), made(F.concat(F.lit("20"), part(dm2, 3)), part(dm2, 2), part(dm2, 1)), made(part(ymd, 1), part(ymd, 2), part(ymd, 3)),
    )


def status_by_deadline(deadline: Column, as_of: Column) -> Column:
    return F.when(deadline.isNull(), "unknown").when(deadline.cast("date") >= as_of.cast("date"), "open").otherwise("closed")


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def split_list(c: Column, separator: str = ";") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), f"[{separator}]"), clean_text), lambda x: x.isNotNull())


def merge_lists(old: Column, new: Column) -> Column:
    """The cleaned values of both, each once whatever its case, in order and first spelling."""
    values = F.filter(F.transform(F.concat(F.coalesce(old, F.array()), F.coalesce(new, F.array())), clean_text), lambda x: x.isNotNull())
    return F.filter(values, lambda x, k: F.array_position(F.transform(values, F.lower), F.lower(x)) == k + 1)


def summary(c: Column, least: int = 25, enough: int = 300, most: int = 700) -> Column:
    """Sentences of `least` characters or more until there are `enough`, else the first 500 characters."""
    sentences = F.filter(F.split(clean_text(c), r"(?<=[.!?])\s+"), lambda s: F.char_length(s) >= least)
    joined = F.aggregate(sentences, F.lit(""), lambda a, s: F.when(F.char_length(a) >= enough, a).otherwise(F.trim(F.concat(a, F.lit(" "), s))))
    return F.left(F.coalesce(F.nullif(joined, F.lit("")), F.left(clean_text(c), F.lit(500))), F.lit(most))


def let(value: Column, build: Callable[[Column], Column]) -> Column:
    """build(value), with the value computed once a row however often build names it."""
    return F.get(F.transform(F.array(value), build), 0)


def snippet(c: Column, words: list[str], radius: int = 240) -> Column:
    """The stretch around the earliest of the words."""
    at = let(F.lower(c), lambda low: F.array_min(F.filter(F.array(*(F.locate(w, low) for w in words)), lambda x: x > 0)))
    return let(at, lambda k: stretch(c, k, radius))


def stretch(c: Column, place: Column, radius: int = 240) -> Column:
    """The stretch around a place, null for none."""
    start = F.greatest(place - radius // 2, F.lit(1))
    return clean_text(F.substring(c, start, place + radius - start))


def cosine(a: Column, b: Column) -> Column:
    """Null where one is null, the lengths differ or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)
