"""Column functions that read a record's fields from its free text. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.functions.text import clean_text, let, to_amount, to_date


def padded(*parts: Column) -> Column:
    """The parts in lower case, cleaned, with a space before and after."""
    return F.concat(F.lit(" "), F.coalesce(F.lower(clean_text(F.concat_ws(" ", *parts))), F.lit("")), F.lit(" "))


def has_any(c: Column, words: list[str]) -> Column:
    """Whether the text holds one of the words; false for null."""
    found = c.contains(words[0])
    for w in words[1:]:
        found = found | c.contains(w)
    return F.coalesce(found, F.lit(False))


def labels(c: Column, table: list[tuple[str, list[str]]]) -> Column:
    """The labels of a table whose words a text holds, in the table's order."""
    return F.array_compact(F.array(*(F.when(has_any(c, words), label) for label, words in table)))


def first_label(c: Column, table: list[tuple[str, list[str]]]) -> Column:
    """The first label of a table whose words a text holds, or null."""
    return F.coalesce(*(F.when(has_any(c, words), label) for label, words in table))


def deadline(c: Column) -> Column:
    """struct(deadline, deadline_text): the date after the first of the deadline words, in the list's order, that one follows.

    Each occurrence of a word reads the stretch after it. A text of 240 characters or less without such a date is
    read as a whole, and then has no deadline_text.
    """
    pattern = F.lit(rf"(?iu)(?=({'|'.join(rules.DEADLINE_WORDS)}))(?=(.{{0,{rules.DEADLINE_REACH}}}))")
    order = F.array(*map(F.lit, rules.DEADLINE_WORDS))

    def read(cleaned: Column) -> Column:
        seen = F.zip_with(
            F.regexp_extract_all(cleaned, pattern, 1), F.regexp_extract_all(cleaned, pattern, 2),
            lambda w, s: F.struct(F.array_position(order, F.lower(w)).alias("word"), s.alias("text"), to_date(s).alias("date")),
        )
        dated = F.transform(F.filter(seen, lambda x: x["date"].isNotNull()), lambda x, k: F.struct(x["word"].alias("word"), k.alias("place"), x["date"].alias("deadline"), x["text"].alias("deadline_text")))
        whole = F.when(F.char_length(cleaned) <= 240, to_date(cleaned))
        said = let(F.lower(cleaned), lambda low: has_any(low, rules.DEADLINE_WORDS))
        return let(F.when(said, F.array_min(dated)), lambda best: F.struct(F.coalesce(best["deadline"], whole).alias("deadline"), best["deadline_text"].alias("deadline_text")))

    return let(clean_text(c), read)


def payload_deadline(body: Column, as_of: Column) -> Column:
    """The nearest date from as_of on under any key of a JSON text that names a deadline, else the latest one; null without any."""
    values = F.regexp_extract_all(body, F.lit(r'(?iu)"[^"]*deadline[^"]*"\s*:\s*(\[[^\]]*\]|"(?:[^"\\]|\\.)*")'), 1)
    dates = F.flatten(F.transform(values, lambda v: F.transform(F.regexp_extract_all(v, F.lit(r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{1,2}\s+\p{L}+\s+20\d{2}"), 0), to_date)))
    return let(F.array_compact(dates), lambda found: F.coalesce(F.array_min(F.filter(found, lambda x: x >= as_of.cast("date"))), F.array_max(found)))


def clean_deadline_text(c: Column) -> Column:
    for tail in rules.DEADLINE_TAILS:
        c = F.regexp_replace(clean_text(c), rf"(?iu)\s*{tail}", "")
    return clean_text(F.left(c, F.lit(240)))


def clean_eligibility(c: Column) -> Column:
    c = F.regexp_replace(clean_text(c), r"(?iu)\s*(share|поділитися|детальніше|read more).*$", "")
    return clean_text(F.left(F.regexp_replace(c, r"(?iu)\s*(контакти|contact)[^.!?]{0,180}$", ""), F.lit(900)))


def without_dates(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\b\d{1,2}[./-]\d{1,2}[./-]20\d{2}\b", " "), r"\b20\d{2}[./-]\d{1,2}[./-]\d{1,2}\b", " ")


def amount_text(c: Column) -> Column:
    """The first number of three figures or more with a mark of money, else the first such number."""
    found = F.transform(F.regexp_extract_all(clean_text(c), F.lit(rf"(?iu){rules.MONEY_TEXT_MARK}?\s?\d[\d\s.,]{{2,}}\s?{rules.MONEY_TEXT_END}?"), 0), clean_text)
    marked = F.filter(found, lambda m: F.exists(F.array(*map(F.lit, rules.MONEY_TEXT_MARKERS)), lambda w: F.contains(F.lower(m), w)))
    return F.coalesce(F.get(marked, 0), F.get(found, 0))


def clean_amount_text(c: Column) -> Column:
    """Without markup, labels and dates, at most 300 characters; null for budgets as JSON and for a bare year."""
    cleaned = clean_text(c)
    budget = F.startswith(cleaned, F.lit("{")) & has_any(cleaned, ["budgetTopicActionMap", "deadlineDates"])
    plain = F.regexp_replace(F.regexp_replace(cleaned, "<[^>]+>", " "), rf"(?iu)\b{rules.AMOUNT_LABELS}\s*[:\-–]\s*", "")
    plain = clean_text(without_dates(plain))
    year = F.regexp_like(plain, F.lit(rf"(?iu)^{rules.MONEY_MARK}?\s*20\d{{2}}\s*{rules.MONEY_MARK}?$"))
    return F.when(~F.coalesce(budget | year, F.lit(False)), F.left(plain, F.lit(300)))


def funding_text(least: Column, most: Column, money: Column) -> Column:
    """Like `EUR 15 000 - 25 000`: figures in groups of three; one where both are equal or one is null; null where both are."""
    shown = lambda c: F.replace(F.call_function("format_number", c, F.lit("#,##0.##")), F.lit(","), F.lit(" "))
    sums = F.when(least != most, F.concat(shown(least), F.lit(" - "), shown(most))).otherwise(shown(F.coalesce(most, least)))
    return F.when(sums.isNotNull(), F.concat_ws(" ", money, sums))


def currency_sign(c: Column) -> Column:
    """The currency of a lower-case text, by the first kind of sign that it holds."""
    return F.coalesce(*(F.when(F.regexp_like(c, F.lit(f"(?u){pattern}")), code) for code, pattern in rules.CURRENCY_SIGNS))


def amounts(c: Column, near_mark_only: Column | None = None) -> Column:
    """The sums of money in a text: numbers with a multiplier, or with a mark of money or, from 10,000, a word of money within 40 characters.

    Years, dates and codes of classifications are none, and a k or m that begins a word is no multiplier.
    near_mark_only lets only marks count, not words.
    """
    mark = rules.MONEY_MARK
    pattern = F.lit(rf"(?isu)(?={mark}?\s*\d)(?<=(^.{{0,39}}|.{{40}})){mark}?\s*(\d[\d\s.,]*)(?:\s*([km](?!\p{{L}})|тис\.?|млн\.?|million|thousand))?(?:\s*{mark})?(?=(.{{0,40}}))")

    def matches(text: Column) -> Column:
        part = lambda k: F.regexp_extract_all(text, pattern, k)
        return F.arrays_zip(part(0).alias("whole"), part(1).alias("before"), part(2).alias("number"), part(3).alias("times"), part(4).alias("after"))

    strict = F.lit(False) if near_mark_only is None else F.coalesce(near_mark_only, F.lit(False))

    def read(m: Column) -> Column:
        compact = F.regexp_replace(F.replace(m["number"], F.lit(" "), F.lit("")), "^[.,]+|[.,]+$", "")
        around = F.lower(F.concat(m["before"], m["whole"], m["after"]))
        marked = F.regexp_like(around, F.lit(f"(?u){rules.MONEY_NEAR}"))
        code = F.regexp_like(compact, F.lit(r"^\d{1,2}[.,]\d{1,2}$")) & (F.startswith(compact, F.lit("0")) | ~marked | has_any(around, rules.CODE_WORDS))
        year = F.regexp_like(m["number"], F.lit(r"(?<!\d)20\d{2}(?!\d)")) | F.regexp_like(compact, F.lit(r"^20\d{2}$"))
        amount = to_amount(compact, F.rtrim(m["times"], F.lit(".")))
        named = ~strict & has_any(around, rules.MONEY_WORDS) & (amount >= 10_000)
        return F.when(~code & ~year & ((m["times"] != "") | marked | named), amount)

    return F.filter(F.transform(let(without_dates(clean_text(c)), matches), read), lambda x: x.isNotNull())


def funding(c: Column, source: Column | None = None) -> Column:
    """struct(amount_min, amount_max, currency) of a text.

    A budget as JSON gives the least and the greatest of its contributions, in EUR. In prose "up to" gives no
    amount_min, one sum gives both ends, several give the least and the greatest. All are null without a sign of
    money, or where no currency is named and all sums are under 10,000.
    """
    kind = "struct<amount_min:decimal(14,2),amount_max:decimal(14,2),currency:string>"
    made = lambda low, high, unit: F.struct(low.cast("decimal(14,2)").alias("amount_min"), high.cast("decimal(14,2)").alias("amount_max"), unit.alias("currency"))
    none = F.lit(None).cast(kind)
    marks_only = None if source is None else source.isin(rules.MARKS_ONLY_SOURCES)

    def prose(cleaned: Column) -> Column:
        read = lambda lower, sums, unit: (
            F.when(F.size(sums) == 0, made(F.lit(None), F.lit(None), unit))
            .when(unit.isNull() & (F.array_max(sums) < 10_000), none)
            .when(has_any(lower, rules.LIMIT_WORDS), made(F.lit(None), F.array_max(sums), unit))
            .otherwise(made(F.array_min(sums), F.array_max(sums), unit))
        )
        signed = lambda lower: let(amounts(cleaned, marks_only), lambda sums: let(currency_sign(lower), lambda unit: read(lower, sums, unit)))
        return let(F.lower(cleaned), lambda lower: F.when(has_any(lower, rules.MONEY_SIGNALS), signed(lower)).otherwise(none))

    def read(cleaned: Column) -> Column:
        given = lambda key: F.filter(F.transform(F.regexp_extract_all(cleaned, F.lit(rf'"{key}"\s*:\s*"?(\d+(?:\.\d+)?)'), 1), lambda x: x.try_cast("decimal(14,2)")), lambda x: x > 0)
        ends = F.concat(given("minContribution"), given("maxContribution"))
        budget = lambda e: F.when(F.size(e) > 0, made(F.array_min(e), F.array_max(e), F.lit("EUR")))
        return F.coalesce(let(ends, budget), F.when(~F.startswith(cleaned, F.lit("{")), prose(cleaned)))

    return let(clean_text(c), read)


def status(stated: Column, deadline_at: Column, as_of: Column) -> Column:
    """By the deadline if there is one, else by the words of the stated status."""
    lower = F.lower(clean_text(stated))
    by_date = F.when(deadline_at.cast("date") >= as_of.cast("date"), "open").otherwise("closed")
    return F.when(deadline_at.isNotNull(), by_date).when(has_any(lower, rules.OPEN_WORDS), "open").when(has_any(lower, rules.CLOSED_WORDS), "closed").otherwise("unknown")


def support_type(stated: Column, text: Column) -> Column:
    """The first kind of support named in the stated one and the text, else the stated one."""
    return F.coalesce(let(padded(stated, text), lambda t: first_label(t, rules.SUPPORT_TYPES)), clean_text(stated))


def is_generic_title(c: Column) -> Column:
    return F.coalesce(F.lower(clean_text(c)), F.lit("")).isin(rules.GENERIC_TITLES)


def repaired_title(title: Column, url: Column) -> Column:
    """The title, or for a generic one the last part of the address in words."""
    cleaned = F.coalesce(clean_text(title), F.lit("Untitled opportunity"))
    path = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^[^:/]+://[^/]*(.*)$", 1)
    last = F.element_at(F.split(F.try_url_decode(F.replace(F.rtrim(path, F.lit("/")), F.lit("+"), F.lit("%2B"))), "/"), -1)
    words = clean_text(F.regexp_replace(last, "[_-]", " "))
    made = F.when(~last.isin(rules.GENERIC_PATHS) & (F.char_length(words) >= 6), F.concat(F.upper(F.left(words, F.lit(1))), F.substring(words, F.lit(2), F.char_length(words))))
    return F.when(is_generic_title(cleaned), F.coalesce(made, cleaned)).otherwise(cleaned)


def funder_in_title(c: Column) -> Column:
    """The last parenthesis of a title that reads as a name: capitals in a row, or five words at most."""
    inner = F.transform(F.regexp_extract_all(clean_text(c), F.lit(r"\(([^()]{2,80})\)"), 1), clean_text)
    named = F.filter(inner, lambda x: ~has_any(F.lower(x), rules.NOT_FUNDER_WORDS) & (F.regexp_like(x, F.lit("[A-ZА-ЯІЇЄҐ]{2,}")) | (F.size(F.split(x, " ")) <= 5)))
    return F.try_element_at(named, F.lit(-1))
