"""Readers of listings: services with attributes, cards of search results, links and documents of pages, and pages as drafts."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import extraction as x
from tidemark.functions.rules import CARD, DOCUMENT_ENDINGS, LASTING_TERMS, LOCALES, SERVICE_LABELS, SERVICE_SUPPORT
from tidemark.functions.text import clean_text, currency, status_by_deadline, summary
from tidemark.sources.files import joined, read_pages

_TITLES = "translations:array<struct<title:string,locale:string>>,title:string"
_SERVICE = f"struct<id:string,slug:string,companyName:string,title:string,description:string,externalLink:string,category:struct<slug:string,{_TITLES}>,serviceAttributes:array<struct<value:string,categoryAttribute:struct<attribute:struct<name:string,{_TITLES}>>>>>"


def _some(c: Column) -> Column:
    return F.nullif(clean_text(c), F.lit(""))


def _first(c: Column) -> Column:
    return F.get(F.filter(c, lambda v: v.isNotNull()), 0)


def _translated(c: Column) -> Column:
    """The title in the first of LOCALES that has one, in any other, or the plain one."""
    titles = c["translations"]
    read = lambda locale: _first(F.transform(titles, lambda t: F.when(t["locale"] == locale, _some(t["title"]))))
    return F.coalesce(*map(read, LOCALES), _first(F.transform(titles, lambda t: _some(t["title"]))), _some(c["title"]))


def plain_key(c: Column) -> Column:
    """A label without case, spaces and signs."""
    return F.regexp_replace(F.lower(c), "[^a-zа-яіїєґ0-9]+", "")


def lookup(attributes: Column, labels: list[str]) -> Column:
    """The value of the first attribute whose label is one of the labels, whatever their case and signs."""
    keys = F.transform(F.array(*map(F.lit, labels)), plain_key)
    return F.get(F.filter(attributes, lambda a: F.array_contains(keys, plain_key(a["label"]))), 0)["value"]


def services(raw: DataFrame, as_of: str, pages: str = "") -> DataFrame:
    """Records of services (source, body): a body is a list under `data`, one under `service`, or a service itself.

    `pages` is put before a slug to give its address. Attributes without label or value do not count.
    """
    body = F.from_json("body", f"struct<data:array<{_SERVICE}>,service:{_SERVICE}>")
    alone = F.from_json("body", _SERVICE)
    each = F.when(body["data"].isNotNull(), body["data"]).when(body["service"].isNotNull(), F.array(body["service"])).when(F.coalesce(alone["id"], alone["slug"]).isNotNull(), F.array(alone))
    s = raw.select("source", F.explode(each).alias("s")).filter("s IS NOT NULL")
    label = lambda a: F.coalesce(_some(a["name"]), _translated(a))
    pairs = F.transform("s.serviceAttributes", lambda a: F.struct(label(a["categoryAttribute"]["attribute"]).alias("label"), _some(a["value"]).alias("value")))
    known = F.filter(pairs, lambda p: p["label"].isNotNull() & p["value"].isNotNull())
    s = s.select("source", _some(F.col("s.id")).alias("id"), _some(F.col("s.slug")).alias("slug"), _some(F.col("s.title")).alias("title"), _some(F.col("s.description")).alias("summary"), _some(F.col("s.companyName")).alias("funder"), _some(F.col("s.externalLink")).alias("link"), _translated(F.col("s.category")).alias("program"), F.coalesce(known, F.array().cast("array<struct<label:string,value:string>>")).alias("attributes"))
    s = s.withColumns({name: lookup(F.col("attributes"), labels) for name, labels in SERVICE_LABELS.items()})
    lines = F.transform("attributes", lambda a: F.concat_ws(": ", a["label"], a["value"]))
    values = F.array_join(F.transform("attributes", lambda a: a["value"]), " ")
    s = s.withColumns({"text": clean_text(F.concat_ws(" ", "title", "summary", "funder", F.array_join(lines, " "))), "__all": F.lower(F.concat_ws(" ", "title", "program", values))})
    s = s.withColumn("__deadline", x.deadline(F.coalesce("term", "text")))
    lasting = F.exists(F.array(*map(F.lit, LASTING_TERMS)), lambda t: F.contains(F.lower("term"), t))
    last_year = F.array_max(F.transform(F.regexp_extract_all("term", F.lit(r"\b(20\d{2})\b"), F.lit(1)), lambda y: y.cast("int")))
    now = F.lit(as_of).cast("date")
    status = F.when(lasting, "open").when(last_year >= F.year(now), "open").when(last_year.isNotNull(), "closed").otherwise(status_by_deadline(F.col("__deadline.deadline"), now))
    support = F.coalesce(*(F.when(F.contains("__all", F.lit(mark)), kind) for mark, kind in SERVICE_SUPPORT), F.lit("finance_programme"))
    url = F.concat(F.lit(pages), F.coalesce("slug", "id"))
    return s.select(
        "source", F.coalesce("id", "slug").alias("record_id"), url.alias("source_url"), F.coalesce("link", url).alias("application_url"), "title", F.coalesce("summary", summary(F.col("text"))).alias("summary"), "text", status.alias("status"),
        F.col("__deadline.deadline").alias("deadline"), F.coalesce("__deadline.deadline_text", "term").alias("deadline_text"), "program", "funder", support.alias("support_type"), F.when(support == "grant", "grant").otherwise("business_support").alias("opportunity_type"),
        F.col("amount").alias("amount_text"), F.coalesce(currency(F.col("money")), F.col("money")).alias("currency"), F.col("place").alias("geography_text"), F.array_compact(F.array("place")).alias("regions"), "eligibility", F.array_compact(F.array("program")).alias("topics"), "attributes",
    )


class _Cards(HTMLParser):
    """Cards of a listing; each open element may have a buffer that takes the text inside it."""

    VOID = {"br", "hr", "img", "input", "link", "meta", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cards, self.open = [], []

    def handle_starttag(self, tag, attrs):
        values = {k: v or "" for k, v in attrs}
        classes = {*values.get("class", "").split()}
        above = self.open[-1] if self.open else None
        if above:
            above["children"] += 1
        card = above["card"] if above else None
        if CARD["card"] in classes and CARD["id"] in values:
            card = {"id": values[CARD["id"]], "href": None, "label": None, "title": None, "summary": None, "amount": None, "stated": None, "sponsors": [], "dates": []}
            self.cards.append(card)
        if tag not in self.VOID:
            self.open.append({"tag": tag, "classes": classes, "children": 0, "card": card, "buffer": self._buffer(card, tag, classes, values) if card else None})

    def _buffer(self, card, tag, classes, values):
        """Where the text of the element that starts now belongs, if anywhere; the first of a kind counts."""
        if CARD["link"] in classes and "href" in values and card["href"] is None:
            card["href"] = values["href"]
            return self._new(card, "title")
        if CARD["amount"] in classes and card["amount"] is None:
            card["label"] = values.get("aria-label")
            return self._new(card, "amount")
        for part, mark in (("summary", CARD["summary"]), ("stated", CARD["deadline"])):
            if mark in classes and card[part] is None:
                return self._new(card, part)
        if tag == "a" and values.get("href", "").startswith(CARD["sponsor_path"]) and self._inside(CARD["sponsor"]):
            return self._new(card, "sponsors")
        row = self.open[-1] if self.open else None
        if tag == "td" and row and row["tag"] == "tr" and row["children"] == 1 and CARD["passed"] not in row["classes"] and self._inside(CARD["dates"]):
            return self._new(card, "dates")
        return None

    def _inside(self, mark):
        return any(mark in e["classes"] for e in self.open)

    @staticmethod
    def _new(card, part):
        buffer = []
        if isinstance(card[part], list):
            card[part].append(buffer)
        else:
            card[part] = buffer
        return buffer

    def handle_endtag(self, tag):
        if any(e["tag"] == tag for e in self.open):
            while self.open.pop()["tag"] != tag:
                pass

    def handle_data(self, data):
        for e in self.open:
            if e["buffer"] is not None:
                e["buffer"].append(data)


CARDS = "array<struct<place:int,id:string,url:string,title:string,summary:string,sponsors:array<string>,deadline_text:string,amount_text:string,label:string>>"


def read_cards(html: Column, url: Column) -> Column:
    """The parts of a page's cards, in one pass."""
    text = lambda buffer: " ".join(" ".join(buffer or []).split()) or None

    def read(body, address):
        parser = _Cards()
        parser.feed(body or "")
        for place, c in enumerate(parser.cards):
            dates = [d for d in map(text, c["dates"]) if d]
            yield {"place": place, "id": c["id"].strip() or None, "url": joined(address, c["href"]) if c["href"] else None, "title": text(c["title"]), "summary": text(c["summary"]), "sponsors": [*dict.fromkeys(s for s in map(text, c["sponsors"]) if s)],
                   "deadline_text": dates[0] if dates else text(c["stated"]), "amount_text": text(c["amount"]), "label": c["label"]}

    @F.pandas_udf(CARDS)
    def run(bodies: pd.Series, addresses: pd.Series) -> pd.Series:
        return pd.Series([[*read(b, a)] for b, a in zip(bodies, addresses, strict=True)], dtype=object)

    return run(html, url)


def cards(raw: DataFrame) -> DataFrame:
    """Records of result cards (source, url, body): a body is a page, or JSON with one under `page`. All want a manual review.

    Cards without id or address are left out; one without a title is named by its source and id.
    """
    page = F.coalesce(F.get_json_object("body", "$.page"), F.col("body"))
    c = raw.select("source", F.explode(read_cards(page, F.col("url"))).alias("c")).filter("c.id IS NOT NULL AND c.url IS NOT NULL")
    title = clean_text(F.regexp_replace(F.col("c.title"), CARD["title_prefix"], ""))
    amount = _some(F.regexp_replace(clean_text(F.col("c.label")), f"(?i)^{CARD['amount_prefix']}\\s*", ""))
    read = c.select("source", "c.place", F.col("c.id").alias("record_id"), F.col("c.url").alias("source_url"), F.coalesce(title, F.concat_ws(" ", "source", F.lit("opportunity"), "c.id")).alias("title"), clean_text(F.col("c.summary")).alias("summary"), "c.sponsors", clean_text(F.col("c.deadline_text")).alias("deadline_text"), F.coalesce(amount, F.when(_some(F.col("c.label")).isNull(), clean_text(F.col("c.amount_text")))).alias("amount_text"))
    return read.withColumns({"deadline": x.deadline(F.col("deadline_text"))["deadline"], "funder": F.nullif(F.array_join("sponsors", ", "), F.lit("")), "needs_manual_review": F.lit(True)})


def filtered_links(links: DataFrame, include: str, exclude: list[str] | None = None, least: int = 4, keys: list[str] | None = None) -> DataFrame:
    """Of rows (keys, place, url, title): addresses that contain `include` and are none of `exclude`, the first of each with a title of `least` characters."""
    keys = keys or ["source"]
    whole = lambda c: F.regexp_replace(c, "/+$", "")
    fit = links.withColumn("title", clean_text(F.col("title"))).filter(F.contains("url", F.lit(include)) & (F.char_length("title") >= least))
    if exclude:
        fit = fit.filter(~whole(F.col("url")).isin([e.rstrip("/") for e in exclude]))
    return fit.groupBy(*keys, "url").agg(F.min_by("title", "place").alias("title"), F.min("place").alias("place"))


def documents(links: Column) -> Column:
    """Those of a page's links whose address names a document, titled by their text or address; repeated ones stay."""
    named = F.filter(links, lambda k: F.regexp_like(F.lower(k["url"]), F.lit("|".join(rf"\.{e}" for e in DOCUMENT_ENDINGS))))
    return F.transform(named, lambda k: F.struct(F.coalesce(_some(k["title"]), k["url"]).alias("title"), k["url"].alias("url")))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Sources from JSON lines, one a slug, with `error` for rows without slug, name or address; change.upsert by slug stores them.

    A source is enabled and waits two seconds unless it says otherwise; of two rows of a slug the one with the greater name stays.
    """
    kind = "slug string, name string, base_url string, list_url string, api_url string, feed_url string, sitemap_url string, access_strategy string, enabled boolean, rate_limit_seconds int, notes string"
    rows = spark.read.schema(kind).json(path).withColumns({c: _some(F.col(c)) for c in ("slug", "name", "base_url")})
    rows = rows.withColumns({"enabled": F.coalesce("enabled", F.lit(True)), "rate_limit_seconds": F.coalesce("rate_limit_seconds", F.lit(2))})
    rows = rows.withColumn("error", F.coalesce(*(F.when(F.col(c).isNull(), f"{c} is missing") for c in ("slug", "name", "base_url"))))
    rest = [c for c in rows.columns if c != "slug"]
    return rows.groupBy("slug").agg(F.max(F.struct("name", *(c for c in rest if c != "name"))).alias("r")).select("slug", "r.*")


def page_drafts(pages: DataFrame, as_of: str, html: str = "html", url: str = "url") -> DataFrame:
    """pages with the fields of a draft in place of the body: an empty page gives nulls and an empty list of documents."""
    d = pages.withColumn("__page", read_pages(F.col(html), F.col(url))).drop(html)
    d = d.withColumn("text", _some(F.col("__page.main")))
    d = d.withColumns({"title": F.coalesce(*(_some(F.col(f"__page.{c}")) for c in ("heading", "subheading", "title"))), "summary": summary(F.col("text")), "__deadline": x.deadline(F.col("text")), "amount_text": x.amount_text(F.col("text")), "documents": documents(F.col("__page.links"))})
    d = d.withColumns({"deadline": F.col("__deadline.deadline"), "deadline_text": F.col("__deadline.deadline_text")})
    return d.withColumn("status", status_by_deadline(F.col("deadline"), F.lit(as_of).cast("date"))).drop("__page", "__deadline")
