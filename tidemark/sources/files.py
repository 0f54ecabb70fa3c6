"""Readers of landed files: CSV profiles and history, JSON posts and search results, feeds, sitemaps and pages."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rules import CLIENT_COLUMNS, HISTORY_COLUMNS
from tidemark.functions.text import clean_text, slug, split_list

# What may come of an application.
RESULTS = ["won", "lost", "rejected", "not_submitted", "unknown"]


def _csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"', schema=", ".join(f"{c} string" for c in columns))


def clients(spark: SparkSession, path: str) -> DataFrame:
    """Profiles with lists split and `error` set for rows without a name or a slug."""
    df = _csv(spark, path, CLIENT_COLUMNS).withColumns({c: clean_text(F.col(c)) for c in CLIENT_COLUMNS})
    df = df.withColumn("slug", F.nullif(slug(F.col("name")), F.lit("")))
    lists = {c: split_list(F.col(c)) for c in ("technologies", "target_topics", "excluded_topics")} | {"source_documents": split_list(F.col("source_documents"), "|")}
    return df.withColumns(lists).withColumn("error", F.when(F.col("name").isNull(), "name is missing").when(F.col("slug").isNull(), "slug is empty"))


def history(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """Applications with `row_status` ok, failed (with `error`) or skipped (no such client)."""
    df = _csv(spark, path, HISTORY_COLUMNS).withColumns({c: clean_text(F.col(c)) for c in HISTORY_COLUMNS})
    df = df.withColumn("result", F.coalesce("result", F.lit("unknown"))).withColumn("date", F.try_to_date(F.col("application_date"), "yyyy-MM-dd")).withColumn("weight", F.coalesce(F.col("similarity_weight").try_cast("decimal(6,3)"), F.when(F.col("similarity_weight").isNull(), F.lit(1).cast("decimal(6,3)"))))
    df = df.withColumn("topics", split_list(F.col("topics"))).join(known.select(F.col("name").alias("client_name"), F.col("slug").alias("client_slug")), "client_name", "left")
    error = F.when(~F.col("result").isin(RESULTS), "result is not allowed").when(F.col("application_date").isNotNull() & F.col("date").isNull(), "date does not read").when(F.col("weight").isNull(), "weight does not read")
    return df.withColumn("error", error).withColumn("row_status", F.when(F.col("client_slug").isNull(), "skipped").when(F.col("error").isNotNull(), "failed").otherwise("ok"))


def posts(raw: DataFrame, words: list[str]) -> DataFrame:
    """Posts of a blog's JSON arrays (source, body): those with one of the words, the first of each id."""
    kind = "array<struct<id:long,date:string,date_gmt:string,link:string,title:struct<rendered:string>,excerpt:struct<rendered:string>,content:struct<rendered:string>>>"
    p = raw.select("source", F.posexplode(F.from_json("body", kind)).alias("place", "p"))
    text = lambda c: clean_text(F.regexp_replace(c, "<[^>]*>", " "))
    out = p.select("source", "place", F.col("p.id").alias("record_id"), F.col("p.link").alias("url"), text(F.col("p.title.rendered")).alias("title"), text(F.col("p.excerpt.rendered")).alias("summary"), text(F.col("p.content.rendered")).alias("description"), F.coalesce("p.date_gmt", "p.date").try_cast("timestamp").alias("published_at"))
    everything = F.lower(F.concat_ws(" ", "url", "title", "summary", "description"))
    out = out.filter(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(everything, w)))
    first = F.min_by(F.struct(*(c for c in out.columns if c != "source")), F.col("place"))
    return out.groupBy("source", F.coalesce(F.col("record_id").cast("string"), F.col("url")).alias("identity")).agg(first.alias("r")).select("source", "r.*").drop("place")


def search_results(raw: DataFrame) -> DataFrame:
    """Records of a search service's JSON: fields may be a value or a list."""
    hit = raw.select("source", F.explode(F.from_json(F.coalesce(F.get_json_object("body", "$.results"), F.get_json_object("body", "$.items")), "array<string>")).alias("hit"))
    many = lambda path: F.coalesce(F.from_json(F.get_json_object("hit", path), "array<string>"), F.array_compact(F.array(F.get_json_object("hit", path))))
    first = lambda path: F.get(F.filter(F.transform(many(path), clean_text), lambda x: x.isNotNull()), 0)
    return hit.select("source", F.coalesce(first("$.metadata.identifier"), first("$.id")).alias("record_id"), first("$.content").alias("title"), F.lower(first("$.metadata.status")).alias("status"), first("$.metadata.frameworkProgramme").alias("program"), F.array_distinct(many("$.metadata.keywords")).alias("topics"), many("$.metadata.deadlineDate").alias("deadlines"))


def feed(raw: DataFrame) -> DataFrame:
    """Items of RSS bodies that have a title and a link, each read by itself, so that none takes another's parts."""
    item = raw.select("source", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?s)<item[\s>].*?</item>"), F.lit(0))).alias("place", "item"))
    text = lambda tag: F.regexp_replace(F.regexp_extract("item", rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", 1), r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1")
    published = F.try_to_timestamp(F.regexp_replace(F.trim(text("pubDate")), "^[A-Za-z]{3}, *", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    read = item.select("source", "place", clean_text(text("title")).alias("title"), F.coalesce(clean_text(text("link")), F.when(clean_text(text("guid")).startswith("http"), clean_text(text("guid")))).alias("url"), published.alias("published_at"), clean_text(F.regexp_replace(clean_text(text("description")), "<[^>]*>", " ")).alias("summary"))
    return read.filter("title IS NOT NULL AND url IS NOT NULL")


def sitemap(raw: DataFrame, contains: str = "") -> DataFrame:
    """Addresses of sitemaps that contain a text, the first place of each."""
    loc = raw.select("source", F.posexplode(F.regexp_extract_all("body", F.lit(r"<(?:\w+:)?loc>\s*([^<\s]+)\s*</(?:\w+:)?loc>"), F.lit(1))).alias("place", "url"))
    return loc.filter(F.contains("url", F.lit(contains))).groupBy("source", "url").agg(F.min("place").alias("place"))


class _Page(HTMLParser):
    """Text outside scripts and styles, the title and first heading, links and meta tags of one page."""

    SILENT = {"script", "style", "template"}
    REGIONS = ("article", "main", "body")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts, self.links, self.metas, self.open, self.heads, self.regions = [], [], {}, [], {}, {}

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        if tag == "a" and values.get("href"):
            self.links.append([values["href"], []])
        if tag == "meta" and (name := values.get("property") or values.get("name")):
            self.metas.setdefault(name, values.get("content") or "")
        if tag in self.REGIONS:
            self.regions.setdefault(tag, [len(self.texts), None])
        if tag not in ("meta", "br", "img", "link", "input", "hr"):
            self.open.append(tag)

    def handle_endtag(self, tag):
        closed = None
        while closed != tag and tag in self.open:
            closed = self.open.pop()
            if closed not in self.open and self.regions.get(closed, [0, 0])[1] is None:
                self.regions[closed][1] = len(self.texts)

    def handle_data(self, data):
        if self.SILENT & {*self.open}:
            return
        for tag in ("title", "h1", "h2"):
            if tag in self.open and not self.heads.get(tag, "").strip():
                self.heads[tag] = self.heads.get(tag, "") + data
        if "title" not in self.open:
            self.texts.append(data)
        if "a" in self.open and self.links:
            self.links[-1][1].append(data)

    def main(self):
        """The text of the first article, else main, else body that has any, else all with the title."""
        for tag in self.REGIONS:
            first, last = self.regions.get(tag, (0, 0))
            if text := " ".join(" ".join(self.texts[first:last]).split()):
                return text
        return " ".join(" ".join([self.heads.get("title", ""), *self.texts]).split())


PAGE = "title string, heading string, subheading string, text string, main string, links array<struct<place:int,url:string,title:string>>, metas map<string,string>"


def read_pages(html: Column, url: Column) -> Column:
    """title, first and second heading, text, main text, links (absolute) and metas of pages, in one pass each."""

    @F.pandas_udf(PAGE)
    def run(bodies: pd.Series, addresses: pd.Series) -> pd.DataFrame:
        rows = []
        for body, address in zip(bodies, addresses, strict=True):
            page = _Page()
            page.feed(body or "")
            links = [{"place": k, "url": joined(address, href), "title": " ".join("".join(t).split())} for k, (href, t) in enumerate(page.links)]
            heads = [" ".join(page.heads.get(tag, "").split()) for tag in ("title", "h1", "h2")]
            rows.append((*heads, " ".join(" ".join(page.texts).split()), page.main(), links, page.metas))
        return pd.DataFrame(rows, columns=["title", "heading", "subheading", "text", "main", "links", "metas"])

    return run(html, url)


def joined(base: str | None, href: str) -> str:
    try:
        return urljoin(base or "", href)
    except ValueError:
        return href
