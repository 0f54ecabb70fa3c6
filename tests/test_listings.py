"""Readers of listings and pages on small samples of our own, and records read again from snapshots."""

import json
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.functions import extraction as x
from tidemark.operators import enrich
from tidemark.plans import registry
from tidemark.sources import files, listings

SF = "/root/testdata/sf0.001"


def attribute(name, value, titles=()):
    return {"value": value, "categoryAttribute": {"attribute": {"name": name, "translations": [{"locale": k, "title": t} for k, t in titles]}}}


def test_services(spark):
    one = {"id": 5, "slug": "kredyt", "title": " Кредит для <всіх> ", "companyName": "Bank", "category": {"slug": "c", "translations": [{"locale": "en", "title": "Loans"}, {"locale": "ua", "title": "Позики"}]},
           "serviceAttributes": [attribute("Grant Amount", "До 20 000"), attribute(None, "грн", [("en", "Currency")]), attribute("grantAmount", "later"), attribute("", None), attribute("finalProgramTerm", "На постійній основі"), attribute(None, "Київ", [("ua", "Область")])]}
    two = {"slug": "old", "title": "Програма", "description": "Опис", "serviceAttributes": [attribute("finalProgramTerm", "до кінця 2024 року")]}
    bodies = [json.dumps({"data": [one]}), json.dumps({"service": two}), json.dumps(two | {"slug": "own", "serviceAttributes": None}), "not json", None, "{}"]
    raw = spark.createDataFrame([("s", b) for b in bodies], "source string, body string")
    got = {r.record_id: r for r in listings.services(raw, "2026-06-01", "https://x.org/").collect()}
    assert {*got} == {"5", "old", "own"}
    a, b, c = got["5"], got["old"], got["own"]
    assert (a.amount_text, a.currency, a.geography_text, a.regions) == ("До 20 000", "UAH", "Київ", ["Київ"]) and (a.program, a.topics) == ("Позики", ["Позики"])
    assert (a.support_type, a.opportunity_type, a.status, a.source_url) == ("loan", "business_support", "open", "https://x.org/kredyt") and len(a.attributes) == 5
    assert (b.status, b.summary, b.support_type, b.application_url) == ("closed", "Опис", "finance_programme", "https://x.org/old") and (c.attributes, c.regions) == ([], [])


def card(key, href, inner):
    return f'<div class="result-item-wrapper x" js-result-id="{key}"><a class="grant-url" href="{href}">Grant Title: The <em>big</em> one<br></a>{inner}</div>'


def test_cards(spark):
    dates = '<div class="deadline"><span class="deadline-value">1 Jan, 2030</span><div class="deadline-tables"><table><tbody><tr class="deadline-passed"><td>May 1, 2025</td></tr><tr><td>June 10, 2026</td><td>July 9, 2026</td></tr></tbody></table></div></div>'
    first = card("7", "/g?a=1&amp;b=2", f'<div class="sponsor"><a href="/sponsor/detail/a">A &amp; B</a><a href="/sponsor/detail/a2">A &amp; B</a><a href="/else">C</a></div><p class="description">Some <em>text</em></p><div class="amount" aria-label="Funding Amount: up to $5"><p>no</p></div>{dates}')
    second = card("8", "/h", '<span class="deadline-value">10 Jun, 2026</span><div class="amount">up to <b>$7</b></div>')
    page = first + second + card("", "/none", "") + '<div class="result-item-wrapper" js-result-id="9"><b>no link</b></div><a href="/sponsor/detail/z">out</a>'
    raw = spark.createDataFrame([("s", "https://x.org", json.dumps({"hits": 2, "page": page})), ("t", "https://y.org", second), ("u", None, None), ("v", "https://y.org", "")], "source string, url string, body string")
    got = {(r.source, r.record_id): r for r in listings.cards(raw).collect()}
    assert {*got} == {("s", "7"), ("s", "8"), ("t", "8")}
    a, b = got["s", "7"], got["s", "8"]
    assert (a.title, a.summary, a.sponsors, a.funder) == ("The big one", "Some text", ["A & B"], "A & B") and (a.deadline_text, a.deadline, a.amount_text, a.place) == ("June 10, 2026", date(2026, 6, 10), "up to $5", 0)
    assert (b.source_url, b.deadline_text, b.amount_text, b.sponsors, b.funder, b.needs_manual_review) == ("https://x.org/h", "10 Jun, 2026", "up to $7", [], None, True) and got["t", "8"].source_url == "https://y.org/h"


def test_links_documents_and_regions(spark):
    html = ["<title>T</title><body>side<article> </article><main>Deadline: 10 June 2026. <h2>Sub</h2>Up to 5 000 EUR <a href='/a.PDF?x'></a><a href='/n/one/'>News one</a></main>tail</body>", "<title>T</title>only", None, ""]
    pages = spark.createDataFrame([(k, h, "https://x.org/") for k, h in enumerate(html)], "k int, html string, url string")
    got = {r.k: r for r in listings.page_drafts(pages, "2026-06-01").collect()}
    assert (got[0].title, got[0].deadline, got[0].status) == ("Sub", date(2026, 6, 10), "open") and got[0].text.endswith("News one") and "side" not in got[0].text
    assert [tuple(d) for d in got[0].documents] == [("https://x.org/a.PDF?x", "https://x.org/a.PDF?x")] and (got[1].text, got[1].title) == ("T only", "T")
    assert all((got[k].text, got[k].title, got[k].documents) == (None, None, []) for k in (2, 3))
    links = spark.createDataFrame([("s", 0, "https://x/n/a/", "Own"), ("s", 1, "https://x/n/b", "abc"), ("s", 2, "https://x/n/b", " Second "), ("s", 3, "https://x/n/b", "Third one"), ("s", 4, "https://x/m", "Elsewhere"), ("s", 5, None, "None"), ("s", 6, "https://x/n/c/", "Listing")], "source string, place int, url string, title string")
    assert [tuple(r) for r in listings.filtered_links(links, "/n/", ["https://x/n/c"]).select("url", "title", "place").collect()] == [("https://x/n/b", "Second", 2)]
    assert listings.filtered_links(links.limit(0), "/n/").count() == 0


def test_page_queries_against_a_plain_recount(spark):
    """Links of the query, recounted from the arrays of the page reader one page at a time."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", files.read_pages(F.col("html"), F.col("url")).alias("p")).collect()
    want = {}
    for r in pages:
        for k in r.p.links:
            if "/" in k.url and len(k.title) >= 4:
                want.setdefault((r.page_id, k.url), k.place)
    got = {(r.page_id, r.url): r.place for r in registry.QUERIES["page_links"](spark, SF).collect()}
    assert got == want and got
    drafts = registry.QUERIES["page_drafts"](spark, SF).collect()
    assert sorted(r.page_id for r in drafts) == sorted(r.page_id for r in pages)


def test_funding_text(spark):
    rows = [("15000000", "25000000", "EUR"), ("5", "5", "USD"), (None, "1234.50", None), (None, None, "EUR"), ("20000", None, "UAH")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a string, b string, c string").orderBy("k")
    got = [r.t for r in df.select(x.funding_text(F.col("a").cast("decimal(14,2)"), F.col("b").cast("decimal(14,2)"), F.col("c")).alias("t")).collect()]
    assert got == ["EUR 15 000 000 - 25 000 000", "USD 5", "1 234.5", None, "UAH 20 000"]


def test_recompute_and_catalogue(spark, tmp_path):
    old = [(1, "s", "Support for farms", "old text", Decimal("7.00"), "PLN", ["old"], True), (2, "diia-business", "Second", "Own words, deadline: 10 June 2026.", None, None, None, None), (3, None, "Third", None, None, None, [], False)]
    records = spark.createDataFrame(old, "id int, source string, title string, text string, amount_max decimal(14,2), currency string, topics array<string>, needs_manual_review boolean")
    shots = [(1, "Budget: 5 000 EUR. Deadline: 1 July 2026.", datetime(2026, 1, 2)), (1, "Budget: 9 000 USD.", datetime(2026, 1, 1)), (2, None, datetime(2026, 1, 1)), (None, "lost", datetime(2026, 1, 1))]
    got = {r.id: r for r in enrich.recompute(records, spark.createDataFrame(shots, "id int, text string, fetched_at timestamp"), "2026-06-01").collect()}
    assert {*got} == {1, 2, 3} and (got[1].amount_max, got[1].currency, got[1].deadline) == (Decimal("5000.00"), "EUR", date(2026, 7, 1)) and "old" not in got[1].topics
    assert got[1].opportunity_type == "grant" and got[2].text.startswith("Own words") and got[2].deadline == date(2026, 6, 10) and got[3].deadline is None
    (tmp_path / "s.json").write_text('{"slug": "a", "name": "A", "base_url": "https://a"}\n{"slug": "b", "name": "B", "enabled": false, "rate_limit_seconds": 8}\n{"slug": "a", "name": "0", "base_url": "https://a"}\n')
    rows = {r.slug: r for r in listings.catalogue(spark, str(tmp_path / "s.json")).collect()}
    assert (rows["a"].name, rows["a"].enabled, rows["a"].rate_limit_seconds, rows["a"].error) == ("A", True, 2, None) and (rows["b"].enabled, rows["b"].error) == (False, "base_url is missing")


def test_tables_go_to_python_in_small_batches(spark):
    from tidemark.sources import views

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    had = spark.conf.get(name)
    try:
        for given, then in (("67108864b", str(views.BATCH_BYTES)), ("1000000", "1000000")):
            spark.conf.set(name, given)
            views.table(spark, "/root/testdata/sf0.001", "pages")
            assert spark.conf.get(name) == then
    finally:
        spark.conf.set(name, had)
