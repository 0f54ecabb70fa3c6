"""Query name to callable, and to the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import rules, text
from tidemark.operators import change, classification, dedup, embedding, graph, kindwise, matching, nearest, quality, reports
from tidemark.plans import list_queries, record_queries  # noqa: F401
from tidemark.plans.base import AS_OF, ORACLE_SQL, QUERIES, query  # noqa: F401
from tidemark.sources import files, listings, views

V_OPPS = """opps AS (SELECT p_partkey AS id, p_name AS title, string_split(p_name, ' ') AS topics, p_brand AS funder, lower(p_type) AS support_type,
  p_retailprice::DECIMAL(14,2) AS amount_max, DATE '1998-01-01' + p_size::INT AS deadline, 'src' || (p_partkey % 5) AS source,
  CASE WHEN p_partkey % 7 = 0 THEN 'closed' WHEN p_partkey % 11 <> 0 THEN 'open' END AS status,
  CASE WHEN p_partkey % 3 <> 0 THEN p_name || ' ' || p_type END AS summary, 'https://example.org/' || (p_partkey % 500) AS source_url,
  CASE WHEN p_partkey % 2 = 0 THEN 'EUR' END AS currency FROM part)"""
V_CLIENTS = """clients AS (SELECT c_custkey AS client_key, c_name AS client, c_mktsegment AS sector, n_name AS country,
  CASE c_custkey % 4 WHEN 0 THEN ['ring','blue'] WHEN 1 THEN ['bolt','red','small'] WHEN 2 THEN ['gear','hot','large'] ELSE ['widget','cold'] END AS wanted,
  CASE c_custkey % 4 WHEN 0 THEN ['old'] WHEN 1 THEN ['plate'] WHEN 2 THEN ['new'] ELSE ['anvil'] END AS unwanted
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
V_GATED = f"gated AS (SELECT * FROM opps WHERE coalesce(status, 'unknown') <> 'closed' AND (deadline IS NULL OR deadline >= DATE '{AS_OF}'))"
V_KEYWORD = """keyword AS (SELECT client_key, client, id, topics, list_has_any(topics, wanted) OR len(list_filter(wanted, lambda t: contains(body, t))) > 0 OR contains(body, lower(sector)) AS met, greatest(0, least(10000,
    floor(len(list_intersect(topics, wanted)) * 4500 / len(wanted)) + floor(len(list_filter(wanted, lambda t: contains(body, t))) * 3000 / len(wanted))
    + CASE WHEN contains(body, lower(sector)) THEN 1000 ELSE 0 END - CASE WHEN list_has_any(topics, unwanted) THEN 2000 ELSE 0 END))::INT AS score
  FROM (SELECT *, lower(title || ' ' || coalesce(summary, '')) AS body FROM gated) g CROSS JOIN clients c)"""


def _open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.gates(views.opportunities(spark, sf_dir), AS_OF).withColumn("body", F.lower(F.concat_ws(" ", "title", "summary"))).select("id", "topics", "body")


def _kinds(spark: SparkSession, sf_dir: str) -> tuple:
    """Opportunities and clients by kinds, for the keyword score reads topics, text, wishes and sector alone."""
    offers, offered = matching.kinds(_open(spark, sf_dir), "id", ["topics", "body"])
    people, clients = matching.kinds(views.clients(spark, sf_dir), "client_key", ["wanted", "unwanted", "sector"])
    return offers, offered, people, clients


def _pairs(offers: DataFrame, people: DataFrame) -> DataFrame:
    return matching.pairs(offers, people).withColumn("keyword", matching.keyword_score(F.col("topics"), F.col("body"), F.col("wanted"), F.col("sector"), F.col("unwanted")))


def _named(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    return rows.join(views.clients(spark, sf_dir).select("client_key", "client"), "client_key").select("client", F.col("rank").cast("long").alias("rank"), "id", "score")


@query(f"WITH {V_OPPS}, {V_CLIENTS}, {V_GATED}, {V_KEYWORD} SELECT client, n AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY client ORDER BY score DESC, id) AS n FROM keyword WHERE score >= 2500) WHERE n <= 10")
def shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers, offered, people, clients = _kinds(spark, sf_dir)
    return _named(spark, sf_dir, matching.shortlist_of_kinds(_pairs(offers, people).withColumnRenamed("keyword", "score"), offered, clients))


@query(f"WITH {V_OPPS}, {V_CLIENTS}, {V_GATED}, {V_KEYWORD} SELECT client, count(*) AS n, sum(score)::BIGINT AS total, max(score) AS best FROM keyword WHERE met GROUP BY client")
def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers, offered, people, clients = _kinds(spark, sf_dir)
    scored = _pairs(offers, people).join(offered.groupBy(F.col("kind").alias("id")).agg(F.count("*").alias("times")), "id")
    total = scored.groupBy(F.col("client_key").alias("kind")).agg(F.sum("times").alias("n"), F.sum(F.col("keyword") * F.col("times")).cast("long").alias("total"), F.max("keyword").alias("best"))
    return total.join(clients, "kind").join(views.clients(spark, sf_dir).select("client_key", "client"), "client_key").select("client", "n", "total", "best")


V_HISTORY = """hist AS (SELECT client_key, topics, weight FROM (SELECT o_custkey AS client_key, string_split(p_name, ' ') AS topics, CASE WHEN o_orderstatus = 'F' THEN 120 ELSE 100 END AS weight,
    o_orderkey FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS p FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) ON o_orderkey = l_orderkey JOIN part ON p = p_partkey))"""
V_BLEND = """blended AS (SELECT k.client, k.id, floor(k.score * 75 / 100 + coalesce(max(least(10000, floor((len(list_intersect(k.topics, h.topics)) * 5000 / len(h.topics) + CASE WHEN list_has_any(k.topics, h.topics) THEN 2500 ELSE 0 END) * h.weight / 100))) FILTER (h.topics IS NOT NULL), 0) * 25 / 100)::INT AS score
  FROM keyword k LEFT JOIN hist h USING (client_key) GROUP BY k.client, k.id, k.score)"""


@query(f"WITH {V_OPPS}, {V_CLIENTS}, {V_GATED}, {V_KEYWORD}, {V_HISTORY}, {V_BLEND} SELECT client, n AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY client ORDER BY score DESC, id) AS n FROM blended WHERE score >= 2500) WHERE n <= 10")
def shortlist_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword scores by kinds of clients, histories by client, in the clients' rows; beyond the kinds that these can take, pairs without a keyword score come in where history alone suffices."""
    offers, offered, people, clients = _kinds(spark, sf_dir)
    offers, people, applications = graph.kept(offers), graph.kept(people), views.history(spark, sf_dir)
    own = graph.kept(applications.select("topics", "weight").distinct().withColumn("application", F.monotonically_increasing_id()))
    if kindwise.fits((people, offers), (own, offers.select("topics").distinct())):
        return _named(spark, sf_dir, matching.shortlist_in_rows(_pairs(offers, people), offers, offered, clients, applications, own))
    best = matching.best_history(offers, applications)
    worded = _pairs(offers, people).select("id", F.col("client_key").alias("kind"), "keyword").join(clients, "kind").select("id", "client_key", "keyword")
    either = worded.unionByName(matching.by_history(offers, best).withColumn("keyword", F.lit(0))).groupBy("id", "client_key").agg(F.max("keyword").alias("keyword"))
    scored = either.join(offers.select("id", "topics"), "id").join(best, ["topics", "client_key"], "left")
    return _named(spark, sf_dir, matching.shortlist_of_kinds(scored.withColumn("score", matching.blend(F.col("keyword"), F.coalesce("history", F.lit(0)))), offered))


@query("SELECT coalesce(status, 'unknown') AS status, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'closed' WHEN p_partkey % 11 <> 0 THEN 'open' END AS status FROM part) GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts(views.opportunities(spark, sf_dir), "status")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts(views.records(spark, sf_dir), "source")


@query("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS topic FROM part")
def topic_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.opportunities(spark, sf_dir).select(F.explode("topics").alias("topic")).distinct()


@query(f"WITH {V_OPPS} SELECT id, title, source FROM opps WHERE (contains(lower(title), 'ring') OR contains(lower(coalesce(summary, '')), 'ring')) AND status = 'open' AND list_contains(topics, 'blue')")
def search_opps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.search(views.opportunities(spark, sf_dir), "RING", status="open", topic="Blue").select("id", "title", "source")


SCORED = f"""judged AS (SELECT *, {record_queries.class_sql("' ' || lower(title) || ' '", "' ' || lower(concat_ws(' ', title, summary, funder)) || ' '")} AS class FROM opps),
  graded AS (SELECT *, list_contains({record_queries.quoted(rules.NOISE_CLASSES)}, class) AS noise, length(title) < 8 AND summary IS NULL AS no_context FROM judged),
  scored AS (SELECT *, greatest(0, least(100, (length(title) >= 8)::INT * 10 + 10 + (NOT no_context)::INT * 10 + 10 + 8 + 4 + (currency IS NOT NULL)::INT * 2 + 1
    + CASE coalesce(status, 'unknown') WHEN 'open' THEN 5 WHEN 'unknown' THEN 2 ELSE 0 END + 5 - noise::INT * 60 - (class = 'finance_program')::INT * 5))::INT AS quality_score,
    CASE WHEN noise THEN 'noise_rejected' WHEN length(title) < 8 OR no_context THEN 'needs_review' ELSE 'usable_with_warnings' END AS quality_tier FROM graded)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(classification.contract(classification.classify(views.opportunities(spark, sf_dir))))


@query(f"WITH {V_OPPS}, {SCORED} SELECT id, quality_score, quality_tier FROM scored")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("id", "quality_score", "quality_tier")


@query(f"""WITH {V_OPPS}, {SCORED} SELECT coalesce(source, '*') AS source, count(*) AS n, round(avg(quality_score), 1) AS avg_score, count(*) FILTER (quality_score < 40) AS low,
  count(*) FILTER (quality_tier = 'usable_with_warnings' AND coalesce(status, '') <> 'closed' AND quality_score >= 40) AS ready FROM scored GROUP BY ROLLUP (source)""")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.quality_summary(_scored(spark, sf_dir), "source")


@query(f"WITH {V_OPPS}, {SCORED}, names AS (SELECT unnest(['src0','src1','src2','src9']) AS source) SELECT source, count(*) FILTER (quality_score >= 50) AS approved, count(quality_score) AS total, count(*) FILTER (quality_score >= 50) >= 10 AS passed FROM names LEFT JOIN scored USING (source) GROUP BY source")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.range(4).select(F.concat(F.lit("src"), F.element_at(F.array(*map(F.lit, ["0", "1", "2", "9"])), (F.col("id") + 1).cast("int"))).alias("source"))
    return reports.gate(_scored(spark, sf_dir), "source", F.col("quality_score") >= 50, 10, names)


@query(f"WITH {V_OPPS}, {SCORED} SELECT id, quality_score FROM scored WHERE quality_tier = 'usable_with_warnings' AND quality_score >= 55")
def prepared_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.prepared(_scored(spark, sf_dir), 55, include_unscored=False).select("id", "quality_score")


@query(f"""WITH {V_OPPS}, t AS (SELECT source, count(*) AS total, count(summary) AS summary, count(status) AS status, count(currency) AS currency FROM opps GROUP BY source)
  SELECT source, field, populated, total - populated AS missing, total FROM (UNPIVOT t ON summary, status, currency INTO NAME field VALUE populated)""")
def field_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    opps = views.opportunities(spark, sf_dir)
    return reports.completeness(opps, "source", {c: quality.present(opps, c) for c in ("summary", "status", "currency")})


@query(f"WITH {V_OPPS}, {SCORED} SELECT source, n, id, quality_score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY quality_score, id) AS n FROM scored) WHERE n <= 3")
def audit_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.samples(_scored(spark, sf_dir), "source", ["quality_score", "id"]).select("source", F.col("n").cast("long").alias("n"), "id", "quality_score")


@query("SELECT source, status, id FROM (SELECT user_id AS source, event_type AS status, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) WHERE n = 1")
def latest_job_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.latest(views.jobs(spark, sf_dir), ["source"], [F.col("started_at").desc(), "id"]).select("source", "status", "id")


@query("""SELECT user_id AS source, count(*) AS jobs, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS created, max(ts) AS last_started,
  sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS counter FROM events GROUP BY 1""")
def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = views.jobs(spark, sf_dir)
    return jobs.groupBy("source").agg(F.count("*").alias("jobs"), F.count_if(F.col("status") == "error").alias("failed"), F.count_if(F.col("status") == "purchase").alias("created"), F.max("started_at").alias("last_started"), F.sum("counter").cast("long").alias("counter"))


@query("SELECT count(*) AS total, count(*) FILTER (p_partkey % 7 <> 0 AND p_partkey % 11 <> 0) AS open, count(*) FILTER (p_partkey % 7 = 0) AS closed, count(*) FILTER (p_retailprice >= 1000) AS large FROM part")
def dashboard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.opportunities(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "open").alias("open"), F.count_if(F.col("status") == "closed").alias("closed"), F.count_if(F.col("amount_max") >= 1000).alias("large"))


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of an earlier run, refreshed at their date."""
    status = F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "open").otherwise("unknown")
    deadline = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate").cast("date"))
    return views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), deadline.alias("deadline"), F.col("o_orderdate").alias("updated_at"))


STATE = "state AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'unknown' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE END AS deadline, o_orderdate AS updated_at FROM orders)"
DUE = "due AS (SELECT * FROM state WHERE (status = 'open' AND deadline IS NOT NULL AND updated_at <= TIMESTAMP '1996-01-01' - INTERVAL 7 DAY) OR (status IN ('open', 'unknown') AND deadline IS NULL AND updated_at <= TIMESTAMP '1996-01-01' - INTERVAL 14 DAY))"


@query(f"WITH {STATE}, {DUE} SELECT id, status, updated_at FROM due")
def due_for_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.due_for_refresh(_state(spark, sf_dir), "1996-01-01").select("id", "status", "updated_at")


@query(f"""WITH {STATE}, {DUE}, known AS (SELECT id FROM state WHERE id % 2 = 0), late AS (SELECT id FROM due WHERE id % 2 = 0), batch AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_linenumber = 1)
  SELECT b.id, CASE WHEN k.id IS NULL THEN 'fetch_new' WHEN d.id IS NOT NULL THEN 'refresh' ELSE 'skip' END AS action FROM batch b LEFT JOIN known k ON k.id = b.id LEFT JOIN late d ON d.id = b.id
  UNION ALL SELECT id, 'refresh' FROM late WHERE id NOT IN (SELECT id FROM batch)""")
def incremental_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _state(spark, sf_dir).filter("id % 2 = 0")
    batch = views.table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("id"))
    return change.actions(batch, known, change.due_for_refresh(known, "1996-01-01"), "id")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 <> 0 OR o_orderkey % 5 = 0 THEN 'new' ELSE 'old' END AS version FROM orders")
def upsert_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _state(spark, sf_dir).select("id")
    return change.upsert(rows.filter("id % 2 = 0").withColumn("version", F.lit("old")), rows.filter("id % 2 <> 0 OR id % 5 = 0").withColumn("version", F.lit("new")), ["id"])


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS version FROM orders")
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _state(spark, sf_dir).select("id")
    return change.insert_missing(rows.filter("id % 2 = 0").withColumn("version", F.lit("old")), rows.filter("id % 2 <> 0 OR id % 5 = 0").withColumn("version", F.lit("new")), ["id"])


CANON = r"""canon AS (SELECT page_id, url, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(u, '^[^:]+://([^/?]*)', 1))
  || CASE WHEN rtrim(regexp_extract(u, '^[^:]+://[^/?]*([^?]*)', 1), '/') = '' THEN '/' ELSE rtrim(regexp_extract(u, '^[^:]+://[^/?]*([^?]*)', 1), '/') END
  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT list_contains(['fbclid','gclid','gbraid','wbraid','mc_cid','mc_eid','yclid'], lower(split_part(p, '=', 1))) AND NOT starts_with(lower(p), 'utm_'))) AS kept
    FROM (SELECT page_id, url, split_part(trim(url), '#', 1) AS u FROM pages)))"""


@query(f"WITH {CANON} SELECT page_id, canonical_url FROM canon")
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url")).alias("canonical_url"))


@query(f"WITH {CANON} SELECT canonical_url, count(*) AS n, min(page_id) AS first_page FROM canon GROUP BY 1 HAVING count(*) > 1")
def duplicate_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_urls(spark, sf_dir).groupBy("canonical_url").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).filter("n > 1")


@query()
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = files.read_pages(F.col("html"), F.col("url")).alias("p")
    return views.table(spark, sf_dir, "pages").select("page_id", page).select("page_id", "p.title", "p.heading", F.char_length("p.text").alias("n_chars"), F.sha2("p.text", 256).alias("text_sha256"), F.size("p.links").alias("n_links"))


@query()
def page_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = listings.page_drafts(views.table(spark, sf_dir, "pages"), "2026-06-01")
    return drafts.select("page_id", "title", "summary", F.sha2("text", 256).alias("text_sha256"), "deadline", "deadline_text", "amount_text", "status", F.size("documents").alias("n_documents"))


@query()
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = files.read_pages(F.col("html"), F.col("url"))
    links = views.table(spark, sf_dir, "pages").select("page_id", F.explode(page["links"]).alias("k")).select("page_id", "k.*")
    return listings.filtered_links(links, "/", keys=["page_id"])


@query(r"SELECT doc_id AS id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(text, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+', ' ', 'g')), '') AS text FROM documents".replace('\\"', '"'))
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.clean_text(F.col("text")).alias("text"))


@query()
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.summary(F.col("text")).alias("summary"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query()
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.candidates(views.named_records(spark, sf_dir)).select("left_id", "right_id", "score", F.concat_ws(",", "reasons").alias("reasons"))


@query("SELECT c_custkey AS id, c_custkey // 50 * 50 + 48 AS root, 2 AS size FROM customer WHERE (c_custkey % 50 = 48 AND c_custkey + 1 IN (SELECT c_custkey FROM customer)) OR c_custkey % 50 = 49")
def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.groups(dedup.kept(dedup.candidates(views.named_records(spark, sf_dir), least=dedup.DUPLICATE))).select("id", "root", F.col("size").cast("int").alias("size"))


@query("""WITH w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-zа-яіїєґ0-9]{2,}')) AS word FROM documents), d AS (SELECT id, word, count(*) AS n, sha256(word) AS h FROM w GROUP BY 1, 2),
  p AS (SELECT id, (('0x' || h[1:8])::BIGINT % 64)::INT AS place, sum(CASE WHEN ('0x' || h[9:10])::INT % 2 = 0 THEN n ELSE -n END)::BIGINT AS n FROM d GROUP BY 1, 2)
  SELECT id, place, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS value FROM p WHERE n <> 0""")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return embedding.hash_embedding(docs).withColumn("value", F.round("value", 6))


TOPK = """SELECT query_id, n AS rank, vec_id FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS n
  FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0) WHERE n <= 5"""


def _nearest(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id")


@query(TOPK)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "embeddings")
    return _nearest(nearest.exact(rows.filter("vec_id % 50 = 0"), rows))


@query(TOPK)
def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows out of an inverted index: the lists nearest to a query, then those that can still hold one of its rows."""
    rows = views.table(spark, sf_dir, "embeddings")
    return _nearest(nearest.search(nearest.build(rows), rows.filter("vec_id % 50 = 0"), whole=True))


@query()
def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the true nearest rows the lists nearest to each query hold."""
    rows = views.table(spark, sf_dir, "embeddings")
    asked = rows.filter("vec_id % 50 = 0")
    return nearest.recall(nearest.search(nearest.build(rows), asked), nearest.exact(asked, rows))


@query("SELECT n_name AS country, c_mktsegment AS sector, count(*) AS n, sum(c_acctbal::DECIMAL(14,2))::DOUBLE AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def clients_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "customer").join(F.broadcast(views.table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("country"), F.col("c_mktsegment").alias("sector")).agg(F.count("*").alias("n"), F.sum(F.col("c_acctbal").cast("decimal(14,2)")).cast("double").alias("balance"))


@query("SELECT source, lang, n_docs, rank FROM (SELECT source, lang, n_docs, row_number() OVER (PARTITION BY source ORDER BY n_docs DESC, lang) AS rank FROM (SELECT source, lang, count(*) AS n_docs FROM documents GROUP BY 1, 2))")
def languages_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n_docs"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.col("n_docs").desc(), "lang")).cast("long"))
