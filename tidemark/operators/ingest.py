"""A fetched record saved in one chain: fields read, content hashed, snapshot kept once, record created or updated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions import payload
from tidemark.functions.text import clean_text
from tidemark.operators import enrich
from tidemark.operators.change import put_records
from tidemark.operators.tables import Keyed

#: Columns of a fetched record besides those of enrich.FIELDS; a table may lack any but source and source_url.
FETCHED = {"source": "string", "source_url": "string", "record_id": "string", "title": "string", "summary": "string", "text": "string", "html": "string", "payload": "string"}
SNAPSHOT = "source string, source_url string, content_hash string, record_id string, title string, summary string, text string, html string, payload string, fetched_at timestamp"
RECORD = "id long, source string, record_id string, url string, content_hash string, title string, summary string, status string, deadline date, deadline_text string, amount_min decimal(14,2), amount_max decimal(14,2), amount_text string, currency string, funder string, program string, support_type string, opportunity_type string, topics array<string>, applicant_types array<string>, countries array<string>, regions array<string>, eligibility string, confidence decimal(5,4), needs_manual_review boolean, review_reason string, fields map<string,struct<method:string,confidence:string,evidence:string>>, updated_at timestamp"


def columns(schema: str) -> list[str]:
    return StructType.fromDDL(schema).fieldNames()


def prepared(fetched: DataFrame, as_of: str) -> DataFrame:
    """fetched with all fields read and `content_hash` of payload, page, text and address as they came.

    Rows without source or address cannot be saved: they are left to `rejected`.
    """
    df = fetched.withColumns({n: F.lit(None).cast(t) for n, t in FETCHED.items() if n not in fetched.columns})
    df = df.filter(F.col("source").isNotNull() & clean_text(F.col("source_url")).isNotNull())
    return enrich.enrich(df.withColumns({"content_hash": payload.record_hash(*(F.col(c) for c in ("payload", "html", "text", "source_url"))), "__raw": F.col("text")}), as_of)


def rejected(fetched: DataFrame) -> DataFrame:
    """The rows that cannot be saved, with `error`."""
    error = F.when(F.col("source").isNull(), "source is missing").when(clean_text(F.col("source_url")).isNull(), "source_url is missing")
    return fetched.withColumn("error", error).filter("error is not null")


def save(fetched: DataFrame, snapshots: Keyed, records: Keyed, as_of: str) -> dict[str, int]:
    """Saves fetched rows; gives the numbers of created, updated and rejected ones.

    snapshots has SNAPSHOT and the keys source, source_url, content_hash; records has RECORD and the key id. The same rows
    saved again add no snapshot and leave the records as they are. Of rows of one record in one batch, the one with the
    least `position` counts, if there is such a column.
    """
    now = F.lit(as_of).cast("timestamp")
    ready = prepared(fetched, as_of).withColumns({"url": F.col("source_url"), "updated_at": now}).persist()
    try:
        snapshots.insert_missing(ready.withColumns({"text": F.col("__raw"), "fetched_at": now}).select(*columns(SNAPSHOT)))
        new = ready.select(*(c for c in columns(RECORD) if c != "id"), *(["position"] if "position" in fetched.columns else []))
        put = put_records(records.read().select("id", "source", "record_id", "url"), new).persist()
        counts = {r["change"]: r["count"] for r in put.groupBy("change").count().collect()}
        records.upsert(put.drop("change", "position"))
        put.unpersist()
        return {"created": counts.get("created", 0), "updated": counts.get("updated", 0), "rejected": rejected(fetched).count()}
    finally:
        ready.unpersist()
