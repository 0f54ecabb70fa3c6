"""The text that stands for a record, a client or an application when it is embedded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rules
from tidemark.functions.text import clean_text

# The labels of each kind's lines, in order, and their columns.
RECORD = [
    ("Title", "title"), ("Summary", "summary"), ("Program", "program"), ("Funder", "funder"), ("Status", "status"), ("Opportunity type", "opportunity_type"), ("Support type", "support_type"), ("Funding", "funding"),
    ("Countries", "countries"), ("Applicant types", "applicant_types"), ("Topics", "topics"), ("Keywords", "keywords"), ("Eligibility", "eligibility"), ("Restrictions", "restrictions"), ("Cofinancing", "cofinancing"),
    ("Consortium", "consortium"), ("Description", "description"),
]
CLIENT = [
    ("Client", "client"), ("Country", "country"), ("Sector", "sector"), ("Organization type", "organization_type"), ("Technologies", "technologies"), ("Target topics", "wanted"), ("Excluded topics", "unwanted"),
    ("Product", "product"), ("Risks", "risks"), ("Previous submissions", "previous_submissions"),
]
APPLICATION = [
    ("Client", "client"), (rules.APPLICATION_TITLE, "title"), (rules.APPLICATION_SOURCE, "source"), ("Program", "program"), ("Result", "result"), ("Country", "country"), ("Applicant type", "applicant_type"), ("Topics", "topics"),
    ("Project summary", "project_summary"), ("Reusable materials", "reusable_materials"), ("Notes", "notes"),
]
LONGEST = 12_000


def profile_text(df: DataFrame, lines: list[tuple[str, str]]) -> Column:
    """`Label: value` of each line that the record has, in one line, at most 12,000 characters.

    A null or missing field has no line; a list has one even if it is empty. A funding line joins amount_text and currency.
    """
    kinds = dict(df.dtypes)

    def value(name: str) -> Column | None:
        if name == "funding" and "amount_text" in kinds:
            return F.when(F.col("amount_text").isNotNull(), F.concat_ws(" ", "amount_text", *(["currency"] if "currency" in kinds else [])))
        if name not in kinds:
            return None
        return F.array_join(F.coalesce(F.col(name), F.array().cast(kinds[name])), ", ") if kinds[name].startswith("array") else F.col(name).cast("string")

    parts = [F.concat(F.lit(f"{label}: "), v) for label, name in lines if (v := value(name)) is not None]
    return F.coalesce(F.left(clean_text(F.concat_ws("\n", *parts)), F.lit(LONGEST)), F.lit(""))


def all_profiles(records: DataFrame, clients: DataFrame, applications: DataFrame, keys: tuple[str, str, str] = ("id", "client_key", "id")) -> DataFrame:
    """kind, id, text of all three tables, to be embedded in one run."""
    tables = zip(("record", "client", "application"), (records, clients, applications), (RECORD, CLIENT, APPLICATION), keys, strict=True)
    parts = [df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), profile_text(df, lines).alias("text")) for kind, df, lines, key in tables]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
