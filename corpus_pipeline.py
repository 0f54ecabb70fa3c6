"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a table that is written before the next one reads it. All
but the last keep the columns of documents. A text that loses all its sentences to an earlier copy stays as
an empty row, which packing turns into its end token.

Defined results: a null text counts as empty, is scored and packed as such and stays null until then; repeated
rows are copies, of which those with the least id stay (rows that share that id all do); rows without id are
never removed as copies; where texts of one id differ, the id goes only if all of them are copies of others;
ties in packing are between equal pieces; empty tables give no rows at every stage; other columns pass through
all stages but the last, whatever their names. A stage reads labels or benchmark whole; without labels nothing
is rejected.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, near_duplicates, packing, quality, substrings
from tidemark.llm.common import saved, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id."""
    return near_duplicates.keep_one(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the sentences of all but the first occurrence of a repeated span; other columns stay as they are."""
    return substrings.remove_repeats(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold too much of a benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", good), ("n-gram Jaccard join", unlike), ("substring dedup", unrepeated), ("benchmark decontamination", clean), ("best-fit packing", packed)]

#: Sets of text runs, a fitted model and packing are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name.replace(" ", "-"))
    return docs
