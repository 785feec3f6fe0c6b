"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and
is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import language, mixing, queries, simhash, toxicity
from lodestone.llm.common import table
from lodestone.session import cut_lineage

LEAST_LANGUAGE_SHARE = 0.4
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def apart(stage):
    """``stage`` with columns beyond those of documents under names of their own, so that none
    clashes with what a stage adds; they have their names back after it."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner = [c if c in COLUMNS else f"_extra_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*inner), sf_dir).toDF(*docs.columns)

    return run_stage


@apart
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents without a letter (null and empty texts among them), and those of
    which no language has two fifths of the words: text in two languages stays. Rows are judged
    one by one, repeated rows alike; an empty table stays empty."""
    found = language.identify(docs, "text", queries.language_model(docs))
    good = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SHARE)
    return found.filter(good).select(*docs.columns)


@apart
def leave_out_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the toxicity operator marks as toxic, row by row; a null text
    counts as empty."""
    model = queries.toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, "text", model).filter(F.col("score") < queries.LIKELY).select(*docs.columns)


@apart
def leave_out_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group whose fingerprints are linked:
    four-word shingles, four of 64 bits at most. Null and empty texts are one group. Of a
    repeated id one row stays; rows without an id stay."""
    return simhash.one_of_each(docs, "doc_id", "text", **queries.NEAR)


@apart
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources, up to twice, to temperature weights under which
    every document is shown at least once. A repeated document is a row for each time. A null
    source is a source; a null text has one token."""
    mixed = mixing.mix(docs, "doc_id", "source", "text", max_repeat=queries.MAX_REPEAT)
    return mixed.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 2,048 tokens. A null text is empty: one
    piece, of the token that ends a document. Other columns end here."""
    return queries.packed_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", leave_out_toxic),
    ("simhash_near_dedup", leave_out_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL has no expression for the learned stages; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
