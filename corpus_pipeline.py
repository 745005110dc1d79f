"""From raw documents to packed training sequences. Each stage takes (spark, docs, sf_dir); docs has the columns of documents, and what a stage
returns is written as Parquet and read again as the next one's docs.

Nulls, empty tables and further columns: rows with a null or empty text are judged like any other; every stage but the last keeps all columns of its input, whatever their names, and
an empty table passes through.

The stages bound the bytes that go to Python at once for the whole session (bound_batches), since what they return is planned when the caller writes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facet.llm.common import Stage, bound_batches, table
from facet.llm.near_copies import one_of_each
from facet.llm.op3_quality import accepted, learn
from facet.llm.op4_pii import masked_column, trained
from facet.llm.op6_packing import op6_packing
from facet.llm.op9_decontaminate import clean
from facet.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, fitted on labels that are not held out, scores under 0.5."""
    bound_batches(spark)
    return accepted(docs, learn(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (similarity 0.8 or more by 5-word shingles): that of the least doc_id."""
    bound_batches(spark)
    return one_of_each(docs, Stage(spark, "near-dedup"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return clean(docs, table(spark, sf_dir, "benchmark"), Stage(spark, "clean"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts <EMAIL>, <IP>, <CARD> or <PHONE> in place of personal data; n_chars follows the text."""
    bound_batches(spark)
    out = docs.withColumn("text", masked_column(trained())(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its place in a sequence of 2048 tokens."""
    bound_batches(spark)
    return op6_packing(spark, docs, vocabulary("byte_bpe_50k.json"), end_id=0, room=2048)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", mask_personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Stage(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage.write(docs, name)
    return docs


ORACLE_SQL = None
