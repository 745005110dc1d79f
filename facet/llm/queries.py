"""Queries and SQL of this subpackage, for __spark_entry__.py. Each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Where the public vocabularies are; a parameter of the queries, so that none is copied here.
def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op5_token_ids import op5_token_ids as operator

    return operator(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op6_packing import op6_packing as operator

    return operator(spark, table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, room=2048)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op10_simhash import op10_simhash as operator

    return operator(spark, table(spark, sf_dir, "documents"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op1_token_counts import op1_token_counts as operator

    return operator(spark, table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op2_licences import op2_licences as operator

    return operator(spark, table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op3_quality import op3_quality as operator

    return operator(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op4_pii import op4_pii as operator

    return operator(spark, table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op7_lm_score import op7_lm_score as operator

    return operator(spark, table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op8_topk import op8_topk as operator

    return operator(spark, table(spark, sf_dir, "embeddings"), k=20, query_every=20, scale=64)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op9_decontaminate import op9_decontaminate as operator

    return operator(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = [op1_token_counts, op2_licences, op3_quality, op4_pii, op5_token_ids, op6_packing, op7_lm_score, op8_topk, op9_decontaminate, op10_simhash]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from . import op2_licences, op8_topk, op9_decontaminate

    return {"op2_licences": op2_licences.ORACLE_SQL, "op8_topk": op8_topk.ORACLE_SQL, "op9_decontaminate": op9_decontaminate.ORACLE_SQL}
