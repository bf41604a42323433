"""Documents to packed training sequences, in five stages.

Every stage works on all rows that the one before it kept; ``run`` writes each stage's rows to the shared folder and reads
them again. All stages but the last return the columns of documents, and keep further columns whatever their names.

Defined results, stage by stage (each operator's module says more): null and empty texts are rejected by ``quality_rules``,
so later stages meet none, though each would take them: ``near_dedup`` keeps null texts, ``redact_pii`` leaves both as they
are, ``mix_sources`` and ``best_fit_packing`` pass over what has no words or tokens. A null doc_id, lang or source is kept as a
value of its own. Rows equal in doc_id and text are judged alike, and ``near_dedup`` keeps one. Texts of any length are read
whole. Each stage turns an empty table into an empty table.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from docquery.llm import mixing, packing, pii, quality, simhash
from docquery.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies within their language's band."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, and all others."""
    return simhash.keep_one(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the sources' budgets; a document of several epochs is there several times."""
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of token ids, with the pieces of documents that each holds."""
    return packing.sequences(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("redact_pii", redact_pii), ("mix_sources", mix_sources), ("best_fit_packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training sequences of all documents: shard, bin, n_tokens, pieces (doc_id, row, piece, offset, length) and codes.

    ``codes`` are the sequence's token ids as directly addressable codes (``tokenids.Codes`` reads them). An epoch's copy of a
    document is a row of its own, so ``row`` tells copies apart. An empty table gives no sequences.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # what the stage wrote on its way isn't needed any more, and need not wait for the next collection
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
