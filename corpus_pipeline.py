"""From raw documents to token files: five stages, each a table that the next one reads.

Part of the ``llm`` subpackage. Every stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor kept and returns
the columns of ``documents``; the last one returns the document index that it reads back from the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, minhash, mix, quality, tokens
from tidemark.llm.common import store, tables, text_bytes


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled rows of ``docs`` that are not held out."""
    return quality.keep_good(docs, quality.fit(docs, tables(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (shingle similarity 0.8 or more); one row where ids repeat or are null."""
    return _only(docs, minhash.one_of_each(docs, percent=80), "left_semi").dropDuplicates(["doc_id", "_mark"]).drop("_mark")


def free_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which tiles cover less than the threshold of every benchmark item."""
    found = decontaminate.contaminated(docs, tables(spark, sf_dir, "benchmark")).where("contaminated")
    return _only(docs, found.select("doc_id", "mark").distinct(), "left_anti").drop("_mark")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents by source to their target weights, copies as rows of their own."""
    return mix.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Index of the token files: ``doc_id, start, n_tokens, ids_crc32``, a row for each copy."""
    return tokens.read_documents(tokens.write_ids(docs))


def _only(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    marked = docs.withColumn("_mark", F.xxhash64(text_bytes("text")))
    rows = rows.select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_of"))
    return marked.join(rows, F.expr("doc_id <=> _doc and _mark = _of"), how)


STAGES = [
    ("quality_classifier", good_quality),
    ("minhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", free_of_benchmarks),
    ("source_mixing", mixed_sources),
    ("token_ids", token_files),
]

#: The stages learn, sample and tokenize: not expressible in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
