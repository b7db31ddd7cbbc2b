"""A corpus from raw documents: quality rules, line dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written and read
again as the next one's docs. All but the last give the columns of documents.

Defined results, of every stage: an empty table gives an empty one; null texts count as empty ones and
null doc_ids and sources as values of their own; whole texts are read; columns that a stage doesn't
change pass through, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import delete, shared_folder
from graphloom.llm.lines import without_repeated_lines
from graphloom.llm.mixing import materialize, mix_sources
from graphloom.llm.packing import pack_documents
from graphloom.llm.quality import keep_good
from graphloom.llm.shingles import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, each judged by its own text; null and empty texts fail."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without the lines that others repeat; n_chars follows the text. A line stays in the largest doc_id that holds it."""
    return without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, that of the smallest doc_id; of rows equal in doc_id and text, one."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (none to three times), shard by shard. Rows of an equal doc_id are taken together."""
    return materialize(docs, mix_sources(docs.select("doc_id", "text", "source")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece and its place in a sequence; repeated rows are packed one by one."""
    return pack_documents(docs, kept=60_000)  # the other stages' memory is still held


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Tokens, word-level near duplicates and the mix's draws have no SQL; tests/llm/test_pipeline.py holds each stage's rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
