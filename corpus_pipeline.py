"""The training-data pipeline: toxic documents go, repeated lines go, one of each group of near copies stays, documents
with benchmark passages go, and the rest is encoded. ``run`` applies the stages to the whole of ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runscope.llm import byte_bpe, decontam, line_dedup, simhash, toxicity
from runscope.llm.common import cut, fold
from runscope.llm.queries import vocabulary_file
from runscope.sources.tables import read_table


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that score 0.5 or more go. Labels outside the learning fold are never read."""
    learn = fold(F.col("doc_id"), 5) != 0
    model = toxicity.fit(toxicity.training_sample(docs, read_table(spark, sf_dir, "labels"), learn))
    return toxicity.drop_toxic(docs, model)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: lines that repeat an earlier one, or differ from it by one edit, go; every document stays."""
    return line_dedup.dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the document of the smallest doc_id of each group stays."""
    return simhash.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a window of a benchmark item go."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the token ids of each document that is left, and digests of them and of the decoded bytes."""
    return byte_bpe.encode_decode(docs, vocabulary_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxic_documents), ("line_dedup", repeated_lines), ("simhash_near_dedup", near_copies),
          ("benchmark_decontamination", benchmark_passages), ("byte_level_bpe", encoded)]

#: The trained classifier and the tokenizer can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
