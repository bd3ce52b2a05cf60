"""Corpus pipeline: toxicity, line dedup, near-duplicates, mixing and packing, each over all that the stage before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents, the last one the packed pieces.
``run`` writes each stage to the shared folder and reads it back, so a lost executor costs a re-read of one stage; what a stage wrote for itself is deleted then, and so is its input.

Defined results of all stages: a null or empty text is kept (its lines, shingles and words are none, and it packs as the closing id alone; mixing emits it as often as its source's
other documents); null doc_id, lang and source and very long texts pass like others; repeated rows are kept up to the near-duplicate stage, where equal ones with words leave one; ties go to the smallest
doc_id; an empty table gives an empty one; columns beside those of documents are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwatch.llm import line_dedup, minhash, mixing, packing, toxicity
from tarnwatch.llm.common import drop_table, stored, table


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on every label and drops the documents that the model calls toxic."""
    return toxicity.drop_toxic(docs, toxicity.train_toxicity(docs, table(spark, sf_dir, "labels")))


def repeated_lines_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(docs)


def near_duplicates_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 0.8 of their five-word shingles, the one with the smallest doc_id stays."""
    return minhash.keep_first(docs, width=5, percent=80)


def sources_get_their_shares(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def documents_fill_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("line_dedup", repeated_lines_go),
    ("near_duplicates", near_duplicates_go),
    ("mixing", sources_get_their_shares),
    ("packing", documents_fill_sequences),
]
#: The trained stage and the packing have no SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_table(before)  # the documents themselves are no such table
    return STAGES[-1][1](spark, docs, sf_dir)
