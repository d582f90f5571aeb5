"""A corpus pipeline of five stages, each of which works on all rows that the one before it kept.

All stages take nulls in any column, empty and very long texts, repeated rows and empty tables, and all but the last return every
column of their input as it is, whatever its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opalgrid.llm import exact_dedup, mixing, near_dup, packing, quality
from opalgrid.llm.store import finished, read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled ones, doesn't reject.

    Null and empty texts have the score of the classifier's bias; long ones are scored whole; equal texts stay or go together, repeated rows too. Without
    labels nothing is rejected; without documents nothing comes out.
    """
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts, the row with the largest doc_id.

    Null counts as the empty text, of which one row stays. A null id stays only where all ids of its text are null. Of rows that repeat
    id and text that stays whose other columns have the least hash. Long texts are compared whole. An empty table stays empty.
    """
    return exact_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the row with the smallest doc_id.

    Null and empty texts have no words and all stay, and so do rows without an id. Rows that repeat an id are one document: if it is kept, all stay. Long
    texts are compared whole. An empty table stays empty.
    """
    return near_dup.without_near_duplicates(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of all sources in target proportions; a document comes as often as the mix takes it, three times at most.

    Null and empty texts have no words; null is a source of its own. Rows without an id and repeated rows are drawn one by one. A long text is taken whole or
    not at all. An empty table stays empty.
    """
    return mixing.mixed(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences.

    Null and empty texts are the end token alone; long ones are cut into pieces; repeated rows, and rows without an id, are packed one by one. Other columns
    are left out. An empty table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]

#: SQL can express neither the trained classifier nor the packer: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of each is written and read again as the next one's input.

    Of a stage only its result is left in the shared folder.
    """
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = finished(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
