"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on everything the stage before it kept.
All but the last return the columns of ``docs``, whatever they are; the last returns the
packed pieces.  Between stages the table is written and read again, so a lost executor
repeats a stage's tasks at most; a stage's own tables and its input are removed when its
output is there.

Defined results: a null or empty text has no words and fails the base rule, so it goes in the
first stage; texts of any length are judged whole; of rows that repeat each other, key included,
one stays; a null key is a key like any other, a null language the stratum ''; further columns, also
with the names that the operators use inside, come through unchanged; an empty table gives no
pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import decontaminate, neardup, packing, pii, rules
from termloom.llm.common import read_table
from termloom.session import discard, materialize, run_scope

#: The chain of trained and exact decisions has no SQL form.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the certified cutoffs do not reject."""
    return rules.accepted(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component; documents without words are all kept."""
    return neardup.representatives(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in the benchmark."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by marks."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths with their ids."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_free),
    ("pii", private_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; the pieces without their ids."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with run_scope(spark):
            docs = materialize(stage(spark, docs, sf_dir), keep=True)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir).drop("ids")
