"""Document scans: JSON lines, or any table that has the columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from termloom.functions.text import featured_text

# class is read as double and cut to int, so 1, 1.0 and a long all work
DOCUMENT_SCHEMA = "doc_id string, extracted_text string, class double, cluster_id string"
CORRUPT_COLUMN = "_corrupt_record"


def read_documents(
    spark: SparkSession, paths: str | Sequence[str], permissive: bool = False
) -> DataFrame:
    """``(doc_id, cluster_id, label, extracted_text)`` from one or more JSONL paths.

    A malformed line or a missing cluster id fails the job.  With ``permissive``
    malformed lines are kept in ``_corrupt_record`` instead.
    """
    schema = DOCUMENT_SCHEMA
    reader = spark.read.option("mode", "FAILFAST")
    if permissive:
        schema += f", {CORRUPT_COLUMN} string"
        reader = spark.read.option("mode", "PERMISSIVE").option(
            "columnNameOfCorruptRecord", CORRUPT_COLUMN
        )
    scan = reader.schema(schema).json(paths if isinstance(paths, str) else list(paths))
    return _documents_of(scan, permissive)


def _documents_of(scan: DataFrame, permissive: bool = False) -> DataFrame:
    cluster_id = F.col("cluster_id")
    if not permissive:
        cluster_id = F.coalesce(
            cluster_id, F.raise_error(F.lit("document without cluster_id")).cast("string")
        )
    extra = [CORRUPT_COLUMN] if permissive else []
    return scan.select(
        "doc_id",
        cluster_id.alias("cluster_id"),
        F.col("class").cast("int").alias("label"),
        featured_text("extracted_text").alias("extracted_text"),
        *extra,
    )


def as_documents(
    table: DataFrame,
    text: str,
    cluster_id: Column | str,
    label: Column | None = None,
    doc_id: str | None = None,
) -> DataFrame:
    """Any table as documents."""
    cluster = F.col(cluster_id) if isinstance(cluster_id, str) else cluster_id
    columns = [
        cluster.cast("string").alias("cluster_id"),
        (F.lit(None) if label is None else label).cast("int").alias("label"),
        featured_text(text).alias("extracted_text"),
    ]
    if doc_id:
        columns.insert(0, F.col(doc_id))
    return table.select(*columns)


def label_and_prefix(documents: DataFrame, label: int, prefix: str) -> DataFrame:
    """Give one class's corpus its label, and ids that cannot meet the other's."""
    return documents.withColumn("label", F.lit(label)).withColumn(
        "cluster_id", F.concat(F.lit(prefix), F.col("cluster_id"))
    )


def merge_classes(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Both classes in one corpus, repeats kept."""
    return label_and_prefix(positive, 1, "p").unionByName(
        label_and_prefix(negative, 0, "n")
    )


def write_class(
    documents: DataFrame, path: str, label: int, prefix: str
) -> None:
    """One class's corpus as its part of a table by label; written again, it replaces itself.

    Other classes' parts stay, so the classes can be added in any order and more than once.
    """
    marked = label_and_prefix(documents, label, prefix)
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "label"
    ).parquet(path)


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """The corpus of all classes that :func:`write_class` has put there."""
    table = spark.read.parquet(path)
    return table.withColumn("label", F.col("label").cast("int"))


def read_or_set_aside(
    spark: SparkSession,
    paths: str | Sequence[str],
    aside: str,
    most_malformed: int = 0,
    mode: str = "error",
) -> tuple[DataFrame, int]:
    """Documents, and how many malformed lines were written to ``aside``.

    ``aside`` gets ``(file, block_start, line)`` of every malformed line.  More than
    ``most_malformed`` fail the job, after they have been written.
    """
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.col("value").alias("line"),
        F.from_json(
            "value",
            f"{DOCUMENT_SCHEMA}, {CORRUPT_COLUMN} string",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COLUMN},
        ).alias("_document"),
    )
    broken = F.col("_document").isNull() | F.col("_document")[CORRUPT_COLUMN].isNotNull()
    lines = lines.where(F.trim("line") != "")
    seen = Observation()
    malformed = lines.where(broken).select("file", "block_start", "line")
    malformed.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).json(aside)
    n = seen.get["n"]
    if n > most_malformed:
        raise ValueError(f"{n} malformed lines, see {aside}")
    fields = lines.where(~broken).select("_document.*")
    return _documents_of(fields.drop(CORRUPT_COLUMN)), n
