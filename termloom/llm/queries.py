"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import alignment, bytepair, ctw, decontaminate, hardneg, licenses, neardup
from termloom.llm import packing, pii, ranking, rules, substrings, tokenfile
from termloom.llm.common import ROW, read_table
from termloom.session import shared_folder


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = pii.find_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = list(pii.BASE_PATTERNS)
    return found.select(
        F.col(ROW).getField("doc_id").alias("doc_id"),
        *[
            F.size(pii.of_kinds(F.col("spans"), [k])).cast("long").alias(f"n_{k}")
            for k in kinds
        ],
        F.sha2(pii.spans_text(pii.of_kinds(F.col("spans"), kinds)), 256).alias("base_sha256"),
        pii.spans_text(F.col("spans")).alias("spans"),
    )


def op2_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document; a fifth of the keys is kept out of training."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(False))
    return ctw.scores(docs, ~held_out).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score",
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into sequences of power-of-two lengths up to 1024."""
    return packing.pack(read_table(spark, sf_dir, "documents")).drop("ids")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document that stand in another document too."""
    return substrings.repeated_passages(read_table(spark, sf_dir, "documents"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    slim = rules.judge(docs, labels, carry=["doc_id", "lang"])
    return slim.select(
        F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept",
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    found = decontaminate.contamination(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    found = licenses.scan(read_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select(
        F.col(ROW)["doc_id"].alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; a quarter of the keys is kept out of the fit."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = ranking.fit(docs, read_table(spark, sf_dir, "labels").where(~held_out))
    scored = ranking.score(docs, model, carry=["doc_id"])
    return scored.select(F.col(ROW)["doc_id"].alias("doc_id"), "score").select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicates of every document."""
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as shards with a key index and read back."""
    path = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    tokenfile.write(read_table(spark, sf_dir, "documents"), path)
    return tokenfile.read(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op11_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh has the next label."""
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers aligned in every document, with counts over all documents."""
    return alignment.align(read_table(spark, sf_dir, "documents")).documents


def op13_bytepair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the bytes that they decode to."""
    decoded = bytepair.decode(bytepair.encode(read_table(spark, sf_dir, "documents")))
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_pii": op1_pii,
    "op2_ctw": op2_ctw,
    "op3_packing": op3_packing,
    "op4_substrings": op4_substrings,
    "op5_decontaminate": op5_decontaminate,
    "op6_licenses": op6_licenses,
    "op7_quality": op7_quality,
    "op8_neardup": op8_neardup,
    "op9_rules": op9_rules,
    "op10_tokenfile": op10_tokenfile,
    "op11_hardneg": op11_hardneg,
    "op12_alignment": op12_alignment,
    "op13_bytepair": op13_bytepair,
}
