"""Documents to annotated sentences, token tables and term bags.

A document stays one row throughout, so none of these operators shuffles;
per-document term counts come from sorting the terms inside the row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from termloom.functions import text as tx

Annotator = Callable[[DataFrame], DataFrame]


def annotate(
    documents: DataFrame,
    text_column: str = "extracted_text",
    pos_rule: tx.Rule = tx.rule_pos_tag,
    ner_rule: tx.Rule = tx.no_ner,
) -> DataFrame:
    """Replace the text column by ``sentences``, using column-expression rules."""
    return documents.withColumn(
        "sentences", tx.annotate_text(text_column, pos_rule, ner_rule)
    ).drop(text_column)


def annotate_with(
    documents: DataFrame,
    make_annotator: Callable[[], Callable[[str], list[list[dict]]]],
    text_column: str = "extracted_text",
) -> DataFrame:
    """Annotate with a Python library.

    ``make_annotator`` is called once per task and returns a function from text to
    sentences, each a list of dicts with ``token, lemma, pos_tag, ner``.  Documents
    stream through in Arrow batches.
    """
    kept = [field for field in documents.schema if field.name != text_column]
    schema = StructType(
        [*kept, StructField("sentences", _sentences_type(documents), True)]
    )
    names = [field.name for field in kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        annotator = make_annotator()
        for batch in batches:
            out = batch[names].copy()
            out["sentences"] = [annotator(text or "") for text in batch[text_column]]
            yield out

    annotated = documents.mapInPandas(run, schema)
    # lemmas may not hold the two marks the phrase expression uses
    return annotated.withColumn(
        "sentences",
        F.transform(
            "sentences",
            lambda sentence: F.transform(
                sentence,
                lambda token: token.withField(
                    "lemma", F.translate(F.lower(token["lemma"]), "\u0001\u0002", "")
                ),
            ),
        ),
    )


def generalize_entities(
    annotated: DataFrame, mapping: Mapping[str, str] = tx.ENTITY_TERMS
) -> DataFrame:
    return annotated.withColumn("sentences", tx.generalize("sentences", mapping))


def token_table(annotated: DataFrame) -> DataFrame:
    """One row per token: ``sent_id, pos, token, lemma, pos_tag, ner``."""
    keys = [name for name in annotated.columns if name != "sentences"]
    sentences = annotated.select(
        *keys, F.posexplode_outer("sentences").alias("sent_id", "sentence")
    )
    tokens = sentences.select(
        *keys, "sent_id", F.posexplode_outer("sentence").alias("pos", "t")
    )
    return tokens.where(F.col("pos").isNotNull()).select(*keys, "sent_id", "pos", "t.*")


def from_token_table(tokens: DataFrame, *keys: str) -> DataFrame:
    """Annotated documents from a token table that was tagged elsewhere.

    ``keys`` identify a document.  The groups are one sentence, then one document.
    """
    sentence = (
        tokens.groupBy(*keys, "sent_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "token", "lemma", "pos_tag", "ner")))
             .alias("tokens"))
        .select(
            *keys,
            "sent_id",
            F.transform(
                "tokens",
                lambda t: F.struct(
                    t["token"].alias("token"),
                    F.translate(F.lower(t["lemma"]), "\u0001\u0002", "").alias("lemma"),
                    t["pos_tag"].alias("pos_tag"),
                    t["ner"].alias("ner"),
                ),
            ).alias("sentence"),
        )
    )
    return (
        sentence.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("sent_id", "sentence"))).alias("s"))
        .select(*keys, F.transform("s", lambda s: s["sentence"]).alias("sentences"))
    )


def document_terms(
    annotated: DataFrame,
    ngrams: str | None = "prefix",
    flush_tail: bool = False,
    max_n: int = tx.MAX_NGRAM,
    unigrams: bool = True,
) -> DataFrame:
    """Replace ``sentences`` by ``terms``: unigrams and phrase n-grams, repeats kept."""
    with_phrases = annotated
    parts = []
    if unigrams:
        parts.append(tx.unigrams("sentences"))
    if ngrams:
        with_phrases = annotated.withColumn("_phrases", tx.phrases("sentences", flush_tail))
        parts.append(tx.phrase_ngrams("_phrases", ngrams, max_n))
    if not parts:
        raise ValueError("neither unigrams nor n-grams requested")
    terms = F.concat(*parts) if len(parts) > 1 else parts[0]
    return with_phrases.withColumn("terms", terms).drop("sentences", "_phrases")


def term_bags(documents: DataFrame) -> DataFrame:
    """Replace ``terms`` by ``bag``: each distinct term of the document with its count.

    Done inside the row by sorting, so no shuffle and no row id is needed.
    """
    return (
        documents.withColumn("_sorted", F.sort_array("terms"))
        .withColumn("_starts", tx.run_starts("_sorted"))
        .withColumn("bag", tx.sorted_runs("_sorted", "_starts"))
        .drop("terms", "_sorted", "_starts")
    )


def phrase_table(annotated: DataFrame, flush_tail: bool = False) -> DataFrame:
    """One row per phrase: its words joined by a blank, and their number."""
    keys = [name for name in annotated.columns if name != "sentences"]
    exploded = annotated.withColumn("_phrases", tx.phrases("sentences", flush_tail)).select(
        *keys, F.explode_outer("_phrases").alias("words")
    )
    return exploded.where(F.col("words").isNotNull()).select(
        *keys,
        F.array_join("words", " ").alias("phrase"),
        F.size("words").alias("n_words"),
    )


def _sentences_type(documents: DataFrame):
    empty = documents.sparkSession.range(0).select(
        F.lit(None).cast(tx.SENTENCES_TYPE).alias("sentences")
    )
    return empty.schema["sentences"].dataType
