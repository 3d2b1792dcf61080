"""The jobs a user runs: build a dictionary, vectorise a corpus."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from termloom.functions import text as tx
from termloom.operators import annotate as an
from termloom.operators import dictionary as dc
from termloom.operators import evaluate as ev
from termloom.operators import svm
from termloom.operators import vectors as vc
from termloom.session import materialize, spread

# Entries of a row of a model vector at most; longer vectors are cut by so many indices.
SEGMENT_SIZE = 1_000_000


@dataclass(frozen=True)
class TermOptions:
    """How documents become terms; a model needs the same options throughout."""

    ngrams: str | None = "prefix"
    max_n: int = tx.MAX_NGRAM
    flush_tail: bool = False
    generalize: bool = False
    entities: Mapping[str, str] | None = None
    annotator: an.Annotator = an.annotate


def corpus_terms(documents: DataFrame, options: TermOptions = TermOptions()) -> DataFrame:
    """Documents with an array of their terms."""
    annotated = options.annotator(documents)
    if options.generalize:
        annotated = an.generalize_entities(annotated, options.entities or tx.ENTITY_TERMS)
    return an.document_terms(annotated, options.ngrams, options.flush_tail, options.max_n)


def corpus_bags(documents: DataFrame, options: TermOptions = TermOptions()) -> DataFrame:
    """Documents with their term counts, written once for all later steps."""
    return materialize(an.term_bags(corpus_terms(documents, options)))


def build_dictionary(
    bags: DataFrame, max_terms: int | None = None
) -> DataFrame:
    """The frequency-ordered dictionary of a corpus, optionally only its head."""
    dictionary = dc.build_dictionary(dc.term_counts(bags))
    return dictionary if max_terms is None else dc.cap(dictionary, max_terms)


def vectorize(
    bags: DataFrame,
    dictionary: DataFrame,
    merge: str = "max",
    unique: bool = True,
    complete: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Cluster table and vector entries of a corpus against a given dictionary.

    A dictionary that this library numbered lists no term twice; for one from elsewhere say
    ``unique=False``, and the last index of a term counts.  ``complete`` says that it was made
    of these bags and not capped, see :func:`~termloom.operators.vectors.cluster_entries`.
    """
    entries = vc.cluster_entries(bags, dictionary, merge, unique=unique, complete=complete)
    return vc.clusters(bags, mark_bare=complete), entries


def model_vectors(
    bags: DataFrame,
    dictionary: DataFrame,
    merge: str = "max",
    segment_size: int = SEGMENT_SIZE,
    complete: bool = False,
) -> DataFrame:
    """The sparse vector of each cluster in bounded rows, written once for training."""
    vectors = vc.assemble(
        *vectorize(bags, dictionary, merge, complete=complete), segment_size, vc.long_clusters(bags, segment_size)
    )
    return spread(materialize(vectors), "cluster_id", "segment")


@dataclass(frozen=True)
class Evaluation:
    """Tables that describe a model on labelled clusters."""

    scored: DataFrame
    confusion: DataFrame
    errors: DataFrame
    roc: DataFrame
    auc: DataFrame


def evaluate(model: svm.SvmModel, vectors: DataFrame) -> Evaluation:
    """Score labelled vectors once and derive all reports from that table."""
    scored = materialize(svm.score(vectors, model))
    truth, scores = svm.evaluation_records(scored)
    aligned = ev.align(truth, scores)
    return Evaluation(
        scored=scored,
        confusion=ev.confusion_matrix(scored, labels=(0, 1), actual="label"),
        errors=ev.error_rate(scored, actual="label"),
        roc=ev.roc_curve(aligned),
        auc=ev.roc_auc(aligned),
    )
