"""Term-count vectors per document and per cluster, in long form and assembled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.operators.dictionary import (
    exploded_bags,
    fits_broadcast,
    keyed,
    lookup,
    membership,
    perhaps_known,
    reverse_dictionary,
    split_head,
    term_key,
)
from termloom.session import materialize, sized

_MERGES = {
    "max": lambda: F.max("n").cast("double"),
    "sum": lambda: F.sum("n").cast("double"),
}


def doc_term_vectors(
    bags: DataFrame,
    dictionary: DataFrame,
    row_id: str,
    unique: bool = False,
    complete: bool = False,
) -> DataFrame:
    """``(row_id, idx, value)``: how often a document holds each dictionary term.

    ``unique`` says that the dictionary lists no term twice, ``complete`` that it was made of these bags.
    """
    entries = lookup(exploded_bags(bags, row_id), dictionary, unique=unique, complete=complete)
    return entries.select(row_id, "idx", F.col("n").cast("double").alias("value"))


# Column of a cluster table that tells whether no document of the cluster has a term.
BARE = "_bare"


def clusters(bags: DataFrame, mark_bare: bool = False) -> DataFrame:
    """One row per cluster: the smallest label and the number of documents.

    With ``mark_bare`` also the column ``BARE``, for :func:`cluster_vectors` and :func:`assemble`.
    """
    counted = [F.min("label").alias("label"), F.count(F.lit(1)).alias("n_docs")]
    if mark_bare:
        holds = F.exists("bag", lambda entry: entry["term"].isNotNull())
        counted.append((~F.max(F.coalesce(holds, F.lit(False)))).alias(BARE))
    return bags.groupBy("cluster_id").agg(*counted)


def _met(cluster_table: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cluster table, entries, and the clusters without entries.

    Where the table does not mark these the entries are read twice, so they are merged once and
    written.
    """
    table = sized(materialize(cluster_table), "cluster_id")
    if BARE in cluster_table.columns:
        bare = table.where(F.col(BARE) | F.col("cluster_id").isNull()).drop(BARE)
        return table.drop(BARE), entries, bare
    entries = materialize(entries)
    return table, entries, table.join(entries.select("cluster_id").distinct(), "cluster_id", "left_anti")


def label_conflicts(documents: DataFrame) -> DataFrame:
    """Clusters whose documents disagree on the label."""
    return (
        documents.groupBy("cluster_id")
        .agg(
            F.min("label").alias("min_label"),
            F.max("label").alias("max_label"),
            F.count("label").alias("n_labelled"),
        )
        .where(F.col("min_label") != F.col("max_label"))
    )


def cluster_entries(
    bags: DataFrame,
    dictionary: DataFrame,
    merge: str = "max",
    small_dictionary: bool | None = None,
    unique: bool = False,
    complete: bool = False,
) -> DataFrame:
    """``(cluster_id, idx, value)`` merged over the documents of each cluster.

    ``merge``: ``max`` per dimension, ``sum``, or ``avg`` (sum over the number of
    documents).  The groups are (cluster, term), so one huge cluster still spreads
    over all tasks, and each task combines its rows before the shuffle.

    A small dictionary is joined first, which drops unknown terms and shuffles
    integers.  With a large one this is done for its frequent head only; of the other
    entries a membership filter drops nearly all unknown terms before anything is
    shuffled, what is left is dealt by term once, merged by (cluster, term) where it lies, and
    meets the rest of the dictionary there.  Of a term listed twice the last index counts;
    ``unique`` says that there is none.  ``complete`` says that the dictionary was made of these
    bags and lists all their terms: there is nothing to drop, no filter is made, and entries and
    dictionary are dealt and joined by a short key of the term instead of the term itself.
    """
    small = fits_broadcast(dictionary) if small_dictionary is None else small_dictionary
    entries = exploded_bags(bags, "cluster_id")
    combine = _MERGES["sum" if merge == "avg" else merge]().alias("value")
    if small:
        known = lookup(entries, dictionary, small=True, unique=unique)
        merged = known.groupBy("cluster_id", "idx").agg(combine)
    else:
        table = dictionary if unique else reverse_dictionary(dictionary)
        hot, cold, tail = split_head(entries, table)
        frequent = hot.groupBy("cluster_id", "idx").agg(combine)
        # dealt by term alone, the merge and the join need one shuffle; no term is hot here
        if complete:
            keys, tail = ["_key", "_check"], keyed(tail)
            cold = cold.select("cluster_id", *term_key(), "n")
        else:
            keys, cold = ["term"], perhaps_known(cold, membership(tail))
        rare = cold.repartition(*keys).groupBy("cluster_id", *keys).agg(combine)
        merged = frequent.unionByName(
            rare.join(tail, keys).select("cluster_id", "idx", "value")
        )
    if merge == "avg":
        sizes = clusters(bags).select("cluster_id", "n_docs")
        merged = merged.join(sizes, "cluster_id").select(
            "cluster_id", "idx", (F.col("value") / F.col("n_docs")).alias("value")
        )
    return merged


def cluster_vectors(cluster_table: DataFrame, entries: DataFrame) -> DataFrame:
    """Long form with every cluster; one without a known term has a null ``idx``.

    The entries meet the cluster table in an inner join, which broadcasts a small table or
    splits a hot cluster; clusters without entries are added apart.
    """
    cluster_table, entries, bare = _met(cluster_table, entries)
    columns = ["cluster_id", *[c for c in cluster_table.columns if c != "cluster_id"]]
    columns += [c for c in entries.columns if c != "cluster_id"]
    found = entries.join(cluster_table, "cluster_id").select(*columns)
    missing = [
        F.lit(None).cast(entries.schema[c].dataType).alias(c)
        for c in entries.columns
        if c != "cluster_id"
    ]
    return found.unionByName(
        bare.select(*[c for c in columns if c in cluster_table.columns], *missing)
    )


def long_clusters(bags: DataFrame, most: int) -> DataFrame:
    """Clusters that may have more than ``most`` entries: their bags hold more terms in all."""
    terms = F.sum(F.greatest(F.size("bag"), F.lit(0)))
    return bags.groupBy("cluster_id").agg(terms.alias("n")).where(F.col("n") > most).select("cluster_id")


def assemble(
    cluster_table: DataFrame,
    entries: DataFrame,
    segment_size: int | None = None,
    cut: DataFrame | None = None,
) -> DataFrame:
    """One row per cluster with ``entries``, an array of ``(idx, value)`` by index.

    A vector holds each term at most once, so its length is bounded by the
    dictionary however many documents the cluster has.  Where the dictionary is too
    large for one row, ``segment_size`` cuts each vector into rows of so many
    indices, numbered by ``segment``; the classifier takes either form.  With ``cut``, from
    :func:`long_clusters`, only these clusters are cut: the rare terms of a short vector lie all
    over a large dictionary, and a row for each of its segments would hold an entry or two.
    """
    cluster_table, entries, bare = _met(cluster_table, entries)
    keys = ["cluster_id"]
    if segment_size:
        segment = F.floor(F.col("idx") / segment_size)
        if cut is not None:
            # each holds more than a segment's number of terms, so there are few
            marked = F.broadcast(cut.select(F.col("cluster_id").alias("_cut"), F.lit(True).alias("_long")))
            entries = entries.join(marked, F.col("cluster_id").eqNullSafe(F.col("_cut")), "left")
            segment = F.when(F.col("_long"), segment).otherwise(F.lit(0).cast("bigint"))
        entries = entries.select("cluster_id", "idx", "value", segment.alias("segment"))
        keys.append("segment")
    vectors = entries.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col("idx"), F.col("value")))).alias("entries")
    )
    columns = ["cluster_id", *[c for c in cluster_table.columns if c != "cluster_id"], *keys[1:]]
    # an inner join leaves the rows where they are; in an outer one they would meet by cluster
    found = vectors.join(cluster_table, "cluster_id").select(*columns, "entries")
    empty = F.array().cast("array<struct<idx:bigint,value:double>>").alias("entries")
    none = [F.lit(0).cast("bigint").alias(key) for key in keys[1:]]
    return found.unionByName(bare.select(*columns[: len(columns) - len(none)], *none, empty))


def explain_vector(entries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Put the terms back beside the indices.

    The entries meet the head of a large dictionary and the rest, so they are merged once and
    written.
    """
    return lookup(materialize(entries), dictionary, key="idx")


def max_feature_index(entries: DataFrame) -> DataFrame:
    """Largest index used and the default gamma: 1/index, or 0 without one."""
    largest = F.coalesce(F.max("idx"), F.lit(0))
    return entries.agg(
        largest.cast("bigint").alias("max_index"),
        F.when(largest > 0, F.lit(1.0) / largest).otherwise(F.lit(0.0)).alias("gamma"),
    )


def class_distribution(vectors: DataFrame, label: Column | str = "label") -> DataFrame:
    column = F.col(label) if isinstance(label, str) else label
    return vectors.groupBy(column.alias("label")).agg(F.count(F.lit(1)).alias("n"))
