"""Term counts and the frequency-ordered dictionary ``(idx, term, n)``.

Generators are the outer kind on purpose: for the inner kind the optimizer infers
a "not empty" filter and pushes a second copy of the whole text expression below
the generator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.operators.ordering import with_dense_index
from termloom.session import BROADCAST_LIMIT_BYTES

# Rows of the most frequent dictionary head that are joined by broadcast when the
# whole dictionary is too large, and the bytes that their terms may have in all.
HEAD_ROWS = 10_000
HEAD_BYTES = 10_000_000

# Terms that share a 64-bit word of the membership filter, the bits that each sets in it, and
# the cost of a word in a broadcast.
TERMS_PER_WORD = 6
BITS_PER_TERM = 4
WORD_BYTES = 48


def term_counts(documents: DataFrame) -> DataFrame:
    """Occurrences per term, from ``terms`` or ``bag`` documents."""
    if "bag" in documents.columns:
        return _by_term(documents).agg(F.sum("n").alias("n"))
    terms = documents.select(F.explode_outer("terms").alias("term"))
    return terms.where(F.col("term").isNotNull()).groupBy("term").agg(
        F.count(F.lit(1)).alias("n")
    )


def document_frequency(bags: DataFrame) -> DataFrame:
    """Number of documents a term occurs in."""
    return _by_term(bags).agg(F.count(F.lit(1)).alias("n_docs"))


def vocabulary(documents: DataFrame) -> DataFrame:
    return (
        documents.select(F.explode_outer("terms").alias("term"))
        .where(F.col("term").isNotNull())
        .distinct()
    )


def exploded_bags(bags: DataFrame, *keys: str) -> DataFrame:
    """One row per document and distinct term."""
    return bags.select(*keys, F.inline_outer("bag")).where(F.col("term").isNotNull())


def build_dictionary(counts: DataFrame) -> DataFrame:
    """Number the terms by falling count, ties by term; written to the shared folder."""
    return with_dense_index(counts, F.desc("n"), F.asc("term")).select("idx", "term", "n")


def top_k(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent terms with their index, for a ``k`` that fits one task."""
    ranked = Window.orderBy(F.desc("n"), F.asc("term"))
    return (
        counts.orderBy(F.desc("n"), F.asc("term"))
        .limit(k)
        .select(
            (F.row_number().over(ranked) - 1).cast("bigint").alias("idx"), "term", "n"
        )
    )


def cap(dictionary: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent terms of a numbered dictionary, any ``k``."""
    return dictionary.where(F.col("idx") < k)


def term_count_lines(counts: DataFrame) -> DataFrame:
    """``term``, two tabs, count."""
    return counts.select(
        F.concat_ws("\t\t", "term", F.col("n").cast("string")).alias("line")
    )


def reverse_dictionary(dictionary: DataFrame) -> DataFrame:
    """Term to index; of a term listed twice the last index counts."""
    return dictionary.groupBy("term").agg(F.max("idx").alias("idx"))


def dictionary_bytes(dictionary: DataFrame) -> int:
    """Measured size: term bytes plus a fixed cost per row."""
    row = dictionary.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term")).alias("b")
    ).first()
    return int(row["b"] or 0) + 64 * row["n"]


def fits_broadcast(dictionary: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> bool:
    return dictionary_bytes(dictionary) <= limit


def split_head(
    entries: DataFrame, dictionary: DataFrame, key: str = "term"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(hot, cold, tail)``: entries joined to the head of a large dictionary, the
    other entries, and the rest of the dictionary.

    The head is the bounded number of most frequent rows, the only keys that can be
    hot: the term at rank r holds at most 1/r of all occurrences.  It goes out by
    broadcast; what is left can be shuffled by key without skew.  Very long terms make
    the head shorter and never drop a frequent term out of its middle.
    """
    table = dictionary.select("idx", "term")
    in_head = F.col("idx") < head_rows(table)
    head = table.where(in_head)
    hot = entries.join(F.broadcast(head), key)
    cold = entries.join(F.broadcast(head.select(key)), key, "left_anti")
    return hot, cold, table.where(~in_head)


def head_rows(dictionary: DataFrame) -> int:
    """The largest of ``HEAD_ROWS`` and its halves whose terms fit ``HEAD_BYTES``."""
    steps = [HEAD_ROWS >> i for i in range(HEAD_ROWS.bit_length())]
    sizes = dictionary.where(F.col("idx") < HEAD_ROWS).agg(
        *[
            F.sum(F.when(F.col("idx") < k, F.octet_length("term"))).alias(str(k))
            for k in steps
        ]
    ).first()
    return next((k for k in steps if (sizes[str(k)] or 0) <= HEAD_BYTES), 0)


def _word(term: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(words).cast("bigint"))


def _mask(term: Column) -> Column:
    """The bits that a term sets in its word, from a second hash."""
    other = F.xxhash64(term, F.lit("bits"))
    bits = [
        F.call_function(
            "shiftleft", F.lit(1).cast("bigint"),
            F.shiftrightunsigned(other, 6 * i).bitwiseAND(F.lit(63)).cast("int"),
        )
        for i in range(BITS_PER_TERM)
    ]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return mask


def membership(
    dictionary: DataFrame, limit: int = BROADCAST_LIMIT_BYTES
) -> tuple[DataFrame, int] | None:
    """A Bloom filter of the terms as rows ``(word, bits)``, and its number of words.

    Every term sets a few bits of one 64-bit word (Putze, Sanders and Singler 2007), so a probe
    is one lookup.  Made by an aggregate; None where it would be larger than ``limit``.
    """
    n = dictionary.count()
    words = max(1, -(-n // TERMS_PER_WORD))
    if words * WORD_BYTES > limit:
        return None
    filled = dictionary.groupBy(_word(F.col("term"), words).alias("word")).agg(
        F.bit_or(_mask(F.col("term"))).alias("bits")
    )
    return filled, words


def perhaps_known(entries: DataFrame, filter_: tuple[DataFrame, int] | None) -> DataFrame:
    """Entries without most of those whose term is not in the dictionary; no known one is lost."""
    if filter_ is None:
        return entries
    table, words = filter_
    mask = _mask(F.col("term"))
    return (
        entries.withColumn("_word", _word(F.col("term"), words))
        .join(F.broadcast(table.withColumnsRenamed({"word": "_word", "bits": "_bits"})), "_word")
        .where(F.col("_bits").bitwiseAND(mask) == mask)
        .drop("_word", "_bits")
    )


def term_key(term: str = "term") -> list[Column]:
    """Two hashes of a term, 96 bits in all, that stand for it where rows are dealt by term."""
    return [F.xxhash64(term).alias("_key"), F.hash(term).alias("_check")]


def keyed(dictionary: DataFrame) -> DataFrame:
    """``(_key, _check, idx)`` of a dictionary that lists no term twice.

    Two terms with the same key fail the job; at a thousand million terms one run in 10 ** 11 does.
    """
    rows = dictionary.select(*term_key(), "idx").repartition("_key", "_check")
    clash = F.raise_error(F.lit("two terms have the same key")).cast("bigint")
    idx = F.when(F.count(F.lit(1)) > 1, clash).otherwise(F.max("idx"))
    return rows.groupBy("_key", "_check").agg(idx.alias("idx"))


def lookup(
    entries: DataFrame,
    dictionary: DataFrame,
    key: str = "term",
    small: bool | None = None,
    unique: bool = False,
    complete: bool = False,
) -> DataFrame:
    """Inner join of entries to a dictionary on ``term`` or ``idx``.

    A dictionary of a checked size is broadcast; a larger one is joined in two parts,
    see :func:`split_head`.  Of a term that the dictionary lists twice the last index
    counts on either way; ``unique`` says that there is none, as in a dictionary that
    :func:`build_dictionary` made.  ``complete`` says that all terms are listed: a large dictionary
    is joined by the short keys of :func:`keyed`, and the rows have no ``term``.
    """
    if key == "term" and not unique:
        dictionary = reverse_dictionary(dictionary)
    if fits_broadcast(dictionary) if small is None else small:
        return entries.join(F.broadcast(dictionary.select("idx", "term")), key)
    hot, cold, tail = split_head(entries, dictionary, key)
    if complete and key == "term":
        others = [c for c in entries.columns if c != "term"]
        cold = cold.select(*others, *term_key()).repartition("_key", "_check")
        found = cold.join(keyed(tail), ["_key", "_check"]).select(*others, "idx")
        return hot.select(*others, "idx").unionByName(found)
    return hot.unionByName(cold.join(tail, key))


def _by_term(bags: DataFrame):
    return exploded_bags(bags).groupBy("term")
