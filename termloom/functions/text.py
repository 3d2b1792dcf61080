"""Column functions that turn one document's text into terms.

Everything here is built from Spark's own expressions and keeps a document in
its row: a text becomes an array of sentences, a sentence an array of tokens,
and the terms of the document an array again.  Nothing shuffles until a caller
explodes and groups.

The token struct is ``(token, lemma, pos_tag, ner)``; a richer annotator (see
``operators.annotate``) delivers the same shape.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Tags starting with one of these mark a content word: adjective, verb, adverb,
# noun.
CONTENT_TAG_PREFIXES = ("JJ", "VB", "RB", "NN")

# Longest phrase n-gram.
MAX_NGRAM = 4

# Entity tag -> replacement lemma, as the terms show it (lower case).
ENTITY_TERMS = {
    "PERSON": "-person-",
    "LOCATION": "-location-",
    "NUMBER": "-number-",
    "ORGANIZATION": "-organization-",
}
# The same with the key that never matches a person tag, for vocabularies that
# were built that way.
ENTITY_TERMS_COMPAT = {
    "PERSONS": "-person-",
    "LOCATION": "-location-",
    "NUMBER": "-number-",
    "ORGANIZATION": "-organization-",
}

# Function words of the rule-based annotator (English, German, French, Spanish).
STOPWORDS = (
    # English
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "he", "her",
    "his", "in", "is", "it", "its", "not", "of", "on", "or", "she", "that", "the",
    "their", "then", "they", "this", "to", "was", "were", "which", "with", "you",
    # German
    "auf", "das", "dem", "den", "der", "des", "die", "ein", "eine", "er", "es",
    "im", "ist", "mit", "nicht", "sich", "sie", "und", "von", "zu",
    # French
    "ce", "dans", "du", "elle", "est", "et", "il", "la", "le", "les", "ne", "par",
    "pas", "pour", "que", "qui", "sur", "un", "une",
    # Spanish
    "al", "como", "con", "de", "del", "el", "en", "las", "lo", "los", "más", "no",
    "por", "se", "su", "y",
)

# Characters at or below U+0020, all of which are trimmed.
TRIMMED_CHARS = "".join(chr(code) for code in range(0x21))

# White space, a token (a run of letters and digits, or any other single
# character) and the end of a sentence.  \s, \w and \b are avoided: their
# meaning differs between regex engines.
SPACE = r"[ \t\n\f\r]"
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^ \t\n\f\r\p{L}\p{N}]"
SENTENCE_END_PATTERN = r"(?<=[.!?])[ \t\n\f\r]+"
LETTERS_PATTERN = r"^\p{L}+$"
DIGITS_PATTERN = r"^\p{N}+$"
# ----------------------------------------------------------------------------

TOKEN_STRUCT = "struct<token:string,lemma:string,pos_tag:string,ner:string>"
SENTENCES_TYPE = f"array<array<{TOKEN_STRUCT}>>"
BAG_TYPE = "array<struct<term:string,n:bigint>>"

# Marks used inside one expression while a sentence is cut into phrases.
_BREAK = "\u0001"
_GLUE = "\u0002"

# Slice length that reaches the end of any array without overflowing start + length.
_TO_END = 1 << 30

Rule = Callable[[Column], Column]


def featured_text(text: Column | str) -> Column:
    """Text with missing values as '' and outer control characters and blanks cut off."""
    return F.trim(F.coalesce(_col(text), F.lit("")), F.lit(TRIMMED_CHARS))


def split_sentences(text: Column | str) -> Column:
    """Cut a text after '.', '!' or '?' followed by white space."""
    return F.split(_col(text), SENTENCE_END_PATTERN)


def split_tokens(sentence: Column | str) -> Column:
    return F.regexp_extract_all(_col(sentence), F.lit(TOKEN_PATTERN), F.lit(0))


def rule_pos_tag(token: Column) -> Column:
    """Letters-only words that are no function words count as nouns."""
    return (
        F.when(F.lower(token).isin(*STOPWORDS), F.lit("IN"))
        .when(token.rlike(LETTERS_PATTERN), F.lit("NN"))
        .when(token.rlike(r"^\p{N}"), F.lit("CD"))
        .otherwise(F.lit("SYM"))
    )


def rule_number_ner(token: Column) -> Column:
    """Tag all-digit tokens as NUMBER."""
    return F.when(token.rlike(DIGITS_PATTERN), F.lit("NUMBER"))


def no_ner(token: Column) -> Column:
    return F.lit(None).cast("string")


def annotate_text(
    text: Column | str, pos_rule: Rule = rule_pos_tag, ner_rule: Rule = no_ner
) -> Column:
    """Sentences of token structs, by rules that are column expressions on a token."""

    def token_struct(token: Column) -> Column:
        return F.struct(
            token.alias("token"),
            F.lower(token).alias("lemma"),
            pos_rule(token).alias("pos_tag"),
            ner_rule(token).alias("ner"),
        )

    return F.transform(
        split_sentences(text),
        lambda sentence: F.transform(split_tokens(sentence), token_struct),
    )


def is_wide(lemma: Column) -> Column:
    """Longer than one UTF-16 unit; a lone character beyond the BMP counts as two."""
    return (F.length(lemma) > 1) | (F.octet_length(lemma) == 4)


def is_content_tag(pos_tag: Column) -> Column:
    return F.coalesce(F.substring(pos_tag, 1, 2).isin(*CONTENT_TAG_PREFIXES), F.lit(False))


def generalize(
    sentences: Column | str, mapping: Mapping[str, str] = ENTITY_TERMS
) -> Column:
    """Replace each run of equally tagged entity tokens by one generalised token.

    The first token of the run stays, with its part of speech; its lemma becomes
    the mapped term.
    """
    tags = list(mapping)

    def mapped(token: Column) -> Column:
        lemma = F.lit(None).cast("string")
        for tag, term in mapping.items():
            lemma = F.when(token["ner"] == tag, F.lit(term.lower())).otherwise(lemma)
        return lemma

    def one_sentence(sentence: Column) -> Column:
        def starts_run(token: Column, i: Column) -> Column:
            continues = (
                (i > 0)
                & token["ner"].isin(*tags)
                & token["ner"].eqNullSafe(F.get(sentence, i - 1)["ner"])
            )
            return ~F.coalesce(continues, F.lit(False))

        return F.transform(
            F.filter(sentence, starts_run),
            lambda token: F.struct(
                token["token"].alias("token"),
                F.coalesce(mapped(token), token["lemma"]).alias("lemma"),
                token["pos_tag"].alias("pos_tag"),
                token["ner"].alias("ner"),
            ),
        )

    return F.transform(_col(sentences), one_sentence)


def unigrams(sentences: Column | str) -> Column:
    """Lemmas of a document, repeats kept, single characters dropped."""
    return F.flatten(
        F.transform(
            _col(sentences),
            lambda sentence: F.filter(
                F.transform(sentence, lambda token: token["lemma"]), is_wide
            ),
        )
    )


def phrases(sentences: Column | str, flush_tail: bool = False) -> Column:
    """Maximal runs of content words, as arrays of lemmas.

    Single-character tokens are skipped before the phrase logic, so a comma does
    not end a phrase.  A run that is still open when its sentence ends is dropped
    unless ``flush_tail`` is set.
    """

    def one_sentence(sentence: Column) -> Column:
        wide = F.filter(sentence, lambda token: is_wide(token["lemma"]))
        marked = F.transform(
            wide,
            lambda token: F.when(is_content_tag(token["pos_tag"]), token["lemma"])
            .otherwise(F.lit(_BREAK)),
        )
        runs = F.split(F.array_join(marked, _GLUE), _BREAK)
        if not flush_tail:
            # array_join gives at least '' so there is always a last piece
            runs = F.reverse(F.slice(F.reverse(runs), 2, _TO_END))
        return F.filter(
            F.transform(
                runs, lambda run: F.filter(F.split(run, _GLUE), lambda word: word != "")
            ),
            lambda phrase: F.size(phrase) > 0,
        )

    return F.flatten(F.transform(_col(sentences), one_sentence))


def phrase_ngrams(
    phrase_list: Column | str, style: str = "prefix", max_n: int = MAX_NGRAM
) -> Column:
    """N-grams of size 2..``max_n`` of every phrase.

    ``prefix``: the first n-1 words of the phrase followed by each later word.
    ``contiguous``: each n neighbouring words.
    """
    if style not in ("prefix", "contiguous"):
        raise ValueError(f"unknown n-gram style {style!r}")

    def of_size(phrase: Column, n: int) -> Column:
        later_words = F.slice(phrase, n, _TO_END)
        if style == "prefix":
            prefix = [F.get(phrase, F.lit(i)) for i in range(n - 1)]
            return F.transform(later_words, lambda word: F.concat_ws(" ", *prefix, word))
        return F.transform(
            later_words, lambda _, i: F.array_join(F.slice(phrase, i + 1, n), " ")
        )

    if max_n < 2:
        return F.array().cast("array<string>")
    return F.flatten(
        F.transform(
            _col(phrase_list),
            lambda phrase: F.concat(*[of_size(phrase, n) for n in range(2, max_n + 1)]),
        )
    )


def sorted_runs(sorted_terms: str, starts: str) -> Column:
    """``array<struct<term, n>>`` from a sorted array column and its run starts.

    Both must be columns of their own (not expressions): they are read by
    position for every element.
    """
    def run(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col(starts), k + 1), F.size(sorted_terms))
        return F.struct(
            F.get(F.col(sorted_terms), start).alias("term"),
            (end - start).cast("bigint").alias("n"),
        )

    return F.transform(F.col(starts), run)


def run_starts(sorted_terms: str) -> Column:
    """Positions at which a new value begins in a sorted array column."""
    terms = F.col(sorted_terms)
    return F.when(
        F.size(terms) > 0,
        F.filter(
            F.sequence(F.lit(0), F.size(terms) - 1),
            lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)),
        ),
    )


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column
