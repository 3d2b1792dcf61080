from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import plan_of
from termloom.functions import text as tx
from termloom.operators import annotate as an

SENTENCE = "big/JJ ,/, red/JJ car/NN of/IN old/JJ man/NN ./."


def first(df, column):
    return df.select(column.alias("x")).first()["x"]


def grams_of(spark, words, style, max_n=4):
    row = spark.createDataFrame([([words],)], "p array<array<string>>")
    return first(row, tx.phrase_ngrams("p", style, max_n))


def test_unigrams_keep_repeats_and_drop_single_characters(tagged):
    df = tagged([SENTENCE, "big/JJ a/DT"])
    assert first(df, tx.unigrams("sentences")) == [
        "big", "red", "car", "of", "old", "man", "big",
    ]


@pytest.mark.parametrize(
    "flush_tail, expected",
    [(False, [["big", "red", "car"]]), (True, [["big", "red", "car"], ["old", "man"]])],
)
def test_phrases(tagged, flush_tail, expected):
    assert first(tagged([SENTENCE]), tx.phrases("sentences", flush_tail)) == expected


def test_phrase_is_dropped_at_each_sentence_end(tagged):
    df = tagged(["old/JJ man/NN", "red/JJ car/NN of/IN"])
    assert first(df, tx.phrases("sentences")) == [["red", "car"]]


def test_no_phrases_in_empty_text(tagged):
    df = tagged([], ["./."])
    assert [r["x"] for r in df.select(tx.phrases("sentences", True).alias("x")).collect()] == [
        [], [],
    ]


def test_prefix_ngrams(spark):
    assert sorted(grams_of(spark, list("abcd"), "prefix")) == sorted(
        ["a b", "a c", "a d", "a b c", "a b d", "a b c d"]
    )
    assert grams_of(spark, ["a"], "prefix") == []
    assert len(grams_of(spark, list("abcde"), "prefix")) == 9


def test_contiguous_ngrams(spark):
    assert grams_of(spark, ["big", "red", "car"], "contiguous") == [
        "big red", "red car", "big red car",
    ]


@settings(
    max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=14), st.integers(2, 5))
def test_ngrams_match_their_definition(spark, words, max_n):
    sizes = range(2, min(max_n, len(words)) + 1)
    prefix = [
        " ".join(words[: g - 1] + [words[k]]) for g in sizes for k in range(g - 1, len(words))
    ]
    contiguous = [
        " ".join(words[k : k + g]) for g in sizes for k in range(len(words) - g + 1)
    ]
    assert Counter(grams_of(spark, words, "prefix", max_n)) == Counter(prefix)
    assert Counter(grams_of(spark, words, "contiguous", max_n)) == Counter(contiguous)


def test_unknown_ngram_style_is_refused(spark):
    with pytest.raises(ValueError):
        tx.phrase_ngrams("p", "suffix")


def lemmas(df):
    return [[t["lemma"] for t in s] for s in df.first()["sentences"]]


@pytest.mark.parametrize(
    "sentence, expected",
    [
        ("new/NNP/LOCATION york/NNP/LOCATION and/CC paris/NNP/LOCATION",
         ["-location-", "and", "-location-"]),
        ("paris/NNP/LOCATION london/NNP/LOCATION", ["-location-"]),
        ("new/NNP/LOCATION nasa/NNP/ORGANIZATION", ["-location-", "-organization-"]),
        ("ann/NNP/PERSON lee/NNP/PERSON ran/VBD", ["-person-", "ran"]),
        ("x1/NN/O x2/NN/O", ["x1", "x2"]),
    ],
)
def test_entities(tagged, sentence, expected):
    assert lemmas(an.generalize_entities(tagged([sentence]))) == [expected]


def test_entities_keep_the_first_tag_and_the_compat_mapping_misses_persons(tagged):
    df = tagged(["ann/NNP/PERSON lee/NN/PERSON oslo/NNP/LOCATION"])
    tags = [t["pos_tag"] for t in an.generalize_entities(df).first()["sentences"][0]]
    assert tags == ["NNP", "NNP"]
    assert lemmas(an.generalize_entities(df, tx.ENTITY_TERMS_COMPAT)) == [
        ["ann", "lee", "-location-"]
    ]


def test_rule_annotator(spark):
    df = spark.createDataFrame(
        [("The Cat sat. On 3 mats, x2 \U0001f600! é",)], "extracted_text string"
    )
    tokens = an.token_table(an.annotate(df, ner_rule=tx.rule_number_ner)).collect()
    assert [(t["sent_id"], t["pos"], t["token"], t["lemma"], t["pos_tag"], t["ner"])
            for t in tokens] == [
        (0, 0, "The", "the", "IN", None), (0, 1, "Cat", "cat", "NN", None),
        (0, 2, "sat", "sat", "NN", None), (0, 3, ".", ".", "SYM", None),
        (1, 0, "On", "on", "IN", None), (1, 1, "3", "3", "CD", "NUMBER"),
        (1, 2, "mats", "mats", "NN", None), (1, 3, ",", ",", "SYM", None),
        (1, 4, "x2", "x2", "SYM", None), (1, 5, "\U0001f600", "\U0001f600", "SYM", None),
        (1, 6, "!", "!", "SYM", None), (2, 0, "é", "é", "NN", None),
    ]
    # a character beyond the basic plane counts as two units, é as one
    assert first(an.annotate(df), tx.unigrams("sentences"))[-1] == "\U0001f600"


def test_featured_text(spark):
    df = spark.createDataFrame([(" \t\n a b \x01\r",), (None,)], "t string")
    assert [r["x"] for r in df.select(tx.featured_text("t").alias("x")).collect()] == ["a b", ""]


def test_term_bags_count_within_the_document_and_do_not_shuffle(spark):
    rows = [(1, list("bab")), (2, []), (3, ["z"]), (4, None), (5, list("aaaa"))]
    bags = an.term_bags(spark.createDataFrame(rows, "id int, terms array<string>"))
    found = {r["id"]: {b["term"]: b["n"] for b in r["bag"] or []} for r in bags.collect()}
    assert found == {i: dict(Counter(t or [])) for i, t in rows}
    assert "Exchange" not in plan_of(bags)


def test_whole_text_path_does_not_shuffle(spark):
    docs = spark.createDataFrame([("c", "Red car. Old man walks of it")],
                                 "cluster_id string, extracted_text string")
    bags = an.term_bags(an.document_terms(an.annotate(docs)))
    assert "Exchange" not in plan_of(bags)
    assert "Python" not in plan_of(bags)
    assert {b["term"] for b in bags.first()["bag"]} == {
        "red", "car", "old", "man", "walks", "of", "it", "old man", "old walks",
        "old man walks",
    }


def test_token_table_round_trip(spark, tagged):
    df = tagged([SENTENCE, "new/NNP/LOCATION york/NNP/LOCATION"], ["one/CD two/CD"])
    back = an.from_token_table(an.token_table(df), "row_id")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_python_annotator(spark):
    def make():
        def run(text):
            return [[{"token": w, "lemma": w.upper(), "pos_tag": "NN", "ner": None}
                     for w in text.split()]]
        return run

    docs = spark.createDataFrame([("c1", "ab cd"), ("c2", None)],
                                 "cluster_id string, extracted_text string")
    annotated = an.annotate_with(docs, make)
    assert {r["cluster_id"]: r["x"] for r in annotated.select(
        "cluster_id", tx.unigrams("sentences").alias("x")).collect()} == {
        "c1": ["ab", "cd"], "c2": []}


def test_long_sentence_without_breaks_is_kept_whole(spark):
    words = [f"word{'x' * (i % 7)}{chr(97 + i % 26)}" for i in range(20_000)]
    docs = spark.createDataFrame([(" ".join(words),)], "extracted_text string")
    terms = an.document_terms(an.annotate(docs), flush_tail=True)
    n = len(words)
    assert terms.select(F.size("terms")).first()[0] == n + (n - 1) + (n - 2) + (n - 3)
