"""Alignment of two tokenizers against a plain version."""

import random

import brute
import pytest

from termloom.llm import alignment
from termloom.llm.encoding import byte_alphabet
from termloom.llm.queries import QUERIES

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
BITS = [
    "the ", "a", "é", " ", "  ", "\n", "\t", "𝒳", "字", "<s>", "<0x41>", "<|endoftext|>", "'s",
    "123", "\u3000", "\xa0", "\x00", "ing", "Straße", "aa", "aaa", "!", "..", "\x1c ", "\u200b ",
]


@pytest.fixture(scope="module")
def models():
    a = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    as_byte = {c: i for i, c in enumerate(byte_alphabet())}

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    return (
        lambda t: a.encode(t, add_special_tokens=False).ids,
        lambda i: bytes(as_byte[c] for c in a.id_to_token(i)), b.encode, b_bytes,
    )


def found(documents):
    return {r[0]: tuple(r[c] for c in COLUMNS) for r in documents.collect()}


@pytest.mark.parametrize("block", [4 << 20, 300])
def test_same_as_plain_version(spark, monkeypatch, models, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    rng = random.Random(block)
    rows = [
        (i, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 25))) + "▁" * (i % 9 == 0))
        for i in range(400)
    ]
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, "  x"), (1004, "▁"), (1005, "x "), (1006, "x ")]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    documents, pairs = brute.aligned(rows, *models)
    assert found(got.documents) == documents
    assert documents[1004] == documents[1000] == (0, 0, 0, 0, 0, 0, "")
    assert {(r.a, r.b): r.n_docs for r in got.pairs.collect()} == dict(pairs)


def test_whole_table(spark, models):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    short = [(i, t) for i, t in rows if len(t) < 1500]  # the plain version takes squares of time
    assert len(short) > 50
    table = spark.createDataFrame(short, "doc_id long, text string")
    assert found(alignment.align(table).documents) == brute.aligned(short, *models)[0]
    got = QUERIES["op12_alignment"](spark, folder).collect()
    a = {i: len(models[0](" " + t)) for i, t in rows}
    assert {r.doc_id: r.n_a for r in got} == a


def test_groups_are_kept_if_asked_for(spark, models):
    table = spark.createDataFrame([(1, "hello, Straße"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.groups for r in alignment.align(table, groups=True).documents.collect()}
    assert got[2] == ""
    sides = [g.split("|") for g in got[1].split(";")]
    assert [int(i) for s in sides for i in s[0].split(",")] == models[0](" hello, Straße")
    assert [int(i) for s in sides for i in s[1].split(",")] == models[2]("hello, Straße")


def test_very_long_texts(spark, models):
    rows = [(1, "word and 1234 " * 60_000), (2, "a" * 40_000 + " b"), (3, " " * 5_000)]
    got = found(alignment.align(spark.createDataFrame(rows, "doc_id long, text string")).documents)
    for i, text in rows:
        assert got[i][:2] == (len(models[0](" " + text)), len(models[2](text)))


def test_repeated_rows_are_documents(spark):
    rows = [(1, "one two"), (1, "one two"), (None, "one")]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"))
    counts = sorted(r.count_sum for r in got.documents.collect())
    assert counts == [3, 5, 5]
    assert sorted(r.n_docs for r in got.pairs.collect()) == [2, 3]
