"""Helpers of the operators."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm import mph, shingles
from termloom.llm.components import components
from termloom.llm.encoding import Encoder, default_tokenizer, slices
from termloom.llm.neardup import signature
from termloom.llm.packing import lengths_of

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module", params=[False, True])
def encoder(request):
    return Encoder(default_tokenizer(), by_rank=request.param)


def same_ids(encoder, texts):
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    at = 0
    for text, n in zip(texts, counts.tolist()):
        want = encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert ids[at:at + n].tolist() == want
        at += n


def test_encoder_on_joined_pieces(encoder):
    rng = random.Random(3)
    parts = [
        "a", "Zé", "ö", " ", "  ", "\n", " \n", "\t", "'s", "'ll", ".", ",", "!!", "1", "𝒳", "字",
        "word", "-", '"', "\x1c", "\x85", "<|endoftext|>", "#", "$$$", " the",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    same_ids(encoder, [*texts, "", None, " ", "\n", " a", "  a"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_encoder_on_any_text(encoder, texts):
    same_ids(encoder, texts)


def test_words_are_merged_as_by_the_tokenizer(encoder):
    """Every vocabulary entry and random strings of parts of entries."""
    if encoder.merger is None:
        pytest.skip("words go to the tokenizer")
    rng = random.Random(9)
    tokens = [t for t in encoder.tokenizer.get_vocab() if t != "<|endoftext|>"]
    back = {c: b for b, c in encoder.alphabet.items()}
    words = tokens[::7] + ["".join(rng.choice(tokens) for _ in range(rng.randint(2, 4))) for _ in range(20000)]
    for shown in words:
        raw = bytes(back[c] for c in shown)
        assert encoder.merger._encode_single_piece(raw) == [t.id for t in encoder.model.tokenize(shown)]


def test_encoder_on_slices(encoder):
    batch = pa.record_batch({"t": pa.array([f"text {i} öf x" * (i % 7) for i in range(300)])})
    parts = list(slices(batch, "t", 500))
    assert sum(map(len, parts)) == 300 and len(parts) > 5
    for part in parts:
        same_ids(encoder, part.column("t").to_pylist())


def test_shingles_of_slices():
    texts = pa.array([f"A b {i} c d e {i}" for i in range(50)] + [None, "", "x Y"])
    whole = shingles.shingle_sets(texts)
    part = shingles.shingle_sets(texts.slice(17, 30))
    assert all((a == b).all() for a, b in zip(whole[17:47], part))
    assert [len(s) for s in whole[-3:]] == [0, 0, 1]


@given(st.integers(0, 100_000), st.integers(0, 10))
def test_lengths(n, k):
    found = lengths_of(n, 1 << k)
    assert sum(found) == n and found == sorted(found, reverse=True)
    assert all(x & (x - 1) == 0 and x <= 1 << k for x in found)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 6, 17, 300, 5000])
def test_perfect_hash(n):
    keys = [f"key {i}".encode() for i in range(n)]
    shift, prints = mph.build(keys)
    assert sorted(mph.slot(k, shift, prints) for k in keys) == list(range(n))
    strangers = [mph.slot(f"no {i}".encode(), shift, prints) for i in range(1000)]
    assert sum(s >= 0 for s in strangers) <= 2


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    values = rng.integers(1 << 63, size=1500).astype(np.uint64)
    a, b = signature(values[:1200], 1024), signature(values[300:], 1024)
    assert abs((a == b).mean() - 0.6) < 0.06


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)]
    edges += [(i, i + 1) for i in range(1000, 1200)]  # a long chain
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    parent = {v: v for e in edges for v in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert {r.vertex: r.component for r in got} == {v: root(v) for v in linked}


def test_lookup(spark, tmp_path):
    from termloom.llm import tokenfile

    docs = spark.createDataFrame([(i, "word " * (i % 9)) for i in range(300)], "doc_id long, text string")
    path = str(tmp_path / "ids")
    tokenfile.write(docs, path, shard_ids=50)
    asked = spark.createDataFrame([(0,), (7,), (299,), (1000,), (None,)], "doc_id long")
    got = {r.doc_id: len(r.ids) // 4 for r in tokenfile.lookup(spark, path, asked).collect()}
    whole = {r.doc_id: r.n_tokens for r in tokenfile.read(spark, path).collect()}
    assert got == {i: whole[i] for i in (0, 7, 299)}


def test_brute_luhn():
    assert brute.luhn("4539148803436467") and not brute.luhn("4539148803436468")


def test_index_keeps_its_positions_and_gives_memory_back(monkeypatch):
    import pyarrow as pa

    from termloom.llm import decontaminate as dc

    class Frame:  # hands the function of the tasks back
        schema = {"key": type("Field", (), {"dataType": type("T", (), {"simpleString": lambda _: "bigint"})()})}
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    released = []
    column = type("Column", (), {"alias": lambda self, _: self})()
    monkeypatch.setattr(dc, "named", lambda _: column)
    monkeypatch.setattr(dc, "text_of", lambda _: column)
    monkeypatch.setattr(dc, "TaskContext", type("C", (), {"get": lambda: type("P", (), {"partitionId": lambda _: 2})()}))
    monkeypatch.setattr(dc, "release_memory", lambda: released.append(1), raising=False)
    texts = ["b a b", None, "", "a c"]
    batch = pa.record_batch({"key": pa.array([1, 2, 3, 4]), "t": pa.array(texts)})
    (row,) = [r.to_pylist()[0] for r in dc.build_index(Frame(), gap=3)(iter([batch]))]
    places = np.frombuffer(row["positions"], "<i4").tolist()
    held, at = {}, 0
    for term, n in zip(row["terms"], row["counts"]):
        held[term], at = places[at:at + n], at + n
    # a document's words follow those before it and a gap for each document
    assert held == {"b": [0, 2], "a": [1, 12], "c": [13]} and row["n_words"] == [3, 0, 0, 2]
    assert released == [1]
