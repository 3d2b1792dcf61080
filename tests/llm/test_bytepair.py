"""Ids against the library that the rank files belong to; cutting, decoding, odd input."""

import base64
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from termloom.llm import bytepair
from termloom.llm.queries import QUERIES

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")

BITS = [
    "'s", "'", "t", "'re", "ve", "m", "'ll", "d", "l", "e", " ", "  ", "\n", "\t", "\xa0", "\u3000",
    "a", "é", "Z", "1", "²", "٣", "!", "字", "𝒳", "😀", "\u0301", "\x00", "\x85", "\x1c", "_",
    "<|endoftext|>",
]


@pytest.fixture(scope="module")
def encoding():
    with open(public.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        "own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def random_texts(seed, n=3000):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_ids_and_round_trip(encoding):
    vocabulary = bytepair.rank_file(bytepair.default_ranks())
    texts = [*random_texts(1), None, "", "'", "'r", "'s", " ", "a'"]
    ids, counts = vocabulary.encode(pa.array(texts))
    at = 0
    for text, n in zip(texts, counts.tolist()):
        assert ids[at:at + n].tolist() == encoding.encode_ordinary(text or ""), text
        at += n
    assert vocabulary.decode(ids)[0].tobytes() == "".join(t or "" for t in texts).encode()


def test_slice_of_an_array(encoding):
    texts = pa.array(["é first", "second 字", None, "third"])
    ids, counts = bytepair.rank_file(bytepair.default_ranks()).encode(texts.slice(1, 3))
    assert counts.tolist() == [len(encoding.encode_ordinary(t)) for t in ("second 字", "", "third")]


def test_every_character_is_cut_as_by_the_pattern(encoding):
    """Each code point after a letter, before one, and doubled."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::17]
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)}" for c in points]
    ids, counts = bytepair.rank_file(bytepair.default_ranks()).encode(pa.array(texts))
    expected = encoding.encode_ordinary_batch(texts)
    assert counts.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]


def test_query(spark, tables, encoding):
    texts = [*random_texts(2, 500), None, "", "x" * 300_000, "long text, " * 30_000, " " * 9_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    folder = tables(documents=(rows, "doc_id long, text string"))
    got = QUERIES["op13_bytepair"](spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = encoding.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_ends_give_the_place_of_each_token(spark, encoding):
    text = "Don't 字 stop"
    row = bytepair.encode(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    ends = np.frombuffer(row.ends, "<u4").tolist()
    ids = np.frombuffer(row.ids, "<u4").tolist()
    pieces = [text.encode()[a:b] for a, b in zip([0, *ends], ends)]
    assert pieces == [encoding.decode_single_token_bytes(i) for i in ids]


def test_decoding_refuses_what_does_not_fit(spark):
    def fails(message, *values):
        frame = spark.createDataFrame([(1, *values)], "doc_id long, ids binary, ends binary")
        with pytest.raises(Exception, match=message):
            bytepair.decode(frame).collect()

    four = lambda *x: bytearray(np.array(x, "<u4").tobytes())
    fails("not in the vocabulary", four(50_256), four(1))
    fails("broken item", bytearray(b"abc"), four(1))
    fails("do not end", four(0), four(7))
    empty = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert bytes(bytepair.decode(empty).first()["bytes"]) == b""


def test_scan_ends_after_few_steps():
    """An apostrophe with an ending is followed by its letters: no open run is long."""
    single, compose, value, _, _ = bytepair._functions()
    runs = [
        [bytepair.LETTERS], [bytepair.NUMBERS], [bytepair.RESTS], [bytepair.GLUED], [bytepair.INNER],
        [bytepair.LAST], [bytepair.SHORT, bytepair.LETTERS], [bytepair.LONG, *[bytepair.LETTERS] * 2],
    ]

    def after(f, run):
        for symbol in run:
            f = single[symbol] if f is None else compose[f, single[symbol]]
        return int(f)

    reached = {after(None, run) for run in runs}
    for _ in range(2):
        reached = {after(f, run) for f in reached if value[f] < 0 for run in runs}
    assert all(value[f] >= 0 for f in reached)
