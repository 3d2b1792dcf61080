"""Byte-level BPE over rank files: pre-tokenisation without regular expressions, and decoding.

A batch of texts is one array of code points.  A table gives each its class (letter,
number, space, other white space, rest); two look-aheads of at most two characters make
symbols of them.  A symbol is a function from the state before a character to the state
after it.  Such functions compose associatively, so a doubling scan gives the state before
every character at once, and state and symbol tell whether a match of the pattern begins
there.  The slices between the beginnings are merged by rank, each distinct one once.

Ids travel with the byte offset at which each ends, so a token's place in its text is known
and decoding can be checked.

Defined results: a null text counts as empty, an empty text has no ids and decodes to an
empty text; texts of any length are cut whole; repeated rows are encoded each for itself;
an empty table gives an empty table; other columns of the table are not looked at.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from termloom.llm.common import named, release_memory, text_of
from termloom.llm.encoding import slices
from termloom.llm.shingles import translated

# --- fixed values -----------------------------------------------------------
# Classes of code points.
LETTER, NUMBER, REST, WHITE, SPACE = range(5)
# What may follow an apostrophe to form a match of its own.
SHORT_ENDINGS = ("s", "t", "m", "d")
LONG_ENDINGS = ("re", "ve", "ll")
APOSTROPHE = 0x27
# Symbols: the classes of characters that are no white space, an apostrophe with a short
# or long ending, a space before a character that is no white space, white space before
# white space or the end of the text, and other white space before something else.
LETTERS, NUMBERS, RESTS, SHORT, LONG, GLUED, INNER, LAST = range(8)
# States: a match ends here, inside letters, numbers or rest, after a glued space, inside
# white space, and one or two letters before the end of an apostrophe match.
DONE, IN_LETTERS, IN_NUMBERS, IN_REST, AFTER_SPACE, IN_WHITE, ONE_LEFT, TWO_LEFT = range(8)
# ----------------------------------------------------------------------------

#: State after a symbol, whatever the state before; a match begins at the symbol.
_FRESH = {
    LETTERS: IN_LETTERS, NUMBERS: IN_NUMBERS, RESTS: IN_REST, SHORT: ONE_LEFT, LONG: TWO_LEFT,
    GLUED: AFTER_SPACE, INNER: IN_WHITE, LAST: DONE,
}
#: (state, symbol) pairs that go on with the match, and the state after.
_GOES_ON = {
    (IN_LETTERS, LETTERS): IN_LETTERS, (AFTER_SPACE, LETTERS): IN_LETTERS,
    (TWO_LEFT, LETTERS): ONE_LEFT, (ONE_LEFT, LETTERS): DONE,
    (IN_NUMBERS, NUMBERS): IN_NUMBERS, (AFTER_SPACE, NUMBERS): IN_NUMBERS,
    (IN_WHITE, INNER): IN_WHITE,
    **{
        (state, symbol): IN_REST
        for state in (IN_REST, AFTER_SPACE)
        for symbol in (RESTS, SHORT, LONG)
    },
}


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All functions that symbols and their compositions can be.

    Returns the number of each symbol's function, the composition table (first, then
    second), the constant value of each function (-1: none), the number of each constant
    function, and whether a match begins, by state and symbol.
    """
    states, symbols = range(8), range(8)
    single = [
        tuple(_GOES_ON.get((s, x), _FRESH[x]) for s in states) for x in symbols
    ]
    known = {f: i for i, f in enumerate(dict.fromkeys([*single, *[(s,) * 8 for s in states]]))}
    grown = 0
    while grown < len(known):
        grown = len(known)
        for f in list(known):
            for g in single:
                known.setdefault(tuple(g[s] for s in f), len(known))
    every = list(known)
    compose = np.array([[known[tuple(g[s] for s in f)] for g in every] for f in every], np.uint8)
    value = np.array([f[0] if len(set(f)) == 1 else -1 for f in every], np.int8)
    constant = np.array([known[(s,) * 8] for s in states], np.uint8)
    begins = np.array([[(s, x) not in _GOES_ON for x in symbols] for s in states])
    return np.array([known[f] for f in single], np.uint8), compose, value, constant, begins


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    """Class of every code point, as the Unicode tables of the tiktoken library have it."""
    import tiktoken

    classes = np.full(0x110000, REST, np.uint8)
    single_bytes = {bytes([b]): b for b in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        probe = tiktoken.Encoding(
            pattern, pat_str=pattern, mergeable_ranks=single_bytes, special_tokens={}
        )
        for first in range(0, 0x110000, 0x8000):
            plane = "".join(chr(c) for c in range(first, first + 0x8000) if not 0xD800 <= c < 0xE000)
            held = bytes(probe.encode_ordinary(plane)).decode()
            classes[np.frombuffer(held.encode("utf-32-le"), "<u4")] = kind
    classes[0x20] = SPACE
    return classes


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the first byte of each character in valid UTF-8, and its code point."""
    if not len(data) or data.max() < 0x80:
        return np.arange(len(data)), data.astype(np.uint32)
    at = np.flatnonzero(data & 0xC0 != 0x80)
    lead = data[at]
    points = lead.astype(np.uint32)
    for width, low, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        own = np.flatnonzero((lead >= low) & (lead < (low >> 1 | 0x80)))
        wide = points[own] & mask
        for k in range(1, width):
            wide = wide << 6 | data[at[own] + k] & 0x3F
        points[own] = wide
    return at, points


def symbols_of(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbol of every character; ``ends`` are the character counts up to each text's end."""
    classes = code_point_classes()[points]
    white = classes >= WHITE
    more = np.zeros(len(points), bool)  # something other than white space follows in the text
    more[:-1] = ~white[1:]
    more[ends[ends > 0] - 1] = False
    out = classes.copy()  # the first three symbols have the numbers of their classes
    out[white] = np.where(more[white], np.where(classes[white] == SPACE, GLUED, LAST), INNER)
    marks = np.flatnonzero(points == APOSTROPHE)
    left = ends[np.searchsorted(ends, marks, "right")] - marks - 1
    one = points[np.minimum(marks + 1, len(points) - 1)]
    two = points[np.minimum(marks + 2, len(points) - 1)]
    short = (left >= 1) & np.isin(one, [ord(c) for c in SHORT_ENDINGS])
    long = np.zeros(len(marks), bool)
    for a, b in LONG_ENDINGS:
        long |= (one == ord(a)) & (two == ord(b))
    out[marks[short]] = SHORT
    out[marks[long & (left >= 2)]] = LONG
    return out


def match_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a match of the pattern begins at each character of the texts."""
    single, compose, value, constant, begins = _functions()
    symbols = symbols_of(points, ends)
    first = np.unique(np.concatenate([[0], ends[:-1]]).astype(np.int64))
    first = first[first < len(points)]
    done = single[symbols]
    # a text begins in a fixed state, so its first function is constant
    fresh = np.array([_FRESH[x] for x in range(8)])
    done[first] = constant[fresh[symbols[first]]]
    step, open_ = 1, np.flatnonzero(value[done] < 0)
    while len(open_):
        done[open_] = compose[done[open_ - step], done[open_]]
        open_ = open_[value[done[open_]] < 0]
        step *= 2
    before = np.empty(len(points), np.int8)
    before[1:] = value[done[:-1]]
    before[first] = DONE
    return begins[before, symbols]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


#: Bytes of text, or of ids, that a task looks at together.
TOGETHER_BYTES = 1 << 20


class RankFile:
    """A vocabulary of ranks.  The slice cache holds at most ``limit`` entries."""

    def __init__(self, path: str, limit: int = 200_000):
        with open(path, "rb") as file:
            fields = (line.split() for line in file if line.strip())
            ranks = {base64.b64decode(token): int(rank) for token, rank in fields}
        by_id = {i: token for token, i in ranks.items()}
        size = max(by_id) + 1
        self.known = np.array([i in by_id for i in range(size)])
        tokens = [by_id.get(i, b"") for i in range(size)]
        self.width = np.fromiter(map(len, tokens), np.int64, size)
        self.start = np.cumsum(self.width) - self.width
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache: dict[bytes, bytes] = {}
        self.limit = limit
        release_memory()

    @cached_property
    def merger(self):
        """Merges one slice at a time; its own pattern is not used."""
        import tiktoken

        held = np.flatnonzero(self.known).tolist()
        ranks = {
            self.flat[self.start[i]:self.start[i] + self.width[i]].tobytes(): i for i in held
        }
        return tiktoken.Encoding(
            "ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}
        )

    def slice_ids(self, piece: bytes) -> bytes:
        ids = self.cache.get(piece)
        if ids is None:
            ids = array("I", self.merger._encode_single_piece(piece)).tobytes()
            if len(self.cache) < self.limit and len(piece) < 64:
                self.cache[piece] = ids
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each text."""
        texts = translated(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1)
        buffer = texts.buffers()[2]
        data = np.frombuffer(buffer, np.uint8, int(offsets[-1])) if offsets[-1] else np.zeros(0, np.uint8)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        at, points = code_points(data)
        cuts = at[match_starts(points, np.searchsorted(at, offsets[1:]))]
        pieces = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(cuts),
            [None, pa.py_buffer(np.append(cuts, len(data)).astype(np.int64)), buffer],
        ).dictionary_encode()
        table = [self.slice_ids(p) for p in pieces.dictionary.to_pylist()]
        entry = pieces.indices.to_numpy().astype(np.int64)
        width = np.fromiter(map(len, table), np.int64, len(table)) // 4
        ids = gathered(np.frombuffer(b"".join(table), "<u4"), np.cumsum(width) - width, width, entry)
        upto = np.concatenate([[0], np.cumsum(width[entry])])
        return ids, np.diff(upto[np.searchsorted(cuts, offsets)])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids one after another, and the number of bytes of each id."""
        if len(ids) and (ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return gathered(self.flat, self.start, self.width, ids), self.width[ids]


def gathered(
    flat: np.ndarray, start: np.ndarray, width: np.ndarray, entry: np.ndarray
) -> np.ndarray:
    """The runs of ``flat`` that the entries name, one after another."""
    n = width[entry]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(n) else 0
    kind = np.int32 if max(total, len(flat)) < 2**31 else np.int64
    at = np.repeat((start[entry] - (ends - n)).astype(kind), n)
    at += np.arange(total, dtype=kind)
    return flat[at]


@lru_cache(maxsize=2)
def rank_file(path: str) -> RankFile:
    """The vocabulary of this worker process; it serves every task that runs here."""
    return RankFile(path)


def _binary(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value for each count of items."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * data.itemsize
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(counts),
        [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    ).cast(pa.binary())


def _items(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The items of all binary values one after another, and their number in each value."""
    values = column.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, 8 * values.offset)
    width = np.dtype(kind).itemsize
    if (np.diff(bounds) % width).any():
        raise ValueError("a value holds a broken item")
    n = int(bounds[-1] - bounds[0])
    data = np.frombuffer(values.buffers()[2], np.uint8, n, int(bounds[0])) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(data).view(kind), np.diff(bounds) // width


def encode(
    docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None
) -> DataFrame:
    """(key, n_tokens, ids, ends) of every text.

    ``ids`` and ``ends`` are little-endian unsigned 32-bit numbers; an end is the number of
    bytes of the text up to the end of its token.
    """
    path = ranks or default_ranks()
    slim = docs.select(named(key).alias("key"), text_of(text).alias("t"))
    kind = slim.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = rank_file(path)
        for batch in (s for b in batches for s in slices(b, "t", TOGETHER_BYTES)):
            ids, counts = vocabulary.encode(batch.column("t"))
            upto = np.cumsum(vocabulary.width[ids])
            last = np.cumsum(counts)
            before = np.concatenate([[0], upto])[last - counts]
            yield pa.record_batch(
                {
                    "key": batch.column("key"),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids": _binary(ids.astype("<u4"), counts),
                    "ends": _binary((upto - np.repeat(before, counts)).astype("<u4"), counts),
                }
            )

    encoded = slim.mapInArrow(run, f"key {kind}, n_tokens long, ids binary, ends binary")
    return encoded.withColumnRenamed("key", key)


def decode(
    encoded: DataFrame, key: str = "doc_id", ranks: str | None = None
) -> DataFrame:
    """(key, n_tokens, ids, bytes) from ids alone; null ids give no bytes.

    Where ``encoded`` has ``ends``, the bytes are held against them.
    """
    path = ranks or default_ranks()
    checked = ["ends"] if "ends" in encoded.columns else []
    slim = encoded.select(named(key).alias("key"), "ids", *checked)
    kind = slim.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = rank_file(path)
        for batch in (s for b in batches for s in slices(b, "ids", TOGETHER_BYTES)):
            ids, counts = _items(batch.column("ids"), "<u4")
            data, widths = vocabulary.decode(ids)
            upto = np.concatenate([[0], np.cumsum(widths)])
            last = np.cumsum(counts)
            before = upto[last - counts]
            if checked:
                ends, _ = _items(batch.column("ends"), "<u4")
                if not np.array_equal(ends, upto[1:] - np.repeat(before, counts)):
                    raise ValueError("ids do not end where they ended in their texts")
            yield pa.record_batch(
                {
                    "key": batch.column("key"),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids": batch.column("ids"),
                    "bytes": _binary(data, upto[last] - before),
                }
            )

    decoded = slim.mapInArrow(run, f"key {kind}, n_tokens long, ids binary, bytes binary")
    return decoded.withColumnRenamed("key", key)
