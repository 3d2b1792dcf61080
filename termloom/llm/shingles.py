"""Word shingles of many texts as 64-bit hashes, with numpy over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

PRIME = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def translated(texts: pa.Array, table: bytes | None = None) -> pa.Array:
    """The texts (null: empty) with every byte replaced by ``table``, which must keep UTF-8 valid.

    The result starts at the first byte of its own buffer: string kernels go wrong on
    slices that begin inside one.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
    piece = data.slice(int(bounds[0]), int(bounds[-1] - bounds[0])).to_pybytes() if data else b""
    return pa.LargeStringArray.from_buffers(
        len(texts), pa.py_buffer((bounds - bounds[0]).tobytes()), pa.py_buffer(piece.translate(table) if table else piece)
    )


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z in lower case, cut at ASCII white space) and words per text."""
    texts = pc.ascii_trim_whitespace(translated(texts, LOWER))
    cut = pc.ascii_split_whitespace(texts)
    offsets = cut.offsets.to_numpy().astype(np.int64)
    words = cut.flatten().dictionary_encode()
    known = pd.util.hash_array(
        words.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False
    )
    n = np.diff(offsets)
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    if not len(known):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    hashes = known[words.indices.to_numpy()]
    if empty.any():  # an empty text comes back as one empty word
        hashes = hashes[~np.repeat(empty, n)]
        n = np.where(empty, 0, n)
    return hashes, n


def shingle_sets(texts: pa.Array, words: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a shorter text is one shingle as a whole."""
    hashes, counts = word_hashes(texts)
    joined = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for j in range(words):
        joined = joined * PRIME + hashes[j:j + len(joined)]
    joined = mixed(joined)
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(joined[at:at + n - words + 1]))
        elif n:
            whole = np.uint64(n)
            for h in hashes[at:at + n]:
                whole = np.uint64((int(whole) * int(PRIME) + int(h)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mixed(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
