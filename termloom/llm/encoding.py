"""Byte-level BPE ids of many texts, one encoder for each worker process.

The tokenizer cuts a text before every space that follows a character other than white
space, whatever stands around it.  Such pieces repeat, so each distinct piece is
encoded by the tokenizers library once and its ids are gathered from a table.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from termloom.llm.shingles import translated

# Characters that form one piece of their own after a word.
TAIL = ".,;:!?#$%&*|()\"-"
# White space before a space: the cut rule does not hold there.
UNSAFE = (
    r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] "
)
SAFE_CUT = re.compile(r"(?<!\s)(?=\x20)")
LAST_LATIN = "ɏ"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def rank_merger(path: str):
    """A merger of single words over the ids as ranks; None unless the two orders agree.

    Where every merge makes a token with a larger id than the merge before, the lowest id among
    the possible merges is the first one in the list, and the tiktoken library merges alike.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocabulary = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
    made = [vocabulary.get("".join(pair), -1) for pair in pairs]
    as_byte = {c: b for b, c in enumerate(byte_alphabet())}
    tokens = {i: t for t, i in vocabulary.items() if all(c in as_byte for c in t)}
    singles = {tokens[i] for i in tokens if len(tokens[i]) == 1}
    if made != sorted(set(made)) or len(singles) != 256 or (made and made[0] < 0):
        return None
    kept = {i for t, i in vocabulary.items() if t in singles} | set(made)
    ranks = {bytes(map(as_byte.__getitem__, tokens[i])): i for i in kept}
    return tiktoken.Encoding(
        "words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}
    )


class Encoder:
    """``encode`` gives the ids of a batch; the piece cache holds at most ``limit`` entries.

    With ``by_rank`` words are merged by :func:`rank_merger` where the vocabulary allows.
    """

    def __init__(self, path: str, limit: int = 250_000, by_rank: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.alphabet = dict(enumerate(byte_alphabet()))
        self.merger = rank_merger(path) if by_rank else None
        self.cache: dict[str, bytes] = {}
        self.limit = limit

    def _plain(self, piece: str) -> bytes:
        ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _word(self, word: str) -> bytes:
        """One piece of the pattern: letters with at most one space before."""
        if self.merger is not None:
            return array("I", self.merger._encode_single_piece(word.encode())).tobytes()
        shown = word.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _fresh(self, piece: str) -> bytes:
        if "\n" in piece:
            lines = piece.split("\n")
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in lines[1:]) and (
                lines[0] and not lines[0][-1].isspace()
            ):
                return self.piece("\n").join(map(self.piece, lines))
            return self._plain(piece)
        core = piece.rstrip(TAIL)
        letters = core[1:] if core[:1] == " " else core
        if letters.isalpha() and max(letters) <= LAST_LATIN:
            if len(core) == len(piece):
                return self._word(core)
            return self.piece(core) + self.piece(piece[len(core):])
        return self._plain(piece)

    def piece(self, piece: str) -> bytes:
        ids = self.cache.get(piece)
        if ids is None:
            ids = self._fresh(piece)
            if len(self.cache) < self.limit and len(piece) < 64:
                self.cache[piece] = ids
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each text."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        texts = translated(texts)
        unsafe = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False)
        cuts = pc.split_pattern(pc.if_else(pa.array(unsafe), "", texts), " ")
        bounds = cuts.offsets.to_numpy() - cuts.offsets[0].as_py()
        first = bounds[:-1]
        words = cuts.flatten().dictionary_encode()
        known = words.dictionary.to_pylist()
        table = [self.piece(" " + w) for w in known]
        # the first piece of a text has no space before it; an unsafe text is cut by the rule
        whole = texts.to_pylist() if unsafe.any() else None
        heads = pc.list_element(cuts, 0).to_pylist()
        for i, head in enumerate(heads):
            if unsafe[i]:
                table.append(b"".join(map(self.piece, SAFE_CUT.split(whole[i]))))
            else:
                table.append(self.piece(head) if head else b"")
        entry = words.indices.to_numpy().astype(np.int64)
        entry[first] = len(known) + np.arange(len(heads))
        width = np.fromiter(map(len, table), np.int64, len(table)) // 4
        flat = np.frombuffer(b"".join(table), np.uint32)
        starts = np.cumsum(width) - width
        n = width[entry]
        ends = np.cumsum(n)
        ids = flat[np.repeat(starts[entry] - (ends - n), n) + np.arange(n.sum())]
        return ids, np.add.reduceat(n, first)


@lru_cache(maxsize=2)
def encoder(path: str, by_rank: bool = False) -> Encoder:
    """The encoder of this worker process; it serves every task that runs here."""
    return Encoder(path, by_rank=by_rank)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20):
    """Cuts a batch into runs of rows of about ``most_bytes`` of text (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes.astype(np.int64)) - sizes) // most_bytes
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
