"""Alignment of two tokenizers over a corpus, with document counts of the linked id pairs.

A space and the text are encoded by a byte-level BPE (A), the text by a sentence piece model
(B), which adds the space itself.  Byte offsets where tokens of both end cut the tokens into
groups; tokens whose bytes overlap are linked.

The A-id to same-bytes B-id array is made once from the vocabularies.  A pair of that array
is counted in a vector of the vocabulary's length in each task, and only the vectors are
added up.  All other pairs come from irregular groups: a block of texts lists its distinct
ones with their documents, the lists are counted by key, and each block gets the counts of
its own list back.

No merge of either model crosses a space after a character that is no white space, so
texts are cut there, and each distinct piece of a block is encoded and aligned once.

Defined results: a text that is null or empty, or whose tokens' bytes are not the space and
the text, has no tokens: zeros and an empty digest.  Special tokens are plain text.  Repeated
rows are documents of their own and count as such.  Texts of any length are aligned whole.
An empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.bytepair import WHITE, code_point_classes, code_points, gathered
from termloom.llm.common import named, release_memory
from termloom.llm.encoding import Encoder, byte_alphabet, default_tokenizer, slices
from termloom.llm.shingles import translated
from termloom.session import materialize

# --- fixed values -----------------------------------------------------------
# How sentence pieces write a space.
SHOWN_SPACE = "▁"
# Characters that some tables count as white space and others do not: no cut after them.
DOUBTFUL = (0x1C, 0x1D, 0x1E, 0x1F, 0x180E, 0x200B, 0xFEFF)
# Bits of a pair's code that hold the B id.
B_BITS = 32
# Bits of a block number below the partition.
COUNTER_BITS = 34
# ----------------------------------------------------------------------------

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes one after another; start and length of each part."""
    width = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(width) - width, width


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on in as few bytes each as they need; the first byte says how many."""
    most = int(x.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w - (w == 8))
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of so many values each."""
    upto = np.concatenate([[0], np.cumsum(values)])
    last = np.cumsum(counts)
    return upto[last] - upto[last - counts]


class Pair:
    """Both tokenizers, the bytes of their ids and the identity array (-1: no such id)."""

    def __init__(self, a_path: str, b_path: str, limit: int = 100_000):
        import sentencepiece

        self.a = Encoder(a_path, limit)
        self.a.tokenizer.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.limit = limit
        self.b_cache: dict[str, bytes] = {}
        as_byte = {c: b for b, c in enumerate(byte_alphabet())}
        by_id = {i: t for t, i in self.a.tokenizer.get_vocab(with_added_tokens=True).items()}
        a_bytes = [
            bytes(as_byte.get(c, 0) for c in by_id.get(i, "")) for i in range(max(by_id) + 1)
        ]
        b_bytes = [
            bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i)
            else piece.replace(SHOWN_SPACE, " ").encode()
            for i, piece in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))
        ]
        # a byte that has a piece of its own is written by that piece
        order = sorted(range(len(b_bytes)), key=lambda i: (not self.b.is_byte(i), -i))
        same = {b_bytes[i]: i for i in order}
        self.identity = np.array([same.get(t, -1) if t else -1 for t in a_bytes], np.int64)
        self.a_bytes, self.b_bytes = _flat(a_bytes), _flat(b_bytes)
        # ids as text with what follows them: inside a group, at the end of its side
        self.a_text = [_flat([b"%d%b" % (i, end) for i in range(len(a_bytes))]) for end in (b",", b"|")]
        self.b_text = [_flat([b"%d%b" % (i, end) for i in range(len(b_bytes))]) for end in (b",", b";")]
        self.lone_space = array("I", [self.b.piece_to_id(SHOWN_SPACE)]).tobytes()
        release_memory()

    def b_ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that begin with a space, which the model adds."""
        fresh = [p for p in dict.fromkeys(pieces) if p not in self.b_cache]
        made = {
            p: array("I", ids).tobytes() if len(p) > 1 else self.lone_space
            for p, ids in zip(fresh, self.b.encode([p[1:] for p in fresh], num_threads=1))
        }
        out = [made[p] if p in made else self.b_cache[p] for p in pieces]
        if len(self.b_cache) < self.limit:
            self.b_cache.update((p, ids) for p, ids in made.items() if len(p) < 64)
        return out

    def align(self, pieces: list[str]) -> Aligned:
        """Groups and links of each of the pieces."""
        plain = [p.encode() for p in pieces]
        size = np.fromiter(map(len, plain), np.int64, len(plain))
        sides = []
        for ids, table in (
            ([self.a.piece(p) for p in pieces], self.a_bytes),
            (self.b_ids(pieces), self.b_bytes),
        ):
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            sides.append((np.frombuffer(b"".join(ids), "<u4").astype(np.int64), n, table))
        # tokens that do not spell their piece make it unfit
        fit = np.ones(len(pieces), bool)
        for ids, n, (_, _, width) in sides:
            fit &= _sums(width[ids], n) == size
        spelled = np.frombuffer(b"".join(p for p, f in zip(plain, fit) if f), np.uint8)
        ends = np.cumsum(size[fit])
        for ids, n, table in sides:
            wrong = gathered(*table, ids[np.repeat(fit, n)]) != spelled
            if wrong.any():
                fit[np.flatnonzero(fit)[np.searchsorted(ends, np.flatnonzero(wrong), "right")]] = False
        (a, a_n, (_, _, a_width)), (b, b_n, (_, _, b_width)) = (
            (ids[np.repeat(fit, n)], np.where(fit, n, 0), table) for ids, n, table in sides
        )
        piece_ends = np.cumsum(np.where(fit, size, 0))
        a_ends, b_ends = np.cumsum(a_width[a]), np.cumsum(b_width[b])
        # between two neighbouring ends lies the overlap of one A and one B token
        every = np.union1d(a_ends, b_ends)
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        links = (
            a[np.searchsorted(a_ends, every)] << B_BITS | b[np.searchsorted(b_ends, every)]
        )
        upto = lambda x: np.diff(np.searchsorted(x, piece_ends, "right"), prepend=0)
        groups, n_groups = self._groups(a, b, a_ends, b_ends, common), upto(common)
        return Aligned(fit, a_n, b_n, n_groups, upto(every), links, *groups(n_groups))

    def _groups(self, a, b, a_ends, b_ends, common):
        """Text of all groups in order, each ended by a semicolon."""
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        a_in = np.bincount(a_group, minlength=len(common))
        b_in = np.bincount(b_group, minlength=len(common))
        a_place = np.arange(len(a)) + (np.cumsum(b_in) - b_in)[a_group]
        b_place = np.arange(len(b)) + np.cumsum(a_in)[b_group]
        tables = [*self.a_text, *self.b_text]
        flat = np.concatenate([t[0] for t in tables])
        base = np.cumsum([0] + [len(t[0]) for t in tables])
        start, width = np.zeros((2, len(a) + len(b)), np.int64)
        for ids, place, last, k in (
            (a, a_place, a_ends == common[a_group] if len(a) else np.zeros(0, bool), 0),
            (b, b_place, b_ends == common[b_group] if len(b) else np.zeros(0, bool), 2),
        ):
            for final in (0, 1):
                own = last == bool(final)
                _, first, length = tables[k + final]
                start[place[own]] = base[k + final] + first[ids[own]]
                width[place[own]] = length[ids[own]]
        text = gathered(flat, start, width, np.arange(len(start)))
        in_group = _sums(width, a_in + b_in)
        return lambda n_groups: (text, _sums(in_group, n_groups))


@dataclass
class Aligned:
    """Of each piece: whether its tokens spell it, its numbers, its links (codes of id pairs
    one after another), and the text of its groups (likewise)."""

    fit: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    links: np.ndarray
    text: np.ndarray
    text_size: np.ndarray


@lru_cache(maxsize=1)
def _pair(a_path: str, b_path: str) -> Pair:
    """The tokenizers of this worker process."""
    return Pair(a_path, b_path)


def _cut(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Pieces of a space and each text, and their number in each; none for an empty text."""
    texts = translated(texts)
    held = pc.greater(pc.binary_length(texts), 0)
    space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    texts = translated(pc.if_else(held, pc.binary_join_element_wise(space, texts, none), none))
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1)
    buffer = texts.buffers()[2]
    n_bytes = int(offsets[-1])
    data = np.frombuffer(buffer, np.uint8, n_bytes) if n_bytes else np.zeros(0, np.uint8)
    at, points = code_points(data)
    solid = (code_point_classes()[points] < WHITE) & ~np.isin(points, DOUBTFUL)
    first = np.zeros(len(points), bool)
    begin = np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])
    first[1:] = (points[1:] == 0x20) & solid[:-1]
    first[begin] = True
    cuts = at[first]
    pieces = pa.LargeStringArray.from_buffers(
        len(cuts), pa.py_buffer(np.append(cuts, n_bytes).astype(np.int64)), buffer
    )
    return pieces.dictionary_encode(), np.diff(np.searchsorted(cuts, offsets))


_BLOCK = (
    "block long, keys array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, "
    "n_links array<long>, digest array<string>, groups array<string>, uses array<long>, "
    "piece binary, times binary, piece_links binary, links binary, known binary, "
    "codes array<long>, code_docs array<long>, vector binary"
)


def _block(
    batch: pa.RecordBatch, pair: Pair, vector: np.ndarray, block: int, groups: bool
) -> dict[str, object]:
    """One block of texts aligned; adds its identity pairs to ``vector``."""
    pieces, n_pieces = _cut(batch.column("t"))
    entry = pieces.indices.to_numpy().astype(np.int64)
    found = pair.align(pieces.dictionary.to_pylist())
    n_docs, n_known = len(batch), len(found.fit)
    doc = np.repeat(np.arange(n_docs), n_pieces)
    unfit = np.zeros(n_docs, bool)
    unfit[doc[~found.fit[entry]]] = True
    if unfit.any():
        kept = ~unfit[doc]
        entry, doc, n_pieces = entry[kept], doc[kept], np.where(unfit, 0, n_pieces)
    whole, last = found.text.tobytes(), np.cumsum(found.text_size).tolist()
    shown = [whole[i:j] for i, j in zip([0, *last], last)]
    ends = np.cumsum(n_pieces).tolist()
    # the groups of each text without the last semicolon
    texts = [
        b"".join(map(shown.__getitem__, entry[i:j].tolist()))[:-1] for i, j in zip([0, *ends], ends)
    ]
    # documents by piece, then by pair: each counts once
    used, times = np.unique(doc * max(n_known, 1) + entry, return_counts=True)
    used_doc, used_piece = used // max(n_known, 1), used % max(n_known, 1)
    codes, number = np.unique(found.links, return_inverse=True)
    n = found.n_links[used_piece]
    held = gathered(number, np.cumsum(found.n_links) - found.n_links, found.n_links, used_piece)
    once = np.unique(np.repeat(used_doc, n) * max(len(codes), 1) + held) % max(len(codes), 1)
    docs = np.bincount(once, minlength=len(codes))
    a, b = codes >> B_BITS, codes & (1 << B_BITS) - 1
    regular = pair.identity[a] == b
    vector[a[regular]] += docs[regular]
    irregular = ~regular & (docs > 0)
    # pieces of unfit texts alone have no links to count
    n_links = np.where(np.bincount(used_piece, minlength=n_known) > 0, found.n_links, 0)
    links = number[np.repeat(n_links > 0, found.n_links)]
    total = lambda x: _sums(x[entry], n_pieces)
    return {
        "block": block, "keys": batch.column("key").to_pylist(),
        "n_a": total(found.n_a), "n_b": total(found.n_b),
        "n_groups": total(found.n_groups), "n_links": total(found.n_links),
        "digest": [hashlib.sha256(t).hexdigest() if t else "" for t in texts],
        "groups": [t.decode() for t in texts] if groups else None,
        "uses": np.bincount(used_doc, minlength=n_docs),
        "piece": _packed(used_piece), "times": _packed(times), "piece_links": _packed(n_links),
        "links": _packed(links), "known": codes.astype("<i8").tobytes(),
        "codes": codes[irregular], "code_docs": docs[irregular],
    }


def _blocks(docs: DataFrame, key: str, text: str, paths: tuple[str, str], groups: bool) -> DataFrame:
    """Aligned blocks of texts, and one identity vector for each task."""
    slim = docs.select(named(key).alias("key"), named(text).cast("string").alias("t"))
    kind = slim.schema["key"].dataType.simpleString()
    most_bytes = BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*paths)
        vector = np.zeros(len(pair.identity), np.int64)
        block = TaskContext.get().partitionId() << COUNTER_BITS
        shape = None
        for batch in (s for b in batches for s in slices(b, "t", most_bytes)):
            longs, names, raw = pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary()
            shape = pa.schema(
                [("block", pa.int64()), ("keys", pa.list_(batch.schema.field("key").type)),
                 *[(c, longs) for c in ("n_a", "n_b", "n_groups", "n_links")],
                 ("digest", names), ("groups", names), ("uses", longs),
                 *[(c, raw) for c in ("piece", "times", "piece_links", "links", "known")],
                 ("codes", longs), ("code_docs", longs), ("vector", raw)]
            )
            row = _block(batch, pair, vector, block, groups)
            yield pa.RecordBatch.from_pylist([row], schema=shape)
            block += 1
            del row
            release_memory()
        if shape is not None:
            yield pa.RecordBatch.from_pylist([{"vector": vector.tobytes()}], schema=shape)
        release_memory()

    return slim.mapInArrow(run, _BLOCK.format(kind=kind))


def _identity_counts(blocks: DataFrame) -> DataFrame:
    """(a, n): documents that hold each pair of the identity array, from the tasks' vectors."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("vector"):
                counts = np.frombuffer(raw.as_py(), np.int64)
                held = np.flatnonzero(counts)
                yield pa.record_batch({"a": pa.array(held), "n": pa.array(counts[held])})

    vectors = blocks.where("vector is not null").select("vector")
    return vectors.mapInArrow(entries, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))


def _vector(counts: DataFrame, n: int) -> np.ndarray:
    """(a, n) rows, one for each A id at most, as a vector of the vocabulary's length."""
    out = np.zeros(n, np.int64)
    rows = counts.toArrow()
    out[rows["a"].to_numpy()] = rows["n"].to_numpy()
    return out


@dataclass(frozen=True)
class Alignment:
    """``documents``: (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if
    asked for, groups).  ``pairs``: (a, b, n_docs) of all linked id pairs."""

    documents: DataFrame
    pairs: DataFrame


def align(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    a_tokenizer: str | None = None,
    b_tokenizer: str | None = None,
    groups: bool = False,
) -> Alignment:
    """Aligns all texts.  With ``groups`` the groups themselves are kept beside their digest.

    To the driver and to all tasks go two vectors of the A vocabulary's length.
    """
    paths = a_tokenizer or default_tokenizer(), b_tokenizer or default_pieces()
    identity = _pair(*paths).identity
    blocks = materialize(_blocks(docs, key, text, paths, groups))
    regular = _vector(_identity_counts(blocks), len(identity))
    lists = blocks.where("codes is not null")
    irregular = materialize(
        lists.select(F.inline(F.arrays_zip("codes", "code_docs")))
        .groupBy(F.col("codes").alias("code"))
        .agg(F.sum("code_docs").alias("n"))
    )
    a_id = F.shiftright("code", B_BITS).alias("a")
    best = np.maximum(
        regular, _vector(irregular.groupBy(a_id).agg(F.max("n").alias("n")), len(identity))
    )
    # the counts of each block's own pairs go back to it; a block's list is bounded by its text
    back = (
        lists.select("block", F.explode("codes").alias("code"))
        .join(irregular, "code")
        .groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("code", "n"))).alias("counts"))
        .select("block", F.col("counts.code").alias("counted"), F.col("counts.n").alias("counts"))
    )
    shipped = docs.sparkSession.sparkContext.broadcast((regular, best))
    carried = ["keys", "n_a", "n_b", "n_groups", "n_links", "digest"] + ["groups"] * groups
    counted = lists.select(
        "block", *carried, "uses", "piece", "times", "piece_links", "links", "known"
    ).join(back, "block", "left")
    kind = blocks.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regular, best = shipped.value
        for batch in batches:
            for i in range(len(batch)):
                cell = lambda c: batch.column(c)[i]  # noqa: B023, E731
                packed = lambda c: _unpacked(cell(c).as_py())  # noqa: B023, E731
                # the count of every distinct pair of the block, then of its pieces' links
                known = np.frombuffer(cell("known").as_py(), "<i8")
                a = known >> B_BITS
                count = regular[a]
                counted = cell("counted").values
                if counted is not None:
                    count[np.searchsorted(known, counted.to_numpy())] = cell("counts").values.to_numpy()
                links, n_links = packed("links"), packed("piece_links")
                piece, times = packed("piece"), packed("times")
                first = (count == best[a]).astype(np.int64)
                uses = cell("uses").values.to_numpy()
                total = lambda x: _sums(_sums(x, n_links)[piece] * times, uses)  # noqa: B023, E731
                out = {c: cell(c).values for c in carried}
                out["n_best"] = pa.array(total(first[links]))
                out["count_sum"] = pa.array(total(count[links]))
                yield pa.record_batch(out)

    documents = counted.mapInArrow(
        run,
        f"keys {kind}, n_a long, n_b long, n_groups long, n_links long, digest string, "
        + "groups string, " * groups + "n_best long, count_sum long",
    ).withColumnsRenamed({"keys": key, "digest": "groups_sha256"})
    b_id = F.col("code").bitwiseAND(F.lit((1 << B_BITS) - 1))
    pairs = irregular.select(a_id, b_id.alias("b"), F.col("n").alias("n_docs")).unionByName(
        _identity_rows(docs, identity, regular)
    )
    return Alignment(documents, pairs)


def _identity_rows(docs: DataFrame, identity: np.ndarray, regular: np.ndarray) -> DataFrame:
    held = np.flatnonzero(regular)
    rows = zip(held.tolist(), identity[held].tolist(), regular[held].tolist())
    return docs.sparkSession.createDataFrame(list(rows), "a long, b long, n_docs long")
