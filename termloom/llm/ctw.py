"""Language-model scores by context-tree weighting over bytes.

The next byte is decomposed into its eight bits, so each context (the last d bytes, d from 0
to ``depth``) carries a binary tree of nodes.  A node has a Krichevsky-Trofimov estimate
from the training counts.  Its weighted probability is half that estimate and half the
product of its children, the contexts one byte longer, so every depth takes part:
P_w = (P_e + prod P_w(child)) / 2.  A text is coded with the counts of the training texts: a
bit's probability mixes the estimates along its context path with the weights that follow
from P_e : prod P_w(child), and the path ends at the longest context seen in training.
Minus log2 of the score, divided by the bytes, is the code length per byte.

How it is spread: texts are stored in blocks of about ``BLOCK_BYTES``.  A block lists its
distinct byte grams (context and next byte) and words; these lists are counted by key, the tree
is computed by Spark over subtrees that share the last two context bytes, and the
logarithm of each gram goes back to the blocks that asked for it.  What crosses the
network is one row for each distinct gram of a block, never a position; nothing is broadcast
but the nodes of depth 0 and 1, at most 65,536 each of three numbers.

A unigram word model over the same texts gives the base score.

Defined results: null text is the empty text (one end token); a null key counts as training;
repeated rows are counted and scored each; with no training text every bit costs one bit
and the base score is null; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import named, release_memory, text_of
from termloom.llm.encoding import slices
from termloom.llm.shingles import LOWER, translated
from termloom.session import discard, materialize

BLOCK_BYTES = 24 << 20
#: Text that is taken apart into grams at once; a gram takes about 70 bytes on the way.
SLICE_BYTES = 1 << 18
#: A byte that UTF-8 never holds: it pads the context before a text and ends the text.
EDGE = 0xFF
#: Depth at which the tree is dealt out by subtree.
CUT = 2


def log_gamma_half(n: np.ndarray) -> np.ndarray:
    """ln Gamma(n + 1/2) for whole n >= 0."""
    return _log_gamma(n + 0.5)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma by Stirling's series after shifting the argument above 8."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] += np.log(y[low])
        y[low] += 1
    inverse = 1 / y
    series = inverse / 12 - inverse**3 / 360 + inverse**5 / 1260 - inverse**7 / 1680
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a bit string with these counts."""
    return (
        log_gamma_half(zeros) + log_gamma_half(ones) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)
    )


class Nodes:
    """Nodes of one depth and bit level: sorted ids (context, bit prefix) and their counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, level: int):
        ids = keys >> np.uint64(8 - level)
        edge = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, int)
        bit = (keys >> np.uint64(7 - level)) & np.uint64(1)
        self.ids = ids[edge]
        self.total = np.add.reduceat(counts, edge) if len(edge) else np.zeros(0)
        self.ones = np.add.reduceat(counts * bit, edge) if len(edge) else np.zeros(0)
        self.log_kt = log_kt(self.total - self.ones, self.ones)
        self.one = (self.ones + 0.5) / (self.total + 1)
        self.below = np.zeros(len(edge))
        self.log_weighted = self.log_kt

    def weigh(self, below: np.ndarray) -> None:
        """Sets the weighted probability from the sum over the children."""
        self.below = below
        self.log_weighted = np.logaddexp(self.log_kt, below) - np.log(2)

    def place(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids)


def _at_depth(codes: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(codes & np.uint64((1 << 8 * (depth + 1)) - 1), return_inverse=True)
    return keys, np.bincount(where, counts, len(keys))


def _parent(ids: np.ndarray, depth: int, level: int) -> np.ndarray:
    """Ids of the nodes one byte of context shorter, for nodes of ``depth``."""
    return ids & np.uint64((1 << 8 * (depth - 1) + level) - 1)


def grow(
    codes: np.ndarray, counts: np.ndarray, first: int, last: int, deeper: list | None = None
) -> list[list[Nodes]]:
    """Nodes of the depths first..last, by depth and level, with weighted probabilities.

    ``deeper`` gives, for each level, the sum over children of the last depth's nodes;
    without it the last depth is the leaves.
    """
    tree = []
    for depth in range(first, last + 1):
        keys, n = _at_depth(codes, counts, depth)
        tree.append([Nodes(keys, n, level) for level in range(8)])
    for depth in range(last, first - 1, -1):
        for level in range(8):
            nodes = tree[depth - first][level]
            if depth < last:
                child = tree[depth + 1 - first][level]
                at = nodes.place(_parent(child.ids, depth + 1, level))
                nodes.weigh(np.bincount(at, child.log_weighted, len(nodes.ids)))
            elif deeper is not None:
                nodes.weigh(deeper[level](nodes.ids))
    return tree


class Path:
    """What a node hands to its children: the mix so far, the weight left, and its own end."""

    def __init__(self, mix: np.ndarray, left: np.ndarray, end: np.ndarray):
        self.mix, self.left, self.end = mix, left, end

    def take(self, at: np.ndarray) -> Path:
        return Path(self.mix[at], self.left[at], self.end[at])


def start(n: int) -> Path:
    return Path(np.zeros(n), np.ones(n), np.full(n, 0.5))


def step(nodes: Nodes, above: Path, leaf: bool) -> Path:
    """The path through nodes whose parents gave ``above``."""
    seen = nodes.total > 0
    end = np.where(seen, above.mix + above.left * nodes.one, above.end)
    if leaf:
        return Path(above.mix, above.left, end)
    # share of this depth: beta / (1 + beta) with ln beta = ln P_e - sum of the children
    share = 1 / (1 + np.exp(np.clip(nodes.below - nodes.log_kt, -700, 700)))
    share = np.where(seen, share, 0.0)
    return Path(
        above.mix + above.left * share * nodes.one, above.left * (1 - share), end
    )


def log_probabilities(codes: np.ndarray, counts: np.ndarray, depth: int, roots: list[Path] | None,
                      root_ids: list[np.ndarray] | None, first: int) -> np.ndarray:
    """log10 of the probability of each gram's byte, for whole subtrees from depth ``first``."""
    tree = grow(codes, counts, first, depth)
    out = np.zeros(len(codes))
    for level in range(8):
        path = None
        for d in range(first, depth + 1):
            nodes = tree[d - first][level]
            if d == first:
                if roots is None:
                    above = start(len(nodes.ids))
                else:
                    at = np.searchsorted(root_ids[level], _parent(nodes.ids, d, level))
                    above = roots[level].take(at)
            else:
                above = path.take(tree[d - 1 - first][level].place(_parent(nodes.ids, d, level)))
            path = step(nodes, above, d == depth)
        at = tree[-1][level].place(codes >> np.uint64(8 - level))
        one = path.end[at]
        bit = (codes >> np.uint64(7 - level)) & np.uint64(1)
        out += np.log10(np.where(bit == 1, one, 1 - one))
    return out


def gram_codes(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Code (context and byte) of every byte and of the end, and their number for each text."""
    lower = translated(texts, LOWER)
    _, offsets, data = lower.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(lower) + 1)
    n = np.diff(bounds)
    flat = np.full(int(n.sum()) + (depth + 1) * len(n) + depth, EDGE, np.uint8)
    # each text stands after ``depth`` edge bytes and before one
    at = np.arange(n.sum()) + np.repeat(np.arange(len(n)) * (depth + 1) + depth, n)
    flat[at] = np.frombuffer(data, np.uint8, int(bounds[-1]))
    begin = bounds[:-1] + np.arange(len(n)) * (depth + 1)
    wide = flat.astype(np.uint64)
    code = np.zeros(max(0, len(flat) - depth), np.uint64)
    for j in range(depth + 1):
        code = code << np.uint64(8) | wide[j:j + len(code)]
    own = np.repeat(begin, n + 1) + np.arange((n + 1).sum()) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
    return code[own], n + 1


def space_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words of the lower-cased texts, dictionary-encoded, and their number for each text."""
    lower = pc.ascii_trim_whitespace(translated(texts, LOWER))
    cut = pc.ascii_split_whitespace(lower)
    n = np.diff(cut.offsets.to_numpy().astype(np.int64))
    words = cut.flatten()
    empty = pc.equal(pc.binary_length(lower), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        words = words.filter(pa.array(~np.repeat(empty, n)))
        n = np.where(empty, 0, n)
    return words.dictionary_encode(), n


def stored_blocks(docs: DataFrame, key: str, text: str, train: Column) -> DataFrame:
    """(block, key, train, t): the texts with the block they belong to, written once."""
    slim = docs.select(
        named(key).alias("key"), F.coalesce(train, F.lit(True)).alias("train"), text_of(text).alias("t")
    )
    kind = slim.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 24, 0
        for batch in (s for b in batches for s in slices(b, "t")):
            size = batch.column("t").nbytes
            if held and held + size > BLOCK_BYTES:
                block, held = block + 1, 0
            held += size
            yield pa.record_batch(
                {
                    "block": pa.array(np.full(len(batch), block)),
                    **{c: batch.column(c) for c in ("key", "train", "t")},
                }
            )

    return materialize(slim.mapInArrow(run, f"block long, key {kind}, train boolean, t string"))


class _Lists:
    """Distinct grams and words of one block with their training counts."""

    def __init__(self) -> None:
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: list[pa.Array] = []
        self.word_counts: list[np.ndarray] = []

    def add(self, texts: pa.Array, train: np.ndarray, depth: int) -> None:
        codes, n = gram_codes(texts, depth)
        mine = np.repeat(train, n)
        seen, counts = np.unique(codes[mine], return_counts=True)
        rest = np.unique(codes[~mine])
        self.grams += [(seen, counts), (rest, np.zeros(len(rest), np.int64))]
        words, m = space_words(texts)
        counts = np.bincount(
            words.indices.to_numpy(), np.repeat(train, m).astype(float), len(words.dictionary)
        )
        self.words.append(words.dictionary)
        self.word_counts.append(counts)
        if len(self.grams) > 24:
            self.merge()
            release_memory()

    def merge(self) -> None:
        codes, where = np.unique(np.concatenate([g for g, _ in self.grams]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([c for _, c in self.grams]), len(codes))
        self.grams = [(codes, counts.astype(np.int64))]

    def batches(self, block: int) -> Iterator[pa.RecordBatch]:
        self.merge()
        codes, counts = self.grams[0]
        found = pa.concat_arrays(self.words).dictionary_encode()
        words, total = found.dictionary, np.bincount(
            found.indices.to_numpy(), np.concatenate(self.word_counts), len(found.dictionary)
        ).astype(np.int64)
        most = 100_000
        for i in range(0, len(codes), most):
            part = codes[i:i + most]
            yield pa.record_batch(
                {
                    "block": pa.array(np.full(len(part), block)),
                    "gram": pa.array(part.astype(np.int64)),
                    "word": pa.nulls(len(part), pa.string()),
                    "n": pa.array(counts[i:i + most]),
                }
            )
        for i in range(0, len(words), most):
            part = words.slice(i, most)
            yield pa.record_batch(
                {
                    "block": pa.array(np.full(len(part), block)),
                    "gram": pa.nulls(len(part), pa.int64()),
                    "word": part.cast(pa.string()),
                    "n": pa.array(total[i:i + most]),
                }
            )


def block_lists(stored: DataFrame, depth: int) -> DataFrame:
    """(block, gram or word, training count), one row for each distinct one of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, lists = None, _Lists()
        for batch in (s for b in batches for s in slices(b, "t", SLICE_BYTES)):
            blocks = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(edges, edges[1:]):
                if b == a:
                    continue
                if block is not None and blocks[a] != block:
                    yield from lists.batches(block)
                    lists = _Lists()
                block = int(blocks[a])
                part = batch.slice(a, b - a)
                lists.add(
                    part.column("t"), part.column("train").to_numpy(zero_copy_only=False), depth
                )
        if block is not None:
            yield from lists.batches(block)

    return stored.select("block", "train", "t").mapInArrow(
        run, "block long, gram long, word string, n long"
    )


def _whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted codes and counts of a partition."""
    tables = [(b.column("gram").to_numpy(), b.column("n").to_numpy()) for b in batches]
    if not tables:
        return np.zeros(0, np.uint64), np.zeros(0)
    codes = np.concatenate([t[0] for t in tables]).astype(np.uint64)
    counts = np.concatenate([t[1] for t in tables]).astype(float)
    order = np.argsort(codes)
    return codes[order], counts[order]


def gram_scores(counted: DataFrame, depth: int) -> DataFrame:
    """(gram, logp) from (gram, n): log10 of the weighted probability of each gram's byte."""
    spark = counted.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = F.col("gram").bitwiseAND(((1 << 8 * CUT) - 1) << 8)
    dealt = counted.repartition(parts, cut)

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = _whole(batches)
        if not len(codes):
            return
        top = grow(codes, counts, CUT, depth)[0]
        for level in range(8):
            ids, where = np.unique(_parent(top[level].ids, CUT, level), return_inverse=True)
            sums = np.bincount(where, top[level].log_weighted, len(ids))
            yield pa.record_batch(
                {
                    "level": pa.array(np.full(len(ids), level, np.int32)),
                    "id": pa.array(ids.astype(np.int64)),
                    "below": pa.array(sums),
                }
            )

    # both tables are bounded by the number of nodes of depth 1
    below = (
        dealt.mapInArrow(roots, "level int, id long, below double")
        .groupBy("level", "id").agg(F.sum("below").alias("below")).toPandas()
    )
    pairs = (
        counted.groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("gram"))
        .agg(F.sum("n").alias("n")).toPandas()
    )
    codes = pairs["gram"].to_numpy(np.uint64)
    order = np.argsort(codes)
    deeper = []
    for level in range(8):
        mine = below[below["level"] == level].sort_values("id")
        ids, sums = mine["id"].to_numpy(np.uint64), mine["below"].to_numpy(float)
        deeper.append(lambda at, ids=ids, sums=sums: sums[np.searchsorted(ids, at)])
    top = grow(codes[order], pairs["n"].to_numpy(float)[order], 0, CUT - 1, deeper)
    paths, ids = [], []
    for level in range(8):
        path = step(top[0][level], start(len(top[0][level].ids)), False)
        for d in range(1, CUT):
            nodes = top[d][level]
            at = top[d - 1][level].place(_parent(nodes.ids, d, level))
            path = step(nodes, path.take(at), False)
        paths.append(path)
        ids.append(top[CUT - 1][level].ids)
    sent = spark.sparkContext.broadcast((paths, ids))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts = _whole(batches)
        if len(codes):
            paths, ids = sent.value
            logs = log_probabilities(codes, counts, depth, paths, ids, CUT)
            for i in range(0, len(codes), 100_000):
                yield pa.record_batch(
                    {
                        "gram": pa.array(codes[i:i + 100_000].astype(np.int64)),
                        "logp": pa.array(logs[i:i + 100_000]),
                    }
                )

    return dealt.mapInArrow(finish, "gram long, logp double")


#: Scored grams that a task packs together.
PACKED_GRAMS = 1 << 20


def _packed_scores(scored: DataFrame) -> DataFrame:
    """(block, grams, logs): one row for each block and task instead of one for each gram.

    ``grams`` are the differences of the sorted codes, which compress well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            block, gram = table["block"].to_numpy(), table["gram"].to_numpy()
            order = np.lexsort((gram, block))
            block, gram, logs = block[order], gram[order], table["logp"].to_numpy()[order]
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            spans = list(zip(edges, edges[1:]))
            return pa.record_batch(
                {
                    "block": pa.array([int(block[a]) for a, _ in spans], pa.int64()),
                    "grams": pa.array(
                        [np.diff(gram[a:b], prepend=0).astype("<i8").tobytes() for a, b in spans], pa.binary()
                    ),
                    "logs": pa.array([logs[a:b].astype("<f8").tobytes() for a, b in spans], pa.binary()),
                }
            )

        n = 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                n += len(batch)
            if n >= PACKED_GRAMS:
                yield packed()
                held, n = [], 0
        if held:
            yield packed()

    return scored.mapInArrow(run, "block long, grams binary, logs binary")


def scores(
    docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", depth: int = 5
) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every text.

    ``train`` marks the rows of ``docs`` to learn from.  ``score`` is log10 of the model's
    probability of the whole lower-cased text with its end.
    """
    if not CUT <= depth <= 6:
        raise ValueError(f"depth must lie between {CUT} and 6")
    stored = stored_blocks(docs, key, text, train)
    kind = stored.schema["key"].dataType.simpleString()
    lists = materialize(block_lists(stored, depth))
    grams = lists.where("gram is not null").select("block", "gram", "n")
    words = lists.where("word is not null").select("block", "word", "n")
    counted = materialize(grams.groupBy("gram").agg(F.sum("n").alias("n")))
    tallied = materialize(words.groupBy("word").agg(F.sum("n").alias("c")))
    ends = stored.agg(F.count_if("train")).first()[0]
    seen = tallied.where("c > 0").agg(F.sum("c"), F.count(F.lit(1))).first()
    total = (seen[0] or 0) + ends
    distinct = seen[1] + (ends > 0)
    scored = materialize(gram_scores(counted, depth))
    discard(counted)
    packed = materialize(
        _packed_scores(grams.join(scored, "gram").select("block", "gram", "logp"))
    )
    discard(scored)
    told = materialize(
        words.join(tallied, "word").groupBy("block").agg(
            F.collect_list("word").alias("words"), F.collect_list("c").alias("counts")
        )
    )
    discard(lists, tallied)
    back = packed.unionByName(told, allowMissingColumns=True)

    def run(own: pa.Table, asked: pa.Table) -> pa.Table:
        g = asked.filter(pc.is_valid(asked.column("grams")))
        codes = np.concatenate(
            [np.cumsum(np.frombuffer(x, "<i8")) for x in g.column("grams").to_pylist()] or [[]]
        ).astype(np.uint64)
        logs = np.concatenate(
            [np.frombuffer(x, "<f8") for x in g.column("logs").to_pylist()] or [[]]
        )
        order = np.argsort(codes)
        codes, logs = codes[order], logs[order]
        w = asked.filter(pc.is_valid(asked.column("words")))
        known = pc.list_flatten(w.column("words")).combine_chunks().cast(pa.large_string())
        counts = pc.list_flatten(w.column("counts")).to_numpy()
        out = []
        for batch in own.combine_chunks().to_batches():
            for part in slices(batch, "t", SLICE_BYTES):
                own_codes, n = gram_codes(part.column("t"), depth)
                at = np.searchsorted(codes, own_codes)
                if not (codes[np.minimum(at, len(codes) - 1)] == own_codes).all():
                    raise ValueError("a gram of the block has no score")
                found = logs[at]
                first = np.cumsum(n) - n
                score = np.add.reduceat(found, first)
                ws, m = space_words(part.column("t"))
                place = pc.index_in(ws.dictionary, value_set=known)
                c = counts[place.to_numpy()][ws.indices.to_numpy()] if len(ws.dictionary) else np.zeros(0)
                # the end token closes every text
                c = np.insert(c.astype(np.int64), np.cumsum(m), ends)
                first = np.cumsum(m + 1) - (m + 1)
                if total:
                    base = np.add.reduceat(
                        np.log10((c + 0.5) / (total + 0.5 * (distinct + 1))), first
                    )
                else:
                    base = np.full(len(m), np.nan)
                out.append(
                    pa.record_batch(
                        {
                            "key": part.column("key"),
                            "n_tokens": pa.array(m + 1),
                            "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), first)),
                            "train_tokens": pa.array(np.full(len(m), total, np.int64)),
                            "base_score": pa.array(base, from_pandas=True),
                            "score": pa.array(score),
                            "n_bytes": pa.array(n - 1),
                        }
                    )
                )
        release_memory()
        if not out:  # a block without rows of its own cannot ask for anything
            raise ValueError("scores without texts")
        return pa.Table.from_batches(out)

    return (
        stored.groupBy("block")
        .cogroup(back.groupBy("block"))
        .applyInArrow(
            run,
            f"key {kind}, n_tokens long, n_known long, train_tokens long, base_score double, "
            "score double, n_bytes long",
        )
        .withColumnRenamed("key", key)
    )
