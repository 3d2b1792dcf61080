"""Hard negatives by exact inner products over Hilbert-ordered blocks with zone maps.

Components become whole numbers floor(scale * x).  Rows are sorted by label and by their
place on a Hilbert curve through the dimensions of largest variance, and cut into blocks of
bounded bytes; each block is one Parquet row with the least and greatest value of every
dimension and of the label.  By interval arithmetic these bound the inner product of an
anchor with any row of the block from both sides.

An anchor's own block gives first positives and so a score that other blocks must reach to
be read.  The positives found set the windows of scores for negatives; a block is read for
an anchor only if its bounds meet one of the windows and it holds another label.  Anchors
travel in slices of bounded size to the blocks that need them, each such meeting returns a
few rows for each anchor, and a window over the anchors keeps the best.

Defined results: rows with a null id, label or vector, or with a null or non-finite component,
take no part; shorter vectors are filled up with zeros.  Rows that repeat an id are rows of
their own: each is a candidate, and each is an anchor if the id is one's.  Equal scores are
ordered by id.  Without a row in its window a positive has no row in the result.  An empty
table gives an empty table; other columns are not looked at.  Numbers whose inner products
could leave 64 bits are refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import named
from termloom.session import materialize

# Bytes of vectors in a block, and anchors in a slice.
BLOCK_BYTES = 1 << 20
SLICE_ANCHORS = 1024
# Dimensions of the curve, and bits of each.
CURVE_DIMS, CURVE_BITS = 12, 5
# Zone maps of so many blocks are tested together; up to this size they are broadcast.
ZONES_TOGETHER = 1024
ZONE_LIMIT_BYTES = 32 << 20
# Bits of a row's number: block counter and place in the block, below the partition.
BLOCK_BITS, PLACE_BITS = 24, 20
# Anchors whose scores with one block are held at once.
_ROWS = 64

LEAST = np.iinfo(np.int64).min


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cells (rows x dimensions, below 2**bits)."""
    x = [column.astype(np.int64) for column in cells.T]
    if not x:
        return np.zeros(len(cells), np.int64)
    for low in range(bits - 1, 0, -1):
        below = (1 << low) - 1
        for i in range(len(x)):
            upper = x[i] >> low & 1 == 1
            change = (x[0] ^ x[i]) & below
            if i:
                x[i] = np.where(upper, x[i], x[i] ^ change)
            x[0] = np.where(upper, x[0] ^ below, x[0] ^ (change if i else 0))
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(len(cells), np.int64)
    for low in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> low & 1 == 1, (1 << low) - 1, 0)
    key = np.zeros(len(cells), np.int64)
    for bit in range(bits - 1, -1, -1):
        for column in x:
            key = key << 1 | (column ^ turn) >> bit & 1
    return key


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two tables of whole numbers, exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:  # doubles hold every partial sum
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of ``a`` with a vector in each box."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


@dataclass(frozen=True)
class _Shape:
    """What the tasks must know of the table: width, type and curve."""

    width: int
    kind: str
    dims: tuple[int, ...]
    low: tuple[int, ...]
    high: tuple[int, ...]

    def matrix(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, self.kind).reshape(-1, self.width)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        low, high = np.array(self.low, np.int64), np.array(self.high, np.int64)
        at = (vectors[:, list(self.dims)].astype(np.float64) - low) / (high - low + 1.0)
        return hilbert_keys((at * (1 << CURVE_BITS)).astype(np.int64), CURVE_BITS)


def _shape(rows: DataFrame) -> _Shape | None:
    """One row for each dimension of the vectors; None without any vector."""
    widest = rows.agg(F.max(F.size("v"))).first()[0]
    if widest is None:
        return None
    found = (
        rows.select(F.posexplode("v").alias("dim", "x")).groupBy("dim")
        .agg(F.min("x").alias("low"), F.max("x").alias("high"), F.var_pop("x").alias("spread"))
        .collect()
    )
    most = max((max(abs(r["low"]), abs(r["high"])) for r in found), default=0)
    if 4 * widest * most**2 >= 2**63:
        raise ValueError("inner products of these components may not fit 64 bits")
    curve = sorted((r for r in found if r["high"] > r["low"]), key=lambda r: (-r["spread"], r["dim"]))
    curve = curve[:CURVE_DIMS]
    return _Shape(
        max(widest, 1), "<i4" if most < 2**31 else "<i8", tuple(r["dim"] for r in curve),
        tuple(r["low"] for r in curve), tuple(r["high"] for r in curve),
    )


def _dense(column: pa.Array, shape: _Shape) -> np.ndarray:
    """Lists of components as one table, filled up with zeros."""
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), shape.width), shape.kind)
    out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = (
        column.flatten().to_numpy(zero_copy_only=False)
    )
    return out


def _raw(rows: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in np.ascontiguousarray(rows)]


def _keyed(rows: DataFrame, shape: _Shape) -> DataFrame:
    """(label, key, id, anchor, v as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _dense(batch.column("v"), shape)
            yield pa.record_batch(
                {
                    "label": batch.column("label"), "key": pa.array(shape.keys(vectors)),
                    "id": batch.column("id"), "anchor": batch.column("anchor"),
                    "v": pa.array(_raw(vectors), pa.binary()),
                }
            )

    return rows.select("id", "label", "anchor", "v").mapInArrow(
        run, "label long, key long, id long, anchor boolean, v binary"
    )


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """A partition's rows in order, ``most`` at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        at = 0
        while at < len(batch):
            part = batch.slice(at, most - n)
            held.append(part)
            n, at = n + len(part), at + len(part)
            if n == most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _joined(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def _blocks(keyed: DataFrame, shape: _Shape) -> DataFrame:
    """Blocks of neighbours on the curve with their zone maps, written once."""
    row_bytes = shape.width * np.dtype(shape.kind).itemsize
    most = max(1, min(BLOCK_BYTES // row_bytes, 1 << PLACE_BITS))
    ordered = keyed.repartitionByRange("label", "key", "id").sortWithinPartitions(
        "label", "key", "id", "v"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << BLOCK_BITS
        for rows in _runs(batches, most):
            raw = _joined(rows["v"])
            vectors = shape.matrix(raw)
            labels = rows["label"].to_numpy()
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "block": block, "label_low": int(labels.min()), "label_high": int(labels.max()),
                        "low": vectors.min(axis=0).tobytes(), "high": vectors.max(axis=0).tobytes(),
                        "ids": rows["id"].to_numpy().tobytes(), "labels": labels.tobytes(),
                        "anchors": rows["anchor"].to_numpy(zero_copy_only=False).tobytes(),
                        "vectors": raw,
                    }
                ],
                schema=_schema(
                    block="l", label_low="l", label_high="l", low="b", high="b", ids="b",
                    labels="b", anchors="b", vectors="b",
                ),
            )
            block += 1

    return materialize(
        ordered.mapInArrow(
            run,
            "block long, label_low long, label_high long, low binary, high binary, ids binary, "
            "labels binary, anchors binary, vectors binary",
        )
    )


def _schema(**kinds: str) -> pa.Schema:
    return pa.schema([(c, pa.int64() if k == "l" else pa.binary()) for c, k in kinds.items()])


def _places(groups: np.ndarray) -> np.ndarray:
    """Place of each item inside its group; the groups come in rising order."""
    first = np.flatnonzero(np.diff(groups, prepend=-1))
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.append(first, len(groups))))


def _best(
    scores: np.ndarray, usable: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` best usable scores of each row, from ``floor`` on, in order."""
    shown = np.where(usable, scores, LEAST)
    if shown.shape[1] > k:
        floor = np.maximum(floor, np.partition(shown, -k, axis=1)[:, -k])
    row, column = np.nonzero(usable & (shown >= floor[:, None]))
    order = np.lexsort((ids[column], -scores[row, column], row))
    row, column = row[order], column[order]
    first = _places(row) < k
    return row[first], column[first]


def _anchors(blocks: DataFrame, shape: _Shape, k: int) -> DataFrame:
    """(anchor, home, id, label, v, near): every anchor with the best of its own block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (b.slice(i, 1) for b in batches for i in range(len(b))):
            own = lambda c, t: np.frombuffer(block.column(c)[0].as_py(), t)  # noqa: B023, E731
            ids, labels, vectors = own("ids", "<i8"), own("labels", "<i8"), shape.matrix(own("vectors", shape.kind))
            number = block.column("block")[0].as_py()
            for place in _pieces(np.flatnonzero(own("anchors", "?"))):
                scores = products(vectors[place], vectors)
                usable = labels[place, None] == labels
                usable[np.arange(len(place)), place] = False
                row, column = _best(scores, usable, ids, k, np.full(len(place), LEAST))
                near = [[] for _ in place]
                for i, j in zip(row.tolist(), column.tolist()):
                    near[i].append({"score": int(scores[i, j]), "id": int(ids[j])})
                yield pa.record_batch(
                    {
                        "anchor": pa.array((number << PLACE_BITS) + place),
                        "home": pa.array(np.full(len(place), number)),
                        "id": pa.array(ids[place]), "label": pa.array(labels[place]),
                        "v": pa.array(_raw(vectors[place]), pa.binary()),
                        "near": pa.array(
                            near, pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64())]))
                        ),
                    }
                )

    return materialize(
        blocks.select("block", "ids", "labels", "anchors", "vectors").mapInArrow(
            run,
            "anchor long, home long, id long, label long, v binary, "
            "near array<struct<score:bigint,id:bigint>>",
        )
    )


def _pieces(places: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(places), _ROWS):
        yield places[at:at + _ROWS]


_SLICE = ("anchors", "homes", "ids", "labels", "vectors", "n_given", "given_ids", "given_scores")


def _slices(anchors: DataFrame) -> DataFrame:
    """Neighbouring anchors in rows of bounded size, each with the rows given for it."""
    ordered = anchors.select(
        "anchor", "home", "id", "label", "v", F.col("near.id").alias("near_ids"),
        F.col("near.score").alias("near_scores"),
    ).repartitionByRange("anchor").sortWithinPartitions("anchor")
    most = SLICE_ANCHORS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, most):
            flat = lambda c: np.array([x for r in rows[c].to_pylist() for x in r], "<i8").tobytes()  # noqa: B023, E731
            whole = lambda c: rows[c].to_numpy().tobytes()  # noqa: B023, E731
            row = {
                "anchors": whole("anchor"), "homes": whole("home"), "ids": whole("id"),
                "labels": whole("label"), "vectors": _joined(rows["v"]),
                "n_given": np.array([len(r) for r in rows["near_ids"].to_pylist()], "<i8").tobytes(),
                "given_ids": flat("near_ids"), "given_scores": flat("near_scores"),
            }
            yield pa.RecordBatch.from_pylist([row], schema=_schema(**dict.fromkeys(_SLICE, "b")))

    return materialize(ordered.mapInArrow(run, ", ".join(f"{c} binary" for c in _SLICE)))


@dataclass(frozen=True)
class _Asked:
    """A slice of anchors, or the part of one that a block is read for."""

    anchors: np.ndarray
    homes: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    n_given: np.ndarray
    given_ids: np.ndarray
    given_scores: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch, i: int, shape: _Shape) -> _Asked:
        raw = {c: batch.column(c)[i].as_py() for c in _SLICE}
        return cls(**{
            c: shape.matrix(raw[c]) if c == "vectors" else np.frombuffer(raw[c], "<i8") for c in _SLICE
        })

    def take(self, members: np.ndarray) -> dict[str, bytes]:
        kept = np.zeros(len(self.ids), bool)
        kept[members] = True
        given = np.repeat(kept, self.n_given)
        return {
            c: getattr(self, c)[given if c.startswith("given") else members].tobytes() for c in _SLICE
        }

    def given(self, k: int, missing: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the given rows, k to an anchor; ``missing`` where there are fewer."""
        ids, scores = np.full((2, len(self.ids), k), missing, np.int64)
        at = np.repeat(np.arange(len(self.ids)), self.n_given), _places(
            np.repeat(np.arange(len(self.ids)), self.n_given)
        )
        ids[at], scores[at] = self.given_ids, self.given_scores
        return ids, scores


def _zones(blocks: DataFrame) -> tuple[DataFrame, int, bool]:
    """Zone maps in chunks, the number of chunks, and whether they are small by measure."""
    n, size = blocks.agg(
        F.count(F.lit(1)), F.sum(F.octet_length("low") + F.octet_length("high") + 24)
    ).first()
    chunks = -(-n // ZONES_TOGETHER)
    zones = (
        blocks.select(
            F.pmod(F.xxhash64("block"), F.lit(chunks)).alias("chunk"),
            F.struct("block", "label_low", "label_high", "low", "high").alias("zone"),
        )
        .groupBy("chunk").agg(F.collect_list("zone").alias("zones"))
    )
    return zones, chunks, (size or 0) <= ZONE_LIMIT_BYTES


def _routed(
    slices: DataFrame, zones: tuple[DataFrame, int, bool], shape: _Shape,
    needed: Callable[[_Asked, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray],
) -> DataFrame:
    """For each block the anchors that must see it, by its zone map alone."""
    table, chunks, small = zones
    dealt = slices.withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))
    )
    met = dealt.join(F.broadcast(table) if small else table, "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                asked = _Asked.read(batch, i, shape)
                zones = batch.column("zones")[i].as_py()
                one = lambda c: np.array([z[c] for z in zones], np.int64)  # noqa: B023, E731
                box = lambda c: shape.matrix(b"".join(z[c] for z in zones))  # noqa: B023, E731
                least, greatest = bounds(asked.vectors, box("low"), box("high"))
                block = one("block")
                meets = needed(asked, block, one("label_low"), one("label_high"), least, greatest)
                for j in np.flatnonzero(meets.any(axis=0)):
                    row = asked.take(np.flatnonzero(meets[:, j]))
                    yield pa.RecordBatch.from_pylist(
                        [{"block": int(block[j]), **row}],
                        schema=_schema(block="l", **dict.fromkeys(_SLICE, "b")),
                    )

    return met.select(*_SLICE, "zones").mapInArrow(
        run, "block long, " + ", ".join(f"{c} binary" for c in _SLICE)
    )


def _read(
    routed: DataFrame, blocks: DataFrame, shape: _Shape, schema: str,
    found: Callable[..., Iterator[dict[str, np.ndarray]]],
) -> DataFrame:
    """What ``found`` makes of each block and the anchors that were sent to it."""
    held = blocks.select(
        "block", F.col("ids").alias("row_ids"), F.col("labels").alias("row_labels"),
        F.col("vectors").alias("row_vectors"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                own = lambda c: batch.column(c)[i].as_py()  # noqa: B023, E731
                asked = _Asked.read(batch, i, shape)
                ids, labels = np.frombuffer(own("row_ids"), "<i8"), np.frombuffer(own("row_labels"), "<i8")
                rows = shape.matrix(own("row_vectors"))
                for members in _pieces(np.arange(len(asked.ids))):
                    scores = products(asked.vectors[members], rows)
                    same = asked.labels[members, None] == labels
                    for made in found(asked, members, scores, same, ids):
                        yield pa.record_batch({c: pa.array(x) for c, x in made.items()})

    return routed.join(held, "block").drop("block").mapInArrow(run, schema)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    low_percent: int = 80,
    high_percent: int = 100,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` says which rows are anchors.  For each anchor and each of its best rows of the
    same label: the best rows of other labels whose score is between the two percentages of
    the positive's score, both included.  Ids and labels are whole numbers.
    """
    given = named(vector).cast("array<double>")
    fit = F.forall(given, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        named(key).cast("long").alias("id"), named(label).cast("long").alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
        F.when(fit, F.transform(given, lambda x: F.floor(x * scale).cast("long"))).alias("v"),
    ).where("id is not null and label is not null and v is not null")
    schema = (
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, "
        "negative_score long"
    )
    shape = _shape(rows)
    if shape is None:
        return vectors.sparkSession.createDataFrame([], schema)
    blocks = _blocks(_keyed(rows, shape), shape)
    zones = _zones(blocks)
    near = _anchors(blocks, shape, positives)

    def may_hold_positives(asked, block, label_low, label_high, least, greatest):
        _, scores = asked.given(positives, LEAST)
        own = asked.labels[:, None]
        return (
            (label_low <= own) & (own <= label_high) & (greatest >= scores[:, -1:])
            & (block != asked.homes[:, None])
        )

    def more_positives(asked, members, scores, same, ids):
        floor = asked.given(positives, LEAST)[1][members, -1]
        row, column = _best(scores, same, ids, positives, floor)
        yield {"anchor": asked.anchors[members][row], "score": scores[row, column], "id": ids[column]}

    others = _read(
        _routed(_slices(near), zones, shape, may_hold_positives), blocks, shape,
        "anchor long, score long, id long", more_positives,
    )
    first = _first(
        near.select("anchor", F.inline("near")).unionByName(others), ["anchor"], "score", "id", positives
    )
    chosen = materialize(
        first.groupBy("anchor").agg(
            F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("near")
        )
    )

    def windows(asked):
        """Least and greatest score of each anchor's windows; an empty one without a positive."""
        ids, scores = asked.given(positives, LEAST)
        there = np.arange(positives) < asked.n_given[:, None]
        safe = np.where(there, scores, 0)
        low = np.where(there, -(-safe * low_percent // 100), 1)
        return ids, scores, low, np.where(there, safe * high_percent // 100, 0)

    def may_hold_negatives(asked, block, label_low, label_high, least, greatest):
        _, _, low, high = windows(asked)
        other = (label_low != asked.labels[:, None]) | (label_high != asked.labels[:, None])
        meets = np.zeros(least.shape, bool)
        for w in range(positives):
            open_ = (low[:, w] <= high[:, w])[:, None]
            meets |= open_ & (greatest >= low[:, w, None]) & (least <= high[:, w, None])
        return meets & other

    def more_negatives(asked, members, scores, same, ids):
        positive, positive_score, low, high = (x[members] for x in windows(asked))
        open_ = low <= high
        least = np.where(open_, low, np.iinfo(np.int64).max).min(axis=1)
        most = np.where(open_, high, LEAST).max(axis=1)
        row, column = np.nonzero(~same & (scores >= least[:, None]) & (scores <= most[:, None]))
        score = scores[row, column]
        order = np.lexsort((ids[column], -score, row))
        row, column, score = row[order], column[order], score[order]
        for w in range(positives):
            inside = np.flatnonzero((score >= low[row, w]) & (score <= high[row, w]))
            inside = inside[_places(row[inside]) < negatives]
            anchor = row[inside]
            yield {
                "anchor": asked.anchors[members][anchor], "place": np.full(len(anchor), w),
                "anchor_id": asked.ids[members][anchor], "positive_id": positive[anchor, w],
                "positive_score": positive_score[anchor, w], "negative_id": ids[column[inside]],
                "negative_score": score[inside],
            }

    asked = near.drop("near").join(chosen, "anchor")
    met = _read(
        _routed(_slices(asked), zones, shape, may_hold_negatives), blocks, shape,
        "anchor long, place long, anchor_id long, positive_id long, positive_score long, "
        "negative_id long, negative_score long",
        more_negatives,
    )
    ranked = _first(met, ["anchor", "place"], "negative_score", "negative_id", negatives)
    return ranked.select(*[c.split()[0] for c in schema.split(", ")])


def _first(rows: DataFrame, group: list[str], score: str, key: str, k: int) -> DataFrame:
    """The ``k`` best rows of each group; tasks drop the others before the shuffle."""
    order = Window.partitionBy(*group).orderBy(F.desc(score), F.asc(key))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
