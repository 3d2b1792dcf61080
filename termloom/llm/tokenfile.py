"""Token ids of documents in shard rows with a minimal perfect hash index.

Documents are ordered by key over range partitions, encoded, and written as shards of
about ``shard_ids`` ids (or one longer document).  A shard is one row of a Parquet table,
so that any store that Spark reaches can hold it, with raw little-endian fields:

=============  ==============================================================
part, shard    place of the shard in the global order
first, last    least and largest key, for finding the shard of a key
start          ids in this range partition before the shard
keys           the keys in order
shift, prints  displacements and fingerprints of the perfect hash of the keys
entry          for each slot: number of the first document with that key, and count
offset         for each document: ids before it in the shard, one more at the end
ids            the ids, unsigned 32 bits
=============  ==============================================================

Reading a key costs two hashes, one fingerprint and one slice of ``ids``.  The ranges are
cut from the keys and a row number, so a key with very many rows spreads over partitions.

Defined results: null text is the end id alone; null keys come first; rows that repeat
a key follow each other in input order and are found together; an empty table writes an
empty file set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import named, text_of
from termloom.llm.encoding import default_tokenizer, encoder, slices
from termloom.llm.mph import build, slot

SHARD_TYPE = (
    "part int, shard int, first {kind}, last {kind}, start long, n_ids long, keys array<{kind}>, "
    "shift binary, prints binary, entry binary, offset binary, ids binary"
)


def key_bytes(key: object) -> bytes:
    return b"" if key is None else b"k" + str(key).encode()


def _shard(
    part: int, number: int, start: int, keys: pa.Array, ids: np.ndarray, counts: np.ndarray
) -> dict:
    plain = keys.to_pylist()
    first: dict[bytes, list[int]] = {}
    for i, key in enumerate(plain):
        at = first.setdefault(key_bytes(key), [i, 0])
        at[1] += 1
    shift, prints = build(list(first))
    entry = np.zeros((len(first), 2), "<u4")
    for key, at in first.items():
        entry[slot(key, shift, prints)] = at
    offset = np.concatenate([[0], np.cumsum(counts)])
    return {
        "part": part, "shard": number, "first": plain[0], "last": plain[-1], "start": start,
        "n_ids": int(offset[-1]), "keys": plain, "shift": shift.astype("<i4").tobytes(),
        "prints": prints.astype("<u4").tobytes(), "entry": entry.tobytes(),
        "offset": offset.astype("<i8").tobytes(), "ids": ids.astype("<u4").tobytes(),
    }


class _Pending:
    """Encoded documents that wait for their shard to be full."""

    def __init__(self, shard_ids: int):
        self.most = shard_ids
        self.keys: list[pa.Array] = []
        self.ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.n_ids = 0

    def add(self, keys: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.ids.append(ids)
        self.counts.append(counts)
        self.n_ids += len(ids)

    def cut(self, last: bool) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """Full shards, at the end also what is left; a longer document is a shard of its own."""
        if not self.keys or not (last or self.n_ids > self.most):
            return
        keys, ids, counts = pa.concat_arrays(self.keys), np.concatenate(self.ids), np.concatenate(self.counts)
        upto = np.cumsum(counts)
        at = done = 0
        while at < len(counts):
            end = max(at + 1, int(np.searchsorted(upto, done + self.most, "right")))
            if end == len(counts) and not last:
                break
            yield keys.slice(at, end - at), ids[done:upto[end - 1]], counts[at:end]
            at, done = end, int(upto[end - 1])
        self.keys, self.ids, self.counts = [keys.slice(at)], [ids[done:].copy()], [counts[at:]]
        self.n_ids = len(self.ids[0])


def write(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end_id: int = 2,
    shard_ids: int = 1 << 20,
    partitions: int | None = None,
) -> None:
    """Encodes all documents and writes the shard table to ``path``."""
    where = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(
        named(key).alias("key"), text_of(text).alias("t"), F.monotonically_increasing_id().alias("row")
    )
    ordered = slim.repartitionByRange(partitions, "key", "row").sortWithinPartitions("key", "row")
    kind = slim.schema["key"].dataType
    schema = SHARD_TYPE.format(kind=kind.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(where, by_rank=True).encode
        part = TaskContext.get().partitionId()
        number = start = 0
        pending = _Pending(shard_ids)
        shape = None

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, start
            for keys, ids, counts in pending.cut(last):
                row = _shard(part, number, start, keys, ids, counts)
                number += 1
                start += row["n_ids"]
                yield pa.RecordBatch.from_pylist([row], schema=shape)

        for batch in (s for b in batches for s in slices(b, "t")):
            if shape is None:
                kt = batch.schema.field("key").type
                shape = pa.schema(
                    [("part", pa.int32()), ("shard", pa.int32()), ("first", kt), ("last", kt),
                     ("start", pa.int64()), ("n_ids", pa.int64()), ("keys", pa.list_(kt)),
                     *[(c, pa.binary()) for c in ("shift", "prints", "entry", "offset", "ids")]]
                )
            flat, widths = encode(batch.column("t"))
            pending.add(
                batch.column("key"), np.insert(flat, np.cumsum(widths), np.uint32(end_id)), widths + 1
            )
            yield from rows(False)
        if shape is not None:
            yield from rows(True)

    ordered.drop("row").mapInArrow(run, schema).write.parquet(path)


def _decoded(batch: pa.RecordBatch, i: int) -> dict:
    kinds = {"shift": "<i4", "prints": "<u4", "entry": "<u4", "offset": "<i8", "ids": "<u4"}
    out = {c: np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in kinds.items()}
    out["entry"] = out["entry"].reshape(-1, 2)
    return out


def _records(shard: dict, key: object) -> range:
    """The documents of a shard with a key, by the perfect hash."""
    at = slot(key_bytes(key), shard["shift"], shard["prints"])
    if at < 0:
        return range(0)
    first, count = shard["entry"][at].tolist()
    return range(first, first + count)


def part_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids of all documents in earlier range partitions, for each range partition."""
    sizes = (
        spark.read.parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part")
    ).collect()
    starts, before = {}, 0
    for part, n in sizes:
        starts[part] = before
        before += n
    return starts


def read(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids) of all documents, each found by its key.

    ``start`` counts the ids of all documents before it.  A scan of the shards: the tasks get
    one number for each range partition.
    """
    starts = part_starts(spark, path)
    table = spark.read.parquet(path)
    kind = table.schema["first"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                shard = _decoded(batch, i)
                keys = batch.column("keys")[i].values
                plain = keys.to_pylist()
                begun = starts[batch.column("part")[i].as_py()] + batch.column("start")[i].as_py()
                place, previous = [], None
                for number, key in enumerate(plain):
                    if number and key == previous:
                        place.append(place[-1] + 1)
                    else:
                        found = _records(shard, key)
                        if number not in found:
                            raise ValueError(f"the index does not lead to key {key!r}")
                        place.append(number)
                    previous = key
                offset = shard["offset"]
                n = np.diff(offset)
                ids = shard["ids"].tobytes()
                yield pa.record_batch(
                    {
                        "key": keys,
                        "start": pa.array(begun + offset[place]),
                        "n_tokens": pa.array(n[place]),
                        "ids": pa.array(
                            [ids[4 * int(offset[p]):4 * int(offset[p + 1])] for p in place],
                            pa.binary(),
                        ),
                    }
                )

    return table.select(
        "part", "start", "keys", "shift", "prints", "entry", "offset", "ids"
    ).mapInArrow(run, f"key {kind}, start long, n_tokens long, ids binary").withColumnRenamed(
        "key", key
    )


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ids) of the asked keys (not null); a key that is not there has no row.

    The directory, one small row for each shard, routes keys to shards: both are cut by
    range at the directory's own bounds, so each key meets the few shards of its range.
    """
    table = spark.read.parquet(path)
    directory = table.select("part", "shard", "first", "last")
    asked = keys.select(named(key).alias("asked")).where("asked is not null").distinct()
    bounds = [
        r[0]
        for r in directory.groupBy("part").agg(F.min("first").alias("f")).where("f is not null")
        .orderBy("f").select("f").collect()
    ]
    cell = lambda c: F.size(F.filter(F.lit(bounds), lambda b: b <= c))
    spread = directory.where("last is not null").withColumn(
        "cell",
        F.explode(F.sequence(F.coalesce(cell(F.col("first")), F.lit(0)), cell(F.col("last")))),
    )
    routed = (
        asked.withColumn("cell", cell(F.col("asked")))
        .join(spread, "cell")
        .where("(first is null or asked >= first) and asked <= last")
        .groupBy("part", "shard")
        .agg(F.collect_list("asked").alias("asked"))
    )
    kind = table.schema["first"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                shard = _decoded(batch, i)
                found = [
                    (k, shard["ids"][shard["offset"][p]:shard["offset"][p + 1]].tobytes())
                    for k in batch.column("asked")[i].as_py()
                    for p in _records(shard, k)
                ]
                yield pa.record_batch(
                    {
                        "key": pa.array([f[0] for f in found], batch.column("first").type),
                        "ids": pa.array([f[1] for f in found], pa.binary()),
                    }
                )

    return (
        table.join(routed, ["part", "shard"])
        .select("first", "shift", "prints", "entry", "offset", "ids", "asked")
        .mapInArrow(run, f"key {kind}, ids binary")
        .withColumnRenamed("key", key)
    )
