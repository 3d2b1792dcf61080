"""Packing by power-of-two decomposition.

A document of n ids is cut into n // L pieces of the full length L and one piece for
each binary digit of the rest, longest first.  Each piece is a sequence of its own, so no
sequence crosses documents and none needs padding; sequences of one length form a bucket.

Map-only: documents are encoded where they are read.  Ids of sequences are made of
bucket, partition and a counter, so a task that runs again gives the same ids.

Defined results: a null or empty text is one piece with the end id alone; repeated rows
are packed each for itself; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import named, text_of
from termloom.llm.encoding import default_tokenizer, encoder, slices

# Bits of a sequence id: bucket, partition, counter.
COUNTER_BITS, PARTITION_BITS = 34, 24


def lengths_of(n: int, longest: int) -> list[int]:
    """The pieces of n ids: full ones, then the binary digits of the rest."""
    full, rest = divmod(n, longest)
    return [longest] * full + [
        1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1
    ]


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    longest: int = 1024,
    end_id: int = 0,
) -> DataFrame:
    """Pieces of all documents: key, start, length, ids (little-endian unsigned 32 bits),
    ids_crc32, doc_tokens, sequence_id, offset.  ``longest`` is a power of two.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    path = tokenizer or default_tokenizer()
    slim = docs.select(named(key).alias("key"), text_of(text).alias("t"))
    kind = slim.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        part = TaskContext.get().partitionId() << COUNTER_BITS
        counters = [0] * (longest.bit_length())
        for batch in (s for b in batches for s in slices(b, "t")):
            ids, counts = encode(batch.column("t"))
            row, start, length, payload, crc, total, sequence = [], [], [], [], [], [], []
            at = 0
            for i, n in enumerate(counts.tolist()):
                own = np.append(ids[at:at + n], np.uint32(end_id)).astype("<u4").tobytes()
                at += n
                done = 0
                for size in lengths_of(n + 1, longest):
                    bucket = size.bit_length() - 1
                    chunk = own[4 * done:4 * (done + size)]
                    row.append(i)
                    start.append(done)
                    length.append(size)
                    payload.append(chunk)
                    crc.append(zlib.crc32(chunk))
                    total.append(n + 1)
                    sequence.append(
                        bucket << (COUNTER_BITS + PARTITION_BITS) | part | counters[bucket]
                    )
                    counters[bucket] += 1
                    done += size
            yield pa.record_batch(
                {
                    "key": batch.column("key").take(pa.array(row, pa.int64())),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids": pa.array(payload, pa.binary()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "doc_tokens": pa.array(total, pa.int64()),
                    "sequence_id": pa.array(sequence, pa.int64()),
                    "offset": pa.array(np.zeros(len(row), np.int64)),
                }
            )

    pieces = slim.mapInArrow(
        run,
        f"key {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long",
    )
    return pieces.withColumnRenamed("key", key)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each length, so that a reader of one bucket gets equal sequences."""
    pieces.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
