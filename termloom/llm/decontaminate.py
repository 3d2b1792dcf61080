"""Benchmark decontamination with a positional inverted index.

The index is stored: one row per block of documents (about ``BLOCK_BYTES`` of text) with
its sorted terms and their position lists.  Documents of a block lie on one position axis
with gaps between them, so no match crosses a document.  A search takes the windows of
benchmark items, looks up the lists of their terms in a block, and intersects the lists,
shifted by the place of the term in the window, from the rarest term on.  A start that all
lists share is an exact phrase; one that all lists have within ``slop`` places is a
proximity match.

Building and searching need no shuffle.  Items go to the tasks in slices of bounded bytes,
one pass over the index for each slice, so a benchmark of any size is searched.

Defined results: null text has no words; an item without words never occurs; a null item id
counts as ''; repeated items and repeated documents are rows like any other; empty tables
give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import ROW, named, numbered, release_memory, text_of, without
from termloom.llm.encoding import slices
from termloom.llm.shingles import translated
from termloom.session import materialize, run_scope

#: Text of one index row, rows of one file of the index (what a task decodes at once), and text
#: of one slice of benchmark items.
BLOCK_BYTES = 2 << 20
BLOCKS_PER_FILE = 8
SLICE_BYTES = 4 << 20
# Bytes that are no part of a word become spaces, A-Z become a-z.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)

INDEX_TYPE = (
    "block long, keys array<{kind}>, n_words array<long>, "
    "terms array<string>, counts array<int>, positions binary"
)


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts, dictionary-encoded, and the number of words of each text."""
    texts = pc.ascii_trim_whitespace(translated(texts, WORD_TABLE))
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    cut = pc.ascii_split_whitespace(texts)
    del texts
    n = np.diff(cut.offsets.to_numpy().astype(np.int64))
    words = cut.flatten()
    del cut
    if empty.any():
        words = words.filter(pa.array(~np.repeat(empty, n)))
        n = np.where(empty, 0, n)
    return words.dictionary_encode(), n


def build_index(
    docs: DataFrame, key: str = "doc_id", text: str = "text", gap: int = 16
) -> DataFrame:
    """Index rows of all documents (see ``INDEX_TYPE``)."""
    slim = docs.select(named(key).alias("key"), text_of(text).alias("t"))
    kind = slim.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in (s for b in batches for s in slices(b, "t", BLOCK_BYTES)):
            words, n = words_of(batch.column("t"))
            # positions of a block are stored in 32 bits, so they are computed in 32 bits
            places = np.arange(n.sum(), dtype="<i4")
            places += np.repeat(np.arange(len(n), dtype="<i4") * np.int32(gap), n)
            code = words.indices.to_numpy()
            counts = np.bincount(code, minlength=len(words.dictionary))
            positions = places[np.argsort(code, kind="stable")].tobytes()
            del places, code
            keys = batch.column("key")
            yield pa.record_batch(
                {
                    "block": pa.array([block], pa.int64()),
                    "keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                    "n_words": pa.array([n], pa.list_(pa.int64())),
                    "terms": pa.ListArray.from_arrays(
                        pa.array([0, len(counts)], pa.int32()), words.dictionary.cast(pa.string())
                    ),
                    "counts": pa.array([counts.astype(np.int32)], pa.list_(pa.int32())),
                    "positions": pa.array([positions], pa.binary()),
                }
            )
            block += 1
            del words, positions
        # this worker may wait beside those of the next stage
        release_memory()

    return slim.mapInArrow(run, INDEX_TYPE.format(kind=kind))


def windows_of(
    ids: list[str], texts: pa.Array, size: int
) -> tuple[pa.Array, list[tuple[np.ndarray, list[list[str]]]]]:
    """Vocabulary, and the distinct windows with the items that hold them, by window length."""
    words, counts = words_of(texts)
    code = words.indices.to_numpy()
    found: dict[int, dict[bytes, set[str]]] = {}
    at = 0
    for item, n in zip(ids, counts.tolist()):
        length = min(n, size)
        for i in range(at, at + n - length + 1) if n else ():
            window = code[i:i + length].astype(np.int32).tobytes()
            found.setdefault(length, {}).setdefault(window, set()).add(item)
        at += n
    groups = [
        (
            np.frombuffer(b"".join(windows), np.int32).reshape(-1, length),
            [sorted(items) for items in windows.values()],
        )
        for length, windows in found.items()
    ]
    return words.dictionary, groups


def occurrences(
    window: np.ndarray, lists: list[np.ndarray], slop: int
) -> tuple[np.ndarray, np.ndarray]:
    """Starts of a window, rarest term first, and how far its terms lie from their places."""
    order = sorted(range(len(window)), key=lambda j: len(lists[j]))
    starts = lists[order[0]] - order[0]
    far = np.zeros(len(starts), np.int64)
    for j in order[1:]:
        at = lists[j]
        goal = starts + j
        i = np.searchsorted(at, goal)
        off = np.minimum(
            np.abs(at[np.minimum(i, len(at) - 1)] - goal), np.abs(at[np.maximum(i - 1, 0)] - goal)
        )
        near = off <= slop
        starts, far = starts[near], np.maximum(far, off)[near]
        if not len(starts):
            break
    return starts, far


def search_block(row: dict, vocabulary: pa.Array, groups: list, slop: int, gap: int):
    """(document number, hit intervals, items, near items) of the documents with matches."""
    counts = np.array(row["counts"], np.int64)
    offsets = np.cumsum(counts) - counts
    positions = np.frombuffer(row["positions"], "<i4").astype(np.int64)
    place = pc.index_in(vocabulary, value_set=row["terms"]).to_numpy(zero_copy_only=False)
    here = np.where(np.isnan(place), -1, np.nan_to_num(place)).astype(np.int64)
    n = np.array(row["n_words"], np.int64)
    starts = np.cumsum(n + gap) - (n + gap)
    exact: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str]] = {}
    near: dict[int, set[str]] = {}
    for windows, owners in groups:
        length = windows.shape[1]
        at = here[windows]
        for w in np.flatnonzero((at >= 0).all(axis=1)).tolist():
            lists = [positions[offsets[t]:offsets[t] + counts[t]] for t in at[w]]
            found, far = occurrences(windows[w], lists, slop)
            if not len(found):
                continue
            document = np.searchsorted(starts, np.maximum(found, 0), side="right") - 1
            for s, d, off in zip(found.tolist(), document.tolist(), far.tolist()):
                near.setdefault(d, set()).update(owners[w])
                if off == 0:
                    exact.setdefault(d, []).append((s - int(starts[d]), s - int(starts[d]) + length))
                    items.setdefault(d, set()).update(owners[w])
    for d in near:
        merged: list[list[int]] = []
        for a, b in sorted(exact.get(d, ())):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        yield d, merged, sorted(items.get(d, ())), sorted(near[d])


def _search(index: DataFrame, ids: list[str], texts: pa.Array, size: int, slop: int, gap: int):
    vocabulary, groups = windows_of(ids, texts, size)
    sent = index.sparkSession.sparkContext.broadcast((vocabulary, groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, groups = sent.value
        for batch in batches:
            for i in range(len(batch)):
                row = {
                    "n_words": batch.column("n_words")[i].values.to_numpy(),
                    "terms": batch.column("terms")[i].values,
                    "counts": batch.column("counts")[i].values.to_numpy(),
                    "positions": batch.column("positions")[i].as_py(),
                }
                found = list(
                    search_block(row, vocabulary.cast(row["terms"].type), groups, slop, gap)
                )
                yield pa.record_batch(
                    {
                        "block": pa.array([batch.column("block")[i].as_py()] * len(found), pa.int64()),
                        "document": pa.array([f[0] for f in found], pa.int32()),
                        "hits": pa.array([f[1] for f in found], pa.list_(pa.list_(pa.int64()))),
                        "items": pa.array([f[2] for f in found], pa.list_(pa.string())),
                        "near": pa.array([f[3] for f in found], pa.list_(pa.string())),
                    }
                )
        release_memory()

    return index.select("block", "n_words", "terms", "counts", "positions").mapInArrow(
        run,
        "block long, document int, hits array<array<long>>, items array<string>, "
        "near array<string>",
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = 13,
    slop: int = 2,
) -> DataFrame:
    """(key, n_words, n_hit, items, near_items) of every document.

    ``n_hit`` counts the words inside exact occurrences of any window of ``size``
    consecutive item words (a shorter item is one window); ``items`` are their ids.
    ``near_items`` are the items with a window whose words all lie within ``slop``
    places of their position.
    """
    gap = size + slop + 1
    index = materialize(build_index(docs, key, text, gap), rows_per_file=BLOCKS_PER_FILE)
    asked = benchmark.select(
        F.coalesce(named(item).cast("string"), F.lit("")).alias("id"), text_of(item_text).alias("t")
    ).distinct()
    total = asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-total // SLICE_BYTES))
    found = None
    for part in range(parts):
        table = asked.where(F.pmod(F.xxhash64("id", "t"), F.lit(parts)) == part).toArrow()
        hits = _search(
            index, table.column("id").to_pylist(), table.column("t").combine_chunks(),
            size, slop, gap,
        )
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy("block", "document").agg(
        F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near_items"),
    )
    # overlapping intervals of different slices count once
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda acc, h: F.struct(
            (acc["n"] + F.greatest(F.lit(0), h[1] - F.greatest(acc["to"], h[0]))).alias("n"),
            F.greatest(acc["to"], h[1]).alias("to"),
        ),
        lambda acc: acc["n"],
    )
    found = found.select("block", "document", covered.alias("n_hit"), "items", "near_items")
    rows = index.select("block", F.posexplode(F.arrays_zip("keys", "n_words"))).select(
        "block", F.col("pos").alias("document"), "col.keys", "col.n_words"
    )
    none = F.array().cast("array<string>")
    return rows.join(found, ["block", "document"], "left").select(
        F.col("keys").alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.sort_array(F.coalesce("items", none)).alias("items"),
        F.coalesce("near_items", none).alias("near_items"),
    )


def contaminated(percent: int = 5):
    """At least one word in twenty lies inside an occurrence."""
    return (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns.

    Rows are told apart by a number of their own, so repeated keys are judged each; only the
    numbers of the contaminated rows are kept.
    """
    marked = numbered(docs)
    slim = marked.select("row", F.col(ROW)[text].alias("text"))
    with run_scope(docs.sparkSession):
        bad = contamination(slim, benchmark, key="row").where(contaminated())
        gone = materialize(bad.select("row"), keep=True)
    return without(marked, gone, docs.columns)
