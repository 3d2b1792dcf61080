"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

One permutation spreads the shingles over the 64-bit ring; the second one, circularly
shifted by k strides, gives coordinate k of the signature as a minimum.  Texts that share
all coordinates of a band meet in a bucket.  With 32 bands of 4 a pair at similarity 0.75
is missed with probability 5e-6.

Equal shingle sets are one class first, whatever their number.  The leader of a bucket is
its least class, so a group of near copies has few leaders.  A class is tested on the full
sets against the least of its leaders, then against the leaders that this left in another
component.  The classes of buckets that still hold several components are compared across
them by an exact prefix join: similar sets share one of their rarest shingles, and only pairs
that do are formed, after two exact bounds on what two sets can share: without the shingles
that one of them has alone, and by the common bits of small bitmaps.  So no group of copies is
expanded into its pairs and no pair of a bucket between components is left out.

Defined results: a text without words is linked with nothing; a null key takes part and
gets the least key of its component; repeated rows are one class and come back each;
an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import ROW, named, numbered, release_memory, text_of, without
from termloom.llm.components import components
from termloom.llm.encoding import slices
from termloom.llm.shingles import PRIME, mixed, shingle_sets
from termloom.session import materialize, run_scope

#: Distance between two shifts on the ring of 2**64 places.
STRIDE = np.uint64(0xD1342543DE82EF95)
SPREAD = np.uint64(0xDA942042E4DD58B5)

#: Shingles before one in a prefix that go with it, so that a pair is formed at its first one.
EARLIER = 32


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Coordinates min(pi(sigma(x) - k * stride)) for k below ``size``."""
    out = np.empty(size, np.uint64)
    step = max(1, (1 << 20) // max(1, len(shingles)))
    shifts = np.arange(size, dtype=np.uint64) * STRIDE
    for k in range(0, size, step):
        x = (shingles[None, :] - shifts[k:k + step, None]) * SPREAD
        x ^= x >> np.uint64(32)
        x *= PRIME
        out[k:k + step] = x.min(axis=1)
    return out


def signed(
    docs: DataFrame, key: str, text: str, words: int, bands: int, rows: int
) -> DataFrame:
    """(key, tkey, cls, n, buckets) of each document; cls and buckets are null without words."""
    slim = docs.select(
        named(key).alias("key"), F.xxhash64(text_of(text)).alias("tkey"), text_of(text).alias("t")
    )
    kind = slim.schema["key"].dataType.simpleString()
    own = np.arange(1, bands + 1, dtype=np.uint64) * PRIME

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "t")):
            cls, n, buckets = [], [], []
            for found in shingle_sets(batch.column("t"), words):
                n.append(len(found))
                if not len(found):
                    cls.append(None)
                    buckets.append(None)
                    continue
                cls.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                parts = signature(found, bands * rows).reshape(bands, rows)
                value = own.copy()
                for j in range(rows):
                    value = mixed(value * PRIME + parts[:, j])
                buckets.append(value.view(np.int64))
            yield pa.record_batch(
                {
                    "key": batch.column("key"),
                    "tkey": batch.column("tkey"),
                    "cls": pa.array(cls, pa.binary()),
                    "n": pa.array(n, pa.int64()),
                    "buckets": pa.array(buckets, pa.list_(pa.int64())),
                }
            )
        release_memory()

    return slim.mapInArrow(
        run, f"key {kind}, tkey long, cls binary, n long, buckets array<long>"
    )


def _sets(docs: DataFrame, picks: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(cls, n, shingles, bits) of the classes in ``picks`` (cls, tkey, key): one text of each.

    ``bits`` is a bitmap of the shingles; two sets have at most as many shingles in common as
    common bits, plus the shingles that fall on a bit of their own set.
    """
    slim = docs.select(
        F.xxhash64(text_of(text)).alias("tkey"), named(key).alias("key"), text_of(text).alias("t")
    )
    chosen = picks.select("cls", F.col("tkey").alias("k1"), F.col("key").alias("k2"))
    found = slim.join(
        chosen, (slim["tkey"] == chosen["k1"]) & slim["key"].eqNullSafe(chosen["k2"])
    ).select("cls", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, "t")):
            sets = shingle_sets(batch.column("t"), words)
            yield pa.record_batch(
                {
                    "cls": batch.column("cls"),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "shingles": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    "bits": pa.array([bitmap(s) for s in sets], pa.list_(pa.int64())),
                }
            )
        release_memory()

    sets = found.mapInArrow(run, "cls binary, n long, shingles array<long>, bits array<long>")
    return sets.groupBy("cls").agg(
        *[F.first(c).alias(c) for c in ("n", "shingles", "bits")]
    )


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """64 words with the bit of each shingle set."""
    out = np.zeros(64, np.uint64)
    at = shingles >> np.uint64(52)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(int), np.uint64(1) << (at & np.uint64(63)))
    return out.view(np.int64)


def _common_bits(bits: str, others: str) -> Column:
    return F.aggregate(
        F.zip_with(bits, others, lambda x, y: F.bit_count(x.bitwiseAND(y))),
        F.lit(0), lambda a, b: a + b,
    )


def _distance(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds ``common`` and ``united``, the exact sizes for the pairs (a, b)."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select(
        *pairs.columns,
        F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"),
        (F.size("sa") + F.size("sb")).cast("long").alias("total"),
    ).select(*pairs.columns, "common", (F.col("total") - F.col("common")).alias("united"))


def _similar(percent: int) -> Column:
    return 100 * F.col("common") >= percent * F.col("united")


def _sharing(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """(cls, n, shared, bits, lost) of the classes of ``rest``: size of the set, its shingles that
    another class has (two sets have at most the lesser number in common), and its bitmap.
    """
    spread = (
        rest.select("cls").distinct().join(sets, "cls").select("cls", F.explode("shingles").alias("s"))
    )
    shared = (
        spread.groupBy("s")
        .agg(F.count(F.lit(1)).alias("m"), F.first("cls").alias("cls"))
        .where("m = 1")
        .groupBy("cls")
        .agg(F.count(F.lit(1)).alias("alone"))
    )
    return (
        rest.select("cls").distinct().join(sets.select("cls", "n", "bits"), "cls")
        .join(shared, "cls", "left")
        .select(
            "cls", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"), "bits",
            (F.col("n") - _common_bits("bits", "bits")).alias("lost"),
        )
    )


def _prefixes(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(s, cls, component, earlier): the rarest shingles of the classes that are left, enough of
    them, each with the first ones that come before it.

    Two sets of at least the similarity share one of their n - ceil(p n) + 1 rarest shingles in
    any common order; here by the number of classes in ``rest`` that have them.  A shingle of
    one component only cannot lead to a link between two.
    """
    own = rest.select("cls", "component").distinct().join(sets.select("cls", "n", "shingles"), "cls")
    spread = own.select("cls", "component", "n", F.explode("shingles").alias("s"))
    counts = spread.groupBy("s").agg(
        F.count(F.lit(1)).alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi")
    )
    # the order within a set needs the counts of its shared shingles only: the others come first
    shared = counts.where("m > 1").select("s", "m", (F.col("lo") != F.col("hi")).alias("across"))
    ranked = (
        spread.join(shared, "s")
        .groupBy("cls", "component", "n")
        .agg(F.sort_array(F.collect_list(F.struct("m", "s", "across"))).alias("order"))
    )
    alone = F.col("n") - F.size("order")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    taken = F.slice("order", 1, F.greatest(length - alone, F.lit(0)).cast("int"))
    led = ranked.select(
        "cls", "component", F.transform(F.filter(taken, lambda x: x["across"]), lambda x: x["s"]).alias("led")
    )
    return led.select("cls", "component", "led", F.posexplode("led").alias("at", "s")).select(
        "s", "cls", "component", F.slice("led", F.lit(1), F.least("at", F.lit(EARLIER))).alias("earlier")
    )


def _meeting(prefixes: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of classes in different components that have a shingle of their prefixes in
    common, within the exact bounds.

    A pair is formed at the first such shingle in the order of the prefixes; where that one has
    ``EARLIER`` others before it a pair may come again.
    """
    columns = ("cls", "component", "earlier", "n", "shared", "bits", "lost")
    other = prefixes.select("s", *[F.col(c).alias(f"o_{c}") for c in columns])
    most = F.least("shared", "o_shared")
    at_most = _common_bits("bits", "o_bits") + F.least("lost", "o_lost")
    # similarity m / (n + o_n - m) of at least p, solved for m
    enough = percent * (F.col("n") + F.col("o_n"))
    return (
        prefixes.join(other, "s")
        .where(
            (F.col("cls") < F.col("o_cls"))
            & (F.col("component") != F.col("o_component"))
            & ((100 + percent) * most >= enough)
            & ~F.arrays_overlap("earlier", "o_earlier")
            & ((100 + percent) * at_most >= enough)
        )
        .select(F.col("cls").alias("a"), F.col("o_cls").alias("b"))
    )


def _crossing(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of classes of ``rest`` in different components that may be similar.

    A pair is formed only where both have a shingle among their rarest, and once for nearly all
    pairs.
    """
    prefixes = materialize(_prefixes(rest, sets, percent).join(_sharing(rest, sets), "cls"))
    return _meeting(prefixes, percent).distinct()


def _apart(pairs: DataFrame, reach: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs whose classes are not in one component."""
    left = reach.select(F.col("vertex").alias(a), F.col("component").alias("ca"))
    right = reach.select(F.col("vertex").alias(b), F.col("component").alias("cb"))
    return (
        pairs.join(left, a, "left").join(right, b, "left")
        .where(F.coalesce("ca", a) != F.coalesce("cb", b))
        .select(*pairs.columns)
    )


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = 5,
    percent: int = 75,
    bands: int = 32,
    rows: int = 4,
) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row."""
    marks = materialize(signed(docs, key, text, words, bands, rows))
    classes = materialize(
        marks.where("n > 0")
        .groupBy("cls")
        .agg(
            F.min("key").alias("label"),
            F.min(F.struct("tkey", "key")).alias("pick"),
            F.first("n").alias("n"),
            F.first("buckets").alias("buckets"),
        )
    )
    placed = classes.select(F.explode("buckets").alias("bucket"), "cls")
    leaders = (
        placed.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("m"), F.min("cls").alias("leader"))
        .where("m > 1")
        .select("bucket", "leader")
    )
    members = materialize(placed.join(leaders, "bucket"))
    picks = (
        members.select("cls").distinct().join(classes, "cls").select("cls", "pick.tkey", "pick.key")
    )
    sets = materialize(_sets(docs, picks, key, text, words))
    stars = members.where("cls <> leader").select(F.col("leader").alias("a"), F.col("cls").alias("b"))
    # first one leader for each class, the least; then the other leaders of classes that are
    # not yet in the component of that leader
    tested = materialize(
        _distance(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), sets)
    )
    linked = tested.where(_similar(percent)).select("a", "b")
    reach = components(linked)
    apart = _apart(stars.distinct(), reach, "a", "b").join(tested, ["a", "b"], "left_anti")
    again = materialize(_distance(apart, sets))
    linked = linked.unionByName(again.where(_similar(percent)).select("a", "b"))
    reach = components(linked)
    # buckets that still hold several components: pairs across them
    placed_in = members.join(
        reach.select(F.col("vertex").alias("cls"), "component"), "cls", "left"
    ).select("bucket", "cls", "leader", F.coalesce("component", "cls").alias("component"))
    mixed_buckets = (
        placed_in.groupBy("bucket")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo <> hi")
        .select("bucket")
    )
    rest = materialize(
        placed_in.join(mixed_buckets, "bucket")
        .where("cls <> leader")
        .select("cls", "component")
        .distinct()
    )
    crossing = _crossing(rest, sets, percent)
    more = materialize(_distance(crossing, sets).where(_similar(percent)).select("a", "b"))
    if not more.isEmpty():
        reach = components(linked.unionByName(more))
    named_classes = classes.join(
        reach.select(F.col("vertex").alias("cls"), "component"), "cls", "left"
    ).select("cls", "label", F.coalesce("component", "cls").alias("component"))
    least = named_classes.groupBy("component").agg(F.min("label").alias("component_id"))
    found = named_classes.join(least, "component").select("cls", "component_id")
    out = marks.where("n > 0").select("key", "n", "cls").join(found, "cls", "left").select(
        "key", "n", "component_id"
    )
    out = out.unionByName(
        marks.where("n = 0").select("key", "n", F.col("key").alias("component_id"))
    )
    return out.select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component with its own columns; rows without words are all kept.

    Rows are told apart by a number of their own, so repeated keys lose their copies too; only
    the numbers of the rows that go are kept.
    """
    marked = numbered(docs)
    slim = marked.select(
        F.struct(F.col(ROW)[key].alias("k"), F.col("row").alias("r")).alias("key"),
        F.col(ROW)[text].alias("text"),
    )
    with run_scope(docs.sparkSession):
        found = near_duplicates(slim, key="key", text="text")
        gone = materialize(found.where(~F.col("kept")).select(F.col("key")["r"].alias("row")), keep=True)
    return without(marked, gone, docs.columns)
