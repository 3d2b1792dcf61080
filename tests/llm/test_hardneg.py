"""Hard negatives against a plain version; the parts of the search."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_curve_visits_every_cell_by_single_steps():
    cells = np.array(np.meshgrid(*[range(8)] * 3, indexing="ij")).reshape(3, -1).T
    keys = hardneg.hilbert_keys(cells, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
    assert not hardneg.hilbert_keys(np.zeros((4, 0), int), 5).any()


def test_bounds_hold():
    rng = np.random.default_rng(0)
    rows = rng.integers(-50, 50, (40, 6))
    anchors = rng.integers(-50, 50, (30, 6))
    least, greatest = hardneg.bounds(anchors, rows.min(axis=0)[None], rows.max(axis=0)[None])
    scores = anchors @ rows.T
    assert (least[:, 0] <= scores.min(axis=1)).all() and (greatest[:, 0] >= scores.max(axis=1)).all()


def test_large_numbers_are_exact():
    a = np.array([[2**30, 1], [3, -(2**30)]])
    assert hardneg.products(a, a).tolist() == [[2**60 + 1, 2**31], [2**31, 9 + 2**60]]


def rows(seed, n=350):
    """Clusters with exact copies, repeated ids, ties and rows that take no part."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, 8))
    out = []
    for i in range(n):
        e = centers[rng.integers(6)] * rng.choice([1, 0.3])
        e = e + rng.normal(size=8) * rng.choice([0, 0.05, 0.5])
        out.append(
            (
                i if rng.random() < 0.95 else i // 10 * 10,
                e.tolist() if rng.random() < 0.97 else None,
                int(rng.integers(4)) if rng.random() < 0.97 else None,
            )
        )
    return out + [
        (20, [1.0, None], 1), (30, [float("nan")] * 8, 1), (40, [], 2), (50, [1.0, 2.0], 0),
        (60, [float("-inf")] * 8, 1), (None, [1.0] * 8, 1),
    ]


@pytest.mark.parametrize("block, slice_", [(1 << 20, 1024), (512, 3), (32, 1)])
def test_same_as_plain_version(spark, monkeypatch, block, slice_):
    monkeypatch.setattr(hardneg, "BLOCK_BYTES", block)
    monkeypatch.setattr(hardneg, "SLICE_ANCHORS", slice_)
    table = spark.createDataFrame(rows(block), SCHEMA).repartition(3)
    given = [tuple(r) for r in table.collect()]
    got = hardneg.hard_negatives(table, F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute.hard_negatives(given, 10)


def test_zone_maps_too_large_to_send(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK_BYTES", 128)
    monkeypatch.setattr(hardneg, "ZONES_TOGETHER", 7)
    monkeypatch.setattr(hardneg, "ZONE_LIMIT_BYTES", 0)
    table = spark.createDataFrame(rows(9, 150), SCHEMA)
    got = hardneg.hard_negatives(table, F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute.hard_negatives(rows(9, 150), 10)


def test_far_blocks_are_not_read(spark, monkeypatch):
    """Vectors in tight clusters: most blocks are outside every window."""
    monkeypatch.setattr(hardneg, "BLOCK_BYTES", 32 * 20)
    rng = np.random.default_rng(1)
    centers = np.eye(8) * 10
    table = spark.createDataFrame(
        [(i, (centers[i % 8] + rng.normal(size=8) * 0.05).tolist(), i // 8 % 2) for i in range(1600)],
        SCHEMA,
    )
    read = []
    inner = hardneg._read

    def counted(routed, blocks, *rest):
        read.append((routed.count(), blocks.count()))
        return inner(routed, blocks, *rest)

    monkeypatch.setattr(hardneg, "_read", counted)
    found = hardneg.hard_negatives(table, F.col("vec_id") == 0)
    assert found.count() == 25
    assert all(met <= 0.2 * blocks for met, blocks in read)


def test_hot_vector(spark):
    """A third of the rows are one vector: ties go by id."""
    table = [(i, [0.5, 0.5], i % 2) if i % 3 == 0 else (i, [0.1 * (i % 7), 0.3], i % 2) for i in range(3000)]
    got = hardneg.hard_negatives(spark.createDataFrame(table, SCHEMA), F.col("vec_id") == 300).collect()
    expected = [r for r in brute.hard_negatives(table, 300) if r[0] == 300]
    assert sorted(tuple(r) for r in got) == expected


def test_numbers_too_large_are_refused(spark):
    table = spark.createDataFrame([(1, [1e30], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="64 bits"):
        hardneg.hard_negatives(table, F.lit(True))
