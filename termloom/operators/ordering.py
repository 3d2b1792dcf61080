"""Global positions and running totals without a single-partition window."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import materialize

# monotonically_increasing_id() holds the partition above this many low bits.
_POSITION_BITS = 33


def ordered_blocks(df: DataFrame, *order: Column) -> DataFrame:
    """Sort globally and write the result, with ``_block`` and ``_pos`` columns.

    ``_block`` numbers the range partitions in sort order, ``_pos`` the rows inside
    one.  The range bounds are sampled, so the table is written before anybody
    reads the two columns.  The order must be unique per row to be reproducible.
    """
    placed = df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    return (
        materialize(placed)
        .withColumn("_block", F.shiftright("_place", _POSITION_BITS))
        .withColumn("_pos", F.col("_place").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("_place")
    )


def with_dense_index(
    df: DataFrame, *order: Column, name: str = "idx", start: int = 0
) -> DataFrame:
    """Add the 0-based position of each row in the given order."""
    blocks = ordered_blocks(df, *order)
    sized = _with_offsets(blocks, {"_rows": F.count(F.lit(1))})
    return sized.withColumn(
        name, (F.col("_before_rows") + F.col("_pos") + F.lit(start)).cast("bigint")
    ).select(*df.columns, name)


def with_line_index(lines: DataFrame, name: str = "idx") -> DataFrame:
    """Number the lines of a text scan in the order of its files, without a shuffle.

    ``_file`` and ``_start`` name the block of a file that a line was read from, ``_at`` is the
    scan's own ``monotonically_increasing_id()``: a block is read by one task, line after line.
    The lines are written, because the blocks of a task may be others in a second scan.  Only
    one summary row per block reaches the driver.
    """
    placed = materialize(lines)
    blocks = (
        placed.groupBy("_file", "_start")
        .agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("at"))
        .orderBy("_file", "_start")
        .collect()
    )
    shifts, before = [], 0
    for block in blocks:
        shifts.append((block["_file"], block["_start"], before - block["at"]))
        before += block["n"]
    table = lines.sparkSession.createDataFrame(
        shifts, "_file string, _start bigint, _shift bigint"
    )
    kept = [c for c in lines.columns if c not in ("_file", "_start", "_at")]
    return placed.join(F.broadcast(table), ["_file", "_start"]).select(
        *kept, (F.col("_at") + F.col("_shift")).alias(name)
    )


def with_running_totals(
    df: DataFrame, *order: Column, totals: Mapping[str, str]
) -> DataFrame:
    """Add running sums: ``totals`` maps a new column name to the column summed.

    Each block is summed on its own and shifted by the totals of the blocks before.
    """
    blocks = ordered_blocks(df, *order)
    sums = {f"_{name}": F.sum(source) for name, source in totals.items()}
    within = (
        Window.partitionBy("_block")
        .orderBy("_pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    shifted = _with_offsets(blocks, sums)
    for name, source in totals.items():
        shifted = shifted.withColumn(
            name, F.sum(source).over(within) + F.col(f"_before_{name}")
        )
    return shifted.select(*df.columns, *totals)


def _with_offsets(blocks: DataFrame, aggregates: Mapping[str, Column]) -> DataFrame:
    """Attach, per block, the totals of all earlier blocks as ``_before...`` columns.

    Only one summary row per range partition reaches the driver.
    """
    summary = (
        blocks.groupBy("_block")
        .agg(*[column.alias(name) for name, column in aggregates.items()])
        .orderBy("_block")
        .collect()
    )
    names = list(aggregates)
    if len(summary) <= 1:
        return blocks.select(
            "*", *[F.lit(0).cast("bigint").alias(f"_before{name}") for name in names]
        )
    before = dict.fromkeys(names, 0)
    offsets = []
    for row in summary:
        offsets.append((row["_block"], *[int(before[name]) for name in names]))
        for name in names:
            before[name] += row[name] or 0
    schema = ", ".join(["_block bigint", *[f"_before{name} bigint" for name in names]])
    table = blocks.sparkSession.createDataFrame(offsets, schema)
    return blocks.join(F.broadcast(table), "_block")
