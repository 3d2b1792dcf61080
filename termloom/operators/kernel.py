"""Exact RBF decision values over a table of support vectors.

Each row needs its distance to every support vector, but no pair is ever emitted.  Blocks
of the support table are shipped one after another and every task lets them pass its rows,
which are neither copied nor shuffled.  Beyond a bound of what is shipped in all, both
sides are cut into blocks that meet, with one partial sum per row and block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.features import rbf_sums
from termloom.session import discard, materialize

# Support vectors are shipped to the tasks in blocks of this size, and so many in all.
SUPPORT_LIMIT_BYTES = 32 * 1024 * 1024
SHIPPED_LIMIT_BYTES = 1024 * 1024 * 1024
# Rows that a block passes at once, or that meet it where both sides are cut.
ROWS_PER_SLICE = 20_000


def support_size(support: DataFrame) -> tuple[int, int]:
    """(number of support vectors, bytes of their values), measured."""
    row = support.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("features")).alias("values")
    ).first()
    return row["n"], 8 * int(row["values"] or 0)


def rbf_decision(
    rows: DataFrame,
    support: DataFrame,
    gamma: float,
    rho: float = 0.0,
    id_column: str = "id",
    limit: int = SUPPORT_LIMIT_BYTES,
    rows_per_slice: int = ROWS_PER_SLICE,
    shipped_limit: int = SHIPPED_LIMIT_BYTES,
) -> DataFrame:
    """``(id, decision)``: sum of coef * exp(-gamma |x - sv|^2) minus rho.

    ``rows`` has ``features``, a dense array; ``support`` has ``features`` and
    ``coef``.  Its size is measured: up to ``shipped_limit`` it is shipped in blocks of
    ``limit`` bytes that pass the rows where they are, so the work is linear in the rows and
    nothing of them moves; a larger one meets slices of the rows block by block.  Rows that
    repeat an id are decided each on either way.
    """
    n_support, size = support_size(support)
    if n_support == 0:
        return rows.select(id_column, F.lit(-rho).alias("decision"))
    if size <= shipped_limit:
        blocks = max(1, math.ceil(size / limit))
        sums = _passed(rows, _shipped(support, blocks), gamma, id_column, rows_per_slice)
    else:
        row_bytes = max(1, size // n_support)
        sums = _blocked(
            rows,
            support,
            gamma,
            id_column,
            blocks=math.ceil(size / limit),
            rows_per_slice=max(1, min(rows_per_slice, limit // row_bytes)),
        )
    return sums.select(id_column, (F.col("decision") - F.lit(rho)).alias("decision"))


def _numbered(support: DataFrame, blocks: int) -> DataFrame:
    """Support vectors with their block; equal ones are added up, so that copies cannot fill one."""
    distinct = support.groupBy("features").agg(F.sum("coef").alias("coef"))
    return distinct.withColumn("_block", F.pmod(F.xxhash64("features"), F.lit(blocks)).cast("int"))


def _shipped(support: DataFrame, blocks: int) -> list[Broadcast]:
    """The blocks of a support table of bounded size; the driver holds one at a time."""
    context = support.sparkSession.sparkContext
    table = support if blocks == 1 else materialize(_numbered(support, blocks))
    out = []
    for block in range(blocks):
        local = (table if blocks == 1 else table.where(F.col("_block") == block)).toPandas()
        if len(local):
            vectors = np.vstack(local["features"].to_list()).astype(float)
            out.append(context.broadcast((vectors, local["coef"].to_numpy(float))))
    if blocks > 1:
        discard(table)
    return out


def _passed(
    rows: DataFrame, shipped: list[Broadcast], gamma: float, id_column: str, rows_per_slice: int
) -> DataFrame:
    @F.pandas_udf("double")
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def sums(held: list[np.ndarray]) -> pd.Series:
            x = np.concatenate(held)
            total = np.zeros(len(x))
            for block in shipped:
                total += rbf_sums(x, *block.value, gamma)
                if len(shipped) > 1:  # a worker keeps one block only
                    block.__dict__.pop("_value", None)
            return pd.Series(total)

        held: list[np.ndarray] = []
        for batch in batches:
            if len(batch):
                held.append(np.vstack(batch.to_list()).astype(float))
            if sum(map(len, held)) >= rows_per_slice:
                yield sums(held)
                held = []
        if held:
            yield sums(held)

    return rows.select(id_column, decide("features").alias("decision"))


def _blocked(
    rows: DataFrame,
    support: DataFrame,
    gamma: float,
    id_column: str,
    blocks: int,
    rows_per_slice: int,
) -> DataFrame:
    """Every row visits every support block; groups are bounded on both sides."""
    slices = max(1, math.ceil(rows.count() / rows_per_slice))
    spread_rows = rows.select(
        F.struct(
            F.col(id_column).alias("id"), F.monotonically_increasing_id().alias("row")
        ).alias("_id"),
        F.col("features"),
    ).select(
        "*",
        F.pmod(F.xxhash64("_id"), F.lit(slices)).alias("_slice"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"),
    )
    spread_support = _numbered(support, blocks).select(
        "features",
        "coef",
        "_block",
        F.explode(
            F.sequence(F.lit(0).cast("bigint"), F.lit(slices - 1).cast("bigint"))
        ).alias("_slice"),
    )

    def partial(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({"_id": left["_id"], "part": []})
        if right.empty:
            return pd.DataFrame({"_id": left["_id"], "part": 0.0})
        sums = rbf_sums(
            np.vstack(left["features"].to_list()).astype(float),
            np.vstack(right["features"].to_list()).astype(float),
            right["coef"].to_numpy(float),
            gamma,
        )
        return pd.DataFrame({"_id": left["_id"], "part": sums})

    id_type = spread_rows.schema["_id"].dataType.simpleString()
    parts = (
        spread_rows.groupBy("_block", "_slice")
        .cogroup(spread_support.groupBy("_block", "_slice"))
        .applyInPandas(partial, f"_id {id_type}, part double")
    )
    sums = parts.groupBy("_id").agg(F.sum("part").alias("decision"))
    return sums.select(F.col("_id")["id"].alias(id_column), "decision")
