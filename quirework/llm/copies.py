"""Rows dealt out again after equal ones were counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import col, fresh

BLOCK = 4096


def dealt(rows: DataFrame, n_col: str, copy_col: str, block: int = BLOCK) -> DataFrame:
    """Each row ``n_col`` times, numbered from 1 in ``copy_col``.

    Rows of more than ``block`` copies are cut into blocks that are dealt over
    the partitions, so no array is longer than the number of blocks and no task
    makes all copies of a row.
    """
    n, k = col(n_col), fresh(rows, "qw_block")
    up_to = lambda most: F.explode(F.sequence(F.lit(1).cast("long"), most))
    few = rows.where(n <= block).withColumn(copy_col, up_to(n))
    many = (
        rows.where(n > block)
        .withColumn(k, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / block))))
        .repartition(col(k))
        .withColumn(copy_col, up_to(F.least(F.lit(block).cast("long"), n - col(k) * block)))
        .withColumn(copy_col, col(copy_col) + col(k) * block)
        .drop(k)
    )
    return few.unionByName(many)
