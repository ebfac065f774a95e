"""New ids for a batch of rows without sending the batch through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotwise.functions.running import running_total


def number_rows(df: DataFrame, order: Sequence[str], base: Column | int, out: str) -> DataFrame:
    """``base + 1, base + 2, ...`` in ``order``. Rows are dealt to range partitions and counted there;
    only the counts, one per partition, are accumulated in one place."""
    counted = running_total(df.withColumn("_one", F.lit(1).cast("bigint")), [], order, "_one", out="_position")
    return counted.withColumn(out, (base + F.col("_position")).cast("bigint")).drop("_one", "_position")


def highest(df: DataFrame, column: str) -> Column:
    """Largest value of an id column (0 for an empty table) as a scalar subquery."""
    return df.agg(F.coalesce(F.max(column), F.lit(0)).cast("bigint")).scalar()
