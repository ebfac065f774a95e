"""Arrivals stored in the order in which stock reports need them.

Stock age orders the arrivals of every (hub, product) and cuts them into blocks. Where many reports are asked of the same
arrivals, that is done once: the rows are stored in buckets by hub, product and block, and the few block totals
beside them. Reports then join and order the rows where they lie, without moving them, and a dominant product is still
spread, since its blocks lie in different buckets."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from depotwise.functions.running import BLOCK, Blocked
from depotwise.operators.stock import LOT_ORDER, STOCK_KEY, lots_in_blocks
from depotwise.session import shared_dir
from depotwise.sources.domain import Domain


def store_lots(d: Domain, name: str, buckets: int, folder: str | None = None) -> None:
    """Store all arrivals of `d` as the catalog tables `name` and `name`_blocks, below `folder` or the shared folder.
    Rows without a hub or product are no stock and are left out."""
    cut = lots_in_blocks(d)
    known = " AND ".join(f"{c} IS NOT NULL" for c in STOCK_KEY)
    spark = cut.rows.sparkSession
    place = f"{folder or shared_dir(spark)}/{name}"
    on = list(cut.on)
    # one file for each bucket
    rows = cut.rows.where(known).repartition(buckets, *on)
    rows.write.mode("overwrite").option("path", place).bucketBy(buckets, *on).sortBy(*on, *LOT_ORDER).saveAsTable(name)
    cut.blocks.where(known).write.mode("overwrite").option("path", f"{place}_blocks").saveAsTable(f"{name}_blocks")


def stored_lots(spark: SparkSession, name: str) -> Blocked:
    """The stored arrivals, for the stock reports' ``lots``."""
    order = tuple(F.col(c).desc() for c in LOT_ORDER)
    return Blocked(spark.table(name), spark.table(f"{name}_blocks"), (*STOCK_KEY, BLOCK), order, nulls=False)
