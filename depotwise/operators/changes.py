"""What a batch changes, row by row: every insert, update and delete with its images before and after, in order.

Comparing two snapshots shows one change per row. A batch can change a stock row many times, so the feed is
made from what the batch did: a running balance of each stock row gives every move its images, without serving the
moves one by one. Order: phase of the batch, moment, request, step within it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotwise.functions import columns as C
from depotwise.functions.numbering import number_rows
from depotwise.functions.running import running
from depotwise.operators.checkout import Checkout
from depotwise.operators.mutations import PurchasePlacement, Reversal
from depotwise.operators.stock import STOCK_KEY, Moment
from depotwise.schema import TABLES
from depotwise.session import materialise
from depotwise.sources.domain import Domain, conform

ORDER = ["phase", "moment", "request", "step"]


def _image(table: str, **given: Column) -> Column:
    return F.to_json(F.struct(*[given.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in TABLES[table].struct.fields]))


def _change(rows: DataFrame, table: str, operation: Column, record_id: Column, before: Column, after: Column) -> DataFrame:
    return rows.select(
        *ORDER, F.lit(table).alias("table_name"), operation.alias("operation"), record_id.cast("long").alias("record_id"),
        before.cast("string").alias("before"), after.cast("string").alias("after"),
    )


def _ordered(df: DataFrame, phase: int, moment: Column, request: Column, step: Column) -> DataFrame:
    return df.withColumns(
        {"phase": F.lit(phase), "moment": moment.cast("timestamp_ntz"), "request": request.cast("long"), "step": step.cast("long")}
    )


def inserted(rows: DataFrame, table: str, key: str, phase: int, moment: Column, request: Column, step: int = 0) -> DataFrame:
    """One insert for each row of a table."""
    return _change(_ordered(rows, phase, moment, request, F.lit(step)), table, F.lit("INSERT"), F.col(key), F.lit(None), _image(table))


def deleted(rows: DataFrame, table: str, key: str, phase: int, moment: Column, request: Column, step: int = 0) -> DataFrame:
    return _change(_ordered(rows, phase, moment, request, F.lit(step)), table, F.lit("DELETE"), F.col(key), _image(table), F.lit(None))


def updated(before: DataFrame, after: DataFrame, table: str, key: str, phase: int, moment: Moment) -> DataFrame:
    """One update for each row that differs between two versions of a table with the same keys."""
    old = before.select(F.col(key), _image(table).alias("_before"))
    new = after.select(F.col(key), _image(table).alias("_after"))
    rows = old.join(new, key).where(F.col("_before") != F.col("_after"))
    return _change(_ordered(rows, phase, C.moment(moment), F.col(key), F.lit(0)), table, F.lit("UPDATE"), F.col(key), F.col("_before"), F.col("_after"))


def stock_moves(opening: DataFrame, closing: DataFrame, moves: DataFrame) -> DataFrame:
    """One change of `inventory` for each of ``moves`` (warehouse_id, product_id, units and the order columns)
    between two versions of it. The first move of a row that `opening` lacks inserts it."""
    before = opening.select(*STOCK_KEY, F.col("quantity").alias("_opening"))
    ids = closing.select(*STOCK_KEY, "inventory_id")
    placed = running(moves.withColumn("_one", F.lit(1)), STOCK_KEY, ORDER, {"_upto": ("sum", "units"), "_nth": ("sum", "_one")})
    rows = placed.join(before, STOCK_KEY, "left").join(ids, STOCK_KEY)
    upto = F.coalesce("_opening", F.lit(0)) + F.col("_upto")
    makes = F.col("_opening").isNull() & (F.col("_nth") == 1)
    return _change(
        rows, "inventory", F.when(makes, "INSERT").otherwise("UPDATE"), F.col("inventory_id"),
        F.when(~makes, _image("inventory", quantity=upto - F.col("units"))), _image("inventory", quantity=upto),
    )


def feed(*changes: DataFrame, after: int = 0) -> DataFrame:
    """All changes in order, numbered from ``after + 1``."""
    every = materialise(reduce(DataFrame.unionByName, changes), "changes")
    return number_rows(every, [*ORDER, "table_name", "record_id"], F.lit(after), "change_id").select(
        "change_id", "table_name", "operation", "record_id", "before", "after", F.col("moment").alias("changed_at")
    )


def audit_rows(fed: DataFrame) -> DataFrame:
    """The audit log's rows of a feed."""
    return conform(fed.select(F.col("change_id").alias("log_id"), "table_name", "operation", "record_id", F.col("changed_at").alias("log_time")), "audit_log")


def of_purchases(d: Domain, made: PurchasePlacement, closing: DataFrame, phase: int = 0) -> list[DataFrame]:
    """New purchases, and the stock that their items bring in."""
    moment, request = F.col("purchase_date"), F.col("purchase_id")
    moves = made.items.join(made.purchases.select("purchase_id", "warehouse_id", "purchase_date"), "purchase_id")
    moves = _ordered(moves, phase, moment, request, F.col("purchase_item_id")).withColumn("units", F.col("quantity").cast("long"))
    return [inserted(made.purchases, "purchase", "purchase_id", phase, moment, request), stock_moves(d["inventory"], closing, moves)]


def of_checkout(d: Domain, made: Checkout, phase: int = 0) -> list[DataFrame]:
    """New orders, and the stock that each line takes."""
    moment, request = F.col("order_date"), F.col("order_id")
    moves = made.picked.join(made.orders.select("order_id", "order_date"), "order_id")
    moves = _ordered(moves, phase, moment, request, F.col("order_item_id")).withColumn("units", -F.col("quantity").cast("long"))
    return [inserted(made.orders, "order", "order_id", phase, moment, request), stock_moves(d["inventory"], made.inventory, moves)]


def of_reversals(d: Domain, made: Reversal, as_of: Moment, phase: int = 0) -> list[DataFrame]:
    """Stock that reversed purchases take back, and the purchases that go."""
    gone = d["purchase"].join(made.reversed_ids, "purchase_id", "left_semi")
    items = d["purchase_item"].join(gone.select("purchase_id", "warehouse_id"), "purchase_id")
    items = items.groupBy("purchase_id", *STOCK_KEY).agg(F.sum("quantity").alias("quantity"))
    moment, request = C.moment(as_of), F.col("purchase_id")
    moves = _ordered(items, phase, moment, request, F.col("product_id")).withColumn("units", -F.col("quantity").cast("long"))
    last = deleted(gone, "purchase", "purchase_id", phase, moment, request, (1 << 62))
    return [stock_moves(d["inventory"], made.inventory, moves), last]


def of_transfers(d: Domain, requests: DataFrame, rejected: DataFrame, closing: DataFrame, as_of: Moment, phase: int = 0) -> list[DataFrame]:
    """The stock rows that each granted transfer request draws on and adds to."""
    granted = requests.join(rejected.select(F.col("key").alias("request_id")), "request_id", "left_anti")
    units = F.col("quantity").cast("long")
    side = lambda hub, step, sign: F.struct(F.col(hub).alias("warehouse_id"), F.lit(step).alias("place"), (units * sign).alias("units"))
    moved = granted.select("request_id", "product_id", F.inline(F.array(side("from_warehouse_id", 0, -1), side("to_warehouse_id", 1, 1))))
    return [stock_moves(d["inventory"], closing, _ordered(moved, phase, C.moment(as_of), F.col("request_id"), F.col("place")))]
