"""Sequential allocation: order lines are served one after another and each deducts stock before the
next is routed.

Within a product this order dependence is real (every shipment changes which hub ranks first), so
lines of one product are folded in order; different products run in parallel. The fold streams over partitions
sorted by product, and the state of a hub is one number, the units taken from it: what is left, its surcharge
and its oldest lot are looked up in running totals of its lots. Runs of lines that the leading hub serves
before another one overtakes it are found on running totals of the lines and served at once.

Orders that are served as a whole tie products together: a line that finds no hub takes back what the other
lines of its order took, and so changes what comes after in their products. ``serve_orders`` folds all products on
the assumption that no order fails elsewhere, looks which orders failed where, and folds those products anew
for which that assumption was wrong, until it is right everywhere. Decisions depend on earlier ones
only: the first wrong one has nothing but right ones before it, so each round settles it for good, and
what no round changes is what serving one by one gives. A round folds the products for which it changes something, no
others, and what it decides is written once: the result takes each product from the last round that folded it."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotwise.operators.mutations import apply_deltas
from depotwise.operators.stock import STOCK_KEY, Moment, aged_lots
from depotwise.policy import AgePolicy
from depotwise.session import materialise, work_path
from depotwise.sources.domain import Domain

HUB, LOT, LINE = 0, 1, 2
LINE_KEY = ["order_date", "order_id", "order_item_id"]
REASONS = ("no stock", "insufficient stock", "split across hubs")
NO_STOCK, INSUFFICIENT, SPLIT = range(3)
RESULT = "order_item_id long, order_id long, product_id long, quantity long, hub long, refusal int"
FED = ("product_id", "kind", "warehouse_id", "days", "extra", "units", "order_id", "order_item_id", "held", "whole")
NOWHERE = -1
LOOKAHEAD = 4096
WORTH = 16  # a run of fewer lines is served line by line as fast


class _Hub:
    """One product at one hub. Units without a lot go first, then the oldest lots: the newest units stay."""

    __slots__ = ("hub", "held", "taken", "lotless", "days", "extra", "ends", "relief", "total")

    def __init__(self, hub: int, held: int):
        self.hub, self.held, self.taken, self.lotless = hub, held, 0, held
        self.days, self.extra, self.ends, self.relief, self.total = [], [], [], [], 0

    def add_lot(self, days: int, extra: int, units: int) -> None:
        """Lots (extra: tenths of a unit's rent) come oldest first."""
        self.days.append(days)
        self.extra.append(extra)
        self.relief.append(self.total)
        self.ends.append((self.ends[-1] if self.ends else 0) + units)
        self.total += extra * units

    def close(self) -> None:
        self.lotless = max(self.held - (self.ends[-1] if self.ends else 0), 0)

    def rank(self, taken: int) -> tuple[int, int, int, int]:
        """Smaller is served from first: most surcharge, then the oldest lot, most stock, the lowest id."""
        gone = max(taken - self.lotless, 0)
        i = bisect_right(self.ends, gone)
        if i == len(self.ends):
            return 0, 0, taken - self.held, self.hub
        inside = gone - (self.ends[i - 1] if i else 0)
        return self.relief[i] + self.extra[i] * inside - self.total, -self.days[i], taken - self.held, self.hub

    def lead(self, second: tuple | None) -> int:
        """The most units that can have been taken so that this hub still ranks before `second`."""
        if second is None:
            return self.held
        low, high = self.taken, self.held
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.rank(middle) < second else (low, middle - 1)
        return low


class _ProductStock:
    """Stock of one product at all hubs, in the order in which hubs are chosen."""

    def __init__(self) -> None:
        self.hubs: dict[int, _Hub] = {}
        self.ranking: list[tuple] = []
        self.left: list[int] = []  # units at each hub, ascending
        self.total, self.ready = 0, False

    def open(self) -> None:
        if not self.ready:
            for hub in self.hubs.values():
                hub.close()
                insort(self.ranking, hub.rank(0))
                insort(self.left, hub.held)
                self.total += hub.held
            self.ready = True

    def most(self) -> int:
        return self.left[-1] if self.left else 0

    def choose(self, need: int) -> int:
        """Place in the ranking of the first hub that holds `need`."""
        if need > self.most():
            return NOWHERE
        for place, (_, _, left, _) in enumerate(self.ranking):
            if -left >= need:
                return place
        return NOWHERE

    def move(self, place: int, units: int) -> None:
        """Take units from the hub at a place in the ranking; negative ones come back."""
        old = self.ranking.pop(place)
        hub = self.hubs[old[3]]
        self.left.pop(bisect_right(self.left, -old[2]) - 1)
        hub.taken += units
        self.total -= units
        insort(self.ranking, hub.rank(hub.taken))
        insort(self.left, hub.held - hub.taken)

    def give_back(self, hub_id: int, units: int) -> None:
        hub = self.hubs[hub_id]
        self.move(self.ranking.index(hub.rank(hub.taken)), -units)

    def refusals(self, needs: np.ndarray) -> np.ndarray:
        """Positions in ``REASONS`` for lines that no hub can serve."""
        return np.where(self.total == 0, NO_STOCK, np.where(self.total < needs, INSUFFICIENT, SPLIT))


def _serve_lines(
    stock: _ProductStock, needs: np.ndarray, orders: np.ndarray, held: np.ndarray, whole: np.ndarray, hubs: np.ndarray, refusals: np.ndarray
) -> None:
    """Serve lines in order and write the hub or the refusal of each. Lines of one order are served as a
    whole where that is asked for; an order that is `held` back takes nothing, whatever it finds."""
    n, size = 0, len(needs)
    ends = np.append(np.flatnonzero((orders[1:] != orders[:-1]) | ~whole[1:]) + 1, size)
    of = np.searchsorted(ends, np.arange(size), side="right")
    group_end, single = ends[of], np.diff(ends, prepend=0)[of] == 1
    need_list, held_list, single_list = needs.tolist(), held.tolist(), single.tolist()
    patience = 0
    while n < size:
        need = need_list[n]
        if not single_list[n]:
            stop = int(group_end[n])
            taken = []
            for k in range(n, stop):
                place = stock.choose(need_list[k])
                if place == NOWHERE:
                    refusals[k] = stock.refusals(needs[k : k + 1])[0]
                else:
                    hubs[k] = stock.ranking[place][3]
                    taken.append((hubs[k], need_list[k]))
                    stock.move(place, need_list[k])
            if held_list[n] or len(taken) < stop - n:
                for hub, units in reversed(taken):
                    stock.give_back(int(hub), units)
            n = stop
            continue
        place = stock.choose(need)
        if place == NOWHERE:
            # no state changes until a line fits again, so the lines before it go at once
            ahead = needs[n : n + LOOKAHEAD]
            fits = (ahead <= stock.most()) | ~single[n : n + LOOKAHEAD]
            misfits = int(np.argmax(fits)) or len(ahead)
            refusals[n : n + misfits] = stock.refusals(ahead[:misfits])
            n += misfits
            continue
        if place == 0 and patience == 0:
            leader = stock.hubs[stock.ranking[0][3]]
            limit = leader.lead(stock.ranking[1] if len(stock.ranking) > 1 else None)
            if limit - leader.taken > WORTH * need:
                ahead = needs[n : n + LOOKAHEAD]
                moved = np.where(held[n : n + LOOKAHEAD], 0, ahead)
                before = leader.taken + np.cumsum(moved) - moved
                fine = (before <= limit) & (ahead <= leader.held - before) & single[n : n + LOOKAHEAD]
                run = len(ahead) if fine.all() else int(np.argmin(fine))
                hubs[n : n + run] = leader.hub
                stock.move(0, int(moved[:run].sum()))
                patience = 0 if run >= WORTH else WORTH
                n += run
                continue
            patience = WORTH
        patience = max(patience - 1, 0)
        hubs[n] = stock.ranking[place][3]
        if not held_list[n]:
            stock.move(place, need)
        n += 1


def _serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the products of one partition. Rows come product by product: first its hubs, then their
    lots, then the lines in order; a product may go on over any number of batches. The lines of the last order of a
    batch wait for the next one, which may go on with them."""
    current, stock = None, _ProductStock()
    waiting: dict[str, np.ndarray] | None = None

    def folded(table: dict[str, np.ndarray]) -> pa.RecordBatch:
        nonlocal current, stock
        product, kind = table["product_id"], table["kind"]
        hubs = np.full(len(product), NOWHERE, np.int64)
        refusals = np.full(len(product), NOWHERE, np.int32)
        starts = np.flatnonzero(np.diff(product, prepend=product[:1] - 1))
        for start, stop in zip(starts, [*starts[1:], len(product)], strict=True):
            if product[start] != current:
                current, stock = product[start], _ProductStock()
            lots, lines = start + np.searchsorted(kind[start:stop], (LOT, LINE))
            for hub, units in zip(table["warehouse_id"][start:lots].tolist(), table["units"][start:lots].tolist(), strict=True):
                stock.hubs[hub] = _Hub(hub, units)
            columns = [table[name][lots:lines].tolist() for name in ("warehouse_id", "days", "extra", "units")]
            for hub, *lot in zip(*columns, strict=True):
                stock.hubs[hub].add_lot(*lot)
            if lines < stop:
                stock.open()
                part = slice(lines, stop)
                held, whole = table["held"][part] != 0, table["whole"][part] != 0
                _serve_lines(stock, table["units"][part], table["order_id"][part], held, whole, hubs[part], refusals[part])
        served = kind == LINE
        columns = [table[name][served] for name in ("order_item_id", "order_id", "product_id", "units")]
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (*columns, hubs[served], refusals[served])], [c.split()[0] for c in RESULT.split(", ")]
        )

    for batch in batches:
        table = {name: batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in FED}
        if waiting is not None:
            table = {name: np.concatenate([waiting[name], table[name]]) for name in FED}
        n = len(table["kind"])
        if not n:
            continue
        other = (table["order_id"] != table["order_id"][-1]) | (table["product_id"] != table["product_id"][-1]) | (table["kind"] != LINE)
        keep = n if not table["whole"][-1] else int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        waiting = {name: column[keep:] for name, column in table.items()} if keep < n else None
        if keep:
            yield folded({name: column[:keep] for name, column in table.items()})
    if waiting is not None:
        yield folded(waiting)


def _rows(df: DataFrame, kind: int, **given: Column) -> DataFrame:
    """Rows of the fold; what is not given is zero."""
    types = {"warehouse_id": "long", "days": "int", "extra": "int", "units": "long", "order_date": "timestamp_ntz", "order_id": "long",
             "order_item_id": "long", "held": "int", "whole": "int"}
    none = lambda name: F.lit(None) if name == "order_date" else F.lit(0)
    return df.select(
        "product_id", F.lit(kind).alias("kind"), *[given.get(name, none(name)).cast(t).alias(name) for name, t in types.items()]
    )


def _stock(d: Domain, as_of: Moment, policy: AgePolicy) -> DataFrame:
    """Hubs that hold a product, and its lots summed per (hub, age in days), as rows of the fold."""
    lots = (
        aged_lots(d, as_of, policy)
        .groupBy(*STOCK_KEY, "days_stored", "rent_multiplier")
        .agg(F.sum("units").alias("units"))
        .withColumn("extra", (F.col("rent_multiplier") - 1) * 10)
    )
    c = F.col
    hubs = _rows(d["inventory"].where(F.col("quantity") > 0), HUB, warehouse_id=c("warehouse_id"), units=c("quantity"))
    return hubs.unionByName(_rows(lots, LOT, warehouse_id=c("warehouse_id"), days=c("days_stored"), extra=c("extra"), units=c("units")))


def _stock_of(d: Domain, products: DataFrame, as_of: Moment, policy: AgePolicy) -> DataFrame:
    """``_stock`` of the given products (product_id). Lots of a product don't depend on others, so the rest goes before
    lots are dated and aged."""
    only = lambda table: d[table].join(products, "product_id", "left_semi")
    return _stock(d.replace(**{table: only(table) for table in ("inventory", "purchase_item", "stock_transfer")}), as_of, policy)


def _fold(stock: DataFrame, lines: DataFrame) -> DataFrame:
    """The hub or the refusal of every line. `whole` lines of an order are served together, and take nothing if the
    order is `held` back."""
    names = ("order_date", "order_id", "order_item_id", "held", "whole")
    feed = stock.unionByName(_rows(lines, LINE, units=F.col("quantity"), **{name: F.col(name) for name in names}))
    # A fixed number of partitions: the fold costs time per line, not per byte, so merging small
    # partitions at run time would only take parallelism away.
    partitions = int(feed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = feed.repartition(partitions, "product_id").sortWithinPartitions(
        "product_id", "kind", F.col("days").desc(), *LINE_KEY, "units"
    )
    reasons = F.array(*[F.lit(r) for r in REASONS])
    return ordered.select(*FED).mapInArrow(_serve, RESULT).select(
        "order_item_id", "order_id", "product_id", "quantity",
        F.when(F.col("hub") != NOWHERE, F.col("hub")).alias("warehouse_id"),
        F.when(F.col("refusal") != NOWHERE, F.element_at(reasons, F.col("refusal") + 1)).alias("reason"),
    )


@dataclass(frozen=True)
class Allocation:
    lines: DataFrame
    inventory: DataFrame
    rejected: DataFrame


def allocate_orders(
    d: Domain, lines: DataFrame, as_of: Moment, policy: AgePolicy = AgePolicy()
) -> Allocation:
    """Route and deduct ``lines`` (order_item_id, order_id, product_id, quantity, order_date) in the
    order of ``LINE_KEY``, with stock aged at ``as_of``. Lines of one order are served on their own:
    ``rejected`` names the lines that found no hub. ``serve_orders`` serves orders as a whole."""
    served = materialise(_fold(_stock(d, as_of, policy), lines.withColumns({"held": F.lit(0), "whole": F.lit(0)})), "allocation")
    shipped = served.where(F.col("warehouse_id").isNotNull())
    deltas = shipped.groupBy(*STOCK_KEY).agg((-F.sum("quantity")).alias("units"))
    rejected = served.where(F.col("reason").isNotNull()).select("order_item_id", "order_id", "product_id", "quantity", "reason")
    return Allocation(served, apply_deltas(d["inventory"], deltas), rejected)


def serve_orders(d: Domain, lines: DataFrame, as_of: Moment, policy: AgePolicy = AgePolicy()) -> DataFrame:
    """``lines`` (order_item_id, order_id, product_id, quantity, order_date) with the hub each is shipped from
    (warehouse_id), or would be, and why it finds none (reason): orders are served in the order of ``LINE_KEY``, each
    as a whole or not at all, and what a failed order took is there for the next one. All lines of an order have its date.

    An order of one product is decided by folding that product. Of the others each product is told which
    orders are held back by failures elsewhere; the failures of a round tell the next one."""
    lines = materialise(lines.select(*LINE_KEY, "product_id", "quantity", F.lit(1).alias("whole")), "lines-to-serve")
    asked = materialise(lines.select("product_id").distinct(), "asked-products")
    stock = materialise(_stock_of(d, asked, as_of, policy), "stock-at-hubs")
    products = lines.groupBy("order_id").agg(F.min("product_id").alias("low"), F.max("product_id").alias("high"))
    tied = lines.select("order_id", "product_id").join(products.where("low <> high").select("order_id"), "order_id", "left_semi").distinct()
    tied = materialise(tied, "tied-products")
    key = ["order_id", "product_id"]
    held_lines = lambda some, held: some.join(held.withColumn("_held", F.lit(1)), key, "left").withColumn("held", F.coalesce("_held", F.lit(0))).drop("_held")
    failed_in = lambda served: served.where(F.col("reason").isNotNull()).select(*key).distinct().join(tied, key, "left_semi")

    spark = lines.sparkSession
    rounds, redone = work_path(spark, "served"), work_path(spark, "redone")

    def fold(n: int, stock: DataFrame, lines: DataFrame, held: DataFrame) -> DataFrame:
        """What round `n` decides, written once."""
        served = _fold(stock, held_lines(lines, held))
        served.write.parquet(f"{rounds}/round={n}")
        return spark.read.schema(served.schema).parquet(f"{rounds}/round={n}")

    held, n = tied.limit(0), 0
    served = fold(n, stock, lines, held)
    schema = served.schema
    failures = materialise(failed_in(served), "failures")
    while True:
        # an order is held back in a product if it fails in any other one
        where = failures.groupBy("order_id").agg(F.min("product_id").alias("low"), F.max("product_id").alias("high"))
        now = tied.join(where, "order_id").where("low <> product_id OR high <> product_id").select(*key)
        now = materialise(now, "held-back")
        n += 1
        again = now.exceptAll(held).unionByName(held.exceptAll(now)).select("product_id").distinct()
        again.write.parquet(f"{redone}/round={n}")
        changed = spark.read.schema(again.schema).parquet(f"{redone}/round={n}")
        held = now
        if changed.isEmpty():
            break
        some = lambda df, only=changed: df.join(only, "product_id", "left_semi")
        found = failed_in(fold(n, some(stock), some(lines), some(held)))
        failures = materialise(failures.join(changed, "product_id", "left_anti").unionByName(found), "failures")
    last = spark.read.schema("product_id long, round int").parquet(redone).groupBy("product_id").agg(F.max("round").alias("_last"))
    every = spark.read.schema(T.StructType([*schema.fields, T.StructField("round", T.IntegerType())])).parquet(rounds)
    return every.join(last, "product_id", "left").where(F.col("round") == F.coalesce("_last", F.lit(0))).select(schema.names)
