"""Running totals that do not put a whole key into one task.

A plain ``sum() over (partition by key order by ...)`` sorts every row of a key in a single task, so
one dominant key stalls the job. Here the rows are dealt to range partitions on (key, order) and written
once. The partition is the *block*: a key has at most one block per partition, whatever its times and
ids look like, and a dominant key spreads over many. Block sums are pre-aggregated, a window over the few
blocks of a key gives each block its starting value, and the row-level window runs per (key, block).

``running`` takes that way for keys of many rows only; all rows of other keys go through one window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotwise.session import materialise

BLOCK = "_block"
BEFORE = "_before"
Totals = dict[str, tuple[Literal["sum", "max"], str]]  # name: kind and column
KINDS = {"sum": F.sum, "max": F.max}
FEW = 1 << 16  # rows of a key that one window takes


@dataclass(frozen=True)
class Blocked:
    """Written rows tagged with their block, and one row per block with the totals before it. `nulls` tells whether
    keys may be null; without that, rows that are stored by their blocks are joined where they lie."""

    rows: DataFrame
    blocks: DataFrame
    on: tuple[str, ...]
    order: tuple[Column, ...]
    nulls: bool = True

    def within(self) -> Window:
        """Window inside one block, up to and including the current row."""
        return (
            Window.partitionBy(*self.on)
            .orderBy(*self.order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )

    def join(self, blocks: DataFrame) -> DataFrame:
        """The rows with what is known of their blocks. Null keys are keys like any other."""
        names = {c: f"_of_{c}" for c in self.on}
        side = blocks.withColumnsRenamed(names)
        same = [F.col(c).eqNullSafe(F.col(names[c])) if self.nulls else F.col(c) == F.col(names[c]) for c in self.on]
        return self.rows.join(side, same).drop(*names.values())


def blocked(df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: Totals, descending: bool = False) -> Blocked:
    """Cut ``df`` into blocks that follow ``order`` inside each key. Rows that agree in key and order
    share a block. ``totals`` names sums or maxima of columns; the blocks hold them over all earlier ones
    of the key, under the same names with ``_before`` in front (null for the first block)."""
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    along = [direction(c) for c in order]
    dealt = df.repartitionByRange(*[F.col(k) for k in keys], *along).withColumn(BLOCK, F.spark_partition_id())
    rows = materialise(dealt, "blocks")
    found = rows.groupBy(*keys, BLOCK).agg(*[KINDS[kind](c).alias(f"_in_{name}") for name, (kind, c) in totals.items()])
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    # totals of totals: a maximum of maxima, a sum of sums
    blocks = found.withColumns({f"{BEFORE}_{name}": KINDS[kind](f"_in_{name}").over(earlier) for name, (kind, _) in totals.items()})
    return Blocked(rows, blocks.drop(*[f"_in_{name}" for name in totals]), (*keys, BLOCK), tuple(along))


def _in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: Totals, descending: bool) -> DataFrame:
    cut = blocked(df, keys, order, totals, descending)
    merged = {}
    for name, (kind, c) in totals.items():
        before, here = F.col(f"{BEFORE}_{name}"), KINDS[kind](c).over(cut.within())
        merged[name] = F.greatest(before, here) if kind == "max" else F.coalesce(before, F.lit(0)) + here
    return cut.join(cut.blocks).withColumns(merged).drop(*[f"{BEFORE}_{name}" for name in totals], BLOCK)


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: Totals, descending: bool = False, stored: bool = False
) -> DataFrame:
    """``df`` plus running sums or maxima per key, current row included. Keys of more than FEW rows are cut into
    blocks. ``stored`` says that `df` is read from storage, so that it need not be written to be read twice."""
    if not keys:
        return _in_blocks(df, keys, order, totals, descending)
    rows = df if stored else materialise(df, "rows-to-total")
    many = materialise(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > FEW).select(*keys), "long-keys")
    along = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    window = Window.partitionBy(*keys).orderBy(*along).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = lambda few: few.withColumns({name: KINDS[kind](c).over(window) for name, (kind, c) in totals.items()})
    if many.isEmpty():
        return whole(rows)
    side = many.withColumnsRenamed({c: f"_of_{c}" for c in keys})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]
    long = _in_blocks(rows.join(side, same, "left_semi"), keys, order, totals, descending)
    return whole(rows.join(side, same, "left_anti")).unionByName(long)


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, descending: bool = False, out: str = "running_total"
) -> DataFrame:
    """``df`` plus the running total of ``value`` per key, current row included."""
    return running(df, keys, order, {out: ("sum", value)}, descending)


def take_in_order(quantity: Column, upto: Column, wanted: Column) -> Column:
    """Share of a row that falls inside the first ``wanted`` units, given the running total
    ``upto`` that already includes the row."""
    return F.least(quantity, F.greatest(wanted - (upto - quantity), F.lit(0)))
