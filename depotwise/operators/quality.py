"""Integrity rules as jobs that return the violating rows: (rule, table, key, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotwise.operators.stock import movement_balance
from depotwise.schema import TABLES, Table
from depotwise.sources.domain import Domain


class QualityError(RuntimeError):
    """Raised by ``assert_clean``."""


def _text(*parts: str | Column) -> Column:
    cells = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts]
    return F.concat(*cells)


def _violation(rule: str | Column, table: str, key: Column, detail: Column) -> list[Column]:
    rule = F.lit(rule) if isinstance(rule, str) else rule
    return [rule.alias("rule"), F.lit(table).alias("table"), key.cast("string").alias("key"), detail.alias("detail")]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# ---- rules of one table, from its contract ------------------------------------------


def _row_checks(t: Table) -> list[tuple[str, Column, Column]]:
    """(rule, broken?, detail) for every rule that looks at one row only."""
    checks = [("required", F.col(c).isNull(), _text(c)) for c in t.required]
    checks += [("positive", F.col(c) <= 0, _text(c, " = ", F.col(c))) for c in t.positive]
    checks += [("non-negative", F.col(c) < 0, _text(c, " = ", F.col(c))) for c in t.non_negative]
    checks += [("domain", ~F.col(c).isin(*allowed), _text(c, " = ", F.col(c))) for c, allowed in t.domains.items()]
    checks += [("different", F.col(a) == F.col(b), _text(a, " = ", b)) for a, b in t.different]
    checks += [("length", F.char_length(c) > n, _text(c, f" > {n}")) for c, n in t.lengths.items()]
    return checks


def row_violations(d: Domain, table: str) -> DataFrame:
    """All single-row rules of a table, found in one scan."""
    t = TABLES[table]
    found = F.array(
        *[F.when(broken, F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))) for rule, broken, detail in _row_checks(t)]
    )
    return (
        d[table]
        .select(F.col(t.key).alias("_key"), F.inline(F.array_compact(found)))
        .select(*_violation(F.col("rule"), table, F.col("_key"), F.col("detail")))
    )


GROUPS = 500_000  # rows of a table that one task looks for repeated values in


def unique_violations(d: Domain, table: str) -> DataFrame:
    """Key and unique-column values that occur more than once (nulls never clash). Values are dealt by their hash to
    as many partitions as keep GROUPS rows each, before any are counted: most are different, so counting them where
    they are read would only hold a whole split in memory."""
    t = TABLES[table]
    parts = d[table].count() // GROUPS + 1

    def repeated(columns: tuple[str, ...]) -> DataFrame:
        present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
        value = F.concat_ws(", ", *[F.col(c).cast("string") for c in columns])
        return (
            d[table].where(present).select(*columns).repartition(parts, *columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
            .select(*_violation("unique", table, value, _text(", ".join(columns) + " occurs ", F.col("n"))))
        )

    return _union([repeated(columns) for columns in ((t.key,), *t.unique)])


def foreign_violations(d: Domain, table: str) -> DataFrame | None:
    """References to rows that do not exist. Child keys are reduced to distinct values before the
    anti join, so a dominant missing key is one row there; offending rows are found through it."""
    t = TABLES[table]

    def dangling(column: str, parent: str) -> DataFrame:
        keys = d[parent].select(F.col(TABLES[parent].key).alias(column))
        missing = d[table].where(F.col(column).isNotNull()).select(column).distinct().join(keys, column, "left_anti")
        return (
            d[table].join(missing, column, "left_semi")
            .select(*_violation("reference", table, F.col(t.key), _text(f"{column} = ", F.col(column))))
        )

    parts = [dangling(c, p) for c, p in t.foreign.items()]
    return _union(parts) if parts else None


def table_violations(d: Domain, table: str) -> DataFrame:
    parts = [row_violations(d, table), unique_violations(d, table), foreign_violations(d, table)]
    return _union([p for p in parts if p is not None])


def violations(d: Domain, tables: list[str] | None = None) -> DataFrame:
    """Every contract rule of the given (or all) tables."""
    return _union([table_violations(d, t) for t in tables or TABLES])


# ---- rules across tables -------------------------------------------------------------


def supplier_mismatches(d: Domain) -> DataFrame:
    """Purchased lines whose product belongs to another supplier than the purchase names."""
    buyers = d["purchase"].select("purchase_id", F.col("supplier_id").alias("named"))
    owners = d["product"].select("product_id", F.col("supplier_id").alias("owner"))
    return (
        d["purchase_item"].join(buyers, "purchase_id", "left").join(owners, "product_id", "left")
        .where(~F.col("named").eqNullSafe(F.col("owner")))
        .select(*_violation("supplier owns product", "purchase_item", F.col("purchase_item_id"),
                            _text("product ", F.col("product_id"), " of supplier ", F.col("owner"), ", not ", F.col("named"))))
    )


def capacity_below_stock(d: Domain, proposed: DataFrame) -> DataFrame:
    """Proposed capacities (warehouse_id, capacity_units) that shrink a hub below what it stores.
    Growing a hub always passes, even an overfull one."""
    used = d["inventory"].groupBy("warehouse_id").agg(F.sum("quantity").alias("used"))
    current = d["warehouse"].select("warehouse_id", F.col("capacity_units").alias("current"))
    stored = F.coalesce("used", F.lit(0))
    return (
        proposed.select("warehouse_id", F.col("capacity_units").alias("wanted"))
        .join(current, "warehouse_id").join(used, "warehouse_id", "left")
        .where((F.col("wanted") < F.col("current")) & (F.col("wanted") < stored))
        .select(*_violation("capacity below stock", "warehouse", F.col("warehouse_id"),
                            _text("wanted ", F.col("wanted"), ", stored ", stored)))
    )


def capacity_breaches(d: Domain, after: DataFrame) -> DataFrame:
    """Stock rows of a new snapshot that add units to a hub which then exceeds its capacity. Rows
    that fall or stay never count, so an overfull hub can still be drained. Units are matched per
    (hub, product); stock moved to another hub is all new there."""
    key = ["warehouse_id", "product_id"]
    zero = F.lit(0).cast("bigint")
    both = (
        d["inventory"].select(*key, F.col("quantity").cast("bigint").alias("old"), zero.alias("new"))
        .unionByName(after.select(*key, zero.alias("old"), F.col("quantity").cast("bigint").alias("new")))
        .groupBy(*key).agg(F.sum("old").alias("old"), F.sum("new").alias("new"))
    )
    hubs = (
        both.groupBy("warehouse_id").agg(F.sum("old").alias("used"), F.sum("new").alias("total"))
        .join(d["warehouse"].select("warehouse_id", "capacity_units"), "warehouse_id")
        .where(F.col("total") > F.col("capacity_units"))
    )
    return (
        both.where(F.col("new") > F.col("old")).join(hubs, "warehouse_id")
        .select(
            *key, "capacity_units", F.col("used").alias("used_units"),
            F.greatest(F.col("capacity_units") - F.col("used"), F.lit(0)).alias("free_units"),
            (F.col("new") - F.col("old")).alias("added_units"),
        )
    )


def request_violations(requests: DataFrame, key: str, quantity: str = "quantity", cost: str | None = None,
                       platforms: str | None = None) -> DataFrame:
    """Form rules on incoming requests: whole positive quantity, whole non-negative cost, at least
    one platform."""
    checks = []
    if quantity in requests.columns:
        value = F.col(quantity).cast("double")
        checks.append(("whole positive quantity", value.isNull() | (value <= 0) | (value != F.floor(value))))
    if cost is not None:
        value = F.col(cost).cast("double")
        checks.append(("whole cost", value.isNull() | (value != F.floor(value))))
        checks.append(("non-negative cost", value < 0))
    if platforms is not None:
        checks.append(("at least one platform", F.coalesce(F.size(platforms), F.lit(0)) < 1))
    found = F.array(*[F.when(broken, F.lit(rule)) for rule, broken in checks])
    return (
        requests.select(F.col(key).alias("_key"), F.explode(F.array_compact(found)).alias("rule"))
        .select(*_violation(F.col("rule"), "request", F.col("_key"), F.lit("")))
    )


def negative_balances(d: Domain) -> DataFrame:
    """Days on which the movements of a (hub, product) add up to less than nothing."""
    return movement_balance(d).where(F.col("balance") < 0).drop("net_units")


def duplicate_contacts(d: Domain) -> DataFrame:
    """Contacts that several customers share; matching uses the lowest id."""
    return (
        d["customer"].where(F.col("contact").isNotNull()).groupBy("contact")
        .agg(F.count(F.lit(1)).alias("customers"), F.min("customer_id").alias("matched_id"))
        .where(F.col("customers") > 1)
    )


def duplicate_hub_names(d: Domain) -> DataFrame:
    return (
        d["warehouse"].groupBy("name").agg(F.count(F.lit(1)).alias("hubs")).where(F.col("hubs") > 1)
    )


def summary(found: DataFrame) -> DataFrame:
    """Violations per table and rule."""
    return found.groupBy("table", "rule").agg(F.count(F.lit(1)).alias("violations"))


def assert_clean(found: DataFrame, show: int = 5) -> None:
    """Fail the job if there is any violation, quoting a few."""
    rows = found.limit(show).collect()
    if rows:
        raise QualityError("; ".join(str(r.asDict()) for r in rows))

