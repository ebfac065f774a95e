"""The set of domain tables a job reads, plus loading from and writing to storage."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotwise.schema import TABLES

Provider = DataFrame | Callable[[], DataFrame]


class Domain:
    """Named DataFrames. A provider may be a DataFrame or a function building one on first use,
    so a job only plans the tables it touches."""

    def __init__(self, tables: Mapping[str, Provider]):
        unknown = set(tables) - set(TABLES)
        if unknown:
            raise KeyError(f"not domain tables: {sorted(unknown)}")
        self._tables: dict[str, Provider] = dict(tables)

    def __getitem__(self, name: str) -> DataFrame:
        provider = self._tables[name]
        if callable(provider):
            provider = self._tables[name] = provider()
        return provider

    def __contains__(self, name: str) -> bool:
        return name in self._tables

    def replace(self, **tables: Provider) -> Domain:
        """A copy with some tables swapped, e.g. the inventory snapshot after a batch."""
        return Domain({**self._tables, **tables})

    def register_views(self, prefix: str = "") -> None:
        """Expose every table to ``spark.sql``."""
        for name in self._tables:
            self[name].createOrReplaceTempView(prefix + name)


def load(spark: SparkSession, root: str, fmt: str = "parquet") -> Domain:
    """Read ``root/<table>`` with the declared schema; no inference, pruning left to the scan."""
    return Domain(
        {
            name: (lambda n=name, t=table: spark.read.schema(t.struct).format(fmt).load(f"{root}/{n}"))
            for name, table in TABLES.items()
        }
    )


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project and cast to the table's contract."""
    return df.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table].struct.fields]
    )


def from_rows(spark: SparkSession, rows: Mapping[str, list[tuple]]) -> Domain:
    """Literal rows as tables (missing tables are empty)."""
    return Domain(
        {name: spark.createDataFrame(rows.get(name, []), t.struct) for name, t in TABLES.items()}
    )


def append(df: DataFrame, root: str, table: str, fmt: str = "parquet") -> None:
    """Append rows (bulk load or insert-from-select) to a stored table."""
    conform(df, table).write.mode("append").format(fmt).save(f"{root}/{table}")


def write_snapshot(df: DataFrame, root: str, table: str, version: int | str) -> str:
    """Write one immutable table version beside the tables that ``load`` reads. Re-running a version replaces only that
    version. ``snapshots.SnapshotStore`` versions several tables together."""
    path = f"{root}/versions/{table}/v={version}"
    conform(df, table).write.mode("overwrite").parquet(path)
    return path
