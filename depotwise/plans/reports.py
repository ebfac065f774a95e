"""A named report: how Spark builds it, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotwise.plans.oracle import with_tables
from depotwise.session import materialise
from depotwise.sources.domain import Domain
from depotwise.sources.star import star_domain


@dataclass(frozen=True)
class Inputs:
    """What a report builder gets: the domain tables and the directory they come from."""

    spark: SparkSession
    root: str
    domain: Domain

    def stored(self, *tables: str) -> Inputs:
        """The same with some tables written once, for jobs that read them many times."""
        return replace(self, domain=self.domain.replace(**{t: materialise(self.domain[t], t) for t in tables}))


@dataclass(frozen=True)
class Report:
    build: Callable[[Inputs], DataFrame]
    sql: str | None = None
    hub: str = "region"
    tables: dict[str, str] = field(default_factory=dict)
    optional_ids: tuple[str, ...] = ()

    def run(self, spark: SparkSession, root: str) -> DataFrame:
        built = self.build(Inputs(spark, root, star_domain(spark, root, self.hub)))
        return plain_types(built, self.optional_ids)

    def oracle(self) -> str | None:
        return None if self.sql is None else with_tables(self.sql, self.hub, self.tables)


def plain_types(df: DataFrame, optional_ids: tuple[str, ...] = ()) -> DataFrame:
    """Integers as bigint, decimals and ids that may be missing as double, dates as text, so that
    engines and clients with other decimal, date or null rules can be compared by value. Only the
    outermost projection does this; all sums are exact decimals."""
    whole = (T.ByteType, T.ShortType, T.IntegerType)

    def project(f: T.StructField):
        if isinstance(f.dataType, T.DateType):
            return F.col(f.name).cast("string").alias(f.name)
        if isinstance(f.dataType, T.DecimalType) or f.name in optional_ids:
            return F.col(f.name).cast("double").alias(f.name)
        if isinstance(f.dataType, whole):
            return F.col(f.name).cast("bigint").alias(f.name)
        return F.col(f.name)

    return df.select(*[project(f) for f in df.schema.fields])
