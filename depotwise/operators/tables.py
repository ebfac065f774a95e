"""What every listing offers: search, date range, sort, paging and CSV export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotwise.functions import columns as C
from depotwise.operators.stock import Moment


def search_rows(df: DataFrame, text: str, *fields: str) -> DataFrame:
    """Rows where any field contains the text, ignoring case."""
    return df.where(C.matches_text(text, *fields))


def in_range(df: DataFrame, when: str, as_of: Moment, days: int | None) -> DataFrame:
    return df.where(C.within_days(when, as_of, days))


def row_count(df: DataFrame) -> DataFrame:
    """Exact number of rows as a one-row table; no other column is read."""
    return df.agg(F.count(F.lit(1)).alias("rows"))


def sort_key(df: DataFrame, key: str, descending: bool = False) -> Column:
    """Text sorts by its lower-case form; missing values come last in both directions."""
    value = F.lower(F.col(key)) if isinstance(df.schema[key].dataType, T.StringType) else F.col(key)
    return value.desc_nulls_last() if descending else value.asc_nulls_last()


def sort_rows(df: DataFrame, key: str, descending: bool = False, *ties: str) -> DataFrame:
    return df.orderBy(sort_key(df, key, descending), *[F.col(t).asc_nulls_last() for t in ties])


def top(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """First rows of an order. Each task keeps only its own first rows, so nothing is fully sorted."""
    return df.orderBy(*order).limit(limit)


def page_after(
    df: DataFrame, order: Sequence[str], size: int, after: Sequence | None = None
) -> DataFrame:
    """The next page of a listing sorted newest first on ``order`` (date, id). ``after`` holds the
    order values of the last row seen, so later pages cost no more than the first one."""
    if after is not None:
        fields = [df.schema[c] for c in order]
        seen = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(after, fields, strict=True)])
        # the first column's own bound is what a scan can use to skip rows
        df = df.where((F.col(order[0]) <= F.lit(after[0]).cast(fields[0].dataType)) & (F.struct(*order) < seen))
    return top(df, size, *[F.col(c).desc() for c in order])


def page_by(
    df: DataFrame, sort: Sequence[tuple[str, bool]], size: int, after: Sequence | None = None
) -> DataFrame:
    """The next page of a listing in any order: ``sort`` names columns and whether each descends, the last one
    unique. Text sorts without case, missing values come last in either direction. ``after`` holds the values of these
    columns in the last row seen. Unless it is text, the first column's own bound reaches the scan."""
    keys = [sort_key(df, name, descending) for name, descending in sort]
    if after is not None:
        # a row follows if it agrees on some first columns and comes later on the next
        same, follows = F.lit(True), F.lit(False)
        for i, ((name, descending), seen) in enumerate(zip(sort, after, strict=True)):
            kind = df.schema[name].dataType
            text = isinstance(kind, T.StringType)
            value, last = (F.lower(F.col(name)) if text else F.col(name)), F.lit(seen).cast(kind)
            last = F.lower(last) if text else last
            if seen is None:
                later = F.lit(False)
                bound = value.isNull()
            else:
                later = F.coalesce(value < last if descending else value > last, F.lit(True))
                bound = (value <= last if descending else value >= last) | value.isNull()
            if i == 0 and not text:
                df = df.where(bound)
            follows = follows | (same & later)
            same = same & value.eqNullSafe(last)
        df = df.where(follows)
    return top(df, size, *keys)


def page_at(df: DataFrame, order: Sequence[str], size: int, offset: int) -> DataFrame:
    """The page starting at a row offset, for callers that count rows instead of keeping a key. One task holds
    offset + size rows, so it is for the first pages; ``page_after`` and ``page_by`` cost the same for any page."""
    return df.orderBy(*[F.col(c).desc() for c in order]).offset(offset).limit(size)


def write_csv(df: DataFrame, path: str, headers: Sequence[str] | None = None, quote_all: bool = False,
              single_file: bool = False) -> None:
    """CSV with a header line, double quotes doubled and null as an empty cell. ``quote_all``
    quotes every cell (the report pages), otherwise only cells that need it (the listings).
    A large export stays one file per task; ``single_file`` is for small reports."""
    named = df.toDF(*headers) if headers else df
    text = named.select(*[F.col(f"`{c}`").cast("string") for c in named.columns])
    if quote_all:
        text = text.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in text.columns])
    options = {"header": True, "quote": '"', "escape": '"', "emptyValue": '""' if quote_all else ""}
    rows = text.coalesce(1) if single_file else text
    rows.write.mode("overwrite").options(
        **options, quoteAll=quote_all, nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
