"""Contains-searches over stored tables that open only files which can hold the text.

A search for "contains, ignoring case" cannot use a scan's minima and maxima. For every file of a table the index keeps
which three-letter pieces occur in the searched columns, as positions in a fixed number of slots. A file can hold a text
only if it has all of the text's pieces; what is read is then searched row by row, so slots that coincide cost
time and no result. Texts of one or two letters read every file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depotwise.functions import columns as C

SLOTS = 1 << 14  # an index row has at most so many numbers, whatever the file holds
PIECE = 3


def _pieces(text: Column) -> Column:
    """Slots of the pieces of a text in lower case; of a shorter text none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    last = F.length(low) - PIECE + 1
    cut = F.transform(F.sequence(F.lit(1), last), lambda i: F.pmod(F.xxhash64(F.substring(low, i, F.lit(PIECE))), F.lit(SLOTS)).cast("int"))
    return F.when(last >= 1, cut).otherwise(F.array().cast("array<int>"))


def build_index(spark: SparkSession, table: str, index: str, fields: Sequence[str]) -> None:
    """Write the index of some columns of a Parquet table: (file, slots). Pieces are made distinct before they move."""
    rows = spark.read.parquet(table)
    text = F.explode(F.flatten(F.array(*[_pieces(F.col(f).cast("string")) for f in fields]))).alias("slot")
    pieces = rows.select(F.input_file_name().alias("file"), text).distinct()
    files = rows.select(F.input_file_name().alias("file")).distinct()
    sets = pieces.groupBy("file").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    files.join(sets, "file", "left").select("file", F.coalesce("slots", F.array().cast("array<int>")).alias("slots")).write.mode("overwrite").parquet(index)


def files_with(spark: SparkSession, index: str, text: str) -> list[str]:
    """Files that can hold a text, by the index: at most one name for each file of the table."""
    found = spark.read.parquet(index).where(F.size(F.array_except(_pieces(F.lit(text.strip().lower())), "slots")) == 0)
    return sorted(r.file for r in found.select("file").collect())


def search(spark: SparkSession, table: str, index: str, text: str, fields: Sequence[str]) -> DataFrame:
    """The rows of a table in which one of the columns contains a text, ignoring case."""
    schema = spark.read.parquet(table).schema
    files = files_with(spark, index, text)
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return rows.where(C.matches_text(text, *fields))
