"""Packing token sequences into fixed-length rows: exact complements first, best fit for the rest."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotwise.llm.bpe import encode_bytes
from depotwise.llm.common import slices
from depotwise.session import materialise

CAPACITY = 2048
END_OF_TEXT = (0).to_bytes(4, "little")
PIECE_COLUMNS = "piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first takes what is over, all others are full."""
    first = n % capacity or capacity
    edges = [0, *range(first, n + 1, capacity)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def pieces(df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document of `df` (doc_id, text): place, length and checksum of the ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows, made = [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    ids = encode_bytes(text) + END_OF_TEXT
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append(i)
                        made.append((k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
                yield pa.record_batch([batch.column("doc_id").take(pa.array(rows, pa.int64())), *columns], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, {PIECE_COLUMNS}")


class Stock:
    """How many pieces of each length are left."""

    def __init__(self, counts: dict[int, int]):
        self.left = {k: n for k, n in counts.items() if n > 0}
        self.lengths = sorted(self.left)

    def take(self, parts: tuple[int, ...]) -> int:
        """Use a combination as often as the counts allow."""
        need = {k: parts.count(k) for k in parts}
        if any(k not in self.left for k in need):
            return 0
        times = min(self.left[k] // m for k, m in need.items())
        if times:
            for k, m in need.items():
                self.left[k] -= m * times
                if not self.left[k]:
                    del self.left[k]
                    self.lengths.pop(bisect_left(self.lengths, k))
        return times

    def fitting(self, room: int) -> int | None:
        """The longest length left that is at most `room`."""
        i = bisect_left(self.lengths, room + 1)
        return self.lengths[i - 1] if i else None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, how many such sequences) that use up `counts` exactly.

    Long pieces come first. What fills a piece's gap exactly is looked up among single lengths, then
    sums of two and of three lengths, and used as often as its counts last. Pieces that no combination
    completes go to the fullest open sequence they fit into, longest first; that is done for all
    pieces of equal length and all open sequences of equal room at once.

    The input has at most `capacity` entries and the work depends on those alone, not on the number of
    pieces; so this step on the driver stays the same at every size of the corpus."""
    stock, made = Stock(counts), []

    def use(parts: tuple[int, ...]) -> None:
        if times := stock.take(parts):
            made.append((parts, times))

    use((capacity,))
    for length in sorted(stock.left, reverse=True):
        gap = capacity - length
        if length not in stock.left or gap <= 0:
            continue
        use((length, gap))
        for depth in (2, 3):
            if length not in stock.left:
                break
            for combination in complements(stock, gap, depth, length):
                use((length, *combination))
                if length not in stock.left:
                    break
    open_rooms: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(parts: tuple[int, ...], times: int) -> None:
        room = capacity - sum(parts)
        if room not in open_rooms:
            open_rooms[room] = []
            insort(rooms, room)
        open_rooms[room].append([parts, times])

    for length in reversed(list(stock.lengths)):
        n = stock.left[length]
        while n:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                each = capacity // length
                if n >= each:
                    put((length,) * each, n // each)
                if n % each:
                    put((length,) * (n % each), 1)
                break
            group = open_rooms[rooms[i]]
            parts, times = group.pop()
            if not group:
                del open_rooms[rooms.pop(i)]
            # as many per sequence as its room takes, and no more than there are
            each = min((capacity - sum(parts)) // length, n)
            used = min(times, n // each)
            put(parts + (length,) * each, used)
            if times > used:
                put(parts, times - used)
            n -= used * each
    return made + [(tuple(parts), times) for group in open_rooms.values() for parts, times in group]


def complements(stock: Stock, gap: int, depth: int, longest: int) -> Iterator[tuple[int, ...]]:
    """Combinations of `depth` lengths, each at most `longest`, that sum to `gap`, by hashed complement:
    the last length is looked up, not searched."""
    for a in [k for k in reversed(stock.lengths) if k <= min(longest, gap - depth + 1)]:
        if a not in stock.left:
            continue
        if depth == 2:
            if gap - a <= a and gap - a in stock.left:
                yield (a, gap - a)
        elif 3 * a >= gap:
            for rest in complements(stock, gap - a, depth - 1, a):
                yield (a, *rest)


def pack(df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Ids are those of the tokenizer, then one 0 (so a null or empty text is one piece of length 1).
    Only documents longer than `capacity` are cut. Repeated rows and null ids are packed like any
    others, no rows give no rows, and other columns of `df` are ignored.

    Tokens never leave the task that made them. Pieces are numbered per length: in each written
    partition by place, and over partitions by the counts of (length, partition). The plan depends on
    the histogram of lengths only, at most `capacity` numbers; sequences are then found by joining a
    piece's number to the plan's ranges. The plan has at most a few entries per length, so it is small
    whatever the corpus, and a length that a third of all pieces have is spread like any other."""
    spark = df.sparkSession
    local = materialise(numbered(pieces(df, capacity)), "pieces")
    blocks = local.groupBy("length", "part").agg(F.max("nth").alias("n"))
    histogram = {r["length"]: r["n"] for r in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, sequence = [], 0
    first: dict[int, int] = {}
    for parts, times in plan(histogram, capacity):
        offset = 0
        for length in parts:
            a = first.get(length, 0)
            rows.append((length, a, a + times, sequence, offset))
            first[length] = a + times
            offset += length
        sequence += times
    slots = spark.createDataFrame(rows, "length bigint, low bigint, high bigint, sequence bigint, offset bigint")
    starts = blocks.selectExpr("length", "part", "n", "sum(n) over (partition by length order by part) - n as before")
    # the slots that meet a block's numbers, as one short array per block
    met = starts.join(slots, (starts["length"] == slots["length"]) & (F.col("low") < F.col("before") + F.col("n")) & (F.col("high") > F.col("before")))
    blocks = met.groupBy(starts["length"], "part", "before").agg(F.sort_array(F.collect_list(F.struct("low", "sequence", "offset"))).alias("slots"))
    nth = F.col("before") + F.col("nth") - 1
    slot = F.element_at(F.filter("slots", lambda s: s["low"] <= nth), -1)
    return local.join(blocks, ["length", "part"]).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (slot["sequence"] + nth - slot["low"]).alias("sequence_id"),
        slot["offset"].alias("offset"),
    )


def numbered(df: DataFrame) -> DataFrame:
    """Adds the partition (`part`) and the row's number among those of its length there (`nth`, from 1)."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            nth = []
            for length in batch.column("length").to_pylist():
                seen[length] = seen.get(length, 0) + 1
                nth.append(seen[length])
            yield batch.append_column("nth", pa.array(nth, pa.int64()))

    with_part = df.withColumn("part", F.spark_partition_id())
    return with_part.mapInArrow(number, T.StructType([*with_part.schema.fields, T.StructField("nth", T.LongType())]))
