"""Shards along a Hilbert curve over several metadata dimensions, by built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depotwise.session import materialise

BITS = 8
POSITION_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in these


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """The place on the Hilbert curve of a cell with `bits` bits in each dimension.

    Bit planes from the top: where a coordinate has the bit, the lower bits of the first coordinate
    are inverted, else they change places with those of the coordinate. The transposed result is
    Gray-decoded and its bits are interleaved."""
    n = len(dims)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, step: Column) -> Column:
        low = step["q"] - F.lit(1)
        first, here = F.element_at(x, 1), F.element_at(x, step["i"] + 1)
        swap = first.bitwiseXOR(here).bitwiseAND(low)
        has = here.bitwiseAND(step["q"]) != 0

        def moved(value: Column, k: Column) -> Column:
            return (
                F.when(has, F.when(k == 0, value.bitwiseXOR(low)).otherwise(value))
                .when((k == 0) | (k == step["i"]), value.bitwiseXOR(swap))
                .otherwise(value)
            )

        return F.transform(x, moved)

    turned = F.aggregate(steps, F.array(*[d.cast("int") for d in dims]), turn)
    # running exclusive-or over the coordinates, then the parity of the last one's higher bits
    gray = F.aggregate(
        turned,
        F.array().cast("array<int>"),
        lambda acc, v: F.concat(acc, F.array(v.bitwiseXOR(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))))),
    )
    planes = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])
    flip = lambda g: F.aggregate(
        planes,
        F.lit(0),
        lambda t, q: F.when(F.element_at(g, -1).bitwiseAND(q) != 0, t.bitwiseXOR(q - F.lit(1))).otherwise(t),
    )
    cell = F.transform(F.array(F.struct(gray.alias("g"))), lambda s: F.struct(s["g"].alias("g"), flip(s["g"]).alias("t")))
    order = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i + 1).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])

    def interleave(s: Column) -> Column:
        bit = lambda p: F.element_at(s["g"], p["i"]).bitwiseXOR(s["t"])
        return F.aggregate(
            order,
            F.lit(0).cast("bigint"),
            lambda acc, p: acc * 2 + F.floor(bit(p) / F.pow(F.lit(2.0), p["b"])).cast("bigint") % 2,
        )

    return F.element_at(F.transform(cell, interleave), 1)


def category(value: Column) -> Column:
    """A category as one of 255 cells (null: 0); equal values share a cell, so a filter on one value
    meets one slab of the cube."""
    return F.when(value.isNull(), 0).otherwise(F.pmod(F.xxhash64(value.cast("string")), F.lit(255)) + 1)


def magnitude(value: Column) -> Column:
    """A size as one of 256 cells, eight to each doubling; beyond 2**32 in the last."""
    return F.when(value.isNull() | (value < 1), 0).otherwise(F.least(F.lit(255), F.floor(F.log2(value.cast("double")) * 8)))


def hilbert_shards(df: DataFrame, shards: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of `df` (doc_id, text, lang, source) with its shard and slot, law `rows`.

    Rows are ordered by curve index over (source, lang, size), equal texts next to each other, and the
    order is cut into runs whose counts are at most one apart. A run is a narrow box of the metadata
    cube, so a reader can skip files by their minima and maxima. Columns in `keep` are carried along.

    Null text: size 1 and the checksum of no bytes. Null lang, source or doc_id: a cell, or place, of
    their own. Repeated rows: each gets a slot. No rows: no rows. Other columns of `df` are ignored.

    The range exchange splits on the whole order including the row's own number, so no group of equal
    texts or metadata has to fit in one task; ranks come from the place in the written partition plus
    the row counts of earlier partitions (one row per partition, the only thing that meets in one task)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("bigint") + 1
    rows = df.select(
        F.col("doc_id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        hilbert_index([category(F.col("source")), category(F.col("lang")), magnitude(size)]).alias("curve"),
        F.monotonically_increasing_id().alias("row"),
        *[F.col(c).alias(f"kept_{c}") for c in keep],
    )
    order = ("curve", "text_crc32", "text_hash", "doc_id", "row")
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = materialise(placed.drop("text_hash", "row"), "curve")
    parts = (
        placed.groupBy(F.shiftright("place", POSITION_BITS).alias("part"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
        .withColumn("total", F.sum("n").over(Window.partitionBy()))
    )
    ranked = placed.withColumn("part", F.shiftright("place", POSITION_BITS)).join(parts, "part")
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << POSITION_BITS) - 1))
    shard = F.expr(f"rank * {shards} div total")
    return (
        ranked.withColumn("rank", rank)
        .withColumn("shard", shard)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("rank") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "curve",
            *[F.col(f"kept_{c}") for c in keep],
        )
    )
