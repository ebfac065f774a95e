"""What several operators of this package share: inputs, byte batches, prefix hashes, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depotwise.session import materialise

# Texts are worked on in slices of about this many bytes, so that the arrays beside them stay small.
SLICE_BYTES = 1 << 20
# Odd multiplier of the polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about `limit` bytes of `column` each; one long value is a part."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def byte_view(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column end to end, and the n + 1 offsets of its values (null: empty)."""
    large = pa.compute.fill_null(values.cast(pa.large_binary()), b"")
    if isinstance(large, pa.ChunkedArray):
        large = large.combine_chunks()
    _, offsets, data = large.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[large.offset : large.offset + len(large) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    out = np.full(max(n, 1), base & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (multiply and shift)."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * MIX[1]
    return x ^ (x >> np.uint64(31))


def mix_in_place(x: np.ndarray, room: np.ndarray) -> None:
    """`mix` in the place of `x`, with `room` for as many values."""
    for shift, factor in zip((30, 27), MIX, strict=True):
        np.right_shift(x, np.uint64(shift), out=room)
        x ^= room
        x *= factor
    np.right_shift(x, np.uint64(31), out=room)
    x ^= room


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


class PrefixHash:
    """Polynomial hashes of all prefixes of a byte string; any substring's hash is two lookups."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.up = powers(BASE, n)
        self.down = powers(BASE_INVERSE, n + 1)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODES[data] * self.up, dtype=np.uint64, out=self.prefix[1:])

    def of(self, starts: np.ndarray, lengths) -> np.ndarray:
        return (self.prefix[starts + lengths] - self.prefix[starts]) * self.down[starts]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes other than space and 9 to 13) and the index of the
    first word of every document, with one more at the end. Words never cross documents."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    first = inside[1:] & (~inside[:-1] | cut)
    last = inside[:-1] & (~inside[1:] | cut)
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return starts, ends, np.searchsorted(starts, offsets)


LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
SEED = np.uint64(0x5851F42D4C957F2D)


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of `data` on, as one number (what lies beyond its end is zero)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of `data` (already in lower case) that depends on its bytes alone. Eight bytes at a
    time go through a bijection that spreads every bit, so unlike a polynomial it has no family of texts that
    collide; two of n words do with a chance of n * n / 2**65."""
    eights, lengths = eight_bytes(data), ends - starts
    hashes = mix(SEED ^ (eights[starts] & LOW_BYTES[np.minimum(lengths, 8)]))
    live, at = np.flatnonzero(lengths > 8), 8
    while len(live):
        left = lengths[live] - at
        hashes[live] = mix(hashes[live] ^ (eights[starts[live] + at] & LOW_BYTES[np.minimum(left, 8)]))
        live, at = live[left > 8], at + 8
    return mix(hashes ^ lengths.astype(np.uint64))


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words, and the bounds of each document's runs. A document with
    fewer words, but at least one, gives one hash of them all."""
    counts = np.diff(bounds)
    n = len(words)
    rolled = np.zeros(n, dtype=np.uint64)
    if n >= size:
        m = n - size + 1
        for i in range(size):
            rolled[:m] = mix(rolled[:m] ^ words[i : i + m])
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out = np.zeros(len(made) + 1, dtype=np.int64)
    np.cumsum(made, out=out[1:])
    at = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], made)
    shingles = rolled[at] if len(at) else np.empty(0, np.uint64)
    for d in np.flatnonzero((counts > 0) & (counts < size)):
        value = np.full(1, counts[d], dtype=np.uint64)
        for w in words[bounds[d] : bounds[d + 1]]:
            value = mix(value ^ w)
        shingles[out[d]] = value[0]
    return shingles, out


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of `edges` (a, b): the smallest id reachable.

    Each round takes the smallest label among the neighbours and then what that label's own node was
    labelled with, so that chains shorten by doubling, and is written to the shared folder. A node
    with very many links costs one row per link before partial sums, and its join is one that Spark can split."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label"))
    labels = materialise(labels.withColumn("changed", F.lit(True)), "labels")
    while not labels.where("changed").isEmpty():
        known = labels.select(F.col("id").alias("b"), F.col("label").alias("theirs"))
        near = both.join(known, "b").groupBy(F.col("a").alias("id")).agg(F.min("theirs").alias("near"))
        hooked = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("hook"))
        jump = labels.select(F.col("id").alias("hook"), F.col("label").alias("next"))
        moved = hooked.join(jump, "hook", "left").select("id", "old", F.least("hook", "next").alias("label"))
        labels = materialise(moved.select("id", "label", (F.col("label") < F.col("old")).alias("changed")), "labels")
    return labels.select("id", F.col("label").alias("component"))


def connected(named: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) after `links` (a, b) have been added. Only links between components are followed, as
    links between their names."""
    left = named.select(F.col("id").alias("a"), F.col("component").alias("x"))
    right = named.select(F.col("id").alias("b"), F.col("component").alias("y"))
    between = links.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    merged = components(between).select(F.col("id").alias("component"), F.col("component").alias("into"))
    return named.join(merged, "component", "left").select("id", F.coalesce("into", "component").alias("component"))
