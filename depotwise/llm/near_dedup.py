"""Near-duplicate documents by a multi-index join of b-bit minhash signatures, confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotwise.llm.common import LOWER, byte_view, connected, mix, shingle_hashes, slices, word_hashes, word_spans
from depotwise.session import materialise

SHINGLE = 5
# 84 components of 16 bits in 21 chunks of four. A pair that differs in at most 2 * 21 - 1 = 41
# components has a chunk with at most one error (pigeonhole), which masking each place in turn finds.
# At similarity 0.75 a component differs with probability 0.25; more than 41 of 84 then differ with
# probability 2e-7 to 2e-6, and less often the more alike the pair is.
CHUNKS, WIDTH = 21, 4
COMPONENTS = CHUNKS * WIDTH
RADIUS = 2 * CHUNKS - 1
BLOCK = 512  # members of a key that are compared with each other in one row
SLOTS = 1 << 18  # counters that order shingles by how common they are

_SALTS = mix(np.arange(1, 2 * COMPONENTS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
FLIPS = (_SALTS[:COMPONENTS] >> np.uint64(32)).astype(np.uint32)
FACTORS = (_SALTS[COMPONENTS:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def text_shingles(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a text column and each document's bounds among them."""
    data, offsets = byte_view(values)
    data = LOWER[data]
    starts, ends, bounds = word_spans(data, offsets)
    return shingle_hashes(word_hashes(data, starts, ends), bounds, SHINGLE)


def signatures(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of COMPONENTS 16-bit codes for every document; rows of documents without shingles are 0."""
    out = np.zeros((len(bounds) - 1, COMPONENTS), dtype=np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        folded = (shingles >> np.uint64(32)).astype(np.uint32)
        for k in range(COMPONENTS):
            h = (folded ^ FLIPS[k]) * FACTORS[k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            least = np.minimum.reduceat(h, bounds[full])
            out[full, k] = (least ^ (least >> np.uint32(16))).astype(np.uint16)
    return out


def fixed(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    flat = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    ends = np.arange(len(rows) + 1, dtype=np.int32) * flat.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(flat)])


def described(docs: DataFrame) -> DataFrame:
    """Per row: id, n_shingles, two hashes that name the set, and the signature."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                shingles, bounds = text_shingles(batch.column("text"))
                sets = [np.unique(shingles[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                sums = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                others = np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                yield pa.record_batch(
                    [
                        batch.column("id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(sums.view(np.int64)),
                        pa.array(others.view(np.int64)),
                        fixed(signatures(shingles, bounds)),
                    ],
                    names=["id", "n_shingles", "set_a", "set_b", "signature"],
                )

    return docs.mapInArrow(describe, "id bigint, n_shingles bigint, set_a bigint, set_b bigint, signature binary")


def codes(column: pa.Array) -> np.ndarray:
    data, _ = byte_view(column)
    return data.view(np.uint16).reshape(-1, COMPONENTS)


def coarse_keys(signed: DataFrame) -> DataFrame:
    """(key, id): all codes of two chunks at a time. Near copies share some of these few keys, so most are
    connected before the many masked ones are looked at."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = codes(batch.column("signature")).astype(np.uint64)
            keys = np.zeros((batch.num_rows, CHUNKS // 2), dtype=np.uint64)
            for c in range(CHUNKS // 2):
                for k in range(2 * WIDTH):
                    keys[:, c] = mix(keys[:, c] ^ rows[:, 2 * WIDTH * c + k] ^ np.uint64((c + 1) << 32))
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), CHUNKS // 2)
            yield pa.record_batch([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], names=["key", "id"])

    return signed.select("id", "signature").mapInArrow(emit, "key bigint, id bigint")


def bucket_keys(signed: DataFrame) -> DataFrame:
    """(key, id): for every chunk, its codes with one place masked; the place is part of the key."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                rows = codes(batch.column("signature")).reshape(batch.num_rows, CHUNKS, WIDTH).astype(np.uint64)
                keys = np.empty((batch.num_rows, CHUNKS, WIDTH), dtype=np.uint64)
                for masked in range(WIDTH):
                    packed = np.zeros((batch.num_rows, CHUNKS), dtype=np.uint64)
                    for k in range(WIDTH):
                        packed = (packed << np.uint64(16)) | (rows[:, :, k] if k != masked else np.uint64(0))
                    place = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(masked + 1)
                    keys[:, :, masked] = mix(packed ^ mix(place)[None, :])
                ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), COMPONENTS)
                yield pa.record_batch([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], names=["key", "id"])

    return signed.select("id", "signature").mapInArrow(emit, "key bigint, id bigint")


def with_distance(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Adds `h`, the number of signature components in which `a` and `b` differ."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = (codes(batch.column("sa")) != codes(batch.column("sb"))).sum(axis=1)
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(h.astype(np.int64))], names=["a", "b", "h"])

    left = signed.select(F.col("id").alias("a"), F.col("signature").alias("sa"))
    right = signed.select(F.col("id").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(measure, "a bigint, b bigint, h bigint")


def packed_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, items): the sorted shingle hashes of the documents in `ids`. The one step that moves texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                shingles, bounds = text_shingles(batch.column("text"))
                packed = [np.unique(shingles[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.record_batch([batch.column("id"), pa.array(packed, pa.binary())], names=["id", "items"])

    return docs.join(ids, "id", "left_semi").mapInArrow(sets, "id bigint, items binary")


def confirmed(pairs: DataFrame, packed: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity: 100 * shared >= percent * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = packed.select(F.col("id").alias("a"), F.col("items").alias("xa"))
    right = packed.select(F.col("id").alias("b"), F.col("items").alias("xb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "xa", "xb").mapInArrow(check, "a bigint, b bigint")


def rare_first(sets: DataFrame) -> np.ndarray:
    """How many of `sets` (id, items) hold an item of each of SLOTS slots. Any order of items finds all pairs; one by
    these counts puts what many texts share last."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, _ = byte_view(batch.column("items"))
            slots, times = np.unique(items.view(np.uint64) % np.uint64(SLOTS), return_counts=True)
            yield pa.record_batch([pa.array(slots.astype(np.int64)), pa.array(times)], names=["slot", "n"])

    counts = np.zeros(SLOTS, dtype=np.int64)
    found = sets.select("items").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    return counts


def prefix_keys(sets: DataFrame, percent: int) -> DataFrame:
    """(key, id, size, short): the rarest items of each set of `sets` (id, items). Of two sets that reach the similarity,
    the larger has an item among its n - ceil(p * n) + 1 rarest that the other has among its
    n - ceil(2 * p / (1 + p) * n) + 1 rarest (`short`), since so many of its items are in the larger one."""
    shared = sets.sparkSession.sparkContext.broadcast(rare_first(sets))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            data, offsets = byte_view(batch.column("items"))
            items, ends = data.view(np.uint64), offsets // 8
            keys, sizes, shorts = [], [], []
            for start, stop in zip(ends[:-1], ends[1:], strict=True):
                own = items[start:stop]
                n = len(own)
                long = n - -(-percent * n // 100) + 1
                short = n - -(-2 * percent * n // (100 + percent)) + 1
                keys.append(own[np.lexsort((own, counts[own % np.uint64(SLOTS)]))[:long]])
                sizes.append(n)
                shorts.append(np.arange(len(keys[-1])) < short)
            times = [len(k) for k in keys]
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), times)
            keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
            shorts = np.concatenate(shorts) if shorts else np.empty(0, bool)
            yield pa.record_batch(
                [pa.array(keys.view(np.int64)), pa.array(ids), pa.array(np.repeat(np.array(sizes, np.int64), times)), pa.array(shorts)],
                names=["key", "id", "size", "short"],
            )

    return sets.mapInArrow(emit, "key bigint, id bigint, size bigint, short boolean")


def shares(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many items of each of `others` are in `own`; all are arrays of 16-bit hashes, a repeat for each item."""
    ends = np.cumsum([len(o) for o in others])
    mask = np.zeros(1 << 16, dtype=np.int64)
    mask[own] = 1
    total = np.concatenate([[0], np.cumsum(mask[np.concatenate(others)])])
    return total[ends] - total[np.concatenate([[0], ends[:-1]])]


def alike(members: pa.StructArray, percent: int, by_sets: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each member of a key the later ones of other components that are near enough in size, share the key as their
    prefixes ask for, and look alike: by signatures within RADIUS (with the distances), or by sets, counted on
    16-bit hashes of their items, which lose no link."""
    ids, group, size, short, turn = (members.field(f).to_numpy(zero_copy_only=False) for f in ("id", "component", "size", "short", "turn"))
    if by_sets:
        data, offsets = byte_view(members.field("sketch"))
        sets = [data[a:b].view(np.uint16) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    else:
        rows = codes(members.field("sketch"))
    for i in range(len(ids)):
        rest = slice(i + 1, None)
        fits = (group[rest] != group[i]) & (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))
        fits &= (short[rest] & (size[rest] <= size[i])) | (short[i] & (size[i] <= size[rest]))
        # of two blocks only pairs between them, as each is compared with itself in a row of its own
        fits &= (turn[rest] != turn[i]) | (turn[-1] == turn[0])
        at = np.flatnonzero(fits) + i + 1
        if not len(at):
            continue
        if by_sets:
            common = np.minimum(shares(sets[i], [sets[j] for j in at.tolist()]), np.minimum(size[at], size[i]))
            hit = 100 * common >= percent * (size[at] + size[i] - common)
            yield i, at[hit], common[hit]
        else:
            h = (rows[at] != rows[i]).sum(axis=1)
            yield i, at[h <= RADIUS], h[h <= RADIUS]


def nearest(members: pa.StructArray, percent: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Of each member that has partners by signature the pair with the nearest, and the ids of these members."""
    ids = members.field("id").to_numpy(zero_copy_only=False)
    best, partner = np.full(len(ids), COMPONENTS + 1), np.zeros(len(ids), np.int64)
    for i, hit, h in alike(members, percent, False):
        if len(hit):
            closer = hit[h < best[hit]]
            partner[closer] = i
            best[hit] = np.minimum(best[hit], h)
            if h.min() < best[i]:
                best[i], partner[i] = h.min(), hit[np.argmin(h)]
    has = np.flatnonzero(best <= RADIUS)
    a, b = ids[has], ids[partner[has]]
    return [(np.minimum(a, b), np.maximum(a, b))], a


def pair_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([p[k] for p in found]) if found else np.empty(0, np.int64) for k in (0, 1))
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


MEMBER = ("turn", "id", "component", "size", "short", "sketch")


def in_blocks(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """(key, members): the members (key, id, size, short, component) of each key with their `sketches` (id, sketch), dealt
    to blocks of about BLOCK; a row holds two blocks, or one."""
    blocks = members.groupBy("key").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.min("component").alias("x"), F.max("component").alias("y"), F.max("short").alias("any")
    )
    dealt = (
        members.join(blocks.where("x < y and any").drop("x", "y", "any"), "key")
        .join(sketches, "id")
        .withColumn("turn", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    return dealt.groupBy("key", F.least("turn", "other").alias("i"), F.greatest("turn", "other").alias("j")).agg(
        F.sort_array(F.collect_list(F.struct(*MEMBER))).alias("members")
    ).select("key", "members")


def nearest_pairs(members: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """(key, id, a, b): the members of a key that have partners by signature, each with its nearest pair."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, row in zip(batch.column("key").to_pylist(), batch.column("members"), strict=True):
                pairs, ids = nearest(row.values, percent)
                if len(ids):
                    columns = [np.full(len(ids), key), ids, *pairs[0]]
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["key", "id", "a", "b"])

    sketches = signed.select("id", F.col("signature").alias("sketch"))
    return in_blocks(members, sketches).mapInArrow(compare, "key bigint, id bigint, a bigint, b bigint")


def pairs_by_sets(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members whose sets may be alike."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.column("members"):
                ids = row.values.field("id").to_numpy(zero_copy_only=False)
                found += [(np.minimum(ids[hit], ids[i]), np.maximum(ids[hit], ids[i])) for i, hit, _ in alike(row.values, percent, True)]
            yield pair_batch(found)

    return in_blocks(members, sketches).select("members").mapInArrow(compare, "a bigint, b bigint").distinct()


@dataclass(frozen=True)
class NearDuplicates:
    """One row per input row, and the links by which components were joined (between class representatives)."""

    rows: DataFrame
    links: DataFrame


def near_duplicates(df: DataFrame, percent: int = 75) -> NearDuplicates:
    """Components of documents of `df` (doc_id, text) linked by a similarity of `percent` or more.

    rows: doc_id, n_shingles, component_id, kept. A document's set is its distinct 5-word shingles
    (A-Z lowered; with fewer words the whole sequence as one; without words empty and linked with
    nothing). Equal sets form a class, whose smallest doc_id stands for it; classes are compared.

    1. All classes that share a bucket are compared with the smallest of the bucket, on signatures and
       then on full sets, first in few coarse buckets and then, where that has not connected them, in
       those of the masked chunks. That links nearly all.
    2. Members of a bucket that are not in the component of a pivot are compared with that component
       and with each other, on signatures in blocks, where they share one of the rarest items of their sets as
       every link does; components are never compared inside.
    No link within the radius is missed. What leaves the second step is the nearest partner of each member of a key that has
    one, and then all pairs of these that are still apart and whose sets, on 16 bits of each item, may be alike.

    Null or empty text: no shingles, alone. Null doc_id: a row with null component_id, kept. Rows with
    an equal doc_id count as one node. No rows: no rows. Other columns of `df` are ignored."""
    docs = df.select(F.col("doc_id").cast("bigint").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = materialise(described(docs), "described")
    full = rows.where("n_shingles > 0 and id is not null")
    classes = full.groupBy("set_a", "set_b").agg(F.min("id").alias("first"), F.min("n_shingles").alias("n"))
    members = materialise(full.join(classes.drop("n"), ["set_a", "set_b"]).select("id", "first", "signature"), "members")
    signed = materialise(members.where("id = first").select("id", "signature").distinct(), "signed")
    named = signed.select("id", F.col("id").alias("component"))
    placed = materialise(with_pivots(bucket_keys(signed)), "placed")
    ids = placed.select("id").union(placed.select("pivot")).distinct()
    packed = materialise(packed_sets(docs, ids), "sets")
    # sharing two whole chunks is sharing masked ones, so the sets above cover both kinds of buckets
    coarse = with_pivots(coarse_keys(signed)).groupBy("id").agg(F.min("pivot").alias("pivot"))
    pairs = with_distance(coarse.select(F.col("pivot").alias("a"), F.col("id").alias("b")), signed).where(F.col("h") <= RADIUS)
    links = materialise(confirmed(pairs, packed, percent), "links")
    named = materialise(connected(named, links), "named")

    apart = materialise(unconnected(placed, named), "apart")
    stars = apart.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    stars = materialise(with_distance(stars, signed), "stars")
    near = stars.where(F.col("h") <= RADIUS)
    best = near.groupBy("b").agg(F.min(F.struct("h", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    found = materialise(confirmed(best, packed, percent), "links")
    links = links.union(found)
    named = materialise(connected(named, found), "named")
    # pairs with other pivots count only where that has not connected them already
    second = unconnected(near.select(F.col("a").alias("pivot"), F.col("b").alias("id")), named)
    second = second.select(F.col("pivot").alias("a"), F.col("id").alias("b")).join(best, ["a", "b"], "left_anti")
    found = materialise(confirmed(second, packed, percent), "links")
    links = links.union(found)
    named = materialise(connected(named, found), "named")
    sets = materialise(unsettled(apart, stars.select("a", "b"), named, packed), "asked-sets")
    prefixes = materialise(prefix_keys(sets, percent), "prefixes")
    # the nearest partner of each member first, so that few components are left to be compared in full
    close = materialise(nearest_pairs(prefixes.join(named, "id"), signed, percent), "close")
    found = materialise(confirmed(close.select("a", "b").distinct(), packed, percent), "links")
    links = links.union(found)
    named = materialise(connected(named, found), "named")
    asking = prefixes.join(close.select("key", "id").distinct(), ["key", "id"]).join(named, "id")
    rest = materialise(pairs_by_sets(asking, short_items(sets), percent), "rest")
    found = materialise(confirmed(rest, packed, percent), "links")
    links = links.union(found)
    named = connected(named, found)
    # a row of an id with several texts belongs to the smallest component among them
    component = members.select("id", F.col("first").alias("c")).join(named.withColumnsRenamed({"id": "c"}), "c")
    component = component.groupBy("id").agg(F.min("component").alias("component"))
    out = rows.select("id", "n_shingles").join(component, "id", "left")
    label = F.coalesce("component", "id")
    return NearDuplicates(
        out.select(F.col("id").alias("doc_id"), "n_shingles", label.alias("component_id"), F.coalesce(label == F.col("id"), F.lit(True)).alias("kept")),
        links.distinct(),
    )


def with_pivots(keys: DataFrame) -> DataFrame:
    """(key, id, pivot): what shares a key with a smaller id, and the smallest."""
    pivots = keys.groupBy("key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return keys.join(pivots, "key").where("id <> pivot")


def unconnected(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Rows (pivot, id, ...) whose two are in different components, with these as home and component."""
    homes = named.select(F.col("id").alias("pivot"), F.col("component").alias("home"))
    return rows.join(named, "id").join(homes, "pivot").where(F.col("component") != F.col("home"))


def short_items(sets: DataFrame) -> DataFrame:
    """(id, sketch): 16 bits of each item of `sets` (id, items)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column("items"))
            few = (mix(data.view(np.uint64)) >> np.uint64(48)).astype(np.uint16).tobytes()
            ends = (offsets // 4).tolist()
            yield pa.record_batch([batch.column("id"), pa.array([few[a:b] for a, b in zip(ends, ends[1:])], pa.binary())], names=["id", "sketch"])

    return sets.mapInArrow(cut, "id bigint, sketch binary")


def unsettled(apart: DataFrame, stars: DataFrame, named: DataFrame, packed: DataFrame) -> DataFrame:
    """The sets (id, items) of all documents that may have links which the pivots have not shown. apart:
    (key, id, pivot) that were not connected when the pivots were compared; stars: (a, b) of a pivot and what it was
    compared with.

    Whatever shares a bucket with a component that it is not in may still be linked to a member of it other than
    the pivot, or to another such document. Both are met through the rarest items of their sets, so texts that
    share a common passage only do not meet."""
    left = materialise(unconnected(stars.select(F.col("a").alias("pivot"), F.col("b").alias("id")), named), "left")
    others = apart.select("key", "pivot", "id").join(left.select("pivot", "id"), ["pivot", "id"]).select("id")
    # a component of one has been compared with all it shares a bucket with
    homes = left.select(F.col("home").alias("component")).distinct()
    sizes = named.join(homes, "component", "left_semi").groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    inside = named.join(sizes, "component", "left_semi").select("id")
    asked = materialise(others.union(left.select("id")).union(inside).distinct(), "asked")
    return packed.join(asked, "id", "left_semi").select("id", "items")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
items AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM sets),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM items x JOIN items y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
  WHERE 100 * n >= 75 * (len(p.s) + len(q.s) - n)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
SELECT s.doc_id, len(any_value(s.s))::BIGINT AS n_shingles, min(r.other) AS component_id, min(r.other) = s.doc_id AS kept
FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id
"""
