"""Removal of repeated byte strings by a hash-compared suffix sort, spread over a cluster.

A sort of all suffixes would move every byte of the corpus about a hundred times. Here a suffix is
sorted only where it can matter:

* Anchors. Each window of WINDOW bytes picks the smallest hash among its GRAM-byte strings. Equal
  windows pick equal strings at equal places, and successive windows mostly pick the same one, so
  there is about one anchor for 40 bytes. An anchor with the bytes of all its windows is a context.
* A string that is an anchor once in the corpus has no repeated window. Of equal contexts all but the
  earliest are repeated as a whole. Only the earliest contexts of anchors whose surroundings differ,
  the rims of repeated passages, are left.
* Rims of one anchor are sorted as suffixes: mergesort whose comparisons find the common extension by
  binary search over prefix hashes. Neighbours' extensions to the right, and hashes to the left, give
  the classes of equal windows; every match is verified on its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depotwise.llm.common import PrefixHash, byte_view, mix, slices
from depotwise.session import materialise

WINDOW = 100
GRAM = 24
CROWDED = 8  # so many contexts of an anchor in one batch: its rows are dealt by context, not by anchor
BLOCK = 4096  # contexts of an anchor that are sorted together
CHUNK = 16_384  # contexts that are handled at a time
KEEP = np.uint64(0xFFFFFFFF)


def contexts(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """The anchors in byte order: place, first and last start of a window that picks it, hash of the
    anchor's string and of the context."""
    n, width = len(data), window - GRAM + 1
    hashes = PrefixHash(data)
    starts = np.arange(max(n - GRAM + 1, 0))
    value = np.full(n + width, np.iinfo(np.uint64).max, dtype=np.uint64)
    value[: len(starts)] = (mix(hashes.of(starts, GRAM)) & ~KEEP) | starts.astype(np.uint64)
    least, span = value, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[:n], least[width - span : width - span + n])
    at = np.flatnonzero(np.arange(n) + window <= np.repeat(offsets[1:], np.diff(offsets)))
    if not len(at):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    pick = (least[at] & KEEP).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (pick[1:] != pick[:-1]) | (at[1:] != at[:-1] + 1)])
    low, high = at[first], at[np.r_[first[1:] - 1, len(at) - 1]]
    anchor = pick[first]
    shape = ((anchor - low) * 256 + high - low).astype(np.uint64)
    return anchor, low, high, hashes.of(anchor, GRAM), mix(hashes.of(low, high - low + window) ^ mix(shape + np.uint64(1)))


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges sorted by document and start, of equal length or rising ends, joined where they touch."""
    if not len(doc):
        return doc, start, stop
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])]
    first = np.flatnonzero(new)
    return doc[first], start[first], stop[np.r_[first[1:] - 1, len(doc) - 1]]


ANCHORS = "gram bigint, ctx bigint, doc bigint, place bigint, salted boolean"


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """Contexts as rows (gram, ctx, doc, place). What repeats a context of the same batch is known to be
    repeated: such ranges have no gram, their start in `place` and their end in `ctx`. An anchor with
    many contexts in the batch has its rows marked `salted`, and one row without a document besides."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            parts = []
            for batch in slices(whole, "text"):
                data, offsets = byte_view(batch.column("text"))
                ids = batch.column("doc").to_numpy(zero_copy_only=False)
                anchor, low, high, gram, ctx = contexts(data, offsets, window)
                row = np.searchsorted(offsets, low, side="right") - 1
                place = ((low - offsets[row]) << 16) | ((high - low) << 8) | (anchor - low)
                parts.append((gram.view(np.int64), ctx.view(np.int64), ids[row], place))
            gram, ctx, doc, place = (np.concatenate([p[k] for p in parts]) for k in range(4))
            order = np.lexsort((place, doc, ctx, gram))
            gram, ctx, doc, place = gram[order], ctx[order], doc[order], place[order]
            new_gram = np.r_[True, gram[1:] != gram[:-1]][: len(gram)]
            new_ctx = new_gram | np.r_[True, ctx[1:] != ctx[:-1]][: len(gram)]
            again = repeats(new_ctx, doc, place)
            start = place[again] >> 16
            by_place = np.lexsort((start, doc[again]))
            d, a, z = merged(*(x[by_place] for x in (doc[again], start, start + ((place[again] >> 8) & 255) + window)))
            gram_of = np.cumsum(new_gram) - 1
            crowded = np.bincount(gram_of, weights=new_ctx) >= CROWDED if len(gram) else np.empty(0, bool)
            keep = np.flatnonzero(new_ctx)
            marks = np.flatnonzero(new_gram)[crowded]
            nulls = np.r_[np.zeros(len(keep), bool), np.ones(len(marks), bool), np.zeros(len(d), bool)]
            yield pa.record_batch(
                [
                    pa.array(np.r_[gram[keep], gram[marks], d], mask=np.r_[np.zeros(len(keep) + len(marks), bool), np.ones(len(d), bool)]),
                    pa.array(np.r_[ctx[keep], ctx[marks], z]),
                    pa.array(np.r_[doc[keep], doc[marks], d], mask=nulls),
                    pa.array(np.r_[place[keep], place[marks], a]),
                    pa.array(np.r_[crowded[gram_of[keep]], np.zeros(len(marks) + len(d), bool)]),
                ],
                names=["gram", "ctx", "doc", "place", "salted"],
            )

    return docs.mapInArrow(find, ANCHORS)


def repeats(new: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which sorted rows come later than the first of their class (a repeated row of it does not)."""
    if not len(new):
        return np.empty(0, bool)
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return (doc != doc[first]) | (place != place[first])


def judged(found: DataFrame, window: int) -> DataFrame:
    """(doc, start, stop, gram, place): ranges known to be repeated have no gram; the others are contexts
    whose windows may be repeated in part."""

    def settle(table: pa.Table) -> pa.RecordBatch:
        gram, ctx, place = (table.column(c).to_numpy() for c in ("gram", "ctx", "place"))
        real = pa.compute.is_valid(table.column("doc")).to_numpy()
        doc = pa.compute.fill_null(table.column("doc"), 0).to_numpy()
        salted = table.column("salted").to_numpy()
        new_gram = np.r_[True, gram[1:] != gram[:-1]]
        gram_of = np.cumsum(new_gram) - 1
        changes = np.r_[False, (ctx[1:] != ctx[:-1]) & ~new_gram[1:]]
        many = np.bincount(gram_of, weights=changes | salted | ~real) > 0
        gram, ctx, doc, place, many = gram[real], ctx[real], doc[real], place[real], many[gram_of][real]
        new = np.r_[True, (gram[1:] != gram[:-1]) | (ctx[1:] != ctx[:-1])][: len(gram)]
        again, rim = repeats(new, doc, place), new & many
        start = place >> 16
        stop = start + ((place >> 8) & 255) + window
        pick = np.flatnonzero(again | rim)
        return pa.record_batch(
            [pa.array(doc[pick]), pa.array(start[pick]), pa.array(stop[pick]), pa.array(gram[pick], mask=~rim[pick]), pa.array(place[pick])],
            names=["doc", "start", "stop", "gram", "place"],
        )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            known = batch.filter(pa.compute.is_null(batch.column("gram")))
            if known.num_rows:
                none = pa.nulls(known.num_rows, pa.int64())
                yield pa.record_batch(
                    [known.column("doc"), known.column("place"), known.column("ctx"), none, known.column("place")],
                    names=["doc", "start", "stop", "gram", "place"],
                )
            rows = batch.slice(known.num_rows)  # nulls come first
            if not rows.num_rows:
                continue
            grams = rows.column("gram").to_numpy()
            last = int(np.searchsorted(-(grams == grams[-1]).astype(np.int8)[::-1], 0, side="left"))
            cut = rows.num_rows - last
            if cut:
                yield settle(pa.Table.from_batches([*held, rows.slice(0, cut)]))
                held = []
            elif held and held[-1].column("gram")[-1].as_py() != int(grams[-1]):
                yield settle(pa.Table.from_batches(held))
                held = []
            held.append(rows.slice(cut))
        if held:
            yield settle(pa.Table.from_batches(held))

    deal = F.when(F.col("gram").isNull(), F.xxhash64("doc", "place")).when(F.col("salted"), F.xxhash64("gram", "ctx")).otherwise(F.col("gram"))
    dealt = found.repartition(deal).sortWithinPartitions("gram", "ctx", "doc", "place")
    return dealt.mapInArrow(judge, "doc bigint, start bigint, stop bigint, gram bigint, place bigint")


class SuffixOrder:
    """Suffixes of `data` at `starts`, each `limit` bytes at most, sorted within groups."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, limits: np.ndarray, groups: np.ndarray):
        self.data, self.hashes = data, PrefixHash(data)
        self.starts, self.limits, self.groups = starts, limits, groups
        self.steps = [1 << b for b in range(int(limits.max(initial=1)).bit_length() - 1, -1, -1)]

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many bytes suffixes i and j share, by binary search over prefix hashes."""
        a, b = self.starts[i], self.starts[j]
        most = np.minimum(self.limits[i], self.limits[j])
        got = np.zeros(len(i), dtype=np.int64)
        for step in self.steps:
            fits = got + step <= most
            length = np.where(fits, step, 0)
            got += np.where(self.hashes.of(a + got, length) == self.hashes.of(b + got, length), length, 0)
        return got

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i sorts before suffix j; a suffix that is a prefix of the other comes first."""
        shared = self.extension(i, j)
        end_i, end_j = shared >= self.limits[i], shared >= self.limits[j]
        last = len(self.data) - 1
        x = np.where(end_i, -1, self.data[np.minimum(self.starts[i] + shared, last)].astype(np.int64))
        y = np.where(end_j, -1, self.data[np.minimum(self.starts[j] + shared, last)].astype(np.int64))
        return (x < y) | ((x == y) & (i < j))

    def order(self) -> np.ndarray:
        """Mergesort of every group, all merges of a level at once: an element's place in the merged run is
        its place in its own run plus the number of elements of the other run that come before it."""
        n = len(self.starts)
        order = np.argsort(self.groups, kind="stable")
        group = self.groups[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.empty(0, np.int64)
        which = np.cumsum(np.r_[True, group[1:] != group[:-1]])[:n] - 1
        base, size = first[which], np.diff(np.r_[first, n])[which]
        place = np.arange(n) - base
        width = 1
        while n and width < size.max():
            run = place // width
            other = np.where(run % 2 == 0, run + 1, run - 1) * width
            low = np.minimum(other, size)
            high = np.minimum(other + width, size)
            start = low.copy()
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) // 2
                less = self.before(order[base[open_] + middle], order[open_])
                low[open_] = np.where(less, middle + 1, low[open_])
                high[open_] = np.where(less, high[open_], middle)
            target = base + (run // 2) * 2 * width + place % width + (low - start)
            merged_order = np.empty_like(order)
            merged_order[target] = order
            order, width = merged_order, width * 2
        return order


def window_classes(data: np.ndarray, base: np.ndarray, left: np.ndarray, count: np.ndarray, group: np.ndarray, window: int):
    """Rows (context, start in it, class) for all windows of contexts, equal classes for equal windows of
    a group. Context c has its bytes from base[c] on, its anchor left[c] later, and count[c] windows."""
    n = len(base)
    right = count - 1 - left + window
    suffixes = SuffixOrder(data, base + left, right, group)
    order = suffixes.order()
    lcp = np.zeros(n, dtype=np.int64)
    if n > 1:
        lcp[1:] = np.where(group[order[1:]] == group[order[:-1]], suffixes.extension(order[:-1], order[1:]), -1)
    lcp[:1] = -1
    rows = np.repeat(np.arange(n), count[order])  # by rank
    inside = np.arange(len(rows)) - np.repeat(np.cumsum(count[order]) - count[order], count[order])
    context = order[rows]
    reach = left[context] - inside  # bytes of the window in front of the anchor
    need = window - reach
    # rows sorted by reach, then rank: a class goes on while the extensions to the right suffice, which
    # includes those of contexts that have no window at this reach
    by = np.lexsort((rows, reach))
    lowest = np.full(len(by), np.iinfo(np.int64).max)
    r = rows[by]
    if len(by):
        gap = np.flatnonzero(np.r_[False, reach[by][1:] == reach[by][:-1]])
        lowest[:] = -1
        lowest[gap] = range_minimum(lcp, r[gap - 1] + 1, r[gap])
    run = np.cumsum(lowest < need[by])
    start = base[context[by]] + inside[by]
    hashes = suffixes.hashes.of(start, reach[by])
    second = np.lexsort((hashes, run))
    new = np.r_[True, (run[second][1:] != run[second][:-1]) | (hashes[second][1:] != hashes[second][:-1])][: len(second)]
    classes = np.cumsum(new) - 1
    pick = by[second]
    return context[pick], inside[pick], classes, suffixes.hashes


def range_minimum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima of values[low..high], both included, from a table of minima over powers of two."""
    tables, span = [values], 1
    while span * 2 <= len(values):
        tables.append(np.minimum(tables[-1][:-span], tables[-1][span:]))
        span *= 2
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), dtype=values.dtype)
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(tables[k][low[at]], tables[k][high[at] - (1 << k) + 1])
    return out


def verified(data: np.ndarray, first: np.ndarray, other: np.ndarray, window: int) -> bool:
    """Whether the windows at `first` and `other` have equal bytes, all of them."""
    span = np.arange(window)
    return all(
        np.array_equal(data[first[i : i + 8192, None] + span], data[other[i : i + 8192, None] + span]) for i in range(0, len(first), 8192)
    )


RIMS = "gram bigint, doc bigint, place bigint, bytes binary"
FOUND = "doc bigint, start bigint, stop bigint, hash_a bigint, hash_b bigint"


def rims(docs: DataFrame, places: DataFrame, window: int) -> DataFrame:
    """The bytes of the contexts that are left."""

    def slice_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = unpacked(batch, i)
                marks = batch.column("marks")[i].values
                gram, place = marks.field("gram"), marks.field("place")
                where = place.to_numpy()
                low = where >> 16
                stop = low + ((where >> 8) & 255) + window
                parts = [text[a:z] for a, z in zip(low.tolist(), stop.tolist(), strict=True)]
                doc = np.full(len(parts), batch.column("doc")[i].as_py())
                yield pa.record_batch([gram, pa.array(doc), place, pa.array(parts, pa.binary())], names=["gram", "doc", "place", "bytes"])

    wanted = places.groupBy("doc").agg(F.collect_list(F.struct("gram", "place")).alias("marks"))
    return packed(docs).join(wanted, "doc").select("doc", "n", "z", "marks").mapInArrow(slice_out, RIMS)


def packed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc, n, z, *keep): texts compressed for the way through an exchange."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for whole in batches:
            for batch in slices(whole, "text"):
                raw = [t.as_buffer() for t in batch.column("text")]
                z = pa.array([codec.compress(b, asbytes=True) if b.size else b"" for b in raw], pa.binary())
                columns = [batch.column("doc"), pa.array([b.size for b in raw], pa.int64()), z, *(batch.column(c) for c in keep)]
                yield pa.record_batch(columns, names=["doc", "n", "z", *keep])

    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("n", T.LongType()), T.StructField("z", T.BinaryType())])
    for c in keep:
        schema = schema.add(docs.schema[c])
    return docs.mapInArrow(pack, schema)


def unpacked(batch: pa.RecordBatch, i: int) -> bytes:
    n = batch.column("n")[i].as_py()
    return pa.Codec("zstd").decompress(batch.column("z")[i].as_buffer(), n, asbytes=True) if n else b""


def sorted_rims(parts: DataFrame, window: int) -> DataFrame:
    """Repeated windows (doc, start, stop) among contexts of one anchor. Anchors with more than BLOCK
    contexts are sorted in blocks; the earliest window of each class then comes with its hashes."""

    def handle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        doc, place, blocks = (table.column(c).to_numpy() for c in ("doc", "place", "blocks"))
        keys = np.stack([table.column("gram").to_numpy(), table.column("block").to_numpy().astype(np.int64)])
        data, offsets = byte_view(table.column("bytes").combine_chunks())
        group = np.cumsum(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        context, inside, classes, hashes = window_classes(data, offsets[:-1], place & 255, ((place >> 8) & 255) + 1, group, window)
        start = (place[context] >> 16) + inside
        order = np.lexsort((start, doc[context], classes))
        context, inside, classes, start = context[order], inside[order], classes[order], start[order]
        new = np.r_[True, classes[1:] != classes[:-1]]
        at = offsets[context] + inside
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        if not verified(data, at[first][~new], at[~new], window):
            # two strings with one hash: classes anew, from the bytes themselves
            texts = {}
            classes = np.array([texts.setdefault(data[p : p + window].tobytes(), len(texts)) for p in at])
            order = np.lexsort((start, doc[context], classes))
            context, classes, start, at = context[order], classes[order], start[order], at[order]
            new = np.r_[True, classes[1:] != classes[:-1]]
        again = repeats(new, doc[context], start)
        d, a = doc[context][again], start[again]
        by_place = np.lexsort((a, d))
        d, a, z = merged(d[by_place], a[by_place], a[by_place] + window)
        open_ = np.flatnonzero(new & (blocks[context] > 1))
        p = at[open_]
        half = window // 2
        hash_a = mix(hashes.of(p, window))
        hash_b = mix(mix(hashes.of(p, half)) + hashes.of(p + half, window - half))
        od, oa = doc[context][open_], start[open_]
        mask = np.r_[np.ones(len(d), bool), np.zeros(len(od), bool)]
        pad = np.zeros(len(d), np.int64)
        yield pa.record_batch(
            [
                pa.array(np.r_[d, od]),
                pa.array(np.r_[a, oa]),
                pa.array(np.r_[z, oa + window]),
                pa.array(np.r_[pad, hash_a.view(np.int64)], mask=mask),
                pa.array(np.r_[pad, hash_b.view(np.int64)], mask=mask),
            ],
            names=["doc", "start", "stop", "hash_a", "hash_b"],
        )

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                keys = np.stack([batch.column("gram").to_numpy(), batch.column("block").to_numpy().astype(np.int64)])
                cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
                if held and (held[-1].column("gram")[-1].as_py(), held[-1].column("block")[-1].as_py()) != tuple(keys[:, 0].tolist()):
                    cuts = np.r_[0, cuts]
                if rows + batch.num_rows >= CHUNK and len(cuts):
                    if rows + cuts[-1]:
                        yield from handle(pa.Table.from_batches([*held, batch.slice(0, cuts[-1])]))
                    held, rows, batch = [], 0, batch.slice(cuts[-1])
                held.append(batch)
                rows += batch.num_rows
        if rows:
            yield from handle(pa.Table.from_batches(held))

    crowded = parts.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    blocks = F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int")
    dealt = parts.join(crowded, "gram", "left").withColumn("blocks", blocks).drop("n")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc", "place"), F.col("blocks")).cast("int"))
    return dealt.repartition("gram", "block").sortWithinPartitions("gram", "block").mapInArrow(sort, FOUND)


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, start, stop): byte ranges that together hold every repeated window of `docs` (doc, text)."""
    verdicts = materialise(judged(anchors(docs, window), window), "verdicts")
    parts = materialise(rims(docs, verdicts.where("gram is not null").select("doc", "gram", "place"), window), "rims")
    found = materialise(sorted_rims(parts, window), "sorted")
    blocks = found.where("hash_a is not null")
    least = blocks.groupBy("hash_a", "hash_b").agg(F.min(F.struct("doc", "start")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    across = blocks.join(least, ["hash_a", "hash_b"]).where(F.struct("doc", "start") > F.col("least"))
    columns = ("doc", "start", "stop")
    return verdicts.where("gram is null").select(*columns).union(found.where("hash_a is null").select(*columns)).union(across.select(*columns))


def deduplicated(df: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row of `df` (doc_id, text) without its repeated bytes: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, kept (the remaining bytes), and the columns of `keep` as one struct `carried`.

    A byte goes if some string of `window` bytes that covers it also starts earlier: in a smaller
    doc_id, or in the same document further in front; strings may overlap, and are judged on the
    input. Null text counts as empty. A null doc_id is neither searched nor a source. A doc_id stands
    for one text; rows that repeat both are treated alike and are no source for each other. No rows:
    no rows. Other columns of `df` are ignored. `window` is from GRAM to 255."""
    carried = (F.struct(*keep).alias("carried"),) if keep else ()
    names = ("carried",) if keep else ()
    docs = df.select(F.col("doc_id").cast("bigint").alias("doc"), F.coalesce("text", F.lit("")).alias("text"), *carried)
    ranges = repeated_ranges(docs.where("doc is not null").select("doc", "text"), window)
    per_doc = ranges.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text = unpacked(batch, i)
                spans: list[list[int]] = []
                if (marks := batch.column("ranges")[i]).is_valid:
                    pairs = np.stack([marks.values.field(f).to_numpy() for f in ("start", "stop")], axis=1)
                    for a, z in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], z)
                        else:
                            spans.append([a, z])
                edges = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            columns += [batch.column(c) for c in names]
            yield pa.record_batch([batch.column("doc"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *names])

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    schema += "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in names)
    return packed(docs, names).join(per_doc, "doc", "left").select("doc", "n", "z", "ranges", *names).mapInArrow(remove, schema)
