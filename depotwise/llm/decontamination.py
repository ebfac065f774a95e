"""Finding benchmark items in documents: rare words as seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotwise.llm.common import LOWER, byte_view, mix, slices, word_hashes, word_spans

SEED = 5  # words of a seed: rare words of an item that lie close together, not in a row
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.6  # of the score that a whole copy of the item would have
BLOCK_SEEDS = 1_000_000  # words of items that meet the documents at a time: 16 MB for the words and about as much for their items

# Punctuation separates words like white space, so that edits of it alone change nothing.
PLAIN = LOWER.copy()
PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32


def word_codes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of a text column and each row's bounds among them."""
    data, offsets = byte_view(values)
    data = PLAIN[data]
    starts, ends, bounds = word_spans(data, offsets)
    return word_hashes(data, starts, ends), bounds


def least_score(m: int, threshold: float) -> int:
    """The smallest alignment score with which an item of `m` words reaches the threshold."""
    return max(1, math.ceil(threshold * MATCH * m - 1e-9))


def room(m: int, threshold: float) -> int:
    """How many words may be inserted into a copy of an item of `m` words that still reaches the threshold."""
    return max(0, (MATCH * m - least_score(m, threshold)) // -GAP)


def least_matches(m: int, threshold: float) -> int:
    """How many words of an item of `m` words match, at least, in an alignment that reaches the threshold:
    nothing but matches adds to a score."""
    return -(-least_score(m, threshold) // MATCH)


@dataclass
class Items:
    """Benchmark items as words, and seeds: words sorted by hash with the item of each, every pair once.
    `counts`: the words of each item that are distinct, and how often each is in it. Of its seeds `enough`
    (a number for each item) lie within `span` words of a document in every alignment that counts."""

    ids: list
    words: list[np.ndarray]
    counts: list[tuple[np.ndarray, np.ndarray]]
    seeds: np.ndarray
    item: np.ndarray
    enough: np.ndarray
    span: np.ndarray

    def rare(self, counts: dict[int, int], threshold: float) -> Items:
        """With the rarest words of each item as its seeds. An alignment that reaches the threshold leaves out
        m - least_matches places of the item at most, so of so many places and SEED more it has SEED. This
        holds for any choice of places; rare ones are hit less often."""
        chosen, enough, span = [], [], []
        for words in self.words:
            m = len(words)
            need = least_matches(m, threshold)
            n = np.array([counts.get(int(w), 0) for w in words])
            enough.append(min(SEED, need))
            span.append(m + room(m, threshold))
            chosen.append(np.unique(words[np.argsort(n, kind="stable")[: m - need + enough[-1]]]))
        return seeded(self.ids, self.words, self.counts, chosen, enough, span)

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `words`, index of a seed), by place, wherever a word is a seed; once for each item that has it."""
        first, last = np.searchsorted(self.seeds, words, side="left"), np.searchsorted(self.seeds, words, side="right")
        n = last - first
        at = np.repeat(np.arange(len(words)), n)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def seeded(ids: list, words: list, counts: list, chosen: list[np.ndarray], enough: list[int], span: list[int]) -> Items:
    seeds, item = np.concatenate(chosen), np.repeat(np.arange(len(ids)), [len(c) for c in chosen])
    order = np.argsort(seeds, kind="stable")
    return Items(ids, words, counts, seeds[order], item[order], np.array(enough), np.array(span))


def item_blocks(benchmark: DataFrame, limit: int = BLOCK_SEEDS) -> Iterator[Items]:
    """The items in blocks of about `limit` words, streamed to the driver one partition at a time. An item
    without words has no seed."""
    rows: list[tuple] = []
    total = 0
    for row in benchmark.select("item_id", "text").where("text is not null").distinct().toLocalIterator():
        words, _ = word_codes(pa.array([row["text"]], pa.string()))
        if len(words):
            rows.append((row["item_id"], words))
            total += len(words)
        if total >= limit:
            yield block(rows)
            rows, total = [], 0
    if rows:
        yield block(rows)


def block(rows: list[tuple]) -> Items:
    counts = [np.unique(words, return_counts=True) for _, words in rows]
    return seeded([r[0] for r in rows], [r[1] for r in rows], counts, [c[0] for c in counts], [1] * len(rows), [1] * len(rows))


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """The best local alignment score of two word sequences, and the first and last place in `a` plus one.

    One row per word of `b`; inside a row the chain of gaps is a running maximum."""
    n = len(a)
    slope = -GAP * np.arange(n + 1)
    score, start = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in b:
        diagonal = score[:-1] + np.where(a == word, MATCH, MISMATCH)
        up = score[1:] + GAP
        cell = np.r_[0, np.maximum(diagonal, up)]
        begin = np.r_[0, np.where(diagonal >= up, start[:-1], start[1:])]
        fresh = cell <= 0
        cell[fresh], begin[fresh] = 0, np.arange(n + 1)[fresh]
        lifted = cell + slope
        running = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == running, np.arange(n + 1), 0))
        score, start = running - slope, begin[source]
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (int(score[top]), int(start[top]), top)
    return best


def passages(at: np.ndarray, item: np.ndarray, row: np.ndarray, known: Items) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, first place, last place plus one): where an alignment with enough seeds of an item can be.
    Seeds come by place; enough of them within the item's span open a passage of that span on both sides,
    and passages that overlap are one."""
    order = np.argsort(item, kind="stable")
    at, item, row = at[order], item[order], row[order]
    last = np.arange(len(at)) + known.enough[item] - 1
    inside = last < len(at)
    last[~inside] = 0
    span = known.span[item]
    open_ = np.flatnonzero(inside & (item[last] == item) & (row[last] == row) & (at[last] - at < span))
    if not len(open_):
        return
    at, item, row, span = at[open_], item[open_], row[open_], span[open_]
    low, high = at - span + 1, at + span
    new = np.ones(len(at), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (low[1:] > high[:-1])
    start = np.flatnonzero(new)
    stop = np.r_[start[1:], len(at)] - 1
    yield from zip(row[start].tolist(), item[start].tolist(), low[start].tolist(), high[stop].tolist(), strict=True)


def shared_words(words: np.ndarray, counts: tuple[np.ndarray, np.ndarray]) -> int:
    """How many words a passage and an item have in common, each as often as both have it."""
    known, n = counts
    where = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return int(np.minimum(np.bincount(where[known[where] == words], minlength=len(n)), n).sum())


def seed_counts(rows: DataFrame, items: Items) -> dict[int, int]:
    """In how many documents each seed is: summed per batch, then per seed; one number for each of the block's."""
    sent = rows.sparkSession.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unique(sent.value.seeds)
        for whole in batches:
            n = np.zeros(len(known), dtype=np.int64)
            for batch in slices(whole, "text"):
                words, bounds = word_codes(batch.column("text"))
                which = np.minimum(np.searchsorted(known, words), len(known) - 1)
                at = np.flatnonzero(known[which] == words)
                row = np.searchsorted(bounds, at, side="right")
                n += np.bincount(np.unique(row * len(known) + which[at]) % len(known), minlength=len(n))
            k = np.flatnonzero(n)
            yield pa.record_batch([pa.array(known[k].view(np.int64)), pa.array(n[k])], names=["seed", "n"])

    counted = rows.select("text").mapInArrow(count, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n")).collect()
    return {int(np.int64(r["seed"]).view(np.uint64)): r["n"] for r in counted}


def found_in(batch: pa.RecordBatch, known: Items, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, last word plus one) of the best alignment of the items that rows of a
    batch hold. A passage that shares fewer words with an item than must match is not aligned."""
    words, bounds = word_codes(batch.column("text"))
    at, which = known.hits(words)
    row = np.searchsorted(bounds, at, side="right") - 1
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for r, item, low, high in passages(at, known.item[which], row, known):
        base, target = int(bounds[r]), known.words[item]
        low = max(low, base)
        part = words[low : min(high, int(bounds[r + 1]))]
        if shared_words(part, known.counts[item]) < least_matches(len(target), threshold):
            continue
        score, a, z = align(part, target)
        got = (score / (MATCH * len(target)), low - base + a, low - base + z)
        if got[0] >= threshold:
            best[r, item] = max(best.get((r, item), got), got)
    return [(r, known.ids[item], *got) for (r, item), got in sorted(best.items())]


LEAKS = "item_id bigint, score double, first_word bigint, last_word bigint"


def whole_ids(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text")


def contaminated(df: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word for every document of `df` (doc_id, text) that holds a
    copy, perhaps edited, of an item of `benchmark` (item_id, text): the best alignment of the item's
    words in it has `threshold` or more of the score of a full copy.

    Documents are never exchanged: a block of items, of bounded size, goes to the tasks. A first pass
    counts the documents of each word of the items; the second aligns where enough of an item's rarest
    words are close together. Every alignment that reaches the threshold has so many of them, however it
    was edited, so none is lost. More items mean more blocks, not larger ones.

    Null or empty text, or item text: no match. Null ids are kept in the result. Repeated rows of either
    table give one row. No rows: no rows. Other columns are ignored."""
    spark = df.sparkSession
    rows = df.select("doc_id", "text")
    schema = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {LEAKS}"
    found = spark.createDataFrame([], schema)
    for items in item_blocks(whole_ids(benchmark)):
        rare = spark.sparkContext.broadcast(items.rare(seed_counts(rows, items), threshold))

        def search(batches: Iterator[pa.RecordBatch], rare=rare) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "text"):
                    out = found_in(batch, rare.value, threshold)
                    picked, *columns = zip(*out, strict=True) if out else [[]] * 5
                    kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    columns = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                    ids = batch.column("doc_id").take(pa.array(picked, pa.int64()))
                    yield pa.record_batch([ids, *columns], names=["doc_id", "item_id", "score", "first_word", "last_word"])

        found = found.union(rows.mapInArrow(search, schema))
    return found.distinct()


def uncontaminated(df: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `df`, with all their columns, that `contaminated` would not name."""
    spark = df.sparkSession
    kept = df
    for items in item_blocks(whole_ids(benchmark)):
        rare = spark.sparkContext.broadcast(items.rare(seed_counts(df, items), threshold))

        def keep(batches: Iterator[pa.RecordBatch], rare=rare) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "text"):
                    clean = np.ones(batch.num_rows, dtype=bool)
                    clean[[r for r, *_ in found_in(batch, rare.value, threshold)]] = False
                    yield batch.filter(pa.array(clean))

        kept = kept.mapInArrow(keep, df.schema)
    return kept
