"""Spelling variants: words of a corpus that differ by one edit, found by walking a trie that is a table.

Words are counted over all texts. Two words that differ by one inserted, deleted or replaced code point share
either their first or their last half, so every word is entered from both ends (`side`), each time below its
half only. A node is a prefix, named by a hash; only nodes where words part are kept, and an edge carries the
characters up to the next such node, so that long words do not make long walks. The table of edges is built
by grouping, and is never collected or broadcast.

A walk is a frontier of states (word, position, node, edits). Each level joins it with the edges of its nodes.
Without an edit so far, the word's own edge is followed, and each sibling edge is entered by the edit that it
needs: replace, insert or delete. After the edit only the edge that goes on as the word does is followed. An
edge that ends a word with one edit made is a neighbour. A state makes at most one state for each character
that may follow a node, so nothing is square in the number of alike words. Each level is written.

Hashes of prefixes are taken modulo 2**61 - 1; two prefixes of one name would only add states, as the one
edit is checked on the words at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotwise.session import materialise

LETTERS = r"[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
MISPRINT_EVERY = 199
PRIME, BASE = (1 << 61) - 1, 1_000_003_579
END = "\0"  # closes every word in the trie, and is no letter
PATHS = "word string, side int, depth int, node long, rest string"
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, A_TO_Z, A_TO_Z.lower()))


def letter_runs(documents: DataFrame) -> DataFrame:
    """Every run of letters of every text (null: none) that has at least ``MIN_LENGTH`` of them, with the id of its
    row. One run in ``MISPRINT_EVERY``, by crc32 of id and run, has lost a letter."""
    runs = documents.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run"),
    ).where(F.length("run") >= MIN_LENGTH)
    runs = runs.select("doc", lowered(F.col("run")).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.select(F.when(h % MISPRINT_EVERY == 0, cut).otherwise(F.col("run")).alias("word"))


def counted_words(runs: DataFrame) -> DataFrame:
    """(word, n) of the words that are long and frequent enough. Counts are summed before they move."""
    counts = runs.where(F.length("word") >= MIN_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= MIN_COUNT)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of each word below its half, from both ends, with the character that follows."""
    schema = pa.schema([("word", pa.string()), ("side", pa.int32()), ("depth", pa.int32()), ("node", pa.int64()), ("next", pa.string())])
    for batch in batches:
        rows = []
        for word in batch.column(0).to_pylist():
            for side in (0, 1):
                spelt = (word if side == 0 else word[::-1]) + END
                first = len(word) // 2 - 1
                h = side + 1
                for depth, letter in enumerate(spelt):
                    if depth >= first:
                        rows.append((word, side, depth, h, letter))
                        if len(rows) == 50_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows = []
                    h = (h * BASE + ord(letter) + 1) % PRIME
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def spelt(word: Column, side: Column) -> Column:
    return F.concat(F.when(side == 0, word).otherwise(F.reverse(word)), F.lit(END))


def trie_edges(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges (node, first, label, child, leaf) of the trie of `words` below their halves, and where each word
    enters it (word, side, depth, node). A leaf edge ends the word `leaf`, an inner one leads to `child`."""
    paths = words.select("word").mapInArrow(_paths, "word string, side int, depth int, node long, next string")
    paths = materialise(paths, "trie-paths")
    parting = paths.groupBy("node").agg(F.min("next").alias("low"), F.max("next").alias("high")).where("low <> high").select("node")
    steps = paths.drop("next").join(parting, "node").groupBy("word", "side").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("nodes"))
    steps = materialise(steps, "trie-steps")
    at = F.col("nodes")
    hops = F.transform(at, lambda here, i: F.struct(here.depth.alias("depth"), here.node.alias("node"), F.get(at, i + 1).alias("then")))
    edges = steps.select("word", "side", F.explode(hops).alias("hop")).select("word", "side", "hop.*")
    letters = spelt(F.col("word"), F.col("side"))
    last = F.coalesce(F.col("then.depth"), F.length("word") + 1)
    label = F.substring(letters, F.col("depth") + 1, last - F.col("depth"))
    edges = edges.select(
        "node", F.substring(label, 1, 1).alias("first"), label.alias("label"), F.col("then.node").alias("child"),
        F.when(F.col("then").isNull(), F.col("word")).alias("leaf"),
    ).distinct()
    half = F.floor(F.length("word") / 2)
    entry = F.filter(at, lambda a: a.depth >= half)
    entries = steps.select("word", "side", F.get(entry, F.lit(0)).alias("at")).where(F.col("at").isNotNull())
    return materialise(edges, "trie-edges"), entries.select("word", "side", "at.depth", "at.node")


def one_edit(a: Column, b: Column) -> Column:
    """Whether two different words differ by one inserted, deleted or replaced character."""
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(a, b, 1) == 1)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near): every pair of `words` (word) that differ by one edit, in both directions."""
    edges, entries = trie_edges(words)
    frontier = materialise(
        entries.select("word", F.col("node"), F.expr(f"substring(concat(if(side = 0, word, reverse(word)), '{END}'), depth + 1)").alias("rest"), F.lit(0).alias("edits")),
        "frontier",
    )
    found = None
    label, rest, size = F.col("label"), F.col("rest"), F.length("label")
    left = lambda text, n: F.substring(text, F.lit(1), n)
    after = lambda text, n: F.substring(text, n + 1, F.length(text))
    state = lambda test, remaining, edits: F.when(test, F.struct(remaining.alias("rest"), F.lit(edits).alias("edits")))
    # the word's rest against the characters of an edge that starts with another one
    tail = after(label, F.lit(1))
    replaced = state(left(after(rest, F.lit(1)), size - 1) == tail, after(rest, size), 1)
    inserted = state(left(rest, size - 1) == tail, after(rest, size - 1), 1)
    deleted = state(left(after(rest, F.lit(1)), size) == label, after(rest, size + 1), 1)
    while not frontier.isEmpty():
        fresh = frontier.where("edits = 0").join(edges, "node")
        own = F.substring("rest", 1, 1) == F.col("first")
        spread = F.filter(
            F.array(state(own, after(rest, size), 0), *[F.when(~own, s) for s in (replaced, inserted, deleted)]), lambda s: s.isNotNull()
        )
        moved = fresh.select("word", F.col("child").alias("node"), "leaf", F.inline(spread))
        edited = frontier.where("edits = 1").withColumn("first", F.substring("rest", 1, 1)).join(edges, ["node", "first"])
        edited = edited.where(left(rest, size) == label).select("word", F.col("child").alias("node"), "leaf", after(rest, size).alias("rest"), "edits")
        states = materialise(moved.unionByName(edited), "frontier")
        here = states.where((F.col("edits") == 1) & F.col("leaf").isNotNull() & (F.col("rest") == "")).select("word", F.col("leaf").alias("near"))
        found = here if found is None else found.union(here)
        frontier = states.where(F.col("leaf").isNull()).drop("leaf")
    if found is None:
        return words.select("word", F.col("word").alias("near")).limit(0)
    return found.distinct().where(one_edit(F.col("word"), F.col("near")))


def grouped(words: DataFrame) -> DataFrame:
    """Each of `words` (word, n) with its form (the near word of largest n, ties by code points, if that is at
    least ``RATIO`` times its own), root (where the forms lead), n_near and form_n. One row per word; a word
    without near words is its own root."""
    words = materialise(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("form"))).alias("best")
    )
    holds = -F.col("best.rank") >= RATIO * F.col("n")
    formed = words.join(best, "word", "left").select(
        "word", F.when(holds, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(holds, -F.col("best.rank")).alias("form_n"),
    )
    formed = materialise(formed, "word-forms")
    # counts grow by RATIO with each step, so chains are short, and each round doubles what it follows
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        roots = materialise(roots.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "word-roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.drop("moved")
    return formed.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(documents: DataFrame) -> DataFrame:
    """Spelling groups of the words of all texts of `documents` (doc_id, text). No texts, no rows."""
    return grouped(counted_words(letter_runs(documents)))
