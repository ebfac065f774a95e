"""Toxicity scores from a lexicon that also matches misspelled terms, and from what stands around a match."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depotwise.llm.common import SLICE_BYTES, slices
from depotwise.llm.near_dedup import text_shingles

FOLDS, HELD_OUT = 4, 2
SAMPLE_ROWS = 20_000  # labelled rows that the lexicon and the weights are fitted on, at most
LEXICON = 400  # terms and stems, at most
STEMS = range(4, 8)  # lengths of word beginnings that may become stems
LEAST_DOCS = 5  # toxic documents that a term must be in
LEAST_SHARE = 0.02  # and of all toxic documents
PURITY = {1: 0.9, 2: 0.75}  # share that is toxic of the documents with it, and of those that repeat it, at least
FUZZY_FROM = 5  # terms of so many characters may have one wrong, missing or extra
CONTEXT = 8  # words on either side of a match
THRESHOLD = 0.3

QUOTES = "\"'`«»„“”‚‘’‹›"
# Words by which a text speaks to its reader: fixed values.
ADDRESS = frozenset("you your you're yours u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted tú ti tus vosotros".split())
# Words by which a text reports speech: fixed values.
REPORT = frozenset("said says say called calls wrote writes quote quoted word term sagte schrieb nannte dit écrit mot dijo escribió palabra".split())
EDGES = re.compile(r"^[\W_]+|[\W_]+$")


# Bounds of what a worker remembers, in bytes as Python keeps them.
STEP_BYTES, WORD_BYTES, LONG_WORD = 12 << 20, 32 << 20, 64


class Lexicon:
    """A trie of terms (whole words) and stems (beginnings of words).

    The Levenshtein automaton of every term at distance one is walked through the trie at once: a state
    holds, for each trie node that can be reached, the fewest errors so far. States are built when a word
    first needs them and then remembered, so a word costs one step per letter and most words end in the
    dead state after a few."""

    def __init__(self, terms: dict[str, bool], stems: dict[str, bool]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, bool] | None] = [None]  # (1 for a stem, whether one match is telling)
        self.fuzzy: list[bool] = [False]  # whether a term below allows an error
        for kind, words in ((0, terms), (1, stems)):
            for word, sure in words.items():
                node = 0
                for c in word:
                    self.fuzzy[node] |= len(word) >= FUZZY_FROM
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.ends.append(None)
                        self.fuzzy.append(False)
                    node = self.children[node][c]
                self.fuzzy[node] |= len(word) >= FUZZY_FROM
                if self.ends[node] is None or kind:
                    self.ends[node] = (kind, sure)
        self.start = self.close({0: 0})
        self.steps: dict[tuple, tuple] = {}
        self.states: dict[tuple, tuple] = {}
        self.size = 0

    def close(self, state: dict[int, int]) -> tuple:
        """Adds the nodes that a missing letter leads to."""
        for node, errors in list(state.items()):
            if errors == 0:
                for child in self.children[node].values():
                    if self.fuzzy[child] and child not in state:
                        state[child] = 1
        return tuple(sorted(state.items()))

    def step(self, state: tuple, c: str) -> tuple:
        after: dict[int, int] = {}

        def reach(node: int, errors: int) -> None:
            if errors <= 1 and errors < after.get(node, 2):
                after[node] = errors

        for node, errors in state:
            if self.ends[node] and self.ends[node][0]:
                reach(node, errors)  # a stem has been read: the rest of the word is free
            if c in self.children[node]:
                reach(self.children[node][c], errors)
            if errors == 0 and self.fuzzy[node]:
                reach(node, 1)
                for child in self.children[node].values():
                    if self.fuzzy[child]:
                        reach(child, 1)
        return self.close(after)

    def match(self, word: str) -> tuple[int, bool] | None:
        """(errors, sure) of the best term that the word is within reach of."""
        state = self.start
        for c in word:
            after = self.steps.get((state, c))
            if after is None:
                after = self.step(state, c)
                if self.size < STEP_BYTES:
                    self.size += 200 + (0 if after in self.states else 120 * len(after))
                    after = self.states.setdefault(after, after)
                    self.steps[state, c] = after
            if not after:
                return None
            state = after
        found = [(errors, not self.ends[node][1]) for node, errors in state if self.ends[node]]
        if not found:
            return None
        errors, unsure = min(found)
        return errors, not unsure


FEATURES = ("sure", "sure_fuzzy", "unsure", "unsure_fuzzy", "quoted", "addressed", "any_sure", "repeated_unsure", "density")
# Where the data say nothing, weights stay at these: a quoted term counts little, an address adds to it.
PRIOR = np.array([1.5, 0.5, 0.5, 0.0, -1.0, 0.5, 2.0, 1.0, 4.0, -4.0])
STRENGTH = 1.0  # of the pull towards PRIOR


class Words:
    """This worker's memory of which words are near a lexicon term, of about WORD_BYTES at most. A partition that
    ends empties it, since the worker goes on to other work."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.known, self.size = lexicon, {}, 0

    def clear(self) -> None:
        self.known.clear()
        self.size = 0

    def look(self, words: list[str]) -> list:
        known = self.known
        found = list(map(known.get, words, [0] * len(words)))
        if 0 in found:
            for i, value in enumerate(found):
                if value == 0:
                    word = words[i]
                    value = known.get(word, 0)
                    if value == 0:
                        core = EDGES.sub("", word)
                        value = self.lexicon.match(core) if core else None
                        if len(word) <= LONG_WORD:
                            if self.size > WORD_BYTES:
                                self.clear()
                            known[word] = value
                            self.size += 170 + len(word)
                    found[i] = value
        return found


_WORDS: dict[str, Words] = {}


def features(text: str | None, memory: Words) -> list[float]:
    """Sums over the matches in a text. A match is quoted if a quotation is open around it within the
    window, or a word of reporting is near and it is next to a quotation mark; it is addressed if a word of
    address is near and it is not quoted."""
    words = (text or "").lower().split()
    found = memory.look(words)
    hits = [(i, v) for i, v in enumerate(found) if v is not None]
    quoted = addressed = 0.0
    kinds = {(sure, fuzzy): 0.0 for sure in (True, False) for fuzzy in (True, False)}
    for i, (errors, sure) in hits:
        before, after = words[max(0, i - CONTEXT) : i], words[i + 1 : i + 1 + CONTEXT]
        own = words[i]
        opened = own[0] in QUOTES or any(w[0] in QUOTES and w[-1] not in QUOTES for w in before)
        closed = own.rstrip(".,;:!?")[-1:] in QUOTES if own.rstrip(".,;:!?") else False
        closed = closed or any(w.rstrip(".,;:!?")[-1:] and w.rstrip(".,;:!?")[-1] in QUOTES for w in after)
        told = any(EDGES.sub("", w) in REPORT for w in before + after)
        in_quotes = (opened and closed) or (told and (opened or closed))
        kinds[sure, errors > 0] += 1
        quoted += in_quotes
        addressed += not in_quotes and any(EDGES.sub("", w) in ADDRESS for w in before + after)
    named = [kinds[True, False], kinds[True, True], kinds[False, False], kinds[False, True], quoted, addressed]
    exact = kinds[True, False] + kinds[False, False]
    return [*np.log1p(named).tolist(), float(kinds[True, False] > 0), float(kinds[False, False] > 1), exact / (len(words) + 20)]


@dataclass(frozen=True)
class Model:
    terms: dict[str, bool]
    stems: dict[str, bool]
    weights: tuple[float, ...]
    name: str

    def words(self) -> Words:
        """Shared by the tasks of a worker."""
        if self.name not in _WORDS:
            _WORDS.clear()
            _WORDS[self.name] = Words(Lexicon(self.terms, self.stems))
        return _WORDS[self.name]


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def training_rows(df: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of at most `sample_rows` labelled documents outside the held-out fold, chosen by a hash
    of the id. An id with several labels is toxic if one of them says so. Only this bounded list of ids
    and labels is broadcast."""
    known = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    known = known.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    return df.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id").select("text", F.col("toxic").cast("int").alias("toxic"))


def distinct_rows(rows: DataFrame) -> DataFrame:
    """One of the rows that share their smallest shingle hash, so that copies of a text, or near copies,
    don't count as independent documents. Rows without words stay out."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                shingles, bounds = text_shingles(batch.column("text"))
                full = np.diff(bounds) > 0
                least = np.minimum.reduceat(shingles, bounds[:-1][full]) if full.any() else np.empty(0, np.uint64)
                kept = batch.filter(pa.array(full))
                yield kept.append_column("least", pa.array(least.view(np.int64)))

    return rows.mapInArrow(key, "text string, toxic int, least bigint").dropDuplicates(["least"]).drop("least")


COUNTED = ("toxic_1", "n_1", "toxic_2", "n_2")


def learn_lexicon(rows: DataFrame) -> tuple[dict[str, bool], dict[str, bool]]:
    """Terms and stems whose documents are nearly all toxic, and whether that holds for one occurrence
    already (sure) or only where they are repeated.

    Documents are counted per word and word beginning in the tasks, summed before the exchange; only
    the best few come to the driver. Of terms and stems that begin with each other one is chosen."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # small slices: words and beginnings as Python objects take many times the text
            for batch in slices(whole, "text", SLICE_BYTES // 8):
                sums = [Counter() for _ in COUNTED]
                for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                    seen: Counter = Counter()
                    for word, n in Counter((text or "").lower().split()).items():
                        core = EDGES.sub("", word)
                        if 3 < len(core) <= 40:
                            seen[0, core] += n
                            for k in STEMS:
                                if len(core) >= k:
                                    seen[1, core[:k]] += n
                    for at, least in ((0, 1), (2, 2)):
                        found = [k for k, n in seen.items() if n >= least]
                        sums[at + 1].update(found)
                        if label:
                            sums[at].update(found)
                keys = list(sums[1])
                columns = [pa.array([k for k, _ in keys], pa.int32()), pa.array([w for _, w in keys], pa.string())]
                columns += [pa.array([c[k] for k in keys], pa.int64()) for c in sums]
                yield pa.record_batch(columns, names=["kind", "word", *COUNTED])

    single = distinct_rows(rows)
    least = max(LEAST_DOCS, LEAST_SHARE * single.where("toxic > 0").count())
    schema = "kind int, word string, " + ", ".join(f"{c} bigint" for c in COUNTED)
    counted = single.mapInArrow(count, schema).groupBy("kind", "word").agg(*[F.sum(c).alias(c) for c in COUNTED])
    pure = lambda k: (F.col(f"toxic_{k}") >= least) & (F.col(f"toxic_{k}") >= PURITY[k] * F.col(f"n_{k}"))
    support = F.greatest(*[F.when(pure(k), F.col(f"toxic_{k}")).otherwise(0) for k in (1, 2)])
    best = counted.select("kind", "word", pure(1).alias("sure"), support.alias("support")).where("support > 0")
    best = best.orderBy(F.desc("support"), "kind", F.desc(F.length("word")), "word").limit(20 * LEXICON).collect()
    terms: dict[str, bool] = {}
    stems: dict[str, bool] = {}
    by_word = {r["word"]: r["support"] for r in best if r["kind"] == 0}
    for r in best:
        word = r["word"]
        if any(word.startswith(s) or s.startswith(word) for s in (*stems, *terms)) or len(terms) + len(stems) >= LEXICON:
            continue
        # a beginning becomes a stem if it is in clearly more documents than any one word with it
        if r["kind"] == 0:
            terms[word] = r["sure"]
        elif r["support"] > 1.2 * max((n for w, n in by_word.items() if w.startswith(word)), default=0):
            stems[word] = r["sure"]
    return terms, stems


def fit_weights(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, pulled towards PRIOR."""
    x = np.c_[x, np.ones(len(x))]
    w = PRIOR.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + STRENGTH * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + STRENGTH * np.eye(x.shape[1]), gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(df: DataFrame, labels: DataFrame) -> Model:
    """Fits lexicon and weights on `training_rows`. Without labelled rows: no terms, and the weights of PRIOR."""
    rows = training_rows(df, labels)
    terms, stems = learn_lexicon(rows)
    model = Model(terms, stems, (), uuid.uuid4().hex)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = model.words()
        for batch in batches:
            made = [features(t, memory) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array(made, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])
        memory.clear()

    sample = rows.mapInArrow(describe, "x array<double>, toxic int").collect()
    x = np.array([r["x"] for r in sample], dtype=np.float64).reshape(-1, len(FEATURES))
    # equal inputs in any order give equal weights
    order = np.lexsort(x.T) if len(x) else np.empty(0, np.int64)
    y = np.array([float(r["toxic"] > 0) for r in sample])
    return Model(terms, stems, tuple(fit_weights(x[order], y[order]).tolist()), model.name)


def probabilities(texts: list[str | None], memory: Words, weights: np.ndarray) -> np.ndarray:
    x = np.array([features(t, memory) for t in texts])
    return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ weights, -30, 30)))


def score(df: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `df` (doc_id, text), without any exchange.

    The score uses the text alone. Null or empty text: the score of a text without matches. Null doc_id:
    not held out. Repeated rows: one row each. No rows: no rows. Other columns are ignored."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, weights = model.words(), np.array(model.weights)
        for whole in batches:
            for batch in slices(whole, "text"):
                p = probabilities(batch.column("text").to_pylist(), memory, weights)
                yield pa.record_batch([batch.column("doc_id"), pa.array(p)], names=["doc_id", "score"])
        memory.clear()

    scored = df.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, score double")
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(df: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `df`, with all their columns, whose text scores below `threshold`."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, weights = model.words(), np.array(model.weights)
        for whole in batches:
            for batch in slices(whole, "text"):
                p = probabilities(batch.column("text").to_pylist(), memory, weights)
                yield batch.filter(pa.array(p < threshold))
        memory.clear()

    return df.mapInArrow(keep, df.schema)
