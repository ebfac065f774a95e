"""Byte-pair ids and token counts of whole texts through tables of already encoded pre-token runs."""

from __future__ import annotations

import base64
import functools
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from depotwise.llm.common import slices

VOCABULARY = "byte_bpe_50k"
CACHE_ENTRIES = 300_000  # pre-token runs a worker remembers beside the broadcast table
CACHE_BYTES = 32 << 20  # and their length at most
TABLE_ENTRIES = 20_000  # runs in the broadcast table, each of at most TABLE_RUN characters: below 2 MB
TABLE_RUN = 48
SAMPLE_ROWS = 4_000  # rows the table is built from; it changes speed, never a count
RUN_LIMIT = 64  # longer runs are encoded anew each time

# White space besides the plain space and the line feed sends a text to the library as a whole.
RARE_SPACE = re.compile(r"[^\S \n]")


@functools.cache
def library() -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(f"{VOCABULARY}.json"))


@functools.cache
def ranks() -> tiktoken.Encoding:
    """The same vocabulary in the faster library, for runs without special strings."""
    with open(public_tokenizers.path(f"{VOCABULARY}.tiktoken"), "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(VOCABULARY, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


@functools.cache
def special_strings() -> tuple[str, ...]:
    return tuple(t.content for t in library().get_added_tokens_decoder().values())


def ids_of(text: str) -> list[int]:
    """The library's ids; a special string inside a text is its one id, as is the library's default."""
    if any(s in text for s in special_strings()):
        return library().encode(text, add_special_tokens=False).ids
    return ranks().encode_ordinary(text)


def runs(text: str) -> list[str]:
    """`text` cut in front of single spaces between two other characters, which is always a pre-token's
    start, so the runs can be encoded one by one. A text with other white space next to each other, or
    at its ends, is cut only where that holds."""
    if RARE_SPACE.search(text):
        return [text]
    first, *rest = text.split(" ")
    parts = [first, *[" " + p for p in rest]]
    if first and " " not in parts and " \n" not in text and "\n " not in text:
        return parts
    out = parts[:1]
    for part in parts[1:]:
        if len(part) > 1 and part[1] != "\n" and out[-1] and out[-1][-1] not in " \n":
            out.append(part)
        else:
            out[-1] += part
    return out


class Lookup:
    """Two tiers: a fixed table of frequent runs, then a bounded cache of what this worker has encoded."""

    def __init__(self, encode: Callable[[str], object], frequent: dict | None = None):
        self.encode, self.known = encode, dict(frequent or {})
        self.fixed, self.size = len(self.known), 0

    def all(self, keys: list[str]) -> list:
        known = self.known
        found = list(map(known.get, keys))
        if None in found:
            for i, value in enumerate(found):
                if value is None:
                    found[i] = self.miss(keys[i])
        return found

    def miss(self, key: str):
        value = self.known.get(key)
        if value is None:
            value = self.encode(key)
            if len(key) <= RUN_LIMIT:
                if len(self.known) - self.fixed >= CACHE_ENTRIES or self.size >= CACHE_BYTES:
                    self.known = dict(list(self.known.items())[: self.fixed])
                    self.size = 0
                self.known[key] = value
                self.size += len(key)
        return value


@functools.cache
def id_lookup() -> Lookup:
    """This worker's cache from runs to their ids as little-endian bytes."""
    return Lookup(lambda run: np.asarray(ids_of(run), dtype="<u4").tobytes())


def encode_bytes(text: str | None) -> bytes:
    """All ids of a text, four bytes each. One call for a text costs less than looking its runs up; a text with
    special strings goes by its runs, of which only those need the slower library."""
    if not text:
        return b""
    if any(s in text for s in special_strings()):
        return b"".join(id_lookup().all(runs(text)))
    return np.array(ranks().encode_ordinary(text), dtype="<u4").tobytes()


_COUNTS: dict[str, Lookup] = {}


def count_lookup(key: str, frequent: dict[str, int]) -> Lookup:
    """This worker's lookup for one broadcast table."""
    if key not in _COUNTS:
        _COUNTS.clear()
        _COUNTS[key] = Lookup(lambda run: len(ids_of(run)), frequent)
    return _COUNTS[key]


def frequent_lengths(df: DataFrame, entries: int = TABLE_ENTRIES, sample_rows: int = SAMPLE_ROWS) -> dict[str, int]:
    """Token counts of the commonest runs in the first `sample_rows` rows. At most `entries` short runs,
    whatever the size of the input. Each task sends at most `entries` runs; the counting of all their
    candidates is a shuffled sum."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(r for r in runs(text or "") if len(r) <= TABLE_RUN)
        best = seen.most_common(entries)
        yield pa.record_batch({"run": pa.array([k for k, _ in best], pa.string()), "n": pa.array([v for _, v in best], pa.int64())})

    sample = df.select("text").limit(sample_rows)
    best = sample.mapInArrow(counted, "run string, n bigint").groupBy("run").agg(F.sum("n").alias("n"))
    rows = best.orderBy(F.desc("n"), "run").limit(entries).collect()
    return {r["run"]: len(ids_of(r["run"])) for r in rows}


def token_counts(df: DataFrame, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of `df` (doc_id, text).

    Map-side only: the broadcast table holds at most TABLE_ENTRIES counts, misses are encoded once per
    worker and remembered within a bound, and no run is ever shuffled. Null or empty text: 0 bytes and
    0 tokens. Repeated rows and null ids: one row each. Other columns are ignored."""
    context = df.sparkSession.sparkContext
    frequent, key = context.broadcast(frequent_lengths(df)), uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = count_lookup(key, frequent.value)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = batch.column("text").to_pylist()
                totals = [sum(lookup.all(runs(t))) if t else 0 for t in texts]
                sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).cast(pa.int64())
                n = pa.array(totals, pa.int64())
                yield pa.record_batch(
                    [batch.column("doc_id"), sizes, n, pa.compute.greater(n, limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
