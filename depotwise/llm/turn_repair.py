"""Repair of conversations whose turns are blank, repeated, cut off or out of order, with the fewest edits.

A conversation is a sequence of rows (role, text) in order of `turn` (nulls first; rows of one turn by role,
then by the first characters of the text, then by its digest). Null roles and texts count as one space.
Edits: K keeps a row (0), R gives it the role that is due, user or assistant (2), D deletes it (3), I inserts
an empty row of the role that is due (2). Blank and repeated rows must go; a truncated row that stays adds 1.
What is left must alternate user and assistant, with at most one system row first, and end with the
assistant. Of the cheapest edits the ASCII-least string of their letters counts; given it, every role is
determined.

Faults are found by Spark: blank and cut-off rows by expressions, repeated ones by grouping on digests of role
and text, which are 128 bits of SHA-256. The search runs where a conversation's rows arrive in order: first one
byte for each row, then the texts. Backward cost vectors are kept only at every sqrt(n)-th row, and the
blocks between are computed again while the edits are written forward. A conversation of any length so
takes two bytes a row of memory (as much again as the string of edits that it returns), and its texts
stream by. That part of one conversation is sequential, as the SHA-256 over its repaired rows is.

Several rows of a turn, rows without an id (a conversation of their own), roles of any kind (their first
character decides), empty tables and additional columns are all right; a conversation without rows is empty.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
# states: nothing yet, after system, after user, after assistant
START, SYSTEM, USER, ASSISTANT = range(4)
DUE = (USER, USER, ASSISTANT, USER)  # the role that an inserted or changed row takes
ROLES = {USER: "user", ASSISTANT: "assistant"}
ENDING = (0, 4, 2, 0)  # inserts that complete a conversation from each state
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
# initials of roles: system, user, assistant, any other
LEGAL = {(0, 1), (1, 2), (2, 1)}
HEAD = 64
SPACES = " \t\n\x0b\x0c\r"

WHO, ROW, TEXT = range(3)
REPAIRED = "conv_id long, place long, edit string, role string, text string"
REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string, n_rows long, n_repaired long"
)


def allowed(state: int, code: int) -> int | None:
    """The state after a row is kept as it is, or None if it may not be."""
    initial, fault = divmod(code, 4)
    if fault in (BLANK, DUPLICATE):
        return None
    if initial == 0:
        return SYSTEM if state == START else None
    return initial + 1 if initial < 3 and DUE[state] == initial + 1 else None


@lru_cache(maxsize=1 << 16)
def before(code: int, after: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """Cheapest costs from each state with one more row in front, as an amount and what is above it."""
    initial, fault = divmod(code, 4)
    extra = TRUNCATED_COST if fault == TRUNCATED else 0
    costs = []
    for state in range(4):
        best = DELETE_COST + after[state]
        if fault not in (BLANK, DUPLICATE):
            best = min(best, REROLE_COST + extra + after[DUE[state]])
            if (kept := allowed(state, code)) is not None:
                best = min(best, extra + after[kept])
        costs.append(best)
    for _ in range(2):  # after two inserts a third comes back to where one was
        costs = [min(c, INSERT_COST + costs[DUE[s]]) for s, c in enumerate(costs)]
    least = min(costs)
    return least, tuple(c - least for c in costs)


def backward(codes: bytes, vector: tuple[int, tuple[int, ...]]) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Cost vectors in front of each row, from the last to the first."""
    total, above = vector
    for code in reversed(codes):
        more, above = before(code, above)
        total += more
        yield total, above


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and ASCII-least letters of the cheapest edits of rows given by initial and fault."""
    n = len(codes)
    step = max(1, math.isqrt(n))
    marks = {n: (0, ENDING)}
    for i, vector in zip(range(n - 1, -1, -1), backward(codes, marks[n]), strict=True):
        if i % step == 0:
            marks[i] = vector
    at = lambda vector, state: vector[0] + vector[1][state]
    state, letters = START, []
    for start in range(0, n, step):
        stop = min(start + step, n)
        block = [marks[stop], *backward(codes[start:stop], marks[stop])][::-1]
        for i in range(start, stop):
            here, after, code = block[i - start], block[i - start + 1], codes[i]
            extra = TRUNCATED_COST if code % 4 == TRUNCATED else 0
            while True:
                due = at(here, state)
                if DELETE_COST + at(after, state) == due:
                    letters.append(DELETE)
                elif INSERT_COST + at(here, DUE[state]) == due:
                    letters.append(INSERT)
                    state = DUE[state]
                    continue
                elif (kept := allowed(state, code)) is not None and extra + at(after, kept) == due:
                    letters.append(KEEP)
                    state = kept
                else:
                    letters.append(REROLE)
                    state = DUE[state]
                break
    while ENDING[state]:
        letters.append(INSERT)
        state = DUE[state]
    return at(marks[0], START), "".join(letters)


class Conversation:
    """What is known of one conversation while its rows stream by."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes, self.turns, self.last = conv_id, bytearray(), 0, None
        self.lowest = self.highest = self.cost = self.edits = None
        self.at, self.state, self.place, self.digest = 0, START, 0, None

    def row(self, turn: int | None, code: int, digest: bytes) -> None:
        if digest == self.digest and code % 4 != BLANK:
            code += DUPLICATE - code % 4  # equal rows of one turn: the grouping names the first for all of them
        self.digest = digest
        self.codes.append(code)
        if turn is not None and (not self.turns or turn != self.last):
            self.lowest = turn if not self.turns else self.lowest
            self.turns, self.last, self.highest = self.turns + 1, turn, turn

    def search(self) -> None:
        if self.edits is None:
            self.cost, self.edits = cheapest(bytes(self.codes))

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        """The rows to insert where the edits stand."""
        self.search()
        while self.at < len(self.edits) and self.edits[self.at] == INSERT:
            self.at, self.state = self.at + 1, DUE[self.state]
            yield INSERT, ROLES[self.state], ""

    def text(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """The edits that lead to one row and its own."""
        yield from self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == KEEP:
            self.state = SYSTEM if role[:1] == "s" else USER if role[:1] == "u" else ASSISTANT
        elif edit == REROLE:
            self.state = DUE[self.state]
            role = ROLES[self.state]
        yield edit, role, text

    def counts(self) -> tuple[int, ...]:
        gaps = self.highest - self.lowest + 1 - self.turns if self.turns else 0
        faults = [code % 4 for code in self.codes]
        initials = [code // 4 for code in self.codes]
        illegal = sum(pair not in LEGAL for pair in zip(initials, initials[1:]))
        return gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Conversation, list | None]]:
    """Each conversation with the edited rows of one of its rows at a time, and with None at its end."""
    current = None
    for batch in batches:
        for conv_id, kind, turn, code, role, text, digest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if current is None or conv_id != current.conv_id:
                if current is not None:
                    yield current, list(current.inserted())
                    yield current, None
                current = Conversation(conv_id)
            if kind == ROW:
                current.row(turn, code, digest)
            elif kind == TEXT:
                yield current, list(current.text(role, text))
    if current is not None:
        yield current, list(current.inserted())
        yield current, None


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    waiting, weight = [], 0
    for row in rows:
        waiting.append(row)
        weight += sum(len(v) for v in row if isinstance(v, str))
        if len(waiting) == size or weight > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)
            waiting, weight = [], 0
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting), schema)], schema=schema)


def arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for conversation, edited in streamed(batches):
            for edit, role, text in edited or ():
                yield conversation.conv_id, conversation.place, edit, role, text
                conversation.place += edit != DELETE

    yield from batched(rows(), arrow(REPAIRED))


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        digest = hashlib.sha256()
        for c, edited in streamed(batches):
            if edited is None:
                yield c.conv_id, *c.counts(), c.cost, c.edits, digest.hexdigest(), len(c.codes), c.place
                digest = hashlib.sha256()
            for edit, role, text in edited or ():
                if edit != DELETE:
                    digest.update((f"\n{role}:{text}" if c.place else f"{role}:{text}").encode())
                    c.place += 1

    yield from batched(rows(), arrow(REPORT))


def _faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, head, digest, code) of every row: initial and first fault in one number."""
    text, role = F.col("text"), F.col("role")
    last = F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))
    contents = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    marked = rows.select(
        "conv_id", "turn", "role", F.substring(text, 1, HEAD).alias("head"),
        F.substring(F.unhex(F.sha2(contents, 256)), 1, 16).alias("digest"),
        F.when(last == "", BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(TRUNCATED).alias("alone"),
    )
    order = ["turn", "role", "head", "digest"]
    repeated = (
        marked.groupBy("conv_id", "digest")
        .agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(*order)).alias("first"))
        .where("times > 1")
        .select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))
    later = F.coalesce(F.col("first") < F.struct(*order), F.lit(False))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    fault = F.when(F.col("alone") == BLANK, BLANK).when(later, DUPLICATE).otherwise(F.col("alone"))
    return marked.join(repeated, same, "left").select("conv_id", *order, (initial * 4 + fault).cast("int").alias("code"))


def _fed(rows: DataFrame, everyone: DataFrame | None) -> DataFrame:
    """Who there is, the faults of each row, and then the texts: a conversation's records in one place and in order."""
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    none = F.lit(None)
    columns = lambda df, kind, code, role, text, head, digest: df.select(
        "conv_id", F.lit(kind).alias("kind"), (F.col("turn") if kind != WHO else none.cast("long")).alias("turn"),
        code.cast("int").alias("code"), role.cast("string").alias("role"), text.cast("string").alias("text"),
        F.col("role" if kind != WHO else "conv_id").cast("string").alias("by_role"), head.cast("string").alias("head"), digest.cast("binary").alias("digest"),
    )
    contents = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    digest = F.substring(F.unhex(F.sha2(contents, 256)), 1, 16)
    fed = columns(_faults(rows), ROW, F.col("code"), none, none, F.col("head"), F.col("digest")).unionByName(
        columns(rows, TEXT, none, F.col("role"), F.col("text"), F.substring("text", 1, HEAD), digest)
    )
    if everyone is not None:
        who = everyone.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        fed = fed.unionByName(columns(who, WHO, none, none, none, none, none))
    order = [F.col(c).asc_nulls_first() for c in ("kind", "turn", "by_role", "head", "digest")]
    return fed.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order).drop("by_role", "head")


def repaired(rows: DataFrame) -> DataFrame:
    """Every row of every conversation with its edit, and the inserted ones: conv_id, place in the repaired
    conversation (of a deleted row: of what follows), edit, role and text as repaired."""
    return _fed(rows, None).mapInArrow(_rows, REPAIRED)


def reports(rows: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """One row per conversation of `rows` and of `everyone` (conv_id): missing turn numbers (gaps), rows by first fault,
    adjacent rows whose roles may not follow each other, cost and letters of the edits, SHA-256 of the
    repaired rows as `role:text` in lines, and how many rows there were and are."""
    return _fed(rows, everyone).mapInArrow(_reports, REPORT)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows that are left of `conversations` after planned damage: by crc32 of `conv_id:turn` modulo 20
    a row is dropped (0), emptied (1), loses its sentence ends (2), comes twice (3) or becomes the user's (4).
    Nulls count as one space."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    said: Column = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    return conversations.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(text("role")).alias("role"), said.alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
