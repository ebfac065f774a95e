"""Spelling groups against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from depotwise.llm import spelling_groups

SCHEMA = "doc_id bigint, text string, word string, n bigint, near string, side int, node bigint"


def made(spark, texts):
    ids = [None if i == 3 else i for i in range(len(texts))]
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, 3) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def words_of(texts):
    counts = Counter()
    for i, text in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i == 3 else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a != b and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :])


def expected(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    rows = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return rows


def answers(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randrange(6, 11))) for _ in range(60)]
    stems += ["a" * n for n in range(5, 12)] + ["Straße" + "x" * 700 + "end", "Straße" + "x" * 701 + "end", "É" * 6, "é" * 6, "ÿ×÷ÿabcdef"]
    out = []
    for i in range(260):
        words = [rng.choice(stems) if rng.random() < 0.5 else stems[min(int(rng.expovariate(0.2)), len(stems) - 1)] for _ in range(40)]
        if i % 3 == 0:
            j = rng.randrange(len(words))
            words[j] = words[j][:2] + rng.choice("ab") + words[j][rng.choice([2, 3]) :]
        out.append(rng.choice([" ", "-", "1"]).join(w.upper() if rng.random() < 0.1 else w for w in words))
    return out + [None, "", " ", "abc", out[0], out[0], "b" * 60_000] + ["many " + stems[0]] * 300


def test_groups_equal_brute_force(spark, texts):
    counts = words_of(texts)
    got = answers(spelling_groups.spelling_groups(made(spark, texts)))
    assert got == expected(counts)
    assert any(form and root != form for _, form, root, *_ in got) and len(got) > 100


def test_near_words_at_every_place(spark):
    word = "abcdefgh"
    alike = {word[:i] + word[i + 1 :] for i in range(8)} | {word[:i] + c + word[i:] for i in range(9) for c in "ax"} | {word[:i] + "x" + word[i + 1 :] for i in range(8)}
    far = {"abcdefxy", "xybcdefgh", "badcefgh", "abcdefghij"}
    words = spark.createDataFrame([(w,) for w in sorted({word} | alike | far)], "word string")
    got = {(r.word, r.near) for r in spelling_groups.near_words(words).collect()}
    every = {word} | alike | far
    assert got == {(a, b) for a in every for b in every if one_edit(a, b)}


def test_no_rows(spark):
    assert spelling_groups.spelling_groups(made(spark, [])).collect() == []
    assert spelling_groups.spelling_groups(made(spark, [None, "", "short words only"])).collect() == []
    lonely = made(spark, ["lonesome"] * 8).where(F.lit(True))
    assert sum(r.n for r in spelling_groups.spelling_groups(lonely).collect()) >= 5
