"""Near duplicates where many texts are alike but few are linked."""

from __future__ import annotations

import random

import numpy as np

from depotwise.llm import near_dedup
from depotwise.llm.common import word_hashes

SCHEMA = "doc_id bigint, text string, id string, size bigint, key bigint"


def made(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], SCHEMA)


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def components(texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def alike_texts():
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    common = [word() for _ in range(90)]
    texts = []
    for own in (14, 20, 26, 60):  # similarity about 0.77, 0.69, 0.63 and 0.43 to others with the same common words
        texts += [" ".join(common + [word() for _ in range(own)]) for _ in range(45)]
    for _ in range(25):  # links within the group that are no links to its pivot
        chain = rng.choice(texts[45:]).split()
        for _ in range(3):
            chain = chain[:]
            chain[rng.randrange(95, len(chain))] = word()
            texts.append(" ".join(chain))
    return texts


def test_many_alike_texts_few_links(spark):
    texts = alike_texts()
    found = near_dedup.near_duplicates(made(spark, texts))
    assert {r.doc_id: r.component_id for r in found.rows.collect()} == dict(enumerate(components(texts)))


def test_prefixes_meet_every_link(spark):
    """Whatever is linked shares a short and a long prefix, and texts that only share a passage rarely do."""
    texts = alike_texts()
    rows = [(i, np.unique(np.array([hash(s) & (2**64 - 1) for s in shingles(t)], dtype=np.uint64)).tobytes()) for i, t in enumerate(texts)]
    keys = near_dedup.prefix_keys(spark.createDataFrame(rows, "id bigint, items binary"), 75).collect()
    by_key = {}
    for r in keys:
        by_key.setdefault(r.key, []).append((r.id, r.size, r.short))
    met = set()
    for members in by_key.values():
        for a, size_a, short_a in members:
            for b, size_b, short_b in members:
                if a < b and ((short_a and size_a <= size_b) or (short_b and size_b <= size_a)):
                    met.add((a, b))
    sets = [shingles(t) for t in texts]
    linked = {(i, j) for j in range(len(texts)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert linked <= met and len(met) < len(texts) * (len(texts) - 1) / 4


def thue_morse(n, flip=0):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_texts_that_polynomial_hashes_confuse(spark):
    texts = [thue_morse(n, flip) for n in (1024, 2048, 4096) for flip in (0, 1)]
    texts += [f"one two three four {t}" for t in texts]
    rows = near_dedup.near_duplicates(made(spark, texts)).rows.collect()
    assert all(r.kept and r.component_id == r.doc_id for r in rows) and len(rows) == len(texts)


def test_hashes_depend_on_the_word_alone():
    words = ["a" * n for n in range(1, 40)] + ["b" * 9, "éa", "aé", "\0", "\0\0"]
    one = "".join(words).encode()
    sizes = [len(w.encode()) for w in words]
    ends = np.cumsum(sizes)
    first = word_hashes(np.frombuffer(one, np.uint8), ends - sizes, ends)
    two = "--".join(reversed(words)).encode()
    places = [two.index(b"--".join(w.encode() for w in reversed(words[: i + 1]))) for i in range(len(words))]
    again = word_hashes(np.frombuffer(two, np.uint8), np.array(places), np.array(places) + sizes)
    assert first.tolist() == again.tolist() and len(set(first.tolist())) == len(words)
