"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows,
no rows, and columns whose names clash with the operators' own."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from depotwise.llm import bpe, decontamination, near_dedup, packing, passage_dedup, sharding, suffix_dedup, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, length bigint, part string, id string, n string, size int"


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", None if i == 1 else f"s{(i or 0) % 3}", None, 7, "x", "y", "z", 1) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}é" if rng.random() < 0.1 else f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base, shared, line = prose(rng, 120), prose(rng, 60), prose(rng, 30)
    copies = []
    for i in range(12):
        words = base.split()
        words[i * 9] = f"changed{i}"
        copies.append(" ".join(words))
    mixed = [prose(rng, 40) + " " + shared + " " + prose(rng, 40) for _ in range(6)]
    lines = ["\n".join([prose(rng, 20), line, prose(rng, 20), line]) for _ in range(12)]
    odd = [None, "", " \t\n", "one", "one two three", "A b C d", "a B c D", "a" * 3000, "ab" * 900, "é" * 400, "x " * 700, "<|endoftext|> hi  there\n\n\tyou", "a\x85b\xa0 c", "  lead", "trail  "]
    return [base, base, base, *copies, *mixed, *lines, *odd, prose(rng, 5000), shared, shared.upper()]


def strings_removed(rows, window=100):
    first: dict[bytes, tuple] = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for p in range(len(b) - window + 1):
            key = b[p : p + window]
            first[key] = min(first.get(key, (d, p)), (d, p))
    out = []
    for d, b in data:
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - window + 1):
            if first[b[p : p + window]] < (d, p):
                gone[p : p + window] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_repeated_strings_match_brute_force(spark, texts, monkeypatch):
    rows = list(enumerate(texts))
    got = suffix_dedup.deduplicated(documents(spark, texts)).drop("kept").collect()
    assert Counter(map(tuple, got)) == strings_removed(rows)
    # small blocks and chunks take the ways of very common strings
    monkeypatch.setattr(suffix_dedup, "BLOCK", 4)
    monkeypatch.setattr(suffix_dedup, "CROWDED", 2)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 16)
    got = suffix_dedup.deduplicated(documents(spark, texts).repartition(5)).drop("kept").collect()
    assert Counter(map(tuple, got)) == strings_removed(rows)


def test_repeated_strings_keep_repeated_rows_alike_and_skip_null_ids(spark):
    text = " ".join(f"v{i}" for i in range(60))
    got = suffix_dedup.deduplicated(documents(spark, [text, text, text, text], [3, 3, None, 9]), keep=("lang", "n_chars")).collect()
    assert sorted((r.doc_id or -1, r.n_removed, r.carried.lang) for r in got) == [(-1, 0, "en"), (3, 0, "en"), (3, 0, "en"), (9, len(text), "en")]
    assert suffix_dedup.deduplicated(documents(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_suffix_order_is_lexicographic(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    starts, groups = rng.integers(0, 300, 60), rng.integers(0, 4, 60)
    limits = rng.integers(1, 100, 60)
    order = suffix_dedup.SuffixOrder(data, starts, limits, groups).order().tolist()
    key = lambda i: (groups[i], data[starts[i] : starts[i] + limits[i]].tobytes(), i)
    assert order == sorted(range(60), key=key)


def word_sets(rows):
    out = {}
    for d, t in rows:
        words = (t or "").encode().lower().split()
        out[d] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    return out


def components_of(sets):
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in ids}


def test_near_duplicates_match_brute_force(spark, texts):
    rng = random.Random(11)
    chain = [[f"c{i}" for i in range(200)]]
    for step in range(1, 8):  # neighbours are linked, the ends are not
        words = list(chain[-1])
        for k in range(4):
            words[(step * 25 + k * 3) % 200] = f"n{step}_{k}"
        chain.append(words)
    rng.shuffle(chain)
    everything = [*texts, *(" ".join(c) for c in chain)]
    sets = word_sets(enumerate(everything))
    named = components_of(sets)
    got = near_dedup.near_duplicates(documents(spark, everything)).rows.collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {d: (len(sets[d]), named[d], named[d] == d) for d in sets}
    assert len(got) == len(everything)


def test_links_that_the_first_of_a_bucket_does_not_show(spark, monkeypatch):
    """With every pair in the same buckets and a pivot that is linked with nobody, the rest is still found."""
    base = [f"b{i}" for i in range(150)]
    near = [" ".join(base[:i] + [f"z{i}"] + base[i + 1 :]) for i in range(10, 60, 5)]
    lone = " ".join(base[:75] + [f"q{i}" for i in range(75)])
    rows = [lone, *near, *(" ".join([f"f{k}_{i}" for i in range(20)] + base[:60]) for k in range(6))]
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    named = components_of(word_sets(enumerate(rows)))
    got = near_dedup.near_duplicates(documents(spark, rows)).rows.collect()
    assert {r.doc_id: r.component_id for r in got} == named


def test_near_duplicates_nulls_repeats_and_no_rows(spark):
    got = near_dedup.near_duplicates(documents(spark, ["a b c d e f", "a b c d e f", "a b c d e f", None], [4, 4, None, 2])).rows.collect()
    assert sorted(((r.doc_id or -1), r.n_shingles, r.component_id or -1, r.kept) for r in got) == [(-1, 2, -1, True), (2, 0, 2, True), (4, 2, 4, True), (4, 2, 4, True)]
    assert near_dedup.near_duplicates(documents(spark, [])).rows.count() == 0


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_runs_and_ids_equal_the_library(library, texts):
    tricky = ["a  b", "a \nb", "a\n b", " a", "a ", "don't we'll", "x<|endoftext|>y <|endoftext|>", "1 2 3", "a b   c", "tab\tx y", "…  —", "a \n\n b c"]
    for text in [t for t in texts if t] + tricky:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(bpe.encode_bytes(text), "<u4").tolist() == want
        assert "".join(bpe.runs(text)) == text
        assert [i for r in bpe.runs(text) for i in bpe.ids_of(r)] == want


def test_worker_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    lookup = bpe.Lookup(len, {"fixed": 5})
    keys = [f"k{i}" for i in range(100)] + ["fixed", "y" * 100]
    assert lookup.all(keys) == [len(k) for k in keys] and len(lookup.known) <= 12 and lookup.known["fixed"] == 5


def test_a_text_is_encoded_in_one_call(monkeypatch):
    calls, ranks = [], bpe.ranks()

    class Counted:
        def encode_ordinary(self, text):
            calls.append(text)
            return ranks.encode_ordinary(text)

    monkeypatch.setattr(bpe, "ranks", Counted)
    text = "of words that no other test has: quobble quibble  quabble\n and quubble"
    want = bpe.library().encode(text, add_special_tokens=False).ids
    assert np.frombuffer(bpe.encode_bytes(text), "<u4").tolist() == want
    assert calls == [text]


def test_token_counts(spark, texts, library):
    got = bpe.token_counts(documents(spark, [*texts, texts[0]], [*range(len(texts)), None]), limit=100).collect()
    want = Counter()
    for i, t in [*enumerate(texts), (None, texts[0])]:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 100] += 1
    assert Counter(map(tuple, got)) == want
    assert bpe.token_counts(documents(spark, [])).count() == 0


def check_packed(rows, docs, library, capacity):
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 0] for d, t in docs}
    per_doc, per_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
        assert r.ids_crc32 == zlib.crc32(own.tobytes())
        per_doc[r.doc_id].append((r.piece, r.start, r.length))
        per_sequence[r.sequence_id].append((r.offset, r.length))
    for d, pieces in per_doc.items():
        pieces.sort()
        assert [p for p, _, _ in pieces] == list(range(len(pieces)))
        assert sum(n for _, _, n in pieces) == len(ids[d]) and all(n == capacity for _, _, n in pieces[1:])
    for places in per_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(per_sequence)


def test_packing_places_every_token_once(spark, texts, library):
    got = packing.pack(documents(spark, texts), 256).collect()
    assert {r.doc_id for r in got} == set(range(len(texts)))
    used = check_packed(got, enumerate(texts), library, 256)
    assert used <= 1 + 1.1 * sum(r.length for r in got) / 256
    assert packing.pack(documents(spark, [])).count() == 0
    twice = packing.pack(documents(spark, [None, None, "a"], [1, 1, None])).collect()
    assert len(twice) == 3 and len({(r.sequence_id, r.offset) for r in twice}) == 3


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_and_wastes_little(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randrange(1, 101), rng.randrange(1, 20), 100]) for _ in range(3000))
    made = packing.plan(dict(counts), 100)
    used = Counter()
    for parts, times in made:
        assert times > 0 and sum(parts) <= 100
        for p in parts:
            used[p] += times
    assert used == counts
    total = sum(k * n for k, n in counts.items())
    assert sum(t for _, t in made) <= -(-total // 100) + 2


def test_exact_pairs_and_triples_are_found():
    assert sorted(packing.plan({60: 3, 40: 3}, 100)) == [((60, 40), 3)]
    assert dict(packing.plan({50: 1, 30: 1, 20: 1, 45: 2, 25: 2, 15: 4}, 100)) == {(50, 30, 20): 1, (45, 25, 15, 15): 2}
    assert packing.plan({}, 100) == []


def test_shards(spark, texts):
    df = documents(spark, [*texts, texts[0], texts[0]], [*range(len(texts)), None, 0])
    got = sharding.hilbert_shards(df, keep=("source",)).collect()
    per_shard = defaultdict(list)
    for r in got:
        per_shard[r.shard].append(r.slot)
    assert set(per_shard) == set(range(8)) and max(map(len, per_shard.values())) - min(map(len, per_shard.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in per_shard.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in [*enumerate(texts), (None, texts[0]), (0, texts[0])])
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in got)
    assert sharding.hilbert_shards(documents(spark, [])).count() == 0
    assert sorted(r.shard for r in sharding.hilbert_shards(documents(spark, ["a", "b"])).collect()) == [0, 4]


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3)])
def test_hilbert_neighbours_are_one_step_apart(spark, dims, bits):
    cells = spark.range(1 << (dims * bits))
    axes = [F.shiftright("id", bits * i).bitwiseAND(F.lit((1 << bits) - 1)) for i in range(dims)]
    rows = cells.select(*[a.alias(f"d{i}") for i, a in enumerate(axes)], sharding.hilbert_index(axes, bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(1 << (dims * bits)))
    assert all(sum(abs(a[i] - b[i]) for i in range(dims)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def test_no_python_in_the_sharding_plan(spark, texts):
    plan = sharding.hilbert_shards(documents(spark, texts[:3]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


TERMS = {"idiot": True, "worthless": True}


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_automaton_finds_what_edit_distance_says():
    lexicon = toxicity.Lexicon(TERMS | {"abc": True}, {"scum": False, "grumb": True})
    rng = random.Random(3)
    words = ["abc", "abd", "scum", "scumbag", "scun", "grumbling", "grmbling", "grxmbling", "gxumbl", "idiotic", ""]
    for term in [*TERMS, "grumb"]:
        for _ in range(300):
            w = list(term)
            for _ in range(rng.randrange(3)):
                i = rng.randrange(len(w))
                w[i : i + rng.randrange(2)] = rng.choice(["", "x", "o", "xy"])
            words.append("".join(w))
    for word in words:
        best = [(0, True) for t in [*TERMS, "abc"] if t == word] + [(1, True) for t in TERMS if within_one(t, word)]
        best += [(0, False)] if word.startswith("scum") else []
        prefixes = [word[:n] for n in range(len(word) + 1)]
        best += [(0, True)] if "grumb" in prefixes else []
        best += [(1, True)] if any(within_one("grumb", p) for p in prefixes) else []
        want = min(best, key=lambda b: (b[0], not b[1]), default=None)
        assert lexicon.match(word) == want, word


def test_toxicity_learns_from_the_training_folds_only(spark):
    rng = random.Random(9)
    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    rows, labels = [], []
    for i in range(400):
        words = prose(rng, 60).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["grindel", "grindelx", "mopsig"])
        if fold(i) == 2 and i % 4 == 1:
            words[0] = "heldoutword"
        rows.append(" ".join(words))
        labels.append((i, 1 if toxic or (fold(i) == 2 and i % 4 == 1) else 0))
    df = documents(spark, [*rows, None, "", rows[0]], [*range(400), 400, 401, None])
    known = spark.createDataFrame([*labels, (0, 0), (999, 1), (None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.train(df, known)
    assert "heldoutword" not in model.terms and {"mopsig"} <= {*model.terms, *(s for s in ("mopsig",) if any("mopsig".startswith(x) for x in model.stems))}
    got = toxicity.score(df, model).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(by_id[i].held_out == (fold(i) == 2) for i in range(402)) and by_id[None].held_out is False
    assert all(by_id[i].predicted == int(i % 4 == 0) for i in range(400)) and by_id[400].predicted == by_id[401].predicted == 0
    assert by_id[None].score == by_id[0].score
    kept = toxicity.without_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == sum(1 - r.predicted for r in got)
    again = toxicity.train(documents(spark, []), known)
    assert again.terms == {} and toxicity.score(documents(spark, []), again).count() == 0


def test_quoted_matches_count_apart():
    memory = toxicity.Words(toxicity.Lexicon(TERMS, {}))
    at = toxicity.FEATURES.index
    abuse = toxicity.features("you are an idiot and that is it", memory)
    quote = toxicity.features('they said the word "idiot" was used', memory)
    assert abuse[at("addressed")] > 0 and abuse[at("quoted")] == 0
    assert quote[at("quoted")] > 0 and quote[at("addressed")] == 0


def test_leaks(spark):
    rng = random.Random(21)
    items = [prose(rng, 40, 5000) for _ in range(6)] + ["tiny one", None, "", prose(rng, 3, 9000)]
    edited = items[1].split()
    for i in (3, 12, 25, 33):
        edited[i] = "other"
    del edited[18]
    texts = [
        prose(rng, 300, 5000), items[0], prose(rng, 80, 5000) + " " + items[2].upper().replace("É", "é") + "! " + prose(rng, 90, 5000),
        " ".join([prose(rng, 30, 5000), *edited, prose(rng, 30, 5000)]), " ".join(items[3].split()[:12]), None, "", "x tiny one y", items[4] + " " + items[5],
    ]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(0, items[0], 2)], "item_id bigint, text string, score int")
    df = documents(spark, [*texts, items[0]], [*range(len(texts)), None])
    got = decontamination.contaminated(df, bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert pairs == {(1, 0), (None, 0), (2, 2), (3, 1), (7, 6), (8, 4), (8, 5)} and len(got) == len(pairs)
    assert {r.doc_id: (r.first_word, r.last_word) for r in got}[2] == (80, 120)
    clean = decontamination.uncontaminated(df, bench)
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == [0, 4, 5, 6]
    assert decontamination.contaminated(documents(spark, []), bench).count() == 0
    assert decontamination.contaminated(df, bench.limit(0)).count() == 0
    small = list(decontamination.item_blocks(bench.select("item_id", "text"), limit=40))
    assert len(small) > 2 and sorted(i for b in small for i in b.ids) == [0, 1, 2, 3, 4, 5, 6, 9]


def leaks_by_full_alignment(texts, items, threshold=decontamination.THRESHOLD):
    codes = lambda t: decontamination.word_codes(decontamination.pa.array([t]))[0]
    out = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            a, b = codes(text), codes(item)
            score = decontamination.align(a, b)[0] / (decontamination.MATCH * len(b))
            if score >= threshold:
                out[d, i] = score
    return out


def test_leaks_with_a_long_insertion(spark):
    rng = random.Random(22)
    items = [prose(rng, m, 5000) for m in (16, 40, 59)]
    texts = []
    for item in items:
        words = item.split()
        for share in (0.4, 0.6, 0.78, 0.9):
            middle = [prose(rng, int(share * len(words)), 5000)]
            texts.append(" ".join([prose(rng, 50, 5000), *words[: len(words) // 2], *middle, *words[len(words) // 2 :], prose(rng, 50, 5000)]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(documents(spark, texts), bench).collect()}
    due = leaks_by_full_alignment(texts, items)
    assert got == due and len(due) == 9


def test_edited_leaks_match_full_alignment(spark):
    rng = random.Random(23)
    items = [prose(rng, m, 3000) for m in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 16, 16, 25, 39, 40)] + ["the of and the of and the in to of " + prose(rng, 6, 3000)]
    texts = [prose(rng, 200, 3000), " ".join(f"{w} x{i}" for i, w in enumerate(items[4].split())), ""]
    words = items[10].split()
    words[5] = words[10] = words[15 - 1] = "other"
    texts.append(prose(rng, 40, 3000) + " " + " ".join(words))
    for item in items:
        for k in range(12):
            words = item.split()
            for _ in range(rng.randrange(1 + len(words) // 3)):
                i = rng.randrange(len(words))
                words[i : i + rng.randrange(2)] = [f"new{rng.randrange(99)}"] * (rng.randrange(4) > 0)
            start = [] if k % 3 else ["the of and to in"] * 60  # common words on the way
            texts.append(" ".join([*start, prose(rng, 30, 3000), *words, prose(rng, 30, 3000)]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    df = documents(spark, texts)
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(df, bench).collect()}
    due = leaks_by_full_alignment(texts, items)
    assert got == due and len(due) > 100 and (3, 10) in due
    kept = {r.doc_id for r in decontamination.uncontaminated(df, bench).collect()}
    assert kept == set(range(len(texts))) - {d for d, _ in due}


@pytest.mark.parametrize("seed", range(4))
def test_alignment_score_is_smith_waterman(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 4, 30).astype(np.uint64), rng.integers(0, 4, 12).astype(np.uint64)
    table = np.zeros((len(b) + 1, len(a) + 1), dtype=int)
    for i in range(1, len(b) + 1):
        for j in range(1, len(a) + 1):
            same = decontamination.MATCH if a[j - 1] == b[i - 1] else decontamination.MISMATCH
            table[i, j] = max(0, table[i - 1, j - 1] + same, table[i - 1, j] + decontamination.GAP, table[i, j - 1] + decontamination.GAP)
    score, first, last = decontamination.align(a, b)
    assert score == table.max() and decontamination.align(a[first:last], b)[0] == score


@pytest.mark.parametrize("seed", range(3))
def test_compact_windows_name_the_minimum_of_every_run(seed):
    rng = np.random.default_rng(seed)
    value = rng.integers(0, 30 if seed else 2, 90).astype(np.uint64)
    bounds, width = np.array([0, 0, 35, 90]), 8
    found = list(zip(*(x.tolist() for x in passage_dedup.compact_windows(value, bounds, width)), strict=True))
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        for i in range(a, z - width + 1):
            for j in range(i + width, z + 1):
                holders = [(l, c, r) for l, c, r in found if l <= i <= c < j <= r]
                assert len(holders) == 1 and value[holders[0][1]] == value[i:j].min()


def test_passages(spark, texts):
    got = passage_dedup.near_duplicate_passages(documents(spark, texts)).collect()
    words = [[w.decode("latin1") for w in (t or "").encode().lower().split()] for t in texts]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for r in got:
        a, b = shingles(words[r.doc_id][r.first_word : r.last_word]), shingles(words[r.source_doc_id][r.source_first_word : r.source_last_word])
        assert r.source_doc_id < r.doc_id and min(r.last_word - r.first_word, r.source_last_word - r.source_first_word) >= 50
        assert abs(r.similarity - len(a & b) / len(a | b)) < 1e-9 and r.similarity >= 0.75
    seen: dict[tuple, int] = {}
    due = set()
    for d, w in enumerate(words):
        for i in range(len(w) - 49):
            if seen.setdefault(tuple(w[i : i + 50]), d) != d:
                due.add(d)
    assert due <= {r.doc_id for r in got}
    assert passage_dedup.near_duplicate_passages(documents(spark, [])).count() == 0
    assert passage_dedup.near_duplicate_passages(documents(spark, [texts[0], texts[0], texts[0]], [None, 5, 5])).count() == 0


def test_every_repeated_run_of_words_is_covered(spark, texts):
    rng = random.Random(31)
    lines = [prose(rng, rng.randrange(8, 30), 90) for _ in range(14)]
    mixes = [" ".join(rng.choice(lines) for _ in range(rng.randrange(2, 12))) for _ in range(120)]
    # each line has been seen in documents that don't hold the passage before its two copies come
    passage = " ".join(lines[:4])
    odd = [" ".join([prose(rng, 60), line, prose(rng, 60)]) for line in lines for _ in range(3)]
    all_texts = [*odd, *mixes, *(prose(rng, 40) + " " + passage + " " + prose(rng, 40) for _ in range(3)), *texts]
    words = [[w.decode("latin1") for w in (t or "").encode().lower().split()] for t in all_texts]
    covered = defaultdict(list)
    for r in passage_dedup.near_duplicate_passages(documents(spark, all_texts)).collect():
        assert r.source_doc_id < r.doc_id and r.similarity >= 0.75
        covered[r.doc_id].append((r.first_word, r.last_word))
    seen: dict[tuple, int] = {}
    due = 0
    for d, w in enumerate(words):
        for i in range(len(w) - 49):
            if seen.setdefault(tuple(w[i : i + 50]), d) != d:
                due += 1
                assert any(a <= i and i + 50 <= z for a, z in covered[d]), (d, i)
    assert due > 1000


def test_texts_of_many_near_pairs_travel_a_few_times(spark):
    n = 200
    pairs = spark.createDataFrame([(x, y) for x in range(n) for y in range(x)], "x bigint, y bigint")
    blocks = passage_dedup.dealt(pairs)
    assert blocks.select("x", "y").exceptAll(pairs).count() == 0 and blocks.count() == pairs.count()
    assert passage_dedup.members(blocks).count() <= 8 * n  # of 199 pairs each


def test_copies_that_end_in_a_common_line_are_not_compared_with_all_that_have_it(spark, monkeypatch):
    rng = random.Random(47)
    line, passages = prose(rng, 13, 90000), [prose(rng, 60, 90000) for _ in range(12)]
    others = [" ".join([prose(rng, 40, 90000), line]) for _ in range(600)]
    every = [*(" ".join([p, prose(rng, 40, 90000)]) for p in passages), *others, *(" ".join([p, line]) for p in passages)]
    counts, dealt = [], passage_dedup.dealt
    monkeypatch.setattr(passage_dedup, "dealt", lambda pairs: counts.append(pairs.count()) or dealt(pairs))
    got = {(r.doc_id, r.source_doc_id) for r in passage_dedup.near_duplicate_passages(documents(spark, every)).collect()}
    assert got == {(612 + i, i) for i in range(12)}
    assert counts[0] < 600  # not 12 times as many


def test_repeated_lines_are_not_compared_in_all_pairs(monkeypatch):
    rng = np.random.default_rng(5)
    lines = [rng.integers(0, 1 << 40, 19).astype(np.uint64) for _ in range(5)]
    x = np.concatenate([lines[i] for i in rng.integers(0, 5, 200)])
    given, promising = [], passage_dedup.promising
    monkeypatch.setattr(passage_dedup, "promising", lambda *a: given.extend(out := promising(*a)) or out)
    assert passage_dedup.passages(x, x, 0.75)
    assert len(given) < 200


def test_near_passages_are_not_left_to_chance(spark):
    rng = random.Random(41)
    sources = [prose(rng, 60, 90000) for _ in range(300)]
    copies = []
    for text in sources:
        words = text.split()
        words[20 + rng.randrange(20)] = "changed"
        copies.append(" ".join(words))
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(56)}
    assert all(0.75 <= len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) < 0.9 for a, b in zip(sources, copies, strict=True))
    got = {(r.doc_id, r.source_doc_id) for r in passage_dedup.near_duplicate_passages(documents(spark, sources + copies)).collect()}
    assert got == {(i + 300, i) for i in range(300)}


def test_near_passages_whose_shingles_come_earlier_elsewhere(spark):
    """Every shingle of the sources is in earlier documents that hold a part of them only, of some in very many."""
    rng = random.Random(43)
    sources = [prose(rng, 60, 90000) for _ in range(30)]
    around = lambda words: " ".join([prose(rng, 50, 90000), *words, prose(rng, 50, 90000)])
    parts = [around(t.split()[a : a + 24]) for i, t in enumerate(sources) for a in (0, 18, 36) for _ in range(80 if i < 2 else 2)]
    copies = []
    for text in sources:
        words = text.split()
        words[20 + rng.randrange(20)] = "changed"
        copies.append(" ".join(words))
    every = parts + sources + copies
    got = {(r.doc_id, r.source_doc_id) for r in passage_dedup.near_duplicate_passages(documents(spark, every)).collect()}
    first, n = len(parts), len(sources)
    assert got == {(first + n + i, first + i) for i in range(n)}
