"""WARC round trips, exact search and the pipeline against brute force."""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from test_text_operators import components_of, documents, prose, strings_removed, word_sets

import __spark_entry__
import corpus_pipeline
from depotwise.llm import decontamination, metric_tree, queries, toxicity, warc


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_no_page_is_lost_at_a_buffer_s_end(spark, tmp_path):
    """Readers fill buffers of 64 KB; a record may end anywhere in one."""
    pages = spark.range(1500).selectExpr("id as page_id", "concat('http://x/', id) as url", "repeat(concat(id, 'y'), cast(id % 97 as int) + 20) as html")
    got = warc.archived(pages.coalesce(2)).collect()
    assert sorted(r.page_id for r in got) == list(range(1500)) and all(r.valid for r in got)


PAGES = [
    (0, "http://a/", "<p>one</p>"), (1, "http://b/", "<p>one</p>"), (2, None, None), (3, "http://c/\r\nX: y", ""), (4, "http://d/", "é" * 50_000),
    (5, "http://e/", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb" * 300), (6, "http://f/", "0\r\n\r\n"), (None, "http://g/", "<p>one</p>"),
    (7, "http://h/", "é" * 50_000), (8, "http://i/", "\r\n\r\n\r\n\r\n"), (9, "u", "alone"), (9, "u", "alone"),
]


@pytest.mark.parametrize("segment", [64, 1000, 32 << 10])
def test_archives_give_back_what_was_written(spark, segment):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id bigint, url string, html string, kind string, segment int")
    got = warc.archived(pages.repartition(3), segment).collect()
    largest = defaultdict(lambda: -1)
    for page_id, _, html in PAGES:
        b = (html or "").encode()
        largest[b] = max(largest[b], -1 if page_id is None else page_id)
    want = Counter()
    for page_id, _, html in PAGES:
        b = (html or "").encode()
        first = largest[b] == page_id
        want[page_id, len(b), digest(b), "response" if first else "revisit", None if first else largest[b], True, b if first else None] += 1
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid", "payload")
    assert Counter(tuple(bytes(v) if isinstance(v, bytearray) else v for v in (r[f] for f in fields)) for r in got) == want
    assert warc.archived(pages.limit(0)).count() == 0


def test_files_are_archives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "x" * 5000)], "page_id bigint, url string, html string")
    warc.write_archives(pages.coalesce(1), str(tmp_path / "w"), segment=2000)
    [file] = Path(tmp_path / "w").glob("part-*.gz")
    data, kinds = gzip.decompress(file.read_bytes()), []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        n = int(fields[b"Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
        kinds.append(fields[b"WARC-Type"])
        data = rest[n + 4 :]
    assert kinds == [b"response", b"continuation", b"continuation"]


def test_lost_and_damaged_segments_are_told(spark):
    rows = [
        ("a", 1, None, "response", 1, "u", "d", None, True, b"ab"), ("a", 3, 6, "continuation", None, None, None, None, True, b"ef"),
        ("b", 1, None, "response", 2, "u", "d", None, True, b"ab"), ("b", 2, 5, "continuation", None, None, None, None, True, b"cd"),
        ("c", 2, 4, "continuation", None, None, None, None, True, b"cd"),
        ("d", 1, None, "response", 4, "u", "d", None, True, b"ab"), ("d", 2, 4, "continuation", None, None, None, None, True, b"cd"),
        ("d", 2, 4, "continuation", None, None, None, None, True, b"cd"), ("e", None, None, "response", 5, "u", "d", None, True, b"ab"),
    ]
    found = spark.createDataFrame(rows, warc.READ)
    got = {r.origin: (r.complete, r.kind, bytes(r.block)) for r in warc.reassembled(found).collect()}
    assert got == {
        "a": (False, "response", b"abef"), "b": (False, "response", b"abcd"), "c": (False, "continuation", b"cd"),
        "d": (True, "response", b"abcd"), "e": (True, "response", b"ab"),
    }


def test_framing_of_payloads_that_begin_with_a_version_line():
    for head in (b"", b"a" * 100, b"a" * 94, b"a" * 105, b"\r\n"):
        for tail in (b"", b"\nWARC/1.1", b"WARC-Type: response\r\n\r\n" * 30, warc.VERSION * 30):
            payload = head + warc.VERSION + tail
            for size in (1, 7, 100, 8192):
                framed = warc.chunked(payload, size)
                assert warc.unchunked(framed) == payload and warc.BOUNDARY not in framed
            for segment in (10, 64, 300):
                for record in warc.records(1, "u", payload, 1, True, segment):
                    assert warc.BOUNDARY not in warc.VERSION + record + b"\r\n\r\n"


def test_pages_that_are_archives_come_back(spark):
    texts = [warc.VERSION.decode() + "WARC-Type: response\r\n\r\nx", "\nWARC/1.1", "a" * (8192 - 9) + "\nWARC/1.1" + "b" * 100]
    pages = spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)], "page_id bigint, url string, html string")
    got = warc.archived(pages).collect()
    assert len(got) == len(texts) and all(r.valid and r.payload_bytes == len(texts[r.page_id]) for r in got)


def test_chunked_framing():
    for payload in (b"", b"x", b"y" * 20_000, warc.BOUNDARY * 5, b"\r\n" * 9):
        framed = warc.chunked(payload, 100)
        assert warc.unchunked(framed) == payload and warc.BOUNDARY not in framed
    assert warc.unchunked(b"5;name=v\r\nhello\r\n0\r\n\r\n") == b"hello"
    assert warc.unchunked(b"5\r\nhell") is None and warc.unchunked(b"zz\r\n") is None and warc.unchunked(b"3\r\nabcde\r\n0\r\n\r\n") is None


def best_ten(rows, every):
    vectors = [(i, tuple(int(np.floor(1024 * float(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for q, v in set(x for x in vectors if x[0] % every == 0):
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q and len(w) == len(v))
        for rank, (score, i) in enumerate(scored[:10], 1):
            out[q, rank, i, -score] += 1
    return out


@pytest.mark.parametrize("tree", [8192, 70])
def test_search_is_exact(spark, tree, monkeypatch):
    monkeypatch.setattr(metric_tree, "TREE", tree)
    monkeypatch.setattr(metric_tree, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).round(3).tolist()) for i in range(500)]
    rows += [(i, [0.5] * 6) for i in range(500, 800)] + [(i, [-0.25, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(800, 830)]
    rows += [(900, None), (901, []), (902, [1.0, None]), (903, [float("nan")] * 6), (904, [float("inf")] * 6), (None, [1.0] * 6), (910, [3.0, 4.0]), (950, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "t") for i, v in rows], "vec_id bigint, embedding array<float>, dim int, tree string")
    got = metric_tree.top_inner_products(df, every=50).collect()
    assert Counter(map(tuple, got)) == best_ten([(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 50)
    few = metric_tree.top_inner_products(df.where("vec_id < 4"), every=1).collect()
    assert Counter(r.query_id for r in few) == {i: 3 for i in range(4)}
    assert metric_tree.top_inner_products(df.limit(0)).count() == 0


def test_the_tree_leaves_most_distances_out():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8)) * 900
    vectors = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) * 20).astype(np.int64)
    tree = metric_tree.Tree(np.arange(4000), vectors)
    seen = []
    tree.vectors = Counted(vectors, seen)
    tree.search(vectors[0], 0, 10, None)
    assert 10 <= sum(seen) < 1500


class Counted:
    def __init__(self, values, seen):
        self.values, self.seen = values, seen

    def __getitem__(self, rows):
        self.seen.append(len(rows))
        return self.values[rows]


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    import random

    rng = random.Random(2)
    root = str(tmp_path_factory.mktemp("corpus"))
    items = [prose(rng, 40, 6000) for _ in range(3)]
    passage = prose(rng, 60, 6000)
    texts, labels = [], []
    for i in range(160):
        words = prose(rng, 90, 6000).split()
        if i % 8 == 0:
            words[10:10] = ["zornig", "klotzkopf", "klotzkopf"]
        if i % 20 == 5:
            words[30:30] = passage.split()
        if i % 40 == 7:
            words[50:50] = items[i % 3].split()
        texts.append(" ".join(words))
        labels.append((i, int(i % 8 == 0), 1))
    texts += [texts[1], texts[1].replace("w1", "w2", 1), None, ""]
    documents(spark, texts).drop("length", "part", "id", "n", "size").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, texts, items


def test_every_stage_does_what_it_says(spark, corpus, tmp_path):
    root, texts, items = corpus
    docs = spark.read.parquet(f"{root}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, root).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == set(rows)
            break
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            assert set(rows) - set(after) == {i for i in range(160) if i % 8 == 0}
        elif name == "near_duplicates":
            named = components_of(word_sets(rows.items()))
            assert set(after) == {d for d in rows if named[d] == d} and len(after) < len(rows)
        elif name == "suffix_duplicates":
            want = {d: h for d, _, _, _, h in strings_removed(rows.items())}
            assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in after.items()} == want
        elif name == "decontamination":
            gone = set(rows) - set(after)
            assert gone and all(any(item[:60] in rows[d] or item[-60:] in rows[d] for item in items) for d in gone)
            assert not any(item in t for item in items for t in after.values() if t)
        rows = after
    ran = corpus_pipeline.run(spark, root)
    assert {r.doc_id for r in ran.collect()} == set(rows)


def test_cut_characters_leave_valid_text(spark, corpus, monkeypatch):
    root, _, _ = corpus
    head = "".join(f"k{i}é" for i in range(40))
    df = documents(spark, [head + "è" + "x" * 20, head + "é" + "y" * 20, "�" + head]).drop("length", "part", "id", "n", "size")
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, df, root).collect()}
    assert got[0].endswith("x" * 20) and got[1].endswith("y" * 20) and "�" not in got[1] and got[2] == "�"


def test_every_operator_is_registered(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14))
    registered = __spark_entry__.queries()
    assert registered["pipeline"] is corpus_pipeline.run and queries.QUERIES.items() <= registered.items()
    assert set(queries.SQL) <= set(queries.QUERIES)
    assert toxicity.THRESHOLD == 0.3 and decontamination.SEED == 5
