"""Contains-searches through the index give what a scan gives, from fewer files."""

import random

import pytest

from depotwise.functions import columns as C
from depotwise.sources import textindex

FIELDS = ["name", "place"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(6)
    path = tmp_path_factory.mktemp("index")
    stems = ["widget", "Gizmo", "Überzug", "bolt", "anvil", "Çelik", "pipe", "rod"]
    rows = [(i, f"{stems[i % 8]} {rng.randrange(10**6)}", None if i % 9 == 0 else f"Nation {i % 25}") for i in range(4000)]
    rows += [(9000, None, None), (9001, "", "x"), (9002, "ab", "")]
    df = spark.createDataFrame(rows, "id long, name string, place string")
    df.repartitionByRange(16, "name").write.parquet(str(path / "table"))
    textindex.build_index(spark, str(path / "table"), str(path / "files"), FIELDS)
    return str(path / "table"), str(path / "files")


@pytest.mark.parametrize("text", ["giz", "GIZMO 12", "überzug", "çel", "nation 7", "ab", "x", "", "zzzz", "anvil 9", "t 5"])
def test_equal_rows(spark, stored, text):
    table, index = stored
    got = {r.id for r in textindex.search(spark, table, index, text, FIELDS).collect()}
    assert got == {r.id for r in spark.read.parquet(table).where(C.matches_text(text, *FIELDS)).collect()}


def test_fewer_files_are_read(spark, stored):
    table, index = stored
    every = len(textindex.files_with(spark, index, ""))
    some = textindex.search(spark, table, index, "Überzug 1", FIELDS)
    assert every >= 12 and 1 <= len(some.inputFiles()) <= every // 3
    assert textindex.files_with(spark, index, "no such text") == []
