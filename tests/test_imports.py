"""Imports of catalogues with faults, down to the last row that rests on them."""

from graphlib import CycleError

import pytest

from quillgraph.sources import imports
from quillgraph.sources.imports import Table


@pytest.fixture
def table(tmp_path):
    def make(name, lines, schema, key, refers=None):
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
        return Table(name, str(tmp_path / f"{name}.csv"), schema, key, refers or {})

    return make


def reasons(imported, key):
    return {(r[key], r.reason) for r in imported.aside.collect()}


def test_all_below_a_missing_corpus(spark, table):
    corpus = table("corpus", ["id,title", "1,one", "2,two"], "id int, title string", "id")
    edition = table("edition", ["id,corpus", "10,1", "20,2", "90,9", "91,"], "id int, corpus int", "id", {"corpus": "corpus"})
    segment = table("segment", ["id,edition,corpus", "100,10,1", "101,90,1", "102,77,1", "103,10,9", "104,,"], "id int, edition int, corpus int", "id", {"edition": "edition", "corpus": "corpus"})
    note = table("note", ["id,segment", "1,100", "2,101", "3,102"], "id int, segment int", "id", {"segment": "segment"})
    got = imports.import_tables(spark, [note, segment, corpus, edition])
    assert list(got) == ["corpus", "edition", "segment", "note"]
    assert {r.id for r in got["edition"].rows.collect()} == {10, 20, 91} and reasons(got["edition"], "id") == {(90, "corpus: no corpus 9")}
    assert {r.id for r in got["segment"].rows.collect()} == {100, 104}
    assert reasons(got["segment"], "id") == {(101, "edition: no edition 90, it was set aside"), (102, "edition: no edition 77"), (103, "corpus: no corpus 9")}
    assert {r.id for r in got["note"].rows.collect()} == {1}
    assert reasons(got["note"], "id") == {(2, "segment: no segment 101, it was set aside"), (3, "segment: no segment 102, it was set aside")}


def test_lines_and_keys(spark, table):
    t = table("item", ["id,size", "1,5", "x,5", "2,6", "2,7", ",8", "3,many", "4,9,9", "5,1"], "id int, size int", "id")
    got = imports.import_tables(spark, [t], {"item": spark.createDataFrame([(5, 0)], "id int, size int")})["item"]
    assert [tuple(r) for r in got.rows.collect()] == [(1, 5)]
    aside = sorted((r.reason, r.line or "", r.id or 0) for r in got.aside.collect())
    assert aside == [("already there", "", 5), ("no key", "", 0), ("no row", "3,many", 3), ("no row", "4,9,9", 4), ("no row", "x,5", 0), ("repeated key", "", 2), ("repeated key", "", 2)]


def test_a_table_that_refers_to_itself(spark, table):
    lines = ["id,up", "1,", "2,1", "3,2", "4,99", "5,4", "6,5", "7,6", "8,50"]
    t = table("item", lines, "id int, up int", "id", {"up": "item"})
    got = imports.import_tables(spark, [t], {"item": spark.createDataFrame([(50, None)], "id int, up int")})["item"]
    assert {r.id for r in got.rows.collect()} == {1, 2, 3, 8}
    assert reasons(got, "id") == {(4, "up: no item 99"), *[(k, f"up: no item {k - 1}, it was set aside") for k in (5, 6, 7)]}


def test_rows_that_are_there_and_circles(spark, table):
    edition = table("edition", ["id,corpus", "10,1", "11,2"], "id int, corpus int", "id", {"corpus": "corpus"})
    there = {"corpus": spark.createDataFrame([(2,)], "corpus int")}
    assert reasons(imports.import_tables(spark, [edition], there)["edition"], "id") == {(10, "corpus: no corpus 1")}
    with pytest.raises(ValueError, match="neither"):
        imports.import_tables(spark, [edition])
    a, b = Table("a", "", "", "id", {"b": "b"}), Table("b", "", "", "id", {"a": "a"})
    with pytest.raises(CycleError):
        imports.in_order([a, b])
