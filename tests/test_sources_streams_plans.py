"""Sources, streams, and the registered queries against DuckDB."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgraph.plans import catalogue
from quillgraph.sources import database, files
from quillgraph.sources.tables import literal
from quillgraph.streaming import events as stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_as_sql(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == sorted(repr(tuple(r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_files(spark, tmp_path):
    for name in ("archive/b1/001.jpg", "archive/b1/1002.jpg", "archive/b2/x.jpg", "img/a.PNG", "img/a.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode())
    assert files.images(spark, str(tmp_path)).count() == 4
    (tmp_path / "img/b.avif").write_bytes(b"x")
    assert files.images(spark, str(tmp_path)).count() == 4
    assert {(r.book, r.page) for r in files.scans(spark, str(tmp_path)).collect()} == {("b1", 1), ("b1", 1002)}
    assert bytes(files.media(spark, f"{tmp_path}/img").orderBy("path").first().content) == b"img/a.PNG"


def test_catalogue_import(spark, tmp_path):
    (tmp_path / "e.csv").write_text("edition,corpus\n1,10\n2,99\n")
    (tmp_path / "bad.csv").write_text("edition,corpus\nx,10\n")
    schema = "edition int, corpus int"
    good, bad = files.checked_import(files.catalogue(spark, str(tmp_path / "e.csv"), schema), literal(spark, [(10,)], "id int"), "corpus", "id")
    assert [r.edition for r in good.collect()] == [1] and [r.edition for r in bad.collect()] == [2]
    with pytest.raises(Exception, match="(?i)input string|malformed"):
        files.catalogue(spark, str(tmp_path / "bad.csv"), schema).collect()


def test_forms_and_snapshots(spark, tmp_path):
    rows = literal(spark, [(1, "x")], "id int, body string")
    for _ in range(2):
        files.append_submissions(rows, str(tmp_path / "forms"))
        files.snapshot(rows, str(tmp_path / "snap"), "2024-01-01")
    files.export_submissions(spark, str(tmp_path / "forms"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 1
    files.snapshot(literal(spark, [(2, "y"), (3, "z")], "id int, body string"), str(tmp_path / "snap"), "2024-01-02")
    assert sorted(r.id for r in files.latest_snapshot(spark, str(tmp_path / "snap")).collect()) == [2, 3]


def test_database_url():
    got = database.jdbc_options("postgres://me:secret@db:5433/site?x=1")
    assert (got["url"], got["user"], got["password"]) == ("jdbc:postgresql://db:5433/site", "me", "secret")
    assert database.jdbc_options("postgresql://db/site")["url"] == "jdbc:postgresql://db:5432/site"
    with pytest.raises(ValueError):
        database.jdbc_options("sqlite:///x")


def test_share_in_sight(spark):
    rows = spark.createDataFrame([(900.0, 100.0), (915.0, 100.0), (-50.0, 100.0), (2000.0, 100.0), (0.0, 0.0)], "top double, height double")
    got = [r.s for r in rows.select(stream.share_in_sight(F.col("top"), F.col("height"), F.lit(1000.0)).alias("s")).collect()]
    assert got[:4] == pytest.approx([0.2, 0.05, 0.5, 0.0]) and got[4] is None


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 0, minute, second)


@pytest.fixture
def stream_of(spark, tmp_path):
    """A stream that gets each list of rows as a file of its own, in order."""

    def make(*parts, schema="ts timestamp, key string, v double"):
        folder = tmp_path / "in"
        for k, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / str(k)))
            for f in (folder / str(k)).iterdir():  # the stream reads files by age
                os.utime(f, (1_700_000_000 + 60 * k,) * 2)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))

    return make


def test_coalesced(stream_of, tmp_path):
    s = stream_of([(at(0, 1), "a", 1.0), (at(0, 2), "a", 2.0), (at(0, 3), "b", 5.0)], [(at(9), "a", 3.0)], [(at(9, 30), "a", 6.0)], [(at(0, 5), "a", 9.0)], [(at(20), "a", 4.0)])
    got = stream.drained(stream.coalesced(s, "key", "1 minute", "1 minute", "v"), str(tmp_path))
    assert {(r.frame, r.key, r.n, r["last"]) for r in got.collect()} == {(at(0), "a", 2, 2.0), (at(0), "b", 1, 5.0), (at(9), "a", 2, 6.0)}


def test_once_and_toggle(stream_of, tmp_path):
    s = stream_of([(at(0), "a", 0.1), (at(0), "b", 0.2)], [(at(1), "a", 0.5)], [(at(2), "a", 0.01)])
    assert sorted(r.key for r in stream.drained(stream.once_only(s, ["key"], "1 hour"), str(tmp_path)).collect()) == ["a", "b"]
    assert {(r.key, r.switches, r.is_open) for r in stream.drained(stream.toggled(s, "key"), str(tmp_path), "complete").collect()} == {("a", 3, True), ("b", 1, True)}
    assert sorted(r.v for r in stream.drained(stream.revealed(s, "v"), str(tmp_path)).collect()) == [0.2, 0.5]
