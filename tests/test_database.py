"""Tables of a relational database, with the one that comes with Spark."""

import random
import uuid

import pytest
from pyspark.errors import PySparkException

from quillgraph.sources import database

from .test_plans import plan

SCHEMA = "id long, title string, price double, seen timestamp"


@pytest.fixture
def url():
    return f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"


def made(n):
    rng = random.Random(5)
    return [(None if k % 17 == 0 else 3 * k - 40, rng.choice([None, "", "it's", "ก", "a\"b"]), rng.choice([None, k / 7]), None) for k in range(n)]


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_round_trip_in_ranges(spark, url):
    rows = spark.createDataFrame(made(200), SCHEMA)
    database.write_table(rows.repartition(3), url, "items")
    got = database.database_table(spark, url, "items", "id", 4)
    assert got.rdd.getNumPartitions() == 4
    assert rows_of(got) == rows_of(rows)
    sizes = [sum(1 for _ in part) for part in got.select("id").rdd.glom().collect()]
    assert min(sizes) > 30 and sum(sizes) == 200  # the ranges fit the keys
    assert rows_of(database.database_table(spark, url, "items")) == rows_of(rows)


def test_the_source_filters(spark, url):
    database.write_table(spark.createDataFrame(made(100), SCHEMA), url, "items")
    got = database.database_table(spark, url, "items", "id", 4).where("id >= 20 AND title IS NOT NULL").select("id")
    text = plan(got)
    assert "*GreaterThanOrEqual(id,20)" in text and "*IsNotNull(title)" in text and "ReadSchema: struct<id:bigint>" in text
    assert sorted(r.id for r in got.collect()) == sorted(r[0] for r in made(100) if r[0] is not None and r[0] >= 20 and r[1] is not None)


def test_tables_without_keys(spark, url):
    empty = spark.createDataFrame([], SCHEMA)
    database.write_table(empty, url, "items")
    assert database.database_table(spark, url, "items", "id", 4).count() == 0
    database.write_table(spark.createDataFrame([(None, "a", None, None)] * 2, SCHEMA), url, "items")
    assert database.database_table(spark, url, "items", "id", 4).count() == 2


def test_put_rows(spark, url):
    old = [(k, f"old {k}", 1.0, None) for k in range(10)]
    database.write_table(spark.createDataFrame(old, SCHEMA), url, "items")
    new = [(k, f"new {k}", 2.0, None) for k in range(7, 30)]
    assert database.put_rows(spark.createDataFrame(new + new[:5], SCHEMA).repartition(4), url, "items", ["id"]) == (3, 23)
    read = lambda: sorted(map(tuple, database.database_table(spark, url, "items", "id", 3).collect()))
    assert read() == old[:7] + new
    assert not any(n.startswith("STAGE") for n in tables(spark, url))

    for bad, error in (([(1, "x", None, None), (1, "y", None, None)], ValueError), ([(None, "x", None, None)], ValueError)):
        with pytest.raises(error):
            database.put_rows(spark.createDataFrame(bad, SCHEMA), url, "items", ["id"])
    broken = spark.createDataFrame(new, SCHEMA).repartition(4).selectExpr("id", "CASE WHEN id = 20 THEN raise_error('lost') ELSE 'z' END AS title", "price", "seen")
    with pytest.raises(PySparkException, match="lost"):
        database.put_rows(broken, url, "items", ["id"])
    with pytest.raises(Exception, match="(?i)other"):  # the last step fails: a column that isn't there
        database.put_rows(spark.createDataFrame([(1, "x")], "id long, other string"), url, "items", ["id"])
    assert read() == old[:7] + new
    assert not any(n.startswith("STAGE") for n in tables(spark, url))


def tables(spark, url):
    with database._transaction(spark, url) as statement:
        found, out = statement.getConnection().getMetaData().getTables(None, None, "%", None), []
        while found.next():
            out.append(found.getString("TABLE_NAME"))
    return out
