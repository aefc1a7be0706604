"""Relational databases through JDBC; the driver's jar comes with the cluster."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task reads or writes at once.
FETCH = 10_000


def jdbc_options(url: str) -> dict[str, str]:
    """Options from a URL such as postgres://user:password@host:5432/name; one that begins with jdbc: is taken as it is."""
    if url.startswith("jdbc:"):
        return {"url": url}
    m = re.fullmatch(r"(?:postgres|postgresql)://(?:([^:@/]*)(?::([^@/]*))?@)?([^:/]+)(?::(\d+))?/([^?]+)(?:\?.*)?", url)
    if not m:
        raise ValueError("not a database URL")
    user, password, host, port, name = m.groups()
    out = {"url": f"jdbc:postgresql://{host}:{port or 5432}/{name}", "driver": "org.postgresql.Driver"}
    return out | ({"user": user} if user else {}) | ({"password": password} if password else {})


def quoted(name: str) -> str:
    """A column's name as SQL writes it."""
    return '"' + name.replace('"', '""') + '"'


def database_table(spark: SparkSession, url: str, name: str, key: str | None = None, parts: int = 1) -> DataFrame:
    """A table, read in `parts` ranges of an integer key between the smallest and the largest there is.

    The source is asked for both first, so that ranges fit what is there; rows without key are in the first
    range.  Filters, columns and limits that follow are the source's work.  Without key, or when no row has one, one task reads all.
    """
    reader = spark.read.format("jdbc").options(**jdbc_options(url), fetchsize=FETCH)
    whole = reader.option("dbtable", name).load()
    if key is None or parts == 1:
        return whole
    bounds = f"SELECT min({quoted(key)}) AS {quoted('low')}, max({quoted(key)}) AS {quoted('high')} FROM {name}"
    low, high = spark.read.format("jdbc").options(**jdbc_options(url), query=bounds).load().first()
    if low is None:
        return whole
    return reader.options(dbtable=name, partitionColumn=quoted(key), lowerBound=low, upperBound=high + 1, numPartitions=parts).load()


def write_table(rows: DataFrame, url: str, name: str, mode: str = "append", types: str | None = None) -> None:
    """Rows appended, or a table made anew (types: of some columns), by all tasks at once; each has its own transaction."""
    more = {"createTableColumnTypes": types} if types else {}
    rows.write.format("jdbc").options(**jdbc_options(url), dbtable=name, batchsize=FETCH, **more).mode(mode).save()


@contextmanager
def _transaction(spark: SparkSession, url: str) -> Iterator:
    """A statement whose commands take effect together, or not at all."""
    options = jdbc_options(url)
    if driver := options.get("driver"):
        spark._jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
    properties = spark._jvm.java.util.Properties()
    for k in ("user", "password"):
        if k in options:
            properties.setProperty(k, options[k])
    connection = spark._jvm.java.sql.DriverManager.getConnection(options["url"], properties)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        try:
            yield statement
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            statement.close()
    finally:
        connection.close()


def put_rows(rows: DataFrame, url: str, name: str, key: Sequence[str]) -> tuple[int, int]:
    """Puts rows into a table in place of those with the same key; returns how many were replaced and how many came.

    All tasks write to a table of their own first; what then reaches the real one is one transaction of the
    source, so that readers see all of it or nothing, and a failure, of a task or of the last step, leaves it as it
    was.  A task that is run again may leave rows in the first table twice, so each goes there with a digest
    and a number of its own, and one of equal ones is taken.
    Two different rows with one key are an error, and so is a null in the key.
    """
    spark, stage = rows.sparkSession, f"stage_{uuid.uuid4().hex[:20]}"
    columns = ", ".join(map(quoted, rows.columns))
    keys = ", ".join(map(quoted, key))
    same = lambda a, b: " AND ".join(f"{a}.{quoted(k)} = {b}.{quoted(k)}" for k in key)
    told = rows.withColumns({"row_digest": F.sha2(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}), 256), "row_copy": F.uuid()})
    try:
        write_table(told, url, stage, "errorifexists", "row_digest VARCHAR(64), row_copy VARCHAR(36)")
        with _transaction(spark, url) as statement:
            def number(sql: str) -> int:
                result = statement.executeQuery(sql)
                result.next()
                n = result.getLong(1)
                result.close()
                return n

            if number(f"SELECT count(*) FROM {stage} WHERE {' OR '.join(f'{quoted(k)} IS NULL' for k in key)}"):
                raise ValueError(f"a row for {name} has no key")
            digest, copy = quoted("row_digest"), quoted("row_copy")
            if number(f"SELECT count(*) FROM (SELECT {keys} FROM {stage} GROUP BY {keys} HAVING min({digest}) <> max({digest})) t"):
                raise ValueError(f"several rows for one key of {name}")
            gone = statement.executeUpdate(f"DELETE FROM {name} WHERE EXISTS (SELECT 1 FROM {stage} s WHERE {same('s', name)})")
            came = statement.executeUpdate(f"INSERT INTO {name} ({columns}) SELECT {columns} FROM {stage} s WHERE {copy} = (SELECT min({copy}) FROM {stage} t WHERE {same('s', 't')})")
        return gone, came
    finally:
        if _has(spark, url, stage):
            with _transaction(spark, url) as statement:
                statement.executeUpdate(f"DROP TABLE {stage}")


def _has(spark: SparkSession, url: str, name: str) -> bool:
    with _transaction(spark, url) as statement:
        tables = statement.getConnection().getMetaData().getTables(None, None, "%", None)
        while tables.next():
            if tables.getString("TABLE_NAME").lower() == name.lower():
                return True
    return False
