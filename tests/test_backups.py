"""Chains of daily changes restore every day as a full copy would."""

import random

import pytest
from pyspark.errors import PySparkException

from quillgraph.sources import backups

SCHEMA = "site string, id int, title string, tags array<string>"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(list(rows), schema)


def rows_of(df, columns=("site", "id", "title", "tags")):
    return sorted(map(str, df.select(*columns).collect()))


def written(spark, folder, day):
    return spark.read.parquet(f"{folder}/day={day}").count()


def test_every_day_as_a_full_copy(spark, tmp_path):
    rng, folder = random.Random(3), str(tmp_path / "b")
    table, days, sizes = {}, {}, {}
    for k in range(9):
        day = f"2024-01-{2 * k + 1:02}"
        if k not in (4, 6):
            for _ in range(6):
                table[(rng.choice("ab"), rng.randint(0, 12))] = (rng.choice(["x", "y", None]), rng.choice([None, [], ["t"]]))
            for key in rng.sample(sorted(table), 2):
                del table[key]
        days[day] = [(*key, *v) for key, v in table.items()]
        backups.back_up(frame(spark, days[day]).repartition(3), folder, day, ["site", "id"], chain=5)
        sizes[day] = written(spark, folder, day)
    for day, rows in days.items():
        assert rows_of(backups.restored(spark, folder, day, ["site", "id"])) == rows_of(frame(spark, rows))
    assert sizes["2024-01-09"] == 0 and 0 < sizes["2024-01-03"] < 12
    assert [kind for _, kind in backups._days(spark, folder)].count("full") == 2
    assert rows_of(backups.restored(spark, folder, "2024-01-04", ["site", "id"])) == rows_of(frame(spark, days["2024-01-03"]))
    with pytest.raises(ValueError, match="no backup"):
        backups.restored(spark, folder, "2023-12-31", ["site", "id"])
    with pytest.raises(ValueError, match="before the last"):
        backups.back_up(frame(spark, []), folder, "2024-01-02", ["site", "id"])


def test_a_row_that_comes_back_and_a_day_again(spark, tmp_path):
    folder, row = str(tmp_path / "b"), ("a", 1, "x", None)
    for day, rows in (("2024-01-01", [row]), ("2024-01-02", []), ("2024-01-03", [row]), ("2024-01-03", [row, ("a", 2, "y", None)]), ("2024-01-03", [("a", 2, "y", None)])):
        backups.back_up(frame(spark, rows), folder, day, ["site", "id"])
    got = [[r.id for r in backups.restored(spark, folder, f"2024-01-0{k}", ["site", "id"]).collect()] for k in (1, 2, 3)]
    assert got == [[1], [], [2]] and written(spark, folder, "2024-01-02") == 1


def test_columns_that_come_later(spark, tmp_path):
    folder = str(tmp_path / "b")
    backups.back_up(frame(spark, [(1, "x"), (2, "y")], "id int, title string"), folder, "2024-01-01", ["id"])
    backups.back_up(frame(spark, [(1, "x", 5), (2, "y", None)], "id int, title string, size int"), folder, "2024-01-02", ["id"])
    assert rows_of(backups.restored(spark, folder, "2024-01-02", ["id"]), ("id", "title", "size")) == rows_of(frame(spark, [(1, "x", 5), (2, "y", None)], "id int, title string, size int"), ("id", "title", "size"))
    assert backups.restored(spark, folder, "2024-01-01", ["id"]).columns == ["id", "title"]


@pytest.mark.parametrize("rows", [[("a", 1, "x", None), ("a", 1, "y", None)], [("a", None, "x", None)]])
def test_keys(spark, tmp_path, rows):
    with pytest.raises(PySparkException, match="null or repeated key"):
        backups.back_up(frame(spark, rows), str(tmp_path / "b"), "2024-01-01", ["site", "id"])
    assert backups._days(spark, str(tmp_path / "b")) == []
