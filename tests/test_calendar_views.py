"""Views of recurrences against all occurrences; image specs; seeds that keep other columns."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import calendar, text
from quillgraph.operators import changes

from .test_plans import plan

D = dt.date
SCHEMA = "id int, start date, repeat string, repeat_until date"


def made(seed):
    rng = random.Random(seed)
    day = lambda: D(1990, 1, 1) + dt.timedelta(days=rng.randint(0, 9000))
    fixed = [D(2000, 2, 29), D(2001, 1, 31), D(2001, 3, 30), D(1999, 12, 31), D(2004, 2, 29), D(2001, 1, 1)]
    rows = [(k, rng.choice([day(), rng.choice(fixed)]), rng.choice([*calendar.RULES, None, "never"]), rng.choice([None, day(), day()])) for k in range(300)]
    return [*rows, (900, None, "daily", None), (901, D(2001, 5, 5), "monthly", D(2000, 1, 1))]


@pytest.mark.parametrize("low,high", [(D(2001, 2, 1), D(2001, 2, 28)), (D(2004, 2, 29), D(2004, 2, 29)), (D(1989, 1, 1), D(2030, 1, 1)), (D(2001, 3, 31), D(2003, 2, 27)), (D(2005, 1, 1), D(2004, 1, 1))])
def test_views(spark, low, high):
    rows = spark.createDataFrame(made(1), SCHEMA)
    a, b = F.lit(low), F.lit(high)
    everything = calendar.occurrences(rows).where(F.col("occurs").between(a, b))
    view = calendar.occurrences_between(rows, a, b)
    assert sorted(tuple(r) for r in view.select("id", "occurs").collect()) == sorted(tuple(r) for r in everything.select("id", "occurs").collect())
    sums = {r.id: (r.n, r.last, r.days) for r in everything.groupBy("id").agg(F.count("*").alias("n"), F.max("occurs").alias("last"), F.sum(F.unix_date("occurs")).alias("days")).collect()}
    got = {r.id: (r.n, r.last, r.days) for r in calendar.occurrence_totals(rows, a, b).where("start IS NOT NULL").collect()}
    assert {k: v for k, v in got.items() if v[0]} == sums and all(v == (0, None, 0) for k, v in got.items() if k not in sums)


def test_totals_of_all(spark):
    rows = spark.createDataFrame(made(2), SCHEMA)
    sums = {r.id: (r.n, r.last) for r in calendar.occurrences(rows).groupBy("id").agg(F.count("*").alias("n"), F.max("occurs").alias("last")).collect()}
    assert {r.id: (r.n, r.last) for r in calendar.occurrence_totals(rows).where("n > 0").collect()} == {k: v for k, v in sums.items() if v[1]}


def test_no_row_is_made_for_other_dates(spark):
    steps = plan(calendar.occurrences_between(spark.createDataFrame(made(1), SCHEMA), F.lit(D(2001, 2, 1)), F.lit(D(2001, 2, 28)))).split("Generate")
    assert "Filter" not in steps[1].split("(1)")[0]  # nothing is left out behind the explode


@pytest.mark.parametrize("spec,want", [
    ("fill-1920x1080 format-webp", ("fill", 1920, 1080, "webp")), ("width-400", ("width", 400, None, None)), ("height-300|format-png", ("height", None, 300, "png")),
    ("scale-50", ("scale", 50, 50, None)), ("original", ("original", None, None, None)), ("max-10x20", ("max", 10, 20, None)), ("", (None, None, None, None)), ("format-avif width-7", ("width", 7, None, "avif")),
])
def test_rendition(spark, spec, want):
    assert tuple(spark.createDataFrame([(spec,)], "x string").select(text.rendition(F.col("x")).alias("y")).first().y) == want


def test_seeds_keep_other_columns(spark):
    old = spark.createDataFrame([(1, "webpage", True, "d", "t", "0001", 2), (2, "form", True, "d", "t", "0002", 2)], "id int, content_type string, needs_reseed boolean, description string, title string, path string, depth int")
    seed = spark.createDataFrame([(1, "new", "T"), (2, "new", "T"), (3, "new", "T")], "id int, description string, title string")
    rows, _ = changes.seeded(old, seed, "id", ["title"])
    assert {tuple(r[c] for c in ("id", "title", "path", "depth")) for r in rows.collect()} == {(1, "T", "0001", 2), (2, "t", "0002", 2), (3, "T", None, None)}
