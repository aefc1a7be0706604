"""Scans and submissions that are taken once, also when a batch is run again, and gaps in books."""

import os
import random

import pytest

from quillgraph.sources import registry


def put(folder, *names):
    for name in names:
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode())


def forget_last(folder):
    """As if the driver had died when the last batch was written and not yet noted."""
    commits = f"{folder}/taken/commits"
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.remove(f"{commits}/{name}")


def test_scans_are_registered_once(spark, tmp_path):
    files, folder = tmp_path / "media", str(tmp_path / "registry")
    put(files, "archive/b1/001.jpg", "archive/b1/004.jpg", "archive/b2/010.jpg", "archive/b2/cover.jpg", "other/001.jpg")
    registry.register_scans(spark, str(files), folder)
    known = lambda: sorted((r.book, r.page, r.length) for r in registry.registered(spark, folder).collect())
    first = known()
    assert first == [("b1", 1, 18), ("b1", 4, 18), ("b2", 10, 18)]
    put(files, "archive/b1/002.jpg", "archive/b3/1000.jpg")
    registry.register_scans(spark, str(files), folder, files=1)
    assert known() == sorted([*first, ("b1", 2, 18), ("b3", 1000, 19)])
    assert sorted((r.book, r.page) for r in spark.read.parquet(f"{folder}/rows").where("batch > 0").collect()) == [("b1", 2), ("b3", 1000)]
    forget_last(folder)
    registry.register_scans(spark, str(files), folder)
    assert known() == sorted([*first, ("b1", 2, 18), ("b3", 1000, 19)])
    gaps = registry.missing_pages(registry.registered(spark, folder), "book", "page")
    assert sorted(tuple(r) for r in gaps.collect()) == [("b1", 3, 3), ("b2", 1, 9), ("b3", 1, 999)]


@pytest.mark.parametrize("seed", [1, 2])
def test_gaps_and_runs(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), rng.choice([None, *range(-3, 40)])) for _ in range(60)]
    df = spark.createDataFrame(rows, "book string, page int")
    gaps, runs = [], []
    for book in sorted({b for b, _ in rows}):
        there = [p for b, p in rows if b == book and p is not None]
        pages = sorted(set(there))
        missing = [p for p in range(pages[0], pages[-1]) if p not in pages]
        for out, some in ((gaps, missing), (runs, pages)):
            for p in some:
                if out and out[-1][0] == book and out[-1][2] == p - 1:
                    out[-1][2] = p
                else:
                    out.append([book, p, p])
        for r in (r for r in runs if r[0] == book):
            r.append(sum(r[1] <= p <= r[2] for p in there))
    assert sorted(list(r) for r in registry.missing_pages(df, "book", "page", None).collect()) == gaps
    assert sorted(list(r) for r in registry.page_runs(df, "book", "page").collect()) == runs


def test_submissions(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "forms")
    source.mkdir()
    schema = "id int, body string, spam boolean"
    stream = spark.readStream.schema(schema).parquet(str(source))
    for k, rows in enumerate([[(1, "a", None), (2, "b", True)], [(1, "a", False), (3, "c", False)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        registry.take_submissions(stream, folder, "spam")
        if k:
            forget_last(folder)
            registry.take_submissions(stream, folder, "spam")
    assert sorted((r.id, r.body) for r in registry.submissions(spark, folder).collect()) == [(1, "a"), (1, "a"), (3, "c")]
