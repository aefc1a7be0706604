import hashlib
import random

import pyarrow as pa
import pytest

from quillgraph.llm import substring_dedup as sd

from .helpers import HARD, WORD, by, docs


def brute(rows, width):
    """rows: (doc_id, text). Kept words per row."""
    first = {}
    for key, text in rows:
        w = WORD.findall(text or "")
        for k in range(len(w) - width + 1):
            s = tuple(w[k:k + width])
            if key is not None:
                first[s] = min(first.get(s, key), key)
    out = []
    for key, text in rows:
        w = WORD.findall(text or "")
        gone = set()
        for k in range(len(w) - width + 1):
            if key is not None and first[tuple(w[k:k + width])] < key:
                gone |= set(range(k, k + width))
        out.append((key, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_op6(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows, 50)
    assert rows_of(sd.op6_substring_dedup(spark, sf)) == want
    assert any(r[2] for r in want)


def test_op6_sf001(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(sd.op6_substring_dedup(spark, sf)) == brute(rows, 50)


def made(seed, n=120):
    """Documents of few words with shared passages, runs and periods."""
    rng = random.Random(seed)
    pool = [[rng.choice("abcdefgh") for _ in range(rng.randint(5, 150))] for _ in range(6)]
    pool += [["x"] * 90, ["x", "y"] * 60, list("pqr") * 40, ["x"] * 130]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            a = rng.randint(0, len(p))
            words += p[a:a + rng.randint(0, 140)] if rng.random() < 0.8 else [rng.choice("abxy") for _ in range(rng.randint(0, 30))]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("width,seed", [(50, 1), (50, 2), (12, 3), (7, 4), (20, 5)])
def test_shared_runs_and_periods(spark, width, seed):
    texts = made(seed) + HARD
    rows = list(enumerate(texts))
    assert rows_of(sd.substring_dedup_digests(docs(spark, texts, extra=True), width)) == brute(rows, width)


def test_small_batches(monkeypatch):
    rng = random.Random(7)
    rows = sorted((rng.randint(0, 12), rng.randint(0, 3), rng.randint(0, 6), 0, k, 1) for k in range(400))
    names = ["anchor", "content", "doc_id", "tag", "at", "n"]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)

    def run(size):
        got = sd._compared(batch.slice(k, size) for k in range(0, len(rows), size))
        return sorted(tuple(r.values()) for b in got for r in b.to_pylist())

    want = []
    for a in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == a]
        tell = len({r[1] for r in mine}) > 1 and len({r[2] for r in mine}) > 1
        for r in mine:
            source = min(x[2] for x in mine if x[1] == r[1])
            if r[2] > source or tell:
                want.append((*r[2:], r[2] > source))
    for size in (1, 2, 3, 7, 50, 400):
        assert run(size) == sorted(want)


def test_repeated_ids_and_nulls(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, long), (1, long), (2, long + " tail"), (None, long), (2, "other " + long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(sd.substring_dedup_digests(df)) == brute(rows, 50)
    assert sd.substring_dedup_digests(df.where("false")).count() == 0


def test_cut_keeps_white_space(spark):
    shared = " ".join(f"w{k}" for k in range(50))
    got = by(sd.substring_dedup(docs(spark, [shared, f" a\n\tb {shared}\n c  d\n", None])))
    assert got[0]["text"] == shared and got[1]["text"] == " a\n\tb c  d\n" and got[2]["text"] is None


def test_thousands_of_equal_rows(spark):
    """Repeats of a row cost in proportion to their number, in both forms of the operator."""
    from pyspark.sql import functions as F

    words = [f"w{k}" for k in range(61)]
    base = docs(spark, [" ".join(words), "z " * 9 + " ".join(words)]).where("doc_id = 1").crossJoin(spark.range(5000).select(F.col("id").alias("Tag")))
    df = base.unionByName(docs(spark, [" ".join(words)]).selectExpr("*", "0L AS Tag"))
    got = sd.substring_dedup_digests(df).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, got)) == [(0, 61, 0, 1), (1, 70, 61, 5000)]
    cut = sd.substring_dedup(df, length="n_chars").groupBy("doc_id", "text", "n_chars").agg(F.countDistinct("Tag")).collect()
    assert sorted(map(tuple, cut))[1] == (1, "z " * 9, 18, 5000)
