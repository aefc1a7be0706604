import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import components, jaccard_join as jj

from .helpers import HARD, WORD, docs


def shingle_set(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """rows: (doc_id, text) with distinct ids."""
    sets = {k: shingle_set(t) for k, t in rows}
    root = {k: k for k, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(k for k in sets if sets[k])
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k, _ in rows}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_op3(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows)
    assert result(jj.op3_jaccard_join(spark, sf)) == want
    assert any(c != k for k, (_, c) in want.items())


def near_copies(seed, n=60, edits=3):
    rng = random.Random(seed)
    base = [rng.choice("abcdefghij") + str(rng.randint(0, 40)) for _ in range(60)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(w))
            w[k:k + 1] = [[], ["NEW"], [w[k], "x"]][rng.randint(0, 2)]
        out.append(" ".join(w))
    line = " ".join(f"line{k}" for k in range(30))
    out += [line + " " + " ".join(f"t{rng.randint(0, 9)}" for _ in range(rng.randint(0, 12))) for _ in range(40)]
    out += [" ".join(rng.choice("pq") for _ in range(rng.randint(0, 14))) for _ in range(40)]
    return out + [t.upper() for t in out[:5]]


@pytest.mark.parametrize("seed,pivots,often", [(1, 8, 1 << 18), (2, 2, 1 << 18), (3, 1, 10), (4, 2, 0)])
def test_near_copies(spark, monkeypatch, seed, pivots, often):
    monkeypatch.setattr(jj, "PIVOTS", pivots)
    monkeypatch.setattr(jj, "FREQUENT", often)
    monkeypatch.setattr(jj, "FEW", 3)
    monkeypatch.setattr(jj, "MANY", 20)
    texts = near_copies(seed) + HARD
    assert result(jj.near_duplicates(docs(spark, texts, extra=True))) == brute(list(enumerate(texts)))


def test_pairs_in_small_batches(monkeypatch):
    monkeypatch.setattr(jj, "PIVOTS", 3)
    rng = random.Random(5)
    rows = sorted((rng.randint(0, 9), rng.randint(1, 12) << 24 | rng.randint(8, 12)) for _ in range(250))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["token", "grp"])
    pairs, lists = set(), set()
    for token in {r[0] for r in rows}:
        g = sorted({r[1] for r in rows if r[0] == token})
        pairs |= {(g[i], g[j]) for i in range(min(3, len(g))) for j in range(i + 1, len(g)) if 100 * min(g[i] & 255, g[j] & 255) >= 75 * max(g[i] & 255, g[j] & 255)}
        if len(g) > 4:
            lists |= {(token, x) for x in g}
    for size in (1, 2, 5, 250):
        got = [r for b in jj._pairs(batch.slice(k, size) for k in range(0, len(rows), size)) for r in b.to_pylist()]
        assert {(r["a"], r["b"]) for r in got if not r["listed"]} == pairs
        listed = [(r["a"], r["b"]) for r in got if r["listed"]]
        assert set(listed) == lists and len(listed) == len(lists)


def test_nulls_repeats_and_empty(spark):
    a, b, c = "a b c d e f g h", "one two three four five six", "x y z"
    df = spark.createDataFrame([(5, a), (5, b), (7, a), (8, b), (None, a), (9, c), (3, c.upper()), (4, "x y")], "doc_id long, text string")
    got = sorted(map(tuple, jj.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 4, 5), (5, 2, 5), (7, 4, 5), (8, 2, 5), (None, 4, None), (9, 1, 3), (3, 1, 3), (4, 1, 4)], key=str)
    assert jj.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("size", [1_000_000, 40])
def test_components(spark, monkeypatch, size):
    monkeypatch.setattr(components, "LINKS", size)
    rng = random.Random(6)
    links = [(k, k + 1) for k in range(0, 60)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(150)] + [(1000, k) for k in range(1001, 1200)]
    root = {v: v for e in links for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    got = {r.id: r.root for r in components.components(spark.createDataFrame(links, "u long, v long").repartition(7)).collect()}
    assert {v: got.get(v, v) for v in root} == {v: find(v) for v in root}


def test_thousands_of_equal_rows(spark):
    """Rows that repeat two similar documents don't multiply."""
    words = [f"w{k}" for k in range(60)]
    df = docs(spark, [" ".join(words), " ".join(words[:58] + ["x", "y"])]).crossJoin(spark.range(2000).select("id"))
    got = jj.near_duplicates(df).groupBy("doc_id", "n_shingles", "component_id").agg(F.count("*")).collect()
    assert sorted(map(tuple, got)) == [(0, 56, 0, 2000), (1, 56, 0, 2000)]


def test_cells_hold_every_pair_once(spark, monkeypatch):
    """A long list's pivots and members meet once, in cells of bounded size."""
    import numpy as np

    monkeypatch.setattr(jj, "BLOCK", 32)
    monkeypatch.setattr(jj, "CHUNK", 16)
    n = 400
    rows = spark.createDataFrame([(7, n, k, k, 50, bytes(jj.BITMAP // 8)) for k in range(n)], "list long, n long, id long, root long, size long, bitmap binary")
    seen, cells = [], []
    for start, stop in ((0, 64), (64, 64 + jj.MANY)):
        dealt = jj.dealt(rows, start, stop)
        cells += [r.n for r in dealt.groupBy("list", "block", "chunk").agg(F.count("*").alias("n")).collect()]
        seen += [(r.u, r.v) for r in dealt.mapInArrow(jj._pivot_pairs, "u long, v long").collect()]
    assert sorted(seen) == [(a, b) for a in range(n) for b in range(a + 1, n)]
    assert max(cells) < 200 and np.mean(cells) > 10
