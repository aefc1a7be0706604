"""Targets by rounds of resharing in plain Python, copies by rate and draw, and the mix itself."""

import hashlib
import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import source_mix as sm

from .helpers import HARD, WORD, docs
from ..test_plans import plan

SCHEMA = "doc_id long, text string, source string"


def shares(sizes, weights=sm.WEIGHTS, most=sm.MOST):
    """Targets per source, by rounds."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    stopped = set()
    while True:
        rest, open_ = sum(sizes.values()) - sum(most * sizes[s] for s in stopped), sum(weight[s] for s in names if s not in stopped)
        out = {s: Fraction(most * sizes[s]) if s in stopped else Fraction(weight[s] * rest, open_) for s in names}
        fresh = {s for s in names if out[s] > most * sizes[s]}
        if not fresh:
            return out
        stopped |= fresh


def brute(rows, weights=sm.WEIGHTS, most=sm.MOST):
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    total = Counter()
    for n, (_, _, s) in zip(size, rows):
        total[s] += n
    goal = shares(dict(total), weights, most)
    out = []
    for n, (key, text, s) in zip(size, rows):
        rate = float(goal[s]) / total[s] if total[s] else 0.0
        seed = str(key) if key is not None else "text " + hashlib.md5((text or "").encode()).hexdigest()
        draw = int(hashlib.md5(f"{sm.SEED} {seed}".encode()).hexdigest()[:13], 16) / 2**52
        out.append((key, s, n, total[s], float(goal[s]), int(rate) + (draw < rate - int(rate))))
    return sorted(out, key=str)


def result(df):
    return sorted([(r.doc_id, r.source, r.size, r.source_size, r.target, r.copies) for r in df.collect()], key=str)


def test_op11(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sm.op11_source_mix(spark, sf).collect()
    assert sorted([(r.doc_id, r.source, r.size, r.source_size, r.target, r.taken) for r in got], key=str) == sorted([(*r[:5], r[2] * r[5]) for r in brute(rows)], key=str)


@pytest.mark.parametrize("seed", range(4))
def test_stops_in_any_order(spark, seed):
    """Sources of very different sizes: many reach their stop, and what they leave makes others reach theirs."""
    rng = random.Random(seed)
    sources = [None, "", "a", "B", "é", "z", "日", *[f"s{k}" for k in range(rng.randint(0, 9))]]
    rows = []
    for k in range(150):
        s = rng.choice(sources) if rng.random() < 0.5 else "B"
        rows.append((k, " ".join(["w"] * int(rng.choice([0, 1, 3, 30]) * (20 if s == "B" else rng.random() * 3))), s))
    assert result(sm.planned(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert result(sm.planned(spark.createDataFrame(rows, SCHEMA), (1, 7), 2)) == brute(rows, (1, 7), 2)


def test_targets_are_met(spark):
    """Taken words come near the targets, no document is taken more than three times, and reruns agree."""
    rng = random.Random(8)
    rows = [(k, "w " * rng.randint(1, 60), rng.choice(["a"] * 30 + ["b", "b", "c", "d"])) for k in range(8000)]
    df = spark.createDataFrame(rows, SCHEMA)
    plans = sm.planned(df)
    sums = plans.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most"), F.first("source_size").alias("size")).collect()
    for r in sums:
        assert r.most <= 3 and abs(r.taken - r.target) < 0.1 * r.target
    assert {r.source for r in sums if r.target == 3 * r["size"]} and all(r.taken == r.target for r in sums if r.target == 3 * r["size"])
    assert result(plans) == result(sm.planned(df.repartition(7)))


def test_the_mix_holds_each_copy(spark):
    df = docs(spark, HARD * 3, extra=True)
    want = Counter()
    for r in sm.planned(df).collect():
        want[r.doc_id] += r.copies
    got = sm.mixed(df)
    assert got.columns == [*df.columns, "copy"]
    rows = [tuple(r) for r in got.collect()]
    assert Counter(r[0] for r in rows) == +want and len({(r[0], r[-1]) for r in rows}) == len(rows)
    assert {r[0]: r[1] for r in rows}.items() <= dict(enumerate(HARD * 3)).items()


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b", "x"), (None, "c", None), (1, None, "x"), (1, None, "x"), (2, " \n", ""), (2, "a " * 50, None), (2, "a " * 50, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(sm.planned(df)) == brute(rows)
    none = spark.createDataFrame([(1, "", "x"), (2, None, "y")], SCHEMA)
    assert result(sm.planned(none)) == [(1, "x", 0, 0, 0.0, 0), (2, "y", 0, 0, 0.0, 0)]
    assert sm.mixed(none).count() == sm.planned(df.where("false")).count() == sm.mixed(df.where("false")).count() == 0


def test_plan_is_native(spark, sf):
    text = plan(sm.op11_source_mix(spark, sf))
    assert "Broadcast" in text and not any(x in text for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # sources that are too many to broadcast
    try:
        assert result(sm.planned(documents)) == brute([(r.doc_id, r.text, r.source) for r in documents.collect()])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
