"""Editions side by side: anchors, the longest chain and what lies between, against plain Python."""

import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from quillgraph.operators import alignment

SCHEMA = "work string, part int, place int, text string"


def longest(places):
    """Length and canonical chain by comparing all with all."""
    size = []
    for k, b in enumerate(places):
        size.append(1 + max((size[j] for j in range(k) if places[j] < b), default=0))
    out, k = [], max((k for k in range(len(places)) if size[k] == max(size)), default=None)
    while k is not None:
        out.append(k)
        k = max((j for j in range(k) if size[j] == size[k] - 1), default=None) if size[k] > 1 else None
    return out[::-1]


@pytest.mark.parametrize("seed", range(30))
def test_chain(seed):
    rng = random.Random(seed)
    places = rng.sample(range(60), rng.randint(0, 40))
    got = alignment.chain(places)
    assert got == longest(places)
    assert got == sorted(got) and [places[k] for k in got] == sorted(places[k] for k in got)


def brute(left, right):
    """left, right: {key: [(place, text)]}. Rows of keys, line, places and how."""
    out = []
    for key in left.keys() | right.keys():
        a, b = sorted(left.get(key, [])), sorted(right.get(key, []))
        n, m = Counter(t for _, t in a), Counter(t for _, t in b)
        once = [(p, q) for p, t in a for q, u in b if t is not None and t == u and n[t] == m[u] == 1]
        kept = [once[k] for k in longest([q for _, q in once])]
        edges = [(None, None), *kept, (None, None)]
        line = 0
        for (p, q), (r, s) in zip(edges, edges[1:]):
            if p is not None:
                line += 1
                out.append((*key, line, p, q, "anchor"))
            x = [v for v, _ in a if (p is None or v > p) and (r is None or v < r)]
            y = [v for v, _ in b if (q is None or v > q) and (s is None or v < s)]
            for k in range(max(len(x), len(y))):
                line += 1
                u, v = (x[k] if k < len(x) else None), (y[k] if k < len(y) else None)
                out.append((*key, line, u, v, "left" if v is None else "right" if u is None else "filled"))
    return sorted(out)


def made(seed):
    rng = random.Random(seed)
    left, right = defaultdict(list), defaultdict(list)
    for k in range(6):
        key = (f"w{k % 4}", k // 4)
        texts = [rng.choice([f"t{j}", f"t{j}", "again", None]) for j in range(rng.randint(0, 30))]
        other = [t for t in texts if rng.random() < 0.8]
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(other))
            other[at:at] = [f"new{rng.randint(0, 9)}"] * rng.randint(1, 2)
        if k == 1:
            other.reverse()
        if k == 2:  # two halves change places
            other = other[len(other) // 2:] + other[:len(other) // 2]
        step = rng.randint(1, 3)
        left[key] = [(step * j, t) for j, t in enumerate(texts)]
        right[key] = [(5 + j, t) for j, t in enumerate(other)]
    right[("only right", 0)] = [(3, "x"), (1, "y")]
    left[("only left", 0)] = [(1, "x")]
    return left, right


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_aligned(spark, seed):
    left, right = made(seed)
    df = lambda d: spark.createDataFrame([(*key, p, t) for key, v in d.items() for p, t in v], SCHEMA).repartition(3)
    got = alignment.aligned(df(left), df(right), ["work", "part"], "place", "text")
    rows = sorted(tuple(r) for r in got.collect())
    assert sorted(rows, key=str) == sorted(brute({k: v for k, v in left.items() if v}, {k: v for k, v in right.items() if v}), key=str)
    assert {r[-1] for r in rows} == {"anchor", "filled", "left", "right"}
    assert alignment.aligned(df(left).where("false"), df(right).where("false"), ["work", "part"], "place", "text").count() == 0


def test_tangles_over_batches():
    """Tangles that begin and end anywhere in batches of any size."""
    rng = random.Random(4)
    rows, a, b = [], 0, 0
    for _ in range(40):
        tangle = rng.sample(range(6), rng.randint(1, 6))
        tangle = [b + sorted(tangle).index(x) for x in tangle]
        for k, x in enumerate(tangle):
            high, rest = max(tangle[:k + 1]), tangle[k + 1:]
            rows.append((a + k, x, not rest or high < min(rest)))
        a, b = a + len(tangle), b + len(tangle)
    want = longest([r[1] for r in rows])
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["a", "b", "cut"])
    for size in (1, 2, 7, len(rows)):
        got = [r["a"] for x in alignment._chained(batch.slice(k, size) for k in range(0, len(rows), size)) for r in x.to_pylist()]
        assert got == want
