"""What op3 does beside its result: which shingles it takes as frequent, and which texts it compares."""

import random

import numpy as np
import pytest

from quillgraph.llm import jaccard_join as jj
from quillgraph.llm.textkernel import U64

from .helpers import docs
from .test_jaccard_join import brute, result


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def test_frequent_goes_by_documents(spark):
    """A line that one document repeats isn't frequent, one that many have is, and none of them is dropped for room."""
    rng = random.Random(1)
    line, passages = words(rng, 5), [words(rng, 5) for _ in range(50)]
    texts = [" ".join(line * 30)] + [" ".join(p + words(rng, 20)) for p in passages for _ in range(jj.FREQUENT_FROM)]
    key, n = jj.frequent(docs(spark, texts))
    assert len(key) == 50 and set(n.tolist()) == {jj.FREQUENT_FROM}


def test_texts_that_share_one_passage_are_not_compared(spark, monkeypatch):
    """Bitmaps leave few of the pairs that a passage makes, for short and long texts; the result is that of all pairs."""
    rng = random.Random(2)
    texts = []
    for k in range(20):
        passage = words(rng, 12)
        texts += [" ".join(words(rng, n) + passage + words(rng, n)) for n in ([40, 44] if k % 2 else [2500, 2600])]
    near = words(rng, 200)
    texts += [" ".join(near), " ".join(near[:190] + words(rng, 10))]
    read, stored = [], jj.stored
    monkeypatch.setattr(jj, "stored", lambda df, name: (out := stored(df, name), read.append(out.count()) if name == "needed" else None)[0])
    assert result(jj.near_duplicates(docs(spark, texts))) == brute(list(enumerate(texts)))
    assert sum(read) == 2


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_texts_chosen_by_broadcast_or_shuffle(spark, monkeypatch, sent):
    monkeypatch.setattr(jj, "SENT_IDS", sent)
    rng = random.Random(3)
    near = words(rng, 80)
    texts = [" ".join(words(rng, 30)) for _ in range(10)] + [" ".join(near[:k] + ["x"] + near[k + 1:]) for k in range(0, 80, 16)] + [""]
    assert result(jj.near_duplicates(docs(spark, texts))) == brute(list(enumerate(texts)))


def test_bitmaps_never_tell_less_than_is_shared():
    rng = np.random.default_rng(4)
    for n in (0, 1, 7, 900, 1024, 1025, 3000, 5000):
        for share in (0, 0.5, 0.9, 1):
            a = rng.integers(0, 1 << 63, n).astype(U64)
            b = np.concatenate((a[:int(n * share)], rng.integers(0, 1 << 63, n // 8).astype(U64)))
            sides = [np.unique(a), np.unique(b)]
            at = np.array([0, len(sides[0]), len(sides[0]) + len(sides[1])])
            one, two = jj.bitmaps(np.concatenate(sides), np.repeat([0, 1], np.diff(at)), at)
            width = min(len(one), len(two))
            assert width >= jj.BITMAP // 8 and 8 * len(one) >= len(sides[0])
            one, two = (np.frombuffer(jj.folded(m, w), np.uint8) for m in (one, two) for w in [width])
            total, apart = len(sides[0]) + len(sides[1]), int(np.bitwise_count(one ^ two).sum())
            common = len(np.intersect1d(*sides))
            assert (total - apart) // 2 >= common
            assert jj.shareable(np.array([total]), np.array([apart]))[0] or 100 * common < jj.PERCENT * (total - common)
