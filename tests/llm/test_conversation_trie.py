"""The trie against one built turn by turn in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest

from quillgraph.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    """rows: (conv_id, turn, role, text). Sorted rows of COLUMNS."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c >= 0 else -1)
        path = tuple(own.get(c - rest, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in list(members.items()))


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_op13(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = ct.op13_conversation_trie(spark, sf)
    assert result(df) == brute(rows) and all(kind == "bigint" for c, kind in df.dtypes if c != "ends_sha256")


def made(seed, n, depth):
    """Conversations that share beginnings of many lengths."""
    rng = random.Random(seed)
    shared = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "long " * 9])) for _ in range(depth)]
    out = []
    for c in rng.sample(range(-20, 5 * n), n):
        turns = shared[:rng.randint(0, depth)] + [(rng.choice("ua"), rng.choice("xyz")) for _ in range(rng.randint(0, 4))]
        out += [(c, None if k == 0 and rng.random() < 0.3 else k, role, text) for k, (role, text) in enumerate(turns)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed,n,depth,band", [(1, 60, 20, 2), (2, 60, 40, 3), (3, 40, 70, 16), (4, 200, 4, 16), (5, 30, 9, 2)])
def test_bands(spark, seed, n, depth, band):
    """Depths below, at and above powers of the band."""
    rows = made(seed, n, depth)
    assert result(ct.conversation_trie(spark.createDataFrame(rows, SCHEMA), band)) == brute(rows)


def test_nulls_repeats_ties_and_empty(spark):
    rows = [
        (None, 0, "user", "x"), (0, 0, "user", "a"), (0, 0, "user", "a"), (0, 0, "assistant", "a"), (0, None, None, None), (1, 5, "", ""), (2, 1, "user", "b" * 70000),
        (7, 1, "user", "a"), (8, 1, "user", "a"), (9, 2, "u", "sera"), (9, 1, "us", "era"), *[(c, 0, "user", "same") for c in range(100, 160, 5)],
    ]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", Turn int, `KEY` string")
    got = result(ct.conversation_trie(df))
    assert got == brute(rows)
    assert any(r[1] == 0 and r[7] != hashlib.sha256().hexdigest() for r in got)  # a conversation without turns ends in the root
    assert ct.conversation_trie(df.where("false")).count() == 0


def test_keys_above_stay_within_their_bands():
    for band in (2, 3, 4):
        path, keys = ct.Path(band), [ct.ROOT]
        for d in range(1, 70):
            ups = path.down(b"r", str(d).encode())
            keys.append(path.key)
            for level, up in enumerate(ups):
                size = band**level
                first = (d - size) // (size * band) * size * band
                assert d % size == 0 and up == keys[first:d:size] and len(up) <= band
            assert d % band ** len(ups)


@pytest.mark.parametrize("size", [0, 5, 1 << 16])
def test_ids_in_pieces(monkeypatch, size):
    monkeypatch.setattr(ct, "PACKED", size)
    ids = {b"a": list(range(0, 300, 7)), b"b": [5], b"c": list(range(-3, 90))}
    rows = [(k, c) for k, v in ids.items() for c in v]
    batches = lambda n, rows, names: (pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[k:k + n])], names) for k in range(0, len(rows), n))
    packed = [tuple(r.values()) for b in ct._packed(batches(10, rows, ["key", "conv_id"])) for r in b.to_pylist()]
    assert packed == sorted(packed)
    got = {r["key"]: r["ends_sha256"] for b in ct._digested(batches(3, packed, ["key", "first", "ids"])) for r in b.to_pylist()}
    assert got == {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in ids.items()}
