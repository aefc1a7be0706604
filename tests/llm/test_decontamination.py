import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import decontamination as dc

from .helpers import HARD, docs


def slow_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


@settings(max_examples=400, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=30), st.integers(0, 12))
def test_distance(pattern, text, most):
    assert dc.substring_distance(pattern, text, most) == min(slow_distance(pattern, text), most + 1)


def brute(rows, items):
    out = {}
    for d, text in rows:
        text = dc.plain(text)
        for i, item in items:
            item = dc.plain(item)
            most = len(item) * dc.PERCENT // 100
            if item and (found := dc.substring_distance(item, text, most)) <= most:
                out[d, i] = min(found, out.get((d, i), found))
    return out


def result(df):
    return {(r.doc_id, r.item_id): r.distance for r in df.collect()}


def test_op2_against_all_substrings(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text) < 8000]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = result(dc.op2_decontamination(spark, sf))
    short = {d for d, _ in rows}
    assert {k: v for k, v in got.items() if k[0] in short} == brute(rows, items)


def noisy(rng, text, edits):
    for _ in range(edits):
        k = rng.randrange(len(text))
        text = text[:k] + rng.choice(["", "x", text[k] + "y"]) + text[k + 1:]
    return text


def test_recall_and_precision_with_edits(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(400)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(8, 60)))) for k in range(60)]
    texts, want = [], set()
    for k in range(300):
        body = rng.choices(words, k=rng.randint(0, 200))
        if k % 2:
            i, item = rng.choice(items)
            copy = noisy(rng, item, rng.randint(0, len(item) * 6 // 100))
            body.insert(rng.randint(0, len(body)), copy.upper() if k % 3 else copy)
            want.add((k, i))
        texts.append("\n".join(body) if k % 5 == 0 else " ".join(body))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = result(dc.leaks(docs(spark, texts, extra=True), bench))
    exact = brute(list(enumerate(texts)), items)
    assert set(got) <= set(exact) and all(got[k] >= exact[k] for k in got)
    assert want <= set(exact)
    assert len(set(got) & want) >= 0.95 * len(want)


def test_exact_copies_are_always_found(spark, monkeypatch):
    rng = random.Random(9)
    items = [(k, " ".join("".join(rng.choices("abc", k=3)) for _ in range(n))) for k, n in enumerate([1, 2, 3, 4, 5, 7, 9, 11, 20, 40, 80, 150])]
    texts = [t for _, t in items] + [f"before {t}" for _, t in items] + [f"{t} after" for _, t in items]
    monkeypatch.setattr(dc, "BLOCK", 5)
    got = result(dc.leaks(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")))
    assert all(got[k + j * len(items), k] == 0 for k, _ in items for j in range(3))


def test_nulls_blanks_and_empty(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "a b c d e f g h i j"), (4, "other words altogether here")], "item_id long, text string")
    df = docs(spark, HARD + ["x A b\nc d e f g h i j"])
    assert result(dc.leaks(df, bench)) == {(len(HARD), 4): 0}
    assert dc.leaks(df.where("false"), bench).count() == 0
    assert dc.leaks(df, bench.where("false")).count() == 0


def other_words(rng, text, places):
    """Words at these places (shares of the text) replaced by others of their length, more or less."""
    parts = text.split(" ")
    for at in places:
        k = min(int(at * len(parts)), len(parts) - 1)
        parts[k] = "".join(rng.choices("ijklmnop", k=max(1, len(parts[k]) + rng.randint(-1, 1))))
    return " ".join(parts)


def edited(rng, text, percent):
    """Random insertions, deletions and replacements of characters."""
    for _ in range(len(text) * percent // 100):
        k = rng.randrange(len(text))
        text = text[:k] + rng.choice(["", rng.choice("abcdefghé "), text[k] + rng.choice("abcdefghé ")]) + text[k + 1:]
    return text


EDITS = {
    "5 percent": lambda rng, t: edited(rng, t, 5),
    "10 percent": lambda rng, t: edited(rng, t, 10),
    "15 percent": lambda rng, t: edited(rng, t, 15),
    "words": lambda rng, t: other_words(rng, t, [rng.random() for _ in range(t.count(" ") // 10)]),
    "both ends": lambda rng, t: other_words(rng, t, [k / (t.count(" ") + 1) for k in range(t.count(" ") // 17)] + [1 - k / (t.count(" ") + 1) for k in range(t.count(" ") // 17)]),
    "beginning": lambda rng, t: "z" * (len(t) * 15 // 100) + t[len(t) * 15 // 100:],
    "end": lambda rng, t: t[:len(t) - len(t) * 15 // 100] + "z" * (len(t) * 15 // 100),
    "middle": lambda rng, t: t[:len(t) // 2] + "q" * (len(t) * 15 // 100) + t[len(t) // 2:],
}


@pytest.mark.parametrize("sizes", [(3, 4, 5, 6, 7, 8, 9, 10), (12, 14, 20, 40, 64), (70, 100, 150, 400, 900)])
def test_recall_up_to_the_limit(spark, sizes):
    """Of all copies that the exact distance accepts, every kind of edits and length; documents of up to 60,000 characters."""
    rng = random.Random(10)
    words = ["".join(rng.choices("abcdefghéß", k=rng.randint(1, 9))) for _ in range(300)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice(sizes)))) for k in range(40)]
    texts, kinds = [], []
    for _, item in items:
        for kind, edit in EDITS.items():
            body = rng.choices(words, k=10_000 if not len(texts) % 97 else rng.randint(0, 60))
            body.insert(rng.randint(0, len(body)), edit(rng, item))
            texts.append(rng.choice([" ", "\n", " \t "]).join(body))
            kinds.append(kind)
    found = dc.leaks(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    got = result(found)
    want = {(k, k // len(EDITS)) for k in range(len(texts)) if dc.substring_distance(dc.plain(items[k // len(EDITS)][1]), dc.plain(texts[k]), 10_000) <= len(dc.plain(items[k // len(EDITS)][1])) * dc.PERCENT // 100}
    assert len(want) >= 0.8 * len(texts)
    for kind in EDITS:
        all_of = {p for p in want if kinds[p[0]] == kind}
        assert len(all_of & set(got)) >= 0.9 * len(all_of), kind
    assert len(want & set(got)) >= dc.RECALL * len(want)
    for (d, i), distance in got.items():
        assert distance <= len(dc.plain(items[i][1])) * dc.PERCENT // 100
    for r in found.collect():  # the item begins at the word that is named
        rest = " ".join(dc.plain(texts[r.doc_id]).split(" ")[r.at_word:])
        item = dc.plain(items[r.item_id][1])
        assert dc.substring_distance(item, rest[:2 * len(item) + 20], r.distance) == r.distance


def test_texts_without_spaces_and_repeated_items(spark, monkeypatch):
    """Items glued into longer words are found; repeats of an item are one item."""
    monkeypatch.setattr(dc, "PART", 1 << 9)
    rng = random.Random(11)
    signs = "日本語文章検査試験漢字平仮名片仮名読書"
    items = [(k, "".join(rng.choices(signs, k=90))) for k in range(12)]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 3000))) + edited(rng, t, 8) + "".join(rng.choices(signs, k=200)) for _, t in items]
    got = result(dc.leaks(docs(spark, texts), spark.createDataFrame(items * 50, "item_id long, text string")))
    assert {(k, k) for k in range(12)} == set(got)
    blocks = list(dc._blocks(spark.createDataFrame(items * 50, "item_id long, text string")))
    assert [len(b) for b in blocks] == [12]


def evenly(text, every, how):
    """An edit at each so many characters."""
    change = {"replaced": lambda c: "z" if c != "z" else "q", "inserted": lambda c: c + "z", "deleted": lambda c: ""}[how]
    return "".join(change(c) if k % every == every - 1 else c for k, c in enumerate(text))


@pytest.mark.parametrize("every, least", [(10, 0.95), (8, 0.9), (7, 0.7)])
def test_recall_of_even_edits(every, least):
    """Edits that lie evenly leave the fewest samples whole; every seventh character is the most that the limit allows."""
    rng = random.Random(12)
    words = ["".join(rng.choices("etaoinshrdlucmfw", k=rng.randint(2, 9))) for _ in range(400)]
    items = dc.Items([(k, " ".join(rng.choices(words, k=rng.randint(12, 70)))) for k in range(100)])
    for how in ("replaced", "inserted", "deleted"):
        texts = [" ".join(rng.choices(words, k=20)) + " " + evenly(t, every, how) + " and after" for t in items.texts]
        held = [k for k, t in enumerate(texts) if dc.substring_distance(items.texts[k], t, items.limit[k]) <= items.limit[k]]
        assert len(held) >= 90
        got = dc._found(items, dc.Texts(pa.array(texts)).split())
        assert sum((k, k) in got for k in held) >= least * len(held), how


def test_blocks_of_items_find_what_one_block_finds(spark, monkeypatch):
    rng = random.Random(13)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    items = [(k, " ".join(rng.choices(words, k=12))) for k in range(9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(spark, [f"before {t} after" for _, t in items] + HARD, extra=True)
    whole, left = result(dc.leaks(df, bench)), sorted(r[0] for r in dc.decontaminated(df, bench).collect())
    monkeypatch.setattr(dc, "BLOCK", 2)
    assert len(list(dc._blocks(bench))) == 5
    assert result(dc.leaks(df, bench)) == whole == {(k, k): 0 for k in range(9)}
    assert sorted(r[0] for r in dc.decontaminated(df, bench).collect()) == left == list(range(9, 9 + len(HARD)))


def test_regions_and_pieces_as_one_by_one():
    """Overlapping regions of a text and item become one; pieces found by place are those that str.find finds."""
    rng = random.Random(14)
    regions = [(rng.randint(0, 2), rng.randint(0, 2), lo := rng.randint(-20, 60), lo + rng.randint(0, 12)) for _ in range(60)]
    want = []
    for d, i, lo, hi in sorted(regions):
        if want and want[-1][:2] == (d, i) and lo <= want[-1][3]:
            want[-1] = (d, i, want[-1][2], max(hi, want[-1][3]))
        else:
            want.append((d, i, lo, hi))
    assert [tuple(r) for r in dc._merged(np.array(regions)).tolist()] == want
    items = dc.Items([(0, "abcabdabcdda")])
    text = "".join(rng.choices("abcd", k=400))
    value = dc.windows(dc.code_points(text).astype(np.uint64), dc.SHORT, dc._FACTOR)
    at = np.arange(len(value))
    exact, cells = items._by_place(at, value, len(text)), items._by_cell(at, value, len(text))
    for k in range(len("abcabdabcdda") - dc.SHORT + 1):
        piece = "abcabdabcdda"[k:k + dc.SHORT]
        for lo in range(0, 380, 7):
            for hi in (lo - 1, lo, lo + 9, len(text) - dc.SHORT):
                there = 0 <= text.find(piece, lo, max(hi + dc.SHORT, 0)) if hi >= lo else False
                ask = np.array([items.piece[k]]), np.array([lo]), np.array([hi])
                assert exact(*ask)[0] == there
                assert cells(*ask)[0] or not there


@pytest.mark.parametrize("together", [1, 3, 10_000])
def test_windows_that_left_their_text_are_let_go(monkeypatch, together):
    """The same samples agree however often windows are let go, and pointers beyond their text aren't moved on."""
    rng = random.Random(15)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(80)]
    items = dc.Items([(k, " ".join(rng.choices(words, k=rng.choice([4, 9, 30, 200])))) for k in range(30)])
    texts = [" ".join(rng.choices(words, k=20)) + " " + t[:300] for t in items.texts]
    points, off = dc.code_points(" ".join(texts)), np.cumsum([0] + [len(t) + 1 for t in texts])
    start = dc.starts_of(points, off[:-1]).astype(np.int32)
    end = np.minimum(off[np.searchsorted(off, start, "right")], len(points))
    moved, along = [], dc.Walks.along
    monkeypatch.setattr(dc.Walks, "along", lambda self, walk, at, blocks: moved.append(len(at)) or along(self, walk, at, blocks))
    monkeypatch.setattr(dc, "TOGETHER", together, raising=False)
    for samples in items.samples:
        moved.clear()
        got = {t for w, e, p in samples.agreeing(dc.Walks(points), start, end) for t in zip(w.tolist(), e.tolist(), p.tolist())}
        assert together > 1000 or min(moved) < len(start) / 2 or max(map(len, samples.steps.values())) < 9
        want, walks = set(), dc.Walks(points)
        value = walks.grams(samples.gram)
        table = {}
        for key, lo, hi in zip(samples.keys.tolist(), samples.first[:-1].tolist(), samples.first[1:].tolist()):
            step, number = divmod(key, len(samples.values))
            table[step, int(samples.values[number])] = range(lo, hi)
        for walk, blocks in samples.steps.items():
            for block, at in zip(blocks, along(walks, walk, start, blocks)):
                for w, p in enumerate(at.tolist()):
                    if p + samples.gram <= end[w]:
                        want |= {(w, e, p) for e in table.get((walk * samples.width + block, int(value[p])), ())}
        assert got == want and want


def test_samples_by_table_and_search(monkeypatch):
    """A table of samples gives the keys that a search gives, values of equal leading bits are told apart, and the sample where walks begin is there once."""
    rng = random.Random(16)
    items = [(k, " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(rng.choice([4, 9, 60])))) for k in range(40)]
    tables = dc.Items(items).samples
    monkeypatch.setattr(dc, "TABLE", 0)
    walks = dc.Walks(dc.code_points(" ".join(t for _, t in items)))
    for one, other in zip(tables, dc.Items(items).samples):
        assert one.table is not None and other.table is None
        assert all(0 not in blocks for walk, blocks in one.steps.items() if walk)
        known, grams = {v: k for k, v in enumerate(one.values.tolist())}, walks.grams(one.gram)
        assert one.number(walks)[:len(grams)].tolist() == [known.get(v, -1) for v in grams.tolist()]
        value = np.arange(len(one.values))
        for step in range(one.depth * one.width):
            assert one._keys(step, value).tolist() == other._keys(step, value).tolist() if (one.keys // len(value) == step).any() else True
