"""The audit against every order run over every document in plain Python, with files that come in any order."""

import os
import random
from collections import defaultdict
from itertools import permutations

import pytest

from quillgraph.llm import filter_audit as fa
from quillgraph.llm.shared import shared_folder

from .helpers import HARD, WORD

SCHEMA = "doc_id long, text string, source string, `Key` int, `mask` string"
LABELS = "doc_id long, quality int, toxic int"
COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    smallest = {}
    for key, text, _ in rows:
        if key is not None:
            smallest[text or ""] = min(smallest.get(text or "", key), key)
    good, toxic = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, t in labels if t == 1 and k is not None}
    parts = defaultdict(list)
    for key, text, source in rows:
        text = text or ""
        w = WORD.findall(text)
        failed = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": key is not None and smallest[text] < key,
        }
        parts[source or ""].append(({f for f, x in failed.items() if x}, key in good, key in toxic))
    out = []
    for part, docs in parts.items():
        steps, shapley = [], defaultdict(int)
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                there = [d for d in docs if not d[0] & set(order[:k])]
                here = [d for d in there if f in d[0]]
                shapley[f] += len(here)
                steps.append((part, "".join(order), k + 1, len(there) - len(here), len(here), sum(f in d[0] for d in docs) - len(here), sum(d[0] == {f} for d in docs), sum(d[1] for d in here), sum(d[2] for d in here), f))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return sorted(out)


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture
def put(spark, tmp_path):
    """Writes each list of rows as a file, later ones younger, and returns the folder."""
    folder, count = tmp_path / "documents.parquet", iter(range(1000))

    def write(*files):
        for rows in files:
            k = next(count)
            rows = [(*r, k, "x") for r in rows]
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"made-{k}"))
            folder.mkdir(exist_ok=True)
            (part,) = (tmp_path / f"made-{k}").glob("part-*.parquet")
            part.rename(folder / f"{k}.parquet")
            os.utime(folder / f"{k}.parquet", (1_700_000_000 + 60 * k,) * 2)
        return str(folder)

    return write


def audited(spark, path, labels, folder=None, size=1):
    folder = folder or shared_folder(spark, "audit-test")
    fa.audit_files(spark, path, spark.createDataFrame(labels, LABELS), folder, size)
    return fa.report(fa.counters(spark, folder)), folder


def made(seed, n=90):
    rng = random.Random(seed)
    word = lambda: rng.choice(["aa", "b", "Cc", "DDD", "é", "x#", "y", *[f"w{k}" for k in range(60)]])
    pool = [" ".join(word() for _ in range(rng.choice([0, 1, 49, 50, 51, 80, 200]))) for _ in range(14)] + [None, ""]
    rows = [(k, rng.choice(pool), rng.choice(["s", "s", "t", "", None])) for k in range(n)]
    rows += rng.sample(rows, 5) + [(rng.randrange(n), rng.choice(pool), "s") for _ in range(5)] + [(None, rng.choice(pool), "t") for _ in range(4)]
    rng.shuffle(rows)
    labels = [(rng.choice([*range(n), None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(n)]
    return rows, labels


def test_op12(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    df = fa.op12_filter_audit(spark, sf)
    assert result(df) == brute(rows, labels)
    assert dict(df.dtypes)["step"] == "int" and all(kind == "bigint" for c, kind in df.dtypes if c not in ("part", "filter_order", "step"))


@pytest.mark.parametrize("seed,order", [(1, "shuffled"), (2, "down"), (3, "up")])
def test_smaller_ids_come_later(spark, put, seed, order):
    """A micro-batch per file; earlier documents lose their place again and again."""
    rows, labels = made(seed)
    if order != "shuffled":
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0), reverse=order == "down")
    path = put(*[rows[k::6] if order == "shuffled" else rows[k * len(rows) // 6:(k + 1) * len(rows) // 6] for k in range(6)])
    df, folder = audited(spark, path, labels)
    assert result(df) == brute(rows, labels)
    written = fa._written(spark, f"{folder}/changes")
    assert written.select("batch").distinct().count() == 6
    assert (written.where("n < 0").count() > 0) == (order != "up")  # retractions


def test_new_files_and_a_batch_run_again(spark, put):
    rows, labels = made(4)
    path = put(rows[:40], rows[40:60])
    df, folder = audited(spark, path, labels)
    assert result(df) == brute(rows[:60], labels)
    put(rows[60:80], rows[80:])
    df, _ = audited(spark, path, labels, folder)
    assert result(df) == brute(rows, labels)
    assert sorted(os.listdir(f"{folder}/checkpoint/commits"))[-1] == "3"
    for name in ("3", ".3.crc"):  # as if the driver had died when the batch was written and not yet noted
        os.remove(f"{folder}/checkpoint/commits/{name}")
    df, _ = audited(spark, path, labels, folder)
    assert result(df) == brute(rows, labels)
    assert fa._written(spark, f"{folder}/changes").select("batch").distinct().count() == 4


def test_hard_texts_and_no_rows(spark, put, tmp_path):
    rows = [(k % 9, t, "s") for k, t in enumerate(HARD)]
    df, _ = audited(spark, put(rows[:8], rows[8:]), [])
    assert result(df) == brute(rows, [])
    none = str(tmp_path / "none.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(none)
    assert audited(spark, none, [])[0].count() == 0


def test_one_text_in_most_rows(spark, put):
    """What a batch with a very common text brings to its group is a row per part, label and task, not per document."""
    rows = [(k, "same text", "s") for k in range(3000)]
    path = put(rows[1500:], rows[:1500])
    df, folder = audited(spark, path, [(7, 1, 1)])
    assert result(df) == brute(rows, [(7, 1, 1)])
    assert fa._written(spark, f"{folder}/changes").count() < 12
