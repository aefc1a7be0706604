"""BM25 over a stored index against all documents scored in plain Python."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import ranked

from .test_plans import plan

WORDS = ["rare", "hall", "stone", "the", "of", "é", "日本", "x1"]


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        pool = rng.choices(WORDS, [1, 3, 9, 200, 100, 5, 2, 7], k=rng.randint(0, 60))
        if 40 <= k < 44:
            pool += ["rare"] * (9 + k % 3)  # one block stands out
        rows.append((k - 20, " ".join(w.upper() if rng.random() < 0.3 else w for w in pool) + rng.choice(["", ".", " - "])))
    return rows + [(5000, None), (5001, ""), (5002, "--"), (None, "rare rare")]


def brute(rows, terms, k):
    docs = {key: [t for t in re.split(r"[^\w]+|_", (text or "").lower()) if t] for key, text in rows if key is not None}
    n, mean = len(docs), max(1.0, sum(map(len, docs.values())) / max(1, len(docs)))
    terms = {t.lower() for t in terms}
    df = {t: sum(t in d for d in docs.values()) for t in terms}
    out = []
    for key, d in docs.items():
        tf = {t: c for t, c in Counter(d).items() if t in terms}
        if tf:
            out.append((key, len(tf), sum(round(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(d) / mean)), 9) for t, c in tf.items())))
    out.sort(key=lambda r: (-round(r[2], 7), r[0]))
    return out[:k]


@pytest.fixture(scope="module")
def corpus():
    return made(1, 300)


@pytest.fixture(params=[2, 4, 10])
def index(request, spark, corpus, tmp_path, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_BITS", request.param)
    folder = str(tmp_path / "index")
    ranked.write_index(spark.createDataFrame(corpus, "id int, text string"), "id", "text", folder)
    return folder


@pytest.mark.parametrize("terms,k,lead", [(["rare"], 5, 1), (["Rare", "the", "STONE"], 10, 1), (["the", "of"], 40, 3), (["日本", "é", "nowhere"], 3, 4), (["nowhere"], 3, 1), (["hall", "x1"], 1000, 2)])
def test_best_documents(spark, corpus, index, monkeypatch, terms, k, lead):
    monkeypatch.setattr(ranked, "LEAD", lead)
    got = [tuple(r) for r in ranked.search_index(spark, index, terms, k).collect()]
    want = brute(corpus, terms, k)
    assert [r[0] for r in got] == list(range(1, len(got) + 1)) and len(got) == len(want)
    assert [r[3] for r in got] == pytest.approx([r[2] for r in want], abs=1e-7)
    assert Counter(r[2] for r in got) == Counter(r[1] for r in want) and [r[1] for r in got] == [r[0] for r in want]


def test_blocks_are_skipped_and_bounds_hold(spark, tmp_path, monkeypatch, corpus):
    monkeypatch.setattr(ranked, "BLOCK_BITS", 2)
    folder = str(tmp_path / "index")
    ranked.write_index(spark.createDataFrame(corpus, "id int, text string"), "id", "text", folder)
    search = ranked._Search(spark, folder, ["rare", "stone"])
    bounds = {r.block: r.bound for r in search.bounds().collect()}
    for r in search.scores(search.bounds()).collect():
        assert r.score <= bounds[r.key >> 2]
    assert 0 < search.open_blocks(3).count() < len(bounds) / 3


def test_reads_its_partitions_only(spark, corpus, tmp_path):
    folder = str(tmp_path / "index")
    ranked.write_index(spark.createDataFrame(corpus, "id int, text string"), "id", "text", folder)
    rows = ranked.postings_of(spark, folder, ["Rare"])
    text = plan(rows.select("term", "n"))
    assert "PartitionFilters: [isnotnull(bucket" in text and "EqualTo(term,rare)" in text and "ReadSchema: struct<term:string,n:int>" in text
    assert {f.split("bucket=")[1].split("/")[0] for f in rows.inputFiles()} and rows.count() > 0
    text = plan(ranked.search_index(spark, folder, ["rare", "the"], 5))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_no_documents_and_no_terms(spark, tmp_path):
    folder = str(tmp_path / "index")
    ranked.write_index(spark.createDataFrame([], "id int, text string"), "id", "text", folder)
    assert ranked.search_index(spark, folder, ["a"], 5).count() == ranked.search_index(spark, folder, [], 5).count() == 0


def test_each_text_is_read_once_and_its_postings_move_in_blocks(spark, corpus, tmp_path):
    """Neither totals nor the dealing of blocks over files read texts again."""
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    documents = spark.createDataFrame(corpus, "id int, text string").withColumn("text", F.udf(seen, "string")("text"))
    ranked.write_index(documents, "id", "text", str(tmp_path / "index"))
    assert read.value == sum(key is not None for key, _ in corpus)
    totals = spark.read.parquet(str(tmp_path / "index" / "totals")).collect()
    kept = [re.split(r"[^\w]+|_", (text or "").lower()) for key, text in corpus if key is not None]
    assert [tuple(r) for r in totals] == [(len(kept), sum(t != "" for d in kept for t in d))]


@pytest.mark.parametrize("bits,most,sizes", [(2, 1 << 20, [7]), (4, 1, [1, 90]), (10, 60, [13]), (0, 5, [400])])
def test_postings_by_block(bits, most, sizes):
    """However documents come in batches, and where a block is too long for one go; documents of equal key and length count as one."""
    rng = random.Random(4)
    rows = sorted((rng.randrange(-30, 90), rng.choices(WORDS, k=rng.choice([0, 1, 5, 5, 30]))) for _ in range(120))
    batches, at = [], 0
    while at < len(rows):
        part = rows[at:(at := at + rng.choice(sizes))]
        batches += [pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int64()), pa.array([t for _, t in part], pa.list_(pa.string()))], ["key", "terms"])]
    want = Counter((t, key, len(terms)) for key, terms in rows for t in terms)
    got, places = Counter(), []
    for row in (r for b in ranked._by_block(iter([batches[0].slice(0, 0), *batches]), bits, most) for r in b.to_pylist()):
        places.append((row["term"], row["block"]))
        assert row["n"] == len(row["at"]) and row["max_tf"] == max(row["tf"]) and row["min_length"] == min(row["length"]) and row["total"] == sum(row["tf"])
        for at, tf, length in zip(row["at"], row["tf"], row["length"], strict=True):
            got[row["term"], (row["block"] << bits) + at, length] += tf
    assert got == want and (most < 100 or len(places) == len(set(places)))
