import hashlib
from itertools import combinations

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from quillgraph.llm import decontamination, quality_classifier
from quillgraph.llm.shared import stored

from .helpers import HARD, WORD, docs
from .test_decontamination import brute as leaks_of
from .test_jaccard_join import brute as components_of


def table(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def steps(spark, sf):
    """Input and the output of every stage, each written and read again."""
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in cp.STAGES:
        out.append(stored(stage(spark, out[-1], sf), "step"))
    return out


def test_stages_return_documents(steps):
    assert 4 <= len(cp.STAGES) <= 5
    for df in steps[:-1]:
        assert df.schema.simpleString() == steps[0].schema.simpleString()
    assert steps[-1].count() == steps[-2].count() > 0


def test_quality_stage(spark, sf, steps):
    model = quality_classifier.fit(steps[0], spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r.doc_id for r in quality_classifier.scored(steps[0], model).collect() if r.kept}
    before, after = table(steps[0]), table(steps[1])
    assert set(after) == kept and all(after[k] == before[k] for k in after)
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality == 1 and not r.toxic}
    assert len(good & kept) >= 0.95 * len(good)


def test_near_duplicate_stage(steps):
    before, after = table(steps[1]), table(steps[2])
    want = components_of([(k, r.text) for k, r in before.items()])
    assert set(after) == {k for k, (_, c) in want.items() if c == k}
    assert all(after[k] == before[k] for k in after)


def test_substring_stage(steps):
    before, after = table(steps[2]), table(steps[3])
    assert set(before) == set(after)
    first = {}
    for k in sorted(before):
        w = WORD.findall(before[k].text)
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j:j + 50]), k)
    for k in before:
        w = WORD.findall(before[k].text)
        gone = {x for j in range(len(w) - 49) if first[tuple(w[j:j + 50])] < k for x in range(j, j + 50)}
        assert WORD.findall(after[k].text) == [x for j, x in enumerate(w) if j not in gone]
        assert after[k].n_chars == len(after[k].text)
        if not gone:
            assert after[k].text == before[k].text


def test_leak_stage(spark, sf, steps):
    before, after = table(steps[3]), table(steps[4])
    short = {k: r for k, r in before.items() if len(r.text) < 8000}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {d for d, _ in leaks_of([(k, r.text) for k, r in short.items()], items)}
    assert {k for k in after if k in short} == set(short) - bad
    assert all(after[k] == before[k] for k in after)
    again = {r.doc_id for r in decontamination.leaks(steps[3], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert set(after) == set(before) - again


def test_encoding_stage(steps):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    before, after = table(steps[4]), table(steps[5])
    assert set(before) == set(after)
    for k, r in before.items():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert after[k].ids == ids and after[k].n_tokens == len(ids)
        assert after[k].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run(spark, sf, steps):
    assert table(cp.run(spark, sf)) == table(steps[-1])


def test_hard_rows(spark, sf):
    """Nulls, empty texts, repeated rows and ids, and an empty table go through every stage."""
    df = docs(spark, HARD)
    df = df.union(df.limit(3)).union(spark.createDataFrame([(None, t, None, None, None) for t in HARD[:5]], df.schema)).union(spark.createDataFrame([(15, "other text", "en", "s", 1)], df.schema))
    for name, stage in cp.STAGES:
        got = stored(stage(spark, df, sf), "hard")
        assert got.count() <= df.count()
        empty = stage(spark, df.where("false"), sf)
        assert empty.count() == 0, name
        if name == "n-gram Jaccard join":
            ids = [r.doc_id for r in got.collect()]
            assert len([k for k in ids if k is not None]) == len({k for k in ids if k is not None}) and ids.count(None) == 5
            assert all(a != b for a, b in combinations([k for k in ids if k is not None], 2))


def test_extra_columns_with_clashing_names(spark, sf):
    """Every stage leaves extra columns as they are, whatever they are called."""
    df = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 4000")
    extra = {"tag": "doc_id + 1", "_nth": "doc_id + 2", "_spans": "doc_id + 3", "spans": "doc_id + 4", "Text": "concat('x', doc_id)", "DOC_ID": "doc_id + 5", "nth": "doc_id + 6", "c0": "doc_id + 7", "part": "doc_id + 8"}
    wide = df.selectExpr("*", *[f"{value} AS `{name}`" for name, value in extra.items()])
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, wide, sf)
        assert got.columns == wide.columns, name
        rows = [dict(zip(got.columns, r)) for r in got.collect()]
        assert rows
        for r in rows:
            k = r["doc_id"]
            assert [r[c] for c in extra] == [k + 1, k + 2, k + 3, k + 4, f"x{k}", k + 5, k + 6, k + 7, k + 8], name
        plain = {r.doc_id: r.text for r in stage(spark, df, sf).collect()}
        assert {r["doc_id"]: r["text"] for r in rows} == plain, name
    wide = stored(wide, "wide")
    assert {r.doc_id: r.ids for r in cp.STAGES[-1][1](spark, wide, sf).collect()} == {r.doc_id: r.ids for r in cp.STAGES[-1][1](spark, df, sf).collect()}
