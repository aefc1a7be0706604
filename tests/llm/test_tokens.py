import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillgraph.llm import bpe_codec, token_counts, token_output
from quillgraph.llm.shared import shared_folder

from .helpers import HARD, by, docs

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = st.text(st.sampled_from("aAbe'sStrvlmd 0.!é́Σß \n<|>\t's日"), max_size=60)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def codec():
    return bpe_codec.TextCodec(WORDS)


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(BYTES)


@settings(max_examples=300, deadline=None)
@given(LETTERS)
def test_codec_as_library(codec, word_library, text):
    words = text.encode().split()
    forms = codec.forms(words)
    want = word_library.encode(text, add_special_tokens=False).ids
    assert [int(x) for w in words for x in forms[w][1].split()] == want


@settings(max_examples=300, deadline=None)
@given(LETTERS)
def test_counts_as_library(counter, byte_library, text):
    assert counter.counts([text, text + "x"]) == [len(byte_library.encode(t, add_special_tokens=False).ids) for t in (text, text + "x")]


def test_op7_whole_table(spark, sf, word_library):
    got = by(bpe_codec.op7_bpe_codec(spark, sf))
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = word_library.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id]["n_tokens"] == len(ids)
        assert got[r.doc_id]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id]["decoded_sha256"] == hashlib.sha256(word_library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op7_hard_cases(spark, word_library):
    got = by(bpe_codec.encode_decode(docs(spark, HARD, extra=True), WORDS))
    for k, text in enumerate(HARD):
        ids = word_library.encode(text or "", add_special_tokens=False).ids
        assert got[k]["ids"] == ids and got[k]["decoded"] == word_library.decode(ids, skip_special_tokens=False)
    assert bpe_codec.encode_decode(docs(spark, []), WORDS).count() == 0


def test_op8_whole_table_and_hard_cases(spark, sf, byte_library):
    got = by(token_counts.op8_token_counts(spark, sf))
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n = len(byte_library.encode(r.text, add_special_tokens=False).ids)
        assert got[r.doc_id] == {"doc_id": r.doc_id, "n_bytes": len(r.text.encode()), "n_tokens": n, "over_limit": n > 1024}
    got = by(token_counts.token_counts(docs(spark, HARD, extra=True), BYTES))
    assert [got[k]["n_tokens"] for k in range(len(HARD))] == [len(byte_library.encode(t or "", add_special_tokens=False).ids) for t in HARD]
    assert token_counts.token_counts(docs(spark, []), BYTES).count() == 0


def test_chunk_maps_compose():
    rng = np.random.default_rng(5)
    for n in (1, 5, 127, 128, 129, 1000, 5000):
        classes = rng.integers(0, 12, n).astype(np.uint8)
        classes[-1] = token_counts.END
        state, marks = token_counts.START, []
        for c in classes:
            marks.append(token_counts.MARK[state, c])
            state = token_counts.TO[state, c]
        want = [bool(m & 1) or (k + 1 < n and bool(marks[k + 1] & 2)) for k, m in enumerate(marks)]
        assert token_counts.begins(classes).tolist() == want


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (1, 70000), (513, 3), (4096, 50000), (5000, 40)])
def test_wavelet_matrix(n, top):
    ids = np.random.default_rng(n).integers(0, top, n)
    w = token_output.WaveletMatrix.load(token_output.WaveletMatrix.build(ids).dump())
    assert w.all_ids().tolist() == ids.tolist()
    assert w.access(np.arange(n)).tolist() == ids.tolist()
    for value in [0, top - 1, top + 5, *ids[:3].tolist()]:
        assert w.count(value) == int((ids == value).sum())
        assert w.count(value, n // 3, n // 2) == int((ids[n // 3:n // 2] == value).sum())
        assert w.occurrences(value, n // 4) == (n // 4 + np.flatnonzero(ids[n // 4:] == value)).tolist()


def check_output(rows, got, library):
    start = 0
    for key, text in sorted(rows):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert got[key] == {"doc_id": key, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())}
        start += len(ids)


def test_op1(spark, sf, word_library):
    check_output([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], by(token_output.op1_token_output(spark, sf)), word_library)


def test_op1_small_shards_and_hard_cases(spark, word_library):
    random.seed(3)
    texts = HARD + [" ".join(random.choices(["aa", "bÉ", "c1"], k=random.randint(0, 40))) for _ in range(100)]
    for size in (1, 50, 1 << 20):
        folder = shared_folder(spark, "test-shards")
        token_output.write_shards(docs(spark, texts, extra=True), WORDS, folder, shard_ids=size)
        check_output(list(enumerate(texts)), by(token_output.read_shards(spark, folder)), word_library)
    folder = shared_folder(spark, "test-shards")
    token_output.write_shards(docs(spark, []), WORDS, folder)
    assert token_output.read_shards(spark, folder).count() == 0


def test_lookups_from_shard_files(spark, sf, word_library):
    """Counts, places and single ids read from the written files agree with the library's ids."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 3000")
    folder = shared_folder(spark, "lookup")
    token_output.write_shards(rows, WORDS, folder, shard_ids=3000)
    assert spark.read.parquet(folder).count() > 4
    flat, where = [], {}
    for r in sorted(rows.collect(), key=lambda r: r.doc_id):
        ids = word_library.encode(r.text, add_special_tokens=False).ids + [token_output.END_ID]
        for k, i in enumerate(ids):
            where.setdefault(i, []).append((r.doc_id, len(flat), k))  # the document's start and the place in it
        flat += ids
    often = sorted(where, key=lambda i: -len(where[i]))
    some = [often[3], often[len(often) // 2], often[-1], max(flat) + 1, 1 << 20]
    got = {}
    for r in token_output.occurrences(spark, folder, some).collect():
        got.setdefault(r.token_id, []).append((r.doc_id, r.start, r.at))
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(where[i]) for i in some if i in where}
    rng = random.Random(3)
    asked = sorted(rng.sample(range(len(flat)), 300)) + [len(flat) - 1, len(flat), 10 * len(flat)]
    found = token_output.tokens_at(spark, folder, spark.createDataFrame([(p,) for p in asked] + [(None,)], "position long"))
    assert {r.position: r.token_id for r in found.collect()} == {p: flat[p] for p in asked if p < len(flat)}


def test_a_large_document_has_its_own_shard(spark):
    folder = shared_folder(spark, "large")
    token_output.write_shards(docs(spark, ["a b", "word " * 500, "c"]).coalesce(1), WORDS, folder, shard_ids=100)
    assert sorted(sorted(r.doc_ids) for r in spark.read.parquet(folder).collect() if 1 in r.doc_ids) == [[1]]
