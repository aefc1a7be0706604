"""Different long words and lines that a polynomial hash modulo 2^64 takes for equal."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillgraph.llm import jaccard_join, quality_rules, substring_dedup, token_output
from quillgraph.llm.shared import shared_folder
from quillgraph.llm.textkernel import Texts

from .helpers import by, docs
from .test_jaccard_join import brute as brute_join, result
from .test_rules_and_chat import same
from .test_substring_dedup import brute as brute_dedup, rows_of
from .test_tokens import check_output

SIZES = (32, 64, 65, 512, 1024, 2048, 70_000)


def pair(n):
    """The first n letters of the Thue-Morse word over a and b, and of its complement."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", SIZES)
def test_hashes_differ(n):
    t = Texts(pa.array(list(pair(n)))).split()
    for how in ({}, {"lower": True}, {"second": True}):
        assert len(np.unique(t.word_hashes(**how))) == 2
    assert len({*t.word_hashes().tolist(), *t.word_hashes(second=True).tolist()}) == 4


def test_op1(spark):
    texts = [w for n in SIZES for w in pair(n)] + [" ".join(pair(2048)), " ".join(reversed(pair(2048)))]
    folder = shared_folder(spark, "clash")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    token_output.write_shards(docs(spark, texts).coalesce(1), tokenizer, folder)
    check_output(list(enumerate(texts)), by(token_output.read_shards(spark, folder)), Tokenizer.from_file(tokenizer))


def test_op3(spark):
    texts = [w for n in SIZES for w in pair(n)] + [" ".join([w, "x", "y", "z", "v", "w"]) for n in SIZES for w in pair(n)]
    assert result(jaccard_join.near_duplicates(docs(spark, texts))) == brute_join(list(enumerate(texts)))


def test_op6(spark):
    rest = " ".join(f"w{k}" for k in range(49))
    texts = [f"{w} {rest} {w}" for n in SIZES for w in pair(n)] + [" ".join([w] * 60) for n in SIZES for w in pair(n)]
    rows = brute_dedup(list(enumerate(texts)), 50)
    assert not any(r[2] for r in rows)
    assert rows_of(substring_dedup.substring_dedup_digests(docs(spark, texts))) == rows


def test_op9(spark):
    texts = []
    for n in SIZES:
        a, b = pair(n)
        filler = "\n".join(f"line {k} of some words" for k in range(20))
        texts += [f"{a}\n{b}\n{filler}", f"{a}\n{b}\n{a}\n{filler}", f"x {a} y\nx {b} y\n{filler}", f"{a} x y {b} x y {filler}"]
    same(by(quality_rules.quality_rules(docs(spark, texts))), dict(enumerate(texts)))
