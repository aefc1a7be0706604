"""Small documents with the hard cases, and rows of a result by key."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=False):
    rows = [(k, t, None if k % 3 == 0 else "en", "src0", None if t is None else len(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "text AS `TEXT_`", "doc_id AS `Words`", "1 AS part", "2 AS `key`") if extra else df


def by(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


HARD = [
    None, "", " \n\t ", "one", "a b c d", "Á É à̀ ß ΣΑΣ İ", "x\x1cy\x85z w", "<|endoftext|> hello<|startoftext|>x",
    "don't I'LL 're '' 's", "line one\nline one\n\nline one\n", "#*$%&|<> " * 30, "日本語 テキスト 😀👍🏽", "w" * 70000,
    "the quick brown fox jumps over the lazy dog " * 40, "\n".join(f"row {k} of many words here" for k in range(400)),
    "the quick brown fox jumps over the lazy dog " * 40,
]
