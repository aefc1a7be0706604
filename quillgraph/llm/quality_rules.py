"""Quality rules by repetition coverage.

For several lengths n, rolling hashes of all n-grams of a text's words are
grouped within the text; the words of every n-gram that was there before are
marked, and their characters are counted once each however many n-grams overlap.
The same is done for whole lines.  A text passes when no share of its characters
in repeats is above the limit for that n; short texts have wider limits.

Cases: null, empty and blank texts have no words and fail the base rule; texts
are taken whole; repeated rows are judged one by one; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .textkernel import U64, Texts, mix, pick, slices, windows

_FACTOR = 0xBF58476D1CE4E5B9
_DOC = U64(0x94D049BB133111EB)
SYMBOL = np.zeros(256, np.int64)
SYMBOL[list(b"#*$%&|<>")] = 1


@dataclass(frozen=True)
class Limits:
    """Largest shares of word characters that may lie in repeats.

    Texts under `short` words have wider limits, which allow them one repeated
    line, such as a title that comes again at the end: that alone makes no text poor,
    and its share is large only because the text is short.
    """

    ngrams: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    lines: float = 0.20
    short: int = 200
    short_ngrams: dict[int, float] = field(default_factory=lambda: {5: 0.32, 6: 0.31, 7: 0.30, 8: 0.29, 9: 0.28, 10: 0.27})
    short_lines: float = 0.30
    min_words: int = 50
    max_repeat_words: int = 50  # percent of words in 3-word windows found twice


def again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which of those aren't the first."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def covered(marks: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of `width` that begins at one of `marks`."""
    steps = np.bincount(marks, minlength=n + 1)[:n + 1].astype(np.int64)
    steps -= np.bincount(np.minimum(marks + width, n), minlength=n + 1)[:n + 1]
    return np.cumsum(steps[:n]) > 0


class Repeats:
    """Counts of one slice of texts."""

    def __init__(self, column: pa.Array):
        t = self.t = Texts(column).split()
        self.h = t.word_hashes()
        self.doc = t.doc_of_words()
        whole = (t.data & 0xC0) != 0x80
        self.chars = np.concatenate(([0], np.cumsum(whole)))
        self.size = self.chars[t.end] - self.chars[t.start]

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return total[self.t.first[1:]] - total[self.t.first[:-1]]

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Words in n-grams of the text found twice or more, and words in those that were there before."""
        w = windows(self.h, n, _FACTOR)
        if not len(w):
            none = np.zeros(len(self.h), bool)
            return none, none
        at = np.flatnonzero(self.doc[:len(w)] == self.doc[n - 1:])
        twice, later = again(mix(w[at] + (self.doc[at].astype(U64) + U64(1)) * _DOC))
        return covered(at[twice], n, len(self.h)), covered(at[later], n, len(self.h))

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines per text that equal an earlier line, and the word characters in them."""
        t = self.t
        newline = np.flatnonzero(t.data == 10)
        full = np.flatnonzero(t.off[1:] > t.off[:-1])
        start = np.sort(np.concatenate((t.off[full], newline + 1)))
        start = start[start < len(t.data)]
        start = start[np.concatenate(([True], start[1:] != start[:-1]))] if len(start) else start
        stop = np.minimum(np.append(start[1:], len(t.data)), t.off[np.searchsorted(t.off, start, "right")]) if len(start) else start
        if len(start):
            stop = stop - ((t.data[stop - 1] == 10) & (stop > start))
        first, last = np.searchsorted(t.start, start), np.searchsorted(t.start, stop)
        ink = last > first
        start, stop, first, last = start[ink], stop[ink], first[ink], last[ink]
        doc = np.searchsorted(t.off, start, "right") - 1
        _, later = again(mix(t.hashes(start, stop) + (doc.astype(U64) + U64(1)) * _DOC))
        total = np.concatenate(([0], np.cumsum(self.size)))
        chars = (total[last] - total[first])[later]
        return np.bincount(doc[later], minlength=t.n), np.bincount(doc[later], chars, minlength=t.n).astype(np.int64)


def judged(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        r = Repeats(batch.column("text"))
        t = r.t
        words = np.diff(t.first)
        chars = r.per_doc(r.size)
        symbols = np.concatenate(([0], np.cumsum(SYMBOL[t.data])))
        dup_lines, line_chars = r.lines()
        repeat_words = r.per_doc(r.ngrams(3)[0])
        failed = (words < limits.min_words) | (100 * repeat_words > limits.max_repeat_words * words)
        brief = words < limits.short
        good = line_chars <= np.where(brief, limits.short_lines, limits.lines) * chars
        worst = np.zeros(t.n)
        for n, most in limits.ngrams.items():
            share = r.per_doc(r.size * r.ngrams(n)[1]) / np.maximum(chars, 1)
            good &= share <= np.where(brief, limits.short_ngrams[n], most)
            worst = np.maximum(worst, share)
        columns = {
            "doc_id": batch.column("doc_id"), "n_words": words, "word_chars": chars, "n_symbols": symbols[t.off[1:]] - symbols[t.off[:-1]],
            "n_dup_lines": dup_lines, "n_repeat_words": repeat_words, "base_failed": failed, "kept": good & ~failed,
            "repeat_share": worst, "line_repeat_share": line_chars / np.maximum(chars, 1),
        }
        yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, repeat_share double, line_repeat_share double"
)


def quality_rules(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """One row per document (columns doc_id, text): base counts, the shares in repeats, and the verdict."""
    chosen = limits or Limits()
    return pick(docs, "doc_id", "text").mapInArrow(lambda it: judged(it, chosen), SCHEMA)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
