"""Substring dedup by recompression.

A word that lies in a window of 50 words which also starts in a document with a
smaller doc_id is removed; windows are judged on the input.

Recompression renames a text in rounds: a run of one symbol becomes a symbol, then
a pair of neighbours becomes one when a coin thrown by name sends the left one to
the left half of the alphabet and the right one to the right half.  Names are
64-bit fingerprints of what they stand for, so that all tasks give equal strings
equal names without a dictionary that grows with the corpus; a clash of names can
only cost a comparison, as finds are verified by fingerprints of all their words.

With each symbol goes the span of words that its making depended on.  A window
that holds the whole span of a symbol has that symbol wherever it occurs.  So each
window takes as its anchor, among such symbols of the highest round that has any,
the one whose name hashes lowest, and equal windows have equal anchors.  An anchor
goes by the words of its span.  Consecutive windows with the same anchor are a
block.  (Below the rounds: the first change of word in the window; a window of one
word repeated is its own anchor.)

Spark groups blocks by anchor.  Where whole blocks are equal, by a fingerprint of
their words, later documents lose them as a whole; only the first of several
unequal blocks with a common anchor are compared window by window, by 128-bit
fingerprints.  Both groupings are sorted partitions read as a stream, so that a
group of any size takes bounded memory.

Cases: null and blank texts have no words and lose none; texts under 50 words lose
none; rows that repeat a doc_id are not compared with each other, each being
judged by its own text; a row with null doc_id is neither source nor target; an
empty table gives an empty result; extra columns are ignored (op6) or kept (the
pipeline's stage).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import hashed_side, partitions, stored
from .textkernel import U64, Texts, mix, numbered, pick, signed, slices, windows

#: Words in a window.
WINDOW = 50
#: Rounds of recompression; after each, symbols are about a third longer, and spans wider.
ROUNDS = 4
#: Bytes that a span takes in a join, at most.
ROW_BYTES = 100
_RUN, _LEFT, _RIGHT, _LEVEL = U64(0x9FB21C651E98DF25), U64(0xA24BAED4963EE407), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3)
_ONE, _TWO = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def _salt(k: int) -> U64:
    return U64(k * int(_LEVEL) & (1 << 64) - 1)


def lowest(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Place of the first lowest value in each range, by tables over lengths 1, 2, 4 and so on; no range is empty."""
    size = end - begin
    out = np.empty(len(begin), np.int64)
    best, width = np.arange(len(values)), 1
    while True:
        mine = np.flatnonzero((size >= width) & (size < 2 * width))
        a, b = best[begin[mine]], best[end[mine] - width]
        out[mine] = np.where(values[b] < values[a], b, a)
        if not len(size) or 2 * width > size.max():
            return out
        a, b = best[:len(best) - width], best[width:]
        best, width = np.where(values[b] < values[a], b, a), 2 * width


def spans(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ranges of words, each by two ranges of a power of two that cover it."""
    size = end - begin
    out = np.empty(len(begin), U64)
    width = 1
    while len(size) and width <= size.max():
        mine = np.flatnonzero((size >= width) & (size < 2 * width))
        if len(mine):
            w = windows(h, width, _ONE)
            out[mine] = mix(w[begin[mine]] * _LEFT + mix(w[end[mine] - width]) * _RIGHT + size[mine].astype(U64))
        width *= 2
    return out


class Symbols:
    """Symbols of one round: name, first word, and the span of words [lo, hi) that decided it.

    A span that reaches over a document's edge ends one beyond it, where no window reaches.
    """

    def __init__(self, name: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray):
        self.name, self.start, self.lo, self.hi, self.doc = name, start, lo, hi, doc

    def round(self, k: int, first: np.ndarray) -> Symbols:
        """The next round's symbols; first: index of each document's first word, and the end."""
        return self._runs(first)._pairs(k, first)

    def _beside(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """lo of each left neighbour, hi of each right one, and whether the left one is of the same document."""
        same = np.concatenate(([False], self.doc[1:] == self.doc[:-1]))
        left = np.where(same, np.concatenate(([0], self.lo[:-1])), first[self.doc] - 1)
        last = np.append(~same[1:], True)
        right = np.where(last, first[self.doc + 1] + 1, np.append(self.hi[1:], 0))
        return left, right, same

    def _runs(self, first: np.ndarray) -> Symbols:
        left, right, same = self._beside(first)
        begin = np.flatnonzero(np.concatenate(([True], ~(same[1:] & (self.name[1:] == self.name[:-1])))))
        size = np.diff(np.append(begin, len(self.name)))
        name = self.name[begin]
        many = size > 1
        name[many] = mix(name[many] * _RUN + size[many].astype(U64))
        return Symbols(name, self.start[begin], left[begin], right[begin + size - 1], self.doc[begin])

    def _pairs(self, k: int, first: np.ndarray) -> Symbols:
        left, right, same = self._beside(first)
        coin = (mix(self.name + _salt(k)) & U64(1)).astype(bool)  # True: right half
        joined = np.append(~coin[:-1] & coin[1:] & same[1:], False)
        keep = np.concatenate(([True], ~joined[:-1]))
        name = self.name.copy()
        at = np.flatnonzero(joined)
        name[at] = mix(name[at] * _LEFT + mix(name[at + 1]) * _RIGHT)
        lo = np.where(coin, left, self.lo)  # a right one that found no partner saw its left neighbour
        hi = np.where(coin, self.hi, right)  # a left one saw its right neighbour
        return Symbols(name[keep], self.start[keep], lo[keep], hi[keep], self.doc[keep])


class Blocks:
    """Blocks of a slice of texts: anchor, content, document (row of the slice), first window, and number of windows."""

    def __init__(self, t: Texts, width: int = WINDOW, rounds: int = ROUNDS):
        h, first, doc = t.word_hashes(), t.first, t.doc_of_words()
        n = len(h)
        self.anchor = self.content = np.zeros(0, U64)
        self.doc = self.at = self.count = np.zeros(0, np.int64)
        if n < width:
            return
        whole = windows(h, width, _ONE)
        inside = np.flatnonzero(doc[:len(whole)] == doc[width - 1:])
        if not len(inside):
            return
        key = np.zeros(len(whole), U64)  # the anchor
        mark = np.full(len(whole), -1, np.int64)  # tells anchors of a document apart
        levels = [Symbols(h, np.arange(n), np.arange(n), np.arange(1, n + 1), doc)]
        for k in range(rounds):
            levels.append(levels[-1].round(k, first))
        base, open_ = 0, inside
        for k in range(rounds, 0, -1):
            s = levels[k]
            begin, end = np.searchsorted(s.lo, open_), np.searchsorted(s.hi, open_ + width, "right")
            good = end > begin
            found = lowest(mix(s.name), begin[good], end[good])
            used, place = np.unique(found, return_inverse=True)
            key[open_[good]] = (spans(h, s.lo[used], s.hi[used]) + _salt(k))[place]
            mark[open_[good]] = base + found
            base += len(s.lo)
            open_ = open_[~good]
        if len(open_):  # the first change of word
            change = np.flatnonzero(np.concatenate(([False], h[1:] != h[:-1])))
            found = np.searchsorted(change, open_ + 1)
            at = np.append(change, 1 << 60)[found]
            good = at < open_ + width
            at, some = at[good], open_[good]
            key[some] = mix(h[at - 1] * _LEFT + mix(h[at]) * _RIGHT + _LEVEL)
            mark[some] = base + at
            base += n + 1
            # one word throughout: the run it lies in
            flat = open_[~good]
            key[flat] = mix(h[flat] * _RUN + _LEVEL)
            mark[flat] = base + np.searchsorted(change, flat, "right")
            constant = np.zeros(len(whole), bool)
            constant[flat] = True
        else:
            constant = np.zeros(len(whole), bool)
        here = mark[inside]
        cut = np.concatenate(([True], (here[1:] != here[:-1]) | (np.diff(inside) != 1)))
        begin = np.flatnonzero(cut)
        count = np.diff(np.append(begin, len(inside)))
        a, b = inside[begin], inside[begin + count - 1]
        self.anchor, self.at, self.count, self.doc = key[a], a, count, doc[a]
        self.content = np.where(constant[a], key[a], mix(whole[a] * U64(3) + whole[b] * _LEFT + count.astype(U64) * _RIGHT))


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        t = Texts(batch.column("text")).split()
        b = Blocks(t, width)
        ids = batch.column("doc_id").fill_null(0).to_numpy()
        tag = batch.column("tag").to_numpy()
        real = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)[b.doc]
        order = np.flatnonzero(real)[np.lexsort((b.at[real], b.content[real], b.anchor[real], b.doc[real]))]
        anchor, content, doc, n = b.anchor[order], b.content[order], b.doc[order], b.count[order]
        at = (b.at[order] - t.first[doc]).astype(np.int32)
        new = np.ones(len(order), bool)  # equal blocks of a document, as a period has many, are one row
        new[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]) | (doc[1:] != doc[:-1]) | (n[1:] != n[:-1])
        k = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays([
            pa.array(signed(anchor[k])), pa.array(signed(content[k])), pa.array(ids[doc[k]]), pa.array(tag[doc[k]]),
            pa.ListArray.from_arrays(pa.array(np.append(k, len(order)).astype(np.int32)), pa.array(at)), pa.array(n[k].astype(np.int32)),
        ], ["anchor", "content", "doc_id", "tag", "at", "n"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads blocks sorted by anchor, content and document.

    Yields blocks that an earlier document has as a whole (whole), and the first
    of each content where an anchor has several contents and documents.
    Of the anchor that is being read, no more is held than one document's blocks.
    """
    anchor: Any = None
    content = first_doc = any_doc = None
    contents, docs, told = 0, False, False
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        a, c, d = (batch.column(k).to_numpy() for k in ("anchor", "content", "doc_id"))
        new_a = np.concatenate(([anchor is None or a[0] != anchor], a[1:] != a[:-1]))
        new_c = new_a | np.concatenate(([content is None or c[0] != content], c[1:] != c[:-1]))
        begin = np.maximum.accumulate(np.where(new_c, np.arange(len(a)), -1))
        source = np.where(begin >= 0, d[begin], first_doc if first_doc is not None else 0)
        whole = d > source
        group = np.cumsum(new_a) - 1  # -1: goes on from the last batch
        size = int(group[-1]) + 2
        n_contents = np.bincount(group + 1, new_c, size).astype(np.int64)
        low, high = np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min)
        np.minimum.at(low, group + 1, d)
        np.maximum.at(high, group + 1, d)
        several = low < high
        if group[0] == -1:
            n_contents[0] += contents
            several[0] |= docs or low[0] != any_doc
        tell = (n_contents > 1) & several
        if group[0] == -1 and tell[0]:
            yield from held
            held = []
        elif group[-1] != -1:  # the anchor of the last batch is done
            held = []
        wanted = ~whole & tell[group + 1]
        out = whole | wanted
        if out.any():
            part = batch.filter(pa.array(out))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("doc_id", "tag", "at", "n")), pa.array(whole[out])], ["doc_id", "tag", "at", "n", "whole"])
        last = group == group[-1]
        if not tell[-1] and (keep := last & ~whole).any():
            part = batch.filter(pa.array(keep))
            held.append(pa.RecordBatch.from_arrays([*(part.column(k) for k in ("doc_id", "tag", "at", "n")), pa.array(np.zeros(part.num_rows, bool))], ["doc_id", "tag", "at", "n", "whole"]))
        anchor, content, first_doc, any_doc = a[-1], c[-1], source[-1], low[-1]
        contents, docs = int(n_contents[-1]), bool(several[-1])


def positions(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and number of each place in lists of (at, n), where at is a list of first words."""
    parts = lists.flatten()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
    at = parts.field("at")
    times = at.value_lengths().to_numpy()
    return np.repeat(row, times), at.flatten().to_numpy().astype(np.int64), np.repeat(parts.field("n").to_numpy().astype(np.int64), times)


def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """128-bit fingerprints of the windows in the wanted blocks: two of 64 bits, over independent hashes of the words."""
    for batch in slices(batches):
        t = Texts(batch.column("text")).split()
        one, two = windows(t.word_hashes(), width, _ONE), windows(t.word_hashes(second=True), width, _TWO)
        doc, at, n = positions(batch.column("blocks"))
        begin = t.first[doc] + at
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        window = np.arange(total) + np.repeat(begin - ends + n, n)
        row = np.repeat(doc, n)
        ids, tag = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
        for k in range(0, total, 1 << 17):
            w, r = window[k:k + (1 << 17)], row[k:k + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(signed(one[w])), pa.array(signed(two[w])), pa.array(ids[r]), pa.array(tag[r]), pa.array((w - t.first[r]).astype(np.int32))], ["one", "two", "doc_id", "tag", "at"])


def _later(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Reads windows sorted by fingerprint and document; yields those that an earlier document has."""
    last: Any = None
    for batch in batches:
        if not batch.num_rows:
            continue
        one, two, d = (batch.column(k).to_numpy() for k in ("one", "two", "doc_id"))
        new = np.concatenate(([last is None or (one[0], two[0]) != last[:2]], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
        begin = np.maximum.accumulate(np.where(new, np.arange(len(d)), -1))
        source = np.where(begin >= 0, d[begin], last[2] if last is not None else 0)
        out = d > source
        if out.any():
            part = batch.filter(pa.array(out))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tag"), part.column("at"), pa.array(np.full(part.num_rows, width, np.int32))], ["doc_id", "tag", "at", "n"])
        last = (one[-1], two[-1], source[-1])


def repeated_spans(docs: DataFrame, width: int = WINDOW) -> tuple[DataFrame, int]:
    """Spans of words to remove, overlapping as they may: doc_id, tag (hash of the text), at (list of first words), n (words); and their bytes at most."""
    spark = docs.sparkSession
    count = partitions(spark)
    texts = pick(docs, "doc_id", "text").where("text IS NOT NULL AND doc_id IS NOT NULL").withColumn("tag", F.xxhash64("text"))
    blocks = texts.mapInArrow(lambda it: _blocks(it, width), "anchor long, content long, doc_id long, tag long, at array<int>, n int")
    blocks = blocks.repartition(count, "anchor").sortWithinPartitions("anchor", "content", "doc_id", "tag")
    found = stored(blocks.mapInArrow(_compared, "doc_id long, tag long, at array<int>, n int, whole boolean"), "repeats")
    rows, windows_ = found.agg(F.count("*"), F.coalesce(F.sum(F.when(~F.col("whole"), F.size("at") * F.col("n"))), F.lit(0))).first()
    open_ = found.where("NOT whole").groupBy("doc_id", "tag").agg(F.collect_set(F.struct("at", "n")).alias("blocks"))  # a set: rows may repeat
    prints = texts.join(hashed_side(open_, ROW_BYTES * rows), ["doc_id", "tag"]).mapInArrow(lambda it: _fingerprints(it, width), "one long, two long, doc_id long, tag long, at int")
    prints = prints.repartition(count, "one", "two").sortWithinPartitions("one", "two", "doc_id")
    single = prints.mapInArrow(lambda it: _later(it, width), "doc_id long, tag long, at int, n int").withColumn("at", F.array("at"))
    whole = found.where("whole").select("doc_id", "tag", "at", (F.col("n") + width - 1).alias("n"))
    return whole.unionByName(single), ROW_BYTES * (rows + windows_)


def with_spans(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """All rows of docs, columns named as by numbered(), and array column spans (null: none)."""
    found, size = repeated_spans(docs, width)
    spans = found.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("at", "n")).alias("spans"))
    same, name = numbered(docs)
    same = same.withColumn("tag", F.xxhash64(name("text")))
    on = (same[name("doc_id")] == spans["doc_id"]) & (same["tag"] == spans["tag"])
    return same.join(hashed_side(spans, size), on, "left").drop("tag", "doc_id")


def removed_words(batch: pa.RecordBatch, t: Texts) -> np.ndarray:
    """Which words the spans of a batch cover."""
    doc, at, words = positions(batch.column("spans"))
    begin, n = t.first[doc] + at, len(t.start)
    steps = np.bincount(begin, minlength=n + 1).astype(np.int64) - np.bincount(begin + words, minlength=n + 1)
    return np.cumsum(steps)[:n] > 0


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        t = Texts(batch.column("text")).split()
        gone = removed_words(batch, t)
        total = np.concatenate(([0], np.cumsum(gone)))
        lost = total[t.first[1:]] - total[t.first[:-1]]
        kept = []
        for k in range(t.n):
            words = t.raw[t.off[k]:t.off[k + 1]].split()
            if lost[k]:
                words = [w for w, g in zip(words, gone[t.first[k]:t.first[k + 1]].tolist()) if not g]
            kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(t.first)), pa.array(lost), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def substring_dedup_digests(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per document (columns doc_id, text): words, removed words, and the sha256 of what is kept, joined by one space."""
    return with_spans(pick(docs, "doc_id", "text"), width).toDF("doc_id", "text", "spans").mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _cut(batches: Iterator[pa.RecordBatch], text: str, length: str | None) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, text):
        t = Texts(batch.column(text)).split()
        gone = removed_words(batch, t)
        out = batch.column(text).to_pylist()
        for k in np.flatnonzero(batch.column("spans").is_valid().to_numpy(zero_copy_only=False)):
            i, j = t.first[k], t.first[k + 1]
            ends = np.append(t.start[i + 1:j], t.off[k + 1])  # a word goes with the white space after it
            keep = np.flatnonzero(~gone[i:j])
            pieces = [t.raw[t.off[k]:t.start[i]], *(t.raw[a:b] for a, b in zip(t.start[i:j][keep].tolist(), ends[keep].tolist()))]
            out[k] = b"".join(pieces).decode()
        made = {text: pa.array(out, pa.string())}
        if length:
            made[length] = pa.array([None if x is None else len(x) for x in out], pa.int64())
        names = [n for n in batch.schema.names if n != "spans"]
        yield pa.RecordBatch.from_arrays([made.get(n, batch.column(n)) for n in names], names)


def substring_dedup(docs: DataFrame, width: int = WINDOW, length: str | None = None) -> DataFrame:
    """docs with repeated words cut out of text, each with the white space after it; other columns as they are, but for `length`, a long column with the text's characters."""
    same, name = numbered(docs)
    text, chars = name("text"), name(length) if length else None
    return with_spans(docs, width).mapInArrow(lambda it: _cut(it, text, chars), same.schema).toDF(*docs.columns)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
