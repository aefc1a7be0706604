"""BPE encoding and decoding by batched numpy merge rounds.

The words of many texts are encoded together.  The symbols of all distinct new
words lie in one flat array; each round finds the rank of every adjacent pair by
binary search over the sorted pair keys, takes each word's lowest rank, and
merges all its occurrences from the left.  Words without a merge left are done.
Only pairs beside a new symbol are looked up again.

Cases: null text and text without words give no ids (digest of the empty
string); repeated rows are encoded one by one; an empty table gives an empty
result; extra columns are ignored.  Texts are taken whole, in slices of whole
documents, and one distinct word is the largest unit of work.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .textkernel import Texts, pick, slices

#: Words whose encoding a Python worker keeps.
KEPT_WORDS = 250_000
#: Words longer than this are not kept.
KEPT_BYTES = 64
NONE = np.int64(1 << 40)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return [out[b] for b in range(256)]


class Merger:
    """Vocabulary and merges of a tokenizer file, and the merge rounds over them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces: list[str] = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for piece, k in [*vocab.items(), *self.special.items()]:
            self.pieces[k] = piece
        chars = byte_characters()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.shift = np.int64(len(self.pieces).bit_length())
        key = np.array([(vocab[a] << int(self.shift)) | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made[order]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank in the high bits and place among the keys in the low ones, or NONE."""
        key = (left << self.shift) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, (self.ranks[at] << 20) | at, NONE)

    def merge(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and where each word's begin (with the end); no word is empty."""
        n = len(off) - 1
        sym = self.inner[data]
        sym[off[1:] - 1] = self.last[data[off[1:] - 1]]
        word = np.repeat(np.arange(n), np.diff(off))
        done_sym: list[np.ndarray] = []
        done_word: list[np.ndarray] = []
        rank = np.full(len(sym), NONE)  # of the pair that begins here
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self._rank(sym[inside], sym[inside + 1])
        while len(sym):
            head = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            best = np.minimum.reduceat(rank, head)
            size = np.diff(np.append(head, len(sym)))
            alive = np.repeat(best < NONE, size)
            if not alive.all():
                done_sym.append(sym[~alive])
                done_word.append(word[~alive])
                if not alive.any():
                    break
                sym, word, rank = sym[alive], word[alive], rank[alive]
                best, size = best[best < NONE], size[best < NONE]
            hit = np.flatnonzero(rank == np.repeat(best, size))
            if len(hit) > 1:  # of overlapping pairs in a run of equal symbols, every second one goes
                run = np.flatnonzero(np.concatenate(([True], np.diff(hit) != 1)))
                nth = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
                hit = hit[nth % 2 == 0]
            sym[hit] = self.made[rank[hit] & 0xFFFFF]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the new symbols come to lie
            sym, word, rank = sym[keep], word[keep], rank[keep]
            beside = np.zeros(len(sym), bool)
            beside[at] = beside[at[at > 0] - 1] = True
            near = np.flatnonzero(beside)
            rank[near] = NONE
            near = near[near + 1 < len(sym)]
            near = near[word[near] == word[near + 1]]
            rank[near] = self._rank(sym[near], sym[near + 1])
        ids = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        of = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        order = np.argsort(of, kind="stable")
        return ids[order], np.searchsorted(of[order], np.arange(n + 1))


def plain_words(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which words hold only ASCII but apostrophes and <, and the letters of Latin-1, which are NFC as they are."""
    lead = data == 0xC3
    after = np.concatenate(([False], lead[:-1]))
    odd = (data >= 0x80) & ~lead & ~after
    odd |= after & ((data == 0x97) | (data == 0xB7))
    odd |= (data == 39) | (data == 60)
    return ~np.logical_or.reduceat(odd, off[:-1])


def cut_plain(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Plain words in lower case, and where their runs of letters, single digits and runs of other signs begin, with the end."""
    after = np.concatenate(([False], data[:-1] == 0xC3))
    upper = (data >= 65) & (data <= 90) | after & (data >= 0x80) & (data <= 0x9E)
    data = data + upper.astype(np.uint8) * np.uint8(32)
    kind = np.where((data >= 97) & (data <= 122) | (data >= 0x80), 0, np.where((data >= 48) & (data <= 57), 1, 2))
    begin = np.concatenate(([True], (kind[1:] != kind[:-1]) | (kind[1:] == 1)))
    begin[off[:-1]] = True
    return data, np.append(np.flatnonzero(begin), len(data))


class WordCodec:
    """Encodes words (runs of bytes between ASCII white space) as the library does with the file at `path`.

    Texts are put in NFC and lower case and cut into letters, single digits and
    other signs; contractions are cut off; special strings are their own tokens.
    """

    ASCII = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.merger = Merger(path)
        library = Tokenizer.from_file(path)
        self._normal = library.normalizer.normalize_str
        self._cut = library.pre_tokenizer.pre_tokenize_str
        self._byte = {c: b for b, c in enumerate(byte_characters())}
        strings = sorted(self.merger.special, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, strings)) + ")") if strings else None
        self._marks = [s.encode() for s in strings]

    def pieces_of(self, word: bytes) -> list[bytes | int]:
        """What is merged apart from the rest; an int is the id of a special string."""
        if not any(m in word for m in self._marks):
            if word.isascii():
                return self.ASCII.findall(word.lower())
            return self._cut_library(word.decode("utf-8"))
        out: list[bytes | int] = []
        for k, part in enumerate(self._special.split(word.decode("utf-8"))):
            if k % 2:
                out.append(self.merger.special[part])
            elif part:
                out += self._cut_library(part)
        return out

    def _cut_library(self, text: str) -> list[bytes]:
        return [bytes(self._byte[c] for c in piece) for piece, _ in self._cut(self._normal(text))]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and where each word's begin (with the end)."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        data = np.frombuffer(b"".join(words), np.uint8).copy()
        off = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        plain = plain_words(data, off)
        size = np.diff(off)
        if plain.all():
            ids, at = self._encode_plain(data, off)
            return ids, at
        ids, at = self._encode_plain(data[np.repeat(plain, size)], np.concatenate(([0], np.cumsum(size[plain]))))
        others = np.flatnonzero(~plain)
        more, ends = self._encode_pieces([self.pieces_of(words[k]) for k in others])
        count = np.empty(len(words), np.int64)
        count[plain], count[others] = np.diff(at), np.diff(ends)
        at = np.concatenate(([0], np.cumsum(count)))
        out = np.empty(at[-1], np.int64)
        out[np.repeat(plain, count)], out[np.repeat(~plain, count)] = ids, more
        return out, at

    def _encode_plain(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        data, begin = cut_plain(data, off)
        ids, at = self.merger.merge(data, begin)
        return ids, at[np.searchsorted(begin, off)]

    def _encode_pieces(self, pieces: list[list[bytes | int]]) -> tuple[np.ndarray, np.ndarray]:
        flat = [p for ps in pieces for p in ps]
        text = [p for p in flat if not isinstance(p, int)]
        off = np.concatenate(([0], np.cumsum([len(p) for p in text], dtype=np.int64))).astype(np.int64)
        got, at = self.merger.merge(np.frombuffer(b"".join(text), np.uint8), off) if text else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        if len(text) < len(flat):  # special ids go between
            mark = np.array([isinstance(p, int) for p in flat])
            size = np.ones(len(flat), np.int64)
            size[~mark] = np.diff(at)
            begin = np.concatenate(([0], np.cumsum(size)))
            ids = np.empty(begin[-1], np.int64)
            ids[np.repeat(~mark, size)] = got
            ids[begin[:-1][mark]] = [p for p in flat if isinstance(p, int)]
            got, at = ids, begin
        return got, at[np.concatenate(([0], np.cumsum([len(p) for p in pieces], dtype=np.int64))).astype(np.int64)]


class TextCodec:
    """Encoded and decoded forms of whole texts, with the words' forms kept between batches."""

    def __init__(self, path: str):
        self.codec = WordCodec(path)
        self.pieces = [p.encode() for p in self.codec.merger.pieces]
        self.decimal = [b"%d" % k for k in range(len(self.pieces))]
        self.kept: dict[bytes, tuple[int, bytes, bytes]] = {}

    def forms(self, words: list[bytes]) -> dict[bytes, tuple[int, bytes, bytes]]:
        """Of each word: number of ids, the decimal ids, and the decoded pieces, both joined by one space."""
        if len(self.kept) > KEPT_WORDS:  # the older half goes
            self.kept = dict(list(self.kept.items())[KEPT_WORDS // 2:])
        known = self.kept
        new = list(set(words).difference(known))
        if new:
            ids, at = self.codec.encode(new)
            ids, at = ids.tolist(), at.tolist()
            pieces, decimal = self.pieces, self.decimal
            made = {}
            for w, a, b in zip(new, at, at[1:]):
                got = ids[a:b]
                made[w] = (b - a, b" ".join([decimal[i] for i in got]), b" ".join([pieces[i] for i in got]))
            if all(len(w) <= KEPT_BYTES for w in new):
                known.update(made)
            else:
                known = known | made
                self.kept.update((w, v) for w, v in made.items() if len(w) <= KEPT_BYTES)
        return known


@functools.lru_cache(maxsize=1)
def codec_of_worker(path: str) -> TextCodec:
    """One for all tasks that a Python worker runs."""
    return TextCodec(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str, ids_as_lists: bool, decoded_as_text: bool) -> Iterator[pa.RecordBatch]:
    codec = codec_of_worker(path)
    for batch in slices(batches):
        column = batch.column("text").fill_null("").to_pylist()
        words = [t.encode().split() for t in column]
        forms = codec.forms([w for ws in words for w in ws])
        counts, ids, decoded = [], [], []
        for ws in words:
            got = [f for f in map(forms.__getitem__, ws) if f[0]]
            counts.append(sum([f[0] for f in got]))
            a, b = b" ".join([f[1] for f in got]), b" ".join([f[2] for f in got])
            ids.append(a if ids_as_lists else hashlib.sha256(a).hexdigest())
            decoded.append(b.decode() if decoded_as_text else hashlib.sha256(b).hexdigest())
        if ids_as_lists:
            flat = np.fromstring(b" ".join([a for a in ids if a]), np.int32, sep=" ")
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(flat))
        names = ["doc_id", "n_tokens", "ids" if ids_as_lists else "ids_sha256", "decoded" if decoded_as_text else "decoded_sha256"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()) if not ids_as_lists else ids, pa.array(decoded, pa.string())], names)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids array<int>, decoded string. Needs columns doc_id and text."""
    return pick(docs, "doc_id", "text").mapInArrow(lambda it: encoded(it, path, True, True), "doc_id long, n_tokens long, ids array<int>, decoded string")


def encode_decode_digests(docs: DataFrame, path: str) -> DataFrame:
    """As encode_decode, with sha256 digests in place of ids and decoded text."""
    return pick(docs, "doc_id", "text").mapInArrow(lambda it: encoded(it, path, False, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_lists(docs: DataFrame, path: str) -> DataFrame:
    """As encode_decode, with a sha256 digest in place of the decoded text."""
    return pick(docs, "doc_id", "text").mapInArrow(lambda it: encoded(it, path, True, False), "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
