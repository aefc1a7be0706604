"""Token counts by finite-state transducers, without building the tokens.

Two transducers are compiled from the tokenizer file.

The first reads character classes and marks where pre-tokens begin.  It has 13
states, so that a chunk of text is a map from entry state to exit state; the maps
of all chunks of a batch are composed by a parallel prefix scan, and then every
chunk is read from the state it is really entered in.

The second reads the bytes of a pre-token and emits, at each step, by how much
the number of tokens changes.  Its states hold what a longer token could still
need: for every position from which a token may reach beyond the current byte, the
place in the vocabulary's trie, the last token before that position, and the
token count there relative to the count here.  The last token of a prefix is
settled by pairs: a token may follow another if merging the two byte strings
gives just these two.  States and transitions are compiled when first met, so the
machine stays as small as the texts need.

Cases: null and empty texts have no tokens; texts are taken whole, and a
pre-token of any length is read byte by byte; special strings inside a text are
one token each; repeated rows are counted one by one; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe_codec import byte_characters
from .textkernel import Texts, pick, slices

#: Pre-tokens whose counts a Python worker keeps, and the longest of them.
KEPT_PIECES = 400_000
KEPT_BYTES = 64
#: Compiled states after which a worker starts anew.
KEPT_STATES = 150_000
CHUNK = 128

# -- the transducer over character classes -------------------------------------

#: Classes: blank, other white space, letters by their part in contractions, digit, other sign, apostrophe, end.
BLANK, WHITE, LETTER, STMD, R, V, L, E, DIGIT, SIGN, QUOTE, END = range(12)
#: States: at the start; within letters, digits, signs; after one blank, one other
#: white space, several ending in either; after an apostrophe that began a
#: pre-token, that with r, v or l; after a whole contraction.
START, LETTERS, DIGITS, SIGNS, BLANK1, WHITE1, BLANKS, WHITES, APOS, APOS_R, APOS_V, APOS_L, WHOLE = range(13)
HERE, BEFORE = 1, 2  # a pre-token begins at this character; at the one before


def class_machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and marks, by state and class."""
    to = np.zeros((13, 12), np.uint8)
    mark = np.zeros((13, 12), np.uint8)
    fresh = [BLANK1, WHITE1, LETTERS, LETTERS, LETTERS, LETTERS, LETTERS, LETTERS, DIGITS, SIGNS, APOS, START]
    joined = [BLANK1, WHITE1, LETTERS, LETTERS, LETTERS, LETTERS, LETTERS, LETTERS, DIGITS, SIGNS, SIGNS, START]
    letters = (LETTER, STMD, R, V, L, E)
    for state in range(13):
        for c in range(12):
            nxt, m = fresh[c], HERE
            if c == END:
                nxt, m = START, HERE
            elif state == LETTERS and c in letters:
                nxt, m = LETTERS, 0
            elif state == DIGITS and c == DIGIT:
                nxt, m = DIGITS, 0
            elif state == SIGNS and c in (SIGN, QUOTE):
                nxt, m = SIGNS, 0
            elif state in (BLANK1, WHITE1, BLANKS, WHITES):
                if c in (BLANK, WHITE):
                    nxt, m = (BLANKS if c == BLANK else WHITES), 0
                elif state == BLANK1:
                    nxt, m = joined[c], 0
                elif state == BLANKS:
                    nxt, m = joined[c], BEFORE
                elif state == WHITES:
                    nxt, m = fresh[c], HERE | BEFORE
            elif state == APOS:
                if c in (SIGN, QUOTE):
                    nxt, m = SIGNS, 0
                elif c in (STMD, R, V, L):
                    nxt, m = {STMD: WHOLE, R: APOS_R, V: APOS_V, L: APOS_L}[c], 0
            elif state in (APOS_R, APOS_V, APOS_L):
                if c == (L if state == APOS_L else E):
                    nxt, m = WHOLE, 0
                elif c in letters:
                    nxt, m = LETTERS, BEFORE
                else:
                    m = HERE | BEFORE
            to[state, c], mark[state, c] = nxt, m
    return to, mark


TO, MARK = class_machine()
_TO_FLAT, _MARK_FLAT = TO.ravel(), MARK.ravel()


def chunk_entries(classes: np.ndarray) -> np.ndarray:
    """State in which each row of classes is entered, the first at START.

    Every row becomes a map from 13 states to 13; maps are composed over
    doubling distances until each row has that of all rows before it.
    """
    rows = len(classes)
    maps = np.broadcast_to(np.arange(13, dtype=np.uint8), (rows, 13)).copy()
    for k in range(classes.shape[1]):
        maps = _TO_FLAT[maps.astype(np.intp) * 12 + classes[:, k, None]]
        if k % 8 == 7 and (maps == maps[:, :1]).all():  # every entry state leads to the same one
            state = maps[:, 0]
            for j in range(k + 1, classes.shape[1]):
                state = _TO_FLAT[state.astype(np.intp) * 12 + classes[:, j]]
            maps = np.repeat(state[:, None], 13, axis=1)
            break
    step = 1
    while step < rows:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        step *= 2
    return np.concatenate((np.array([START], np.uint8), maps[:-1, START]))


def begins(classes: np.ndarray) -> np.ndarray:
    """At which characters pre-tokens begin; the last class must be END."""
    n = len(classes)
    rows = -(-n // CHUNK)
    padded = np.full(rows * CHUNK, END, np.uint8)
    padded[:n] = classes
    table = padded.reshape(rows, CHUNK)
    state = chunk_entries(table)
    marks = np.empty_like(table)
    for k in range(CHUNK):
        at = state.astype(np.intp) * 12 + table[:, k]
        marks[:, k] = _MARK_FLAT[at]
        state = _TO_FLAT[at]
    marks = marks.ravel()[:n]
    out = (marks & HERE).astype(bool)
    out[:-1] |= (marks[1:] & BEFORE).astype(bool)
    return out


class Classes:
    """The class of each character, found out from the library's own cutting for characters beyond ASCII."""

    def __init__(self, cut):
        self.cut = cut
        self.table = np.full(0x110000, 255, np.uint8)
        for c in range(128):
            s = chr(c)
            self.table[c] = BLANK if s == " " else WHITE if s in "\t\n\x0b\x0c\r" else QUOTE if s == "'" else DIGIT if s.isdigit() else LETTER if s.isalpha() else SIGN
        for s, c in (("s", STMD), ("t", STMD), ("m", STMD), ("d", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
            self.table[ord(s)] = c

    def of(self, points: np.ndarray) -> np.ndarray:
        out = self.table[points]
        if (out == 255).any():
            for p in np.unique(points[out == 255]):
                self.table[p] = self._found(chr(p))
            out = self.table[points]
        return out

    def _found(self, s: str) -> int:
        for before, c in (("a", LETTER), ("1", DIGIT), ("!", SIGN)):
            if len(self.cut(before + s)) == 1:
                return c
        return WHITE


# -- the transducer over bytes -------------------------------------------------


class TokenMachine:
    """Counts the tokens of pre-tokens."""

    def __init__(self, spec: dict):
        vocab: dict[str, int] = spec["model"]["vocab"]
        byte = {c: b for b, c in enumerate(byte_characters())}
        strings = {k: bytes(byte[c] for c in piece) for piece, k in vocab.items() if all(c in byte for c in piece)}
        special = {t["id"] for t in spec["added_tokens"]}
        size = 1 + max(strings)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for k, (a, b) in enumerate(pairs):
            self.rank[vocab[a], vocab[b]] = k
            made.setdefault(vocab[a + b], (vocab[a], vocab[b], k))
        self.made = made
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for k, text in strings.items():
            if k in special or len(text) > 1 and k not in made:
                continue
            node = 0
            for b in text:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = self.children[node][b]
            self.token_at[node] = k
        self.never = size + 1
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[bytes, int] = {}
        self.content: list[bytes] = []
        self.step: dict[int, int] = {}
        self._pairs.clear()
        self._state([(0, -1, 0)])

    def _state(self, items: list[tuple[int, int, int]]) -> int:
        key = array("i", [x for item in items for x in item]).tobytes()
        got = self.states.get(key)
        if got is None:
            got = self.states[key] = len(self.content)
            self.content.append(key)
        return got

    def _spine(self, token: int, side: int, kept: dict) -> list[tuple[int, int]]:
        """The symbols that stand at a token's edge while it grows, from last to first, each with the merge that ends it."""
        got = kept.get(token)
        if got is None:
            got, end, now = [], 1 << 60, token
            while True:
                got.append((now, end))
                if now not in self.made:
                    break
                a, b, end = self.made[now]
                now = b if side else a
            kept[token] = got
        return got

    def follows(self, first: int, second: int) -> bool:
        """Whether two tokens side by side stay two: no merge across the seam comes before those that build them.

        Of equal merges the left one comes first, which takes the symbol left of the seam away but not that right of it.
        """
        got = self._pairs.get((first, second))
        if got is None:
            got = True
            rank = self.rank
            for a, end_a in self._spine(first, 1, self._right):
                for b, end_b in self._spine(second, 0, self._left):
                    r = rank.get((a, b))
                    if r is not None and r < end_a and r <= end_b:
                        got = False
            self._pairs[first, second] = got
        return got

    def _compile(self, state: int, byte: int) -> int:
        """The transition: next state in the high bits, the change of the count plus 2**19 in the low 20."""
        items = array("i")
        items.frombytes(self.content[state])
        on, token, best = [], -1, 0
        for k in range(0, len(items), 3):
            node = self.children[items[k]].get(byte)
            if node is None:
                continue
            t = self.token_at[node]
            if t >= 0 and (items[k + 1] < 0 or self.follows(items[k + 1], t)):
                token, best = t, items[k + 2] + 1
            if self.children[node]:
                on.append((node, items[k + 1], items[k + 2]))
        if token < 0:
            raise ValueError("the vocabulary doesn't cover a byte")
        on = [(node, last, count - best) for node, last, count in on]
        on.append((0, token, 0))
        out = self.step[state << 8 | byte] = self._state(on) << 20 | (best + (1 << 19))
        return out

    def count(self, piece: bytes) -> int:
        total, state, step = 0, 0, self.step
        for b in piece:
            x = step.get(state << 8 | b)
            if x is None:
                x = self._compile(state, b)
            total += (x & 0xFFFFF) - 524288
            state = x >> 20
        return total


class Counter:
    """Token counts of whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.machine = TokenMachine(spec)
        self.classes = Classes(Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str)
        strings = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, strings))) if strings else None
        self.marks = strings
        self.kept: dict[bytes, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        extra, parts, owner = [0] * len(texts), [], []
        for k, text in enumerate(texts):
            if any(m in text for m in self.marks):
                found = self.special.split(text)
                extra[k] = len(found) - 1
            else:
                found = [text]
            for part in found:
                if part:
                    parts.append(part)
                    owner.append(k)
        if not parts:
            return extra
        joined = "\0".join(parts) + "\0"  # a place for END after each part
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        classes = self.classes.of(points)
        classes[ends] = END
        mark = np.flatnonzero(begins(classes))
        width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        byte_at = np.concatenate(([0], np.cumsum(width)))
        raw = joined.encode()
        cuts = byte_at[mark].tolist()
        pieces = [raw[a:b] for a, b in zip(cuts, cuts[1:] + [len(raw)])]
        ended = np.searchsorted(mark, ends)  # the END characters are pieces of their own
        if len(self.kept) > KEPT_PIECES:
            self.kept = dict(list(self.kept.items())[KEPT_PIECES // 2:])
        if len(self.machine.content) > KEPT_STATES:
            self.machine.reset()
        known = self.kept
        count = self.machine.count
        long = {}
        for piece in set(pieces).difference(known):
            if len(piece) <= KEPT_BYTES:
                known[piece] = count(piece)
            else:
                long[piece] = count(piece)
        if long:
            known = known | long
        got = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        got[ended] = 0
        total = np.concatenate(([0], np.cumsum(got)))
        upto = total[ended]
        per_part = np.diff(np.concatenate(([0], upto)))
        out = np.array(extra, np.int64)
        np.add.at(out, np.array(owner), per_part)
        return out.tolist()


@functools.lru_cache(maxsize=1)
def counter_of_worker(path: str) -> Counter:
    """One for all tasks that a Python worker runs."""
    return Counter(path)


def counted(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    counter = counter_of_worker(path)
    for batch in slices(batches):
        column = batch.column("text").fill_null("")
        n_tokens = np.array(counter.counts(column.to_pylist()), np.int64)
        n_bytes = np.diff(Texts(column).off)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """Per document (columns doc_id, text): bytes, tokens, and whether there are more tokens than `limit`."""
    return pick(docs, "doc_id", "text").mapInArrow(lambda it: counted(it, path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
