"""Join of documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more.

A grouped prefix join.  Shingles are put in one order, rare ones first, in which
two sets as similar as that share one of the first n - ceil(0.75 n) + 1 of either:
its prefix.  Documents with equal size and prefix are one group; groups that share
a prefix shingle and whose sizes are near enough are a pair; pairs are expanded to
their members.  Members are compared by parity bitmaps (an exact upper bound of what
they can share) of as many bits as they have shingles, and those that these leave by
their whole sets.  Documents with equal sets are one member, the class, named by its
smallest doc_id.

The order takes shingles that many documents have last.  Which those are is
counted over all documents: every task sends its shingles as sorted, packed keys by
key range, and all that FREQUENT_FROM documents have go to all tasks (of more than
FREQUENT, a bounded list, the most frequent ones).
Any order gives the same result; this one keeps common passages out of prefixes.

The result needs what hangs together, not every link, so a shingle with many
groups is not turned into all their pairs.  The groups are read as a sorted
stream in which the first few, the pivots, are paired with all others; what that
leaves open is done in further rounds with more pivots, over those lists alone that
still hold several components, dealt over tasks in cells of pivots and members, and with pairs only between different components
whose bitmaps allow the similarity.  The rounds end when no list is open, so that no link
between components is missed.

Cases: null, empty and blank texts have no shingles and are linked with nothing;
texts of 1 to 4 words have their whole sequence as one shingle; rows that repeat a
doc_id are one document with the links of all of them; a row with null doc_id is
returned with null component_id and linked with nothing; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .shared import hashed_side, partitions, stored
from .textkernel import U64, Texts, mix, numbered, pick, signed, slices, windows

WORDS = 5
#: Similarity in percent.
PERCENT = 75
#: Shingles that are ordered by their count, after all others.
FREQUENT = 1 << 22
#: Shingles that fewer documents have are not counted as frequent.
FREQUENT_FROM = 9
#: Bits of a shingle's hash that its count goes by.
KEY_BITS = 36
#: Pivots of a list in the first round, the second, and each one after that.
PIVOTS, FEW, MANY = 8, 64, 1 << 16
#: Pivots and members of a list that meet in a task's cell, in mean: pivots, members in short rounds (in long ones as pivots).
BLOCK, CHUNK = 4096, 1024
#: Bits of a member's parity bitmap, at least.
BITMAP = 1024
#: Ids that are broadcast to choose texts by; by more, texts are shuffled.
SENT_IDS = 1 << 20
#: Bits of a shingle's hash in the table that tells what can't be frequent.
COARSE_BITS = 24
SIZE_MASK = (1 << 24) - 1

COUNT_BITS = U64(64 - KEY_BITS)
COUNT_MASK = U64((1 << (64 - KEY_BITS)) - 1)

_FACTOR = 0xB492B66FBE98F273
_DOC = U64(0x9AE16A3B2F90404F)


def shingles(t: Texts, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a slice of split texts with repeats, and each one's text (row of the slice)."""
    h, doc = t.word_hashes(lower=True), t.doc_of_words()
    if not len(h):
        return h, doc
    w = windows(h, words, _FACTOR)
    inside = np.flatnonzero(doc[:len(w)] == doc[words - 1:]) if len(w) else np.zeros(0, np.int64)
    out, of = [w[inside]], [doc[inside]]
    count = np.diff(t.first)
    for n in range(1, words):
        short = np.flatnonzero(count == n)
        value = np.full(len(short), n, U64)
        for k in range(n):
            value = mix(value * U64(_FACTOR) + h[t.first[short] + k])
        out.append(value)
        of.append(short)
    return np.concatenate(out), np.concatenate(of)


def sets(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, by text and value; each one's text; where each text's begin, with the end."""
    value, doc = shingles(t)
    order = np.argsort(doc, kind="stable")  # all but short texts are in order
    value, doc = value[order], doc[order]
    at = np.searchsorted(doc, np.arange(t.n + 1)).tolist()
    for a, b in zip(at[:-1], at[1:]):
        value[a:b].sort()
    if len(value):
        new = np.concatenate(([True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])))
        value, doc = value[new], doc[new]
    return value, doc, np.searchsorted(doc, np.arange(t.n + 1))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, U64), np.cumsum(values, dtype=U64)))
    return total[at[1:]] - total[at[:-1]]


# -- which shingles are frequent -----------------------------------------------


def planes(values: np.ndarray) -> bytes:
    """First bytes of all values, then second ones and so on: these compress better."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _packed(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Distinct keys of shingles, as differences, and how many documents have them, compressed: one row for each key range and few million shingles."""
    held: list[np.ndarray] = []
    size = 0

    def rows() -> pa.RecordBatch:
        keys, times = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        width = -(-(1 << KEY_BITS) // ranges)
        cut = np.searchsorted(keys, np.arange(ranges + 1, dtype=np.uint64) * U64(width))
        part, blob, count = [], [], []
        for k in np.flatnonzero(np.diff(cut)):
            step = np.diff(keys[cut[k]:cut[k + 1]], prepend=U64(k * width)).astype("<u4" if width < 1 << 32 else "<u8")
            plain = planes(step) + planes(times[cut[k]:cut[k + 1]].astype("<u4"))
            part.append(int(k))
            blob.append(pa.compress(plain, "zstd", asbytes=True))
            count.append(len(step))
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(count, pa.int32()), pa.array(blob, pa.binary())], ["part", "n", "keys"])

    for batch in slices(batches):
        value, _, _ = sets(Texts(batch.column("text")).split())
        held.append(value >> U64(64 - KEY_BITS))
        size += len(value)
        if size >= max(4_000_000, 16 * ranges):
            yield rows()
            size = 0
    if size:
        yield rows()


def _counts(ranges: int):
    width = -(-(1 << KEY_BITS) // ranges)
    kind = "<u4" if width < 1 << 32 else "<u8"

    def count(table: pa.Table) -> pa.Table:
        both = []
        size = np.dtype(kind).itemsize
        for part, n, blob in zip(table.column("part").to_pylist(), table.column("n").to_pylist(), table.column("keys")):
            plain = np.frombuffer(pa.decompress(blob.as_buffer(), n * (size + 4), "zstd", asbytes=True), np.uint8)
            step, count = (np.ascontiguousarray(x.reshape(-1, n).T).view(k).ravel() for x, k in ((plain[:n * size], kind), (plain[n * size:], "<u4")))
            key = np.cumsum(step.astype(U64)) + U64(part * width)
            both.append(key << COUNT_BITS | np.minimum(count.astype(U64), COUNT_MASK))  # one number sorts faster than two
        flat = np.sort(np.concatenate(both))
        key, times = flat >> COUNT_BITS, (flat & COUNT_MASK).astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.add.reduceat(times, begin)
        often = n >= FREQUENT_FROM
        return pa.table({"key": pa.array(key[begin[often]].astype(np.int64)), "n": pa.array(n[often])})

    return count


def frequent(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, and counts of the most frequent shingles: at most FREQUENT, of equal counts all or none."""
    ranges = min(1 << 20, 4 * partitions(texts.sparkSession))  # a task holds the keys of one
    packed = texts.select("text").mapInArrow(lambda it: _packed(it, ranges), "part int, n int, keys binary")
    counted = stored(packed.groupBy("part").applyInArrow(_counts(ranges), "key long, n long"), "counted")
    room, least = FREQUENT, 1 << 62
    for n, keys in sorted(map(tuple, counted.groupBy("n").count().collect()), reverse=True):
        room -= keys
        if room < 0:
            break
        least = n
    top = counted.where(F.col("n") >= least).toArrow()
    key, n = top.column("key").to_numpy().astype(U64), top.column("n").to_numpy()
    order = np.argsort(key)
    return key[order], np.minimum(n[order], (1 << 32) - 1).astype(np.uint32)


# -- members, groups and prefixes ----------------------------------------------


class Order:
    """Counts of the frequent shingles by value, 0 for all others."""

    def __init__(self, often: tuple[np.ndarray, np.ndarray]):
        self.keys, self.counts = often
        self.coarse = np.zeros(1 << COARSE_BITS if len(self.keys) else 1, bool)
        self.coarse[(self.keys >> U64(KEY_BITS - COARSE_BITS)).astype(np.int64)] = True

    def hits(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the frequent ones, and their counts."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        maybe = np.flatnonzero(self.coarse[(value >> U64(64 - COARSE_BITS)).astype(np.int64)])
        key = value[maybe] >> U64(64 - KEY_BITS)
        found = np.searchsorted(self.keys, key)
        found[found == len(self.keys)] = 0
        hit = self.keys[found] == key
        return maybe[hit], self.counts[found[hit]]


class Prefixes:
    """Sets and prefixes of a slice of texts in the order that puts frequent shingles last."""

    def __init__(self, t: Texts, often: Order):
        value, doc, at = sets(t)
        self.value, self.value_doc, self.value_at = value, doc, at
        self.size = np.diff(at)
        self.one, self.two = _sums(mix(value), at), _sums(mix(value ^ _DOC), at)
        hit, count = often.hits(value)
        hit = hit[np.lexsort((value[hit], count, doc[hit]))]
        rare = np.ones(len(value), bool)
        rare[hit] = False
        before = np.concatenate((np.zeros(1, np.int64), np.cumsum(rare)))
        place = before[:-1] - before[at[doc]]
        last = np.searchsorted(doc[hit], np.arange(t.n))
        place[hit] = (before[at[1:]] - before[at[:-1]])[doc[hit]] + np.arange(len(hit)) - last[doc[hit]]
        length = self.size - -(-self.size * PERCENT // 100) + 1
        length[self.size == 0] = 0
        take = place < length[doc]
        self.token, self.doc = value[take], doc[take]
        self.at = np.searchsorted(self.doc, np.arange(t.n + 1))
        group = mix(_sums(mix(self.token), self.at) + self.size.astype(U64) * _DOC)
        self.group = (group & ~U64(SIZE_MASK)) | np.minimum(self.size, SIZE_MASK).astype(U64)


def bitmaps(value: np.ndarray, doc: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Parity bitmaps of sets: for each text BITMAP bits or more, a power of two that is no less than its size."""
    size = np.diff(at)
    bits = np.left_shift(BITMAP, np.maximum(0, np.ceil(np.log2(np.maximum(size, 1) / BITMAP)).astype(np.int64)))
    begin = np.concatenate((np.zeros(1, np.int64), np.cumsum(bits // 8)))
    bit = (value & (bits[doc] - 1).astype(U64)).astype(np.int64)
    flat = np.zeros(begin[-1], np.uint8)
    np.bitwise_xor.at(flat, begin[doc] + (bit >> 3), np.left_shift(1, bit & 7).astype(np.uint8))
    plain = flat.tobytes()
    return [plain[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]


def folded(bitmap: bytes, size: int) -> bytes:
    """The bitmap of the same set with fewer bits: `size` bytes."""
    return bitmap if len(bitmap) == size else np.bitwise_xor.reduce(np.frombuffer(bitmap, np.uint8).reshape(-1, size)).tobytes()


def _rows(batches: Iterator[pa.RecordBatch], often) -> Iterator[pa.RecordBatch]:
    """What is kept of each text, and its prefix, once for each group that the task met not long ago."""
    met: set[int] = set()
    order = Order(often)
    for batch in slices(batches):
        p = Prefixes(Texts(batch.column("text")).split(), order)
        fresh = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False) & (p.size > 0)
        plain, prefix = p.token.tobytes(), []
        for g, new, a, b in zip(p.group.tolist(), fresh.tolist(), (8 * p.at[:-1]).tolist(), (8 * p.at[1:]).tolist()):
            prefix.append(plain[a:b] if new and g not in met else None)
            if new:
                met.add(g)
        if len(met) > 200_000:
            met.clear()
        maps = pa.array(bitmaps(p.value, p.value_doc, p.value_at), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p.size), pa.array(signed(p.one)), pa.array(signed(p.two)), pa.array(signed(p.group)), maps, pa.array(prefix, pa.binary())], ["doc_id", "n_shingles", "one", "two", "grp", "bitmap", "prefix"])


def _prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle and group of each prefix."""
    for batch in batches:
        prefixes = batch.column("prefix").to_pylist()
        token = np.frombuffer(b"".join(prefixes), np.int64)
        group = np.repeat(batch.column("grp").to_numpy(), [len(x) // 8 for x in prefixes])
        for k in range(0, len(token), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(token[k:k + (1 << 17)]), pa.array(group[k:k + (1 << 17)])], ["token", "grp"])


def near_size(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads prefix rows sorted by shingle and group.

    Yields pairs of groups (a, b) that share a shingle, one of them among the
    shingle's first PIVOTS; and for shingles with more groups than those pairs
    settle, the shingle and all its groups (listed).
    Of the shingle that is being read, no more than its first groups are held.
    """
    seen: set[tuple[int, int]] = set()
    hold_t, hold_g = np.zeros(0, np.int64), np.zeros(0, np.int64)  # first groups of the open shingle, at most PIVOTS + 1
    count, last = 0, None  # groups of it so far, and the last
    for batch in batches:
        if not batch.num_rows:
            continue
        t, g = batch.column("token").to_numpy(), batch.column("grp").to_numpy()
        new = np.concatenate(([True], (t[1:] != t[:-1]) | (g[1:] != g[:-1])))
        if last == (t[0], g[0]):
            new[0] = False
        final = (t[-1], g[-1])
        t, g = t[new], g[new]
        if not len(t):
            continue
        goes_on = last is not None and last[0] == t[0]
        have = len(hold_t) if goes_on else 0
        skipped = count - have if goes_on else 0
        if goes_on:
            t, g = np.concatenate((hold_t, t)), np.concatenate((hold_g, g))
        begin = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        size = np.diff(np.append(begin, len(t)))
        start = np.repeat(begin, size)
        place = np.arange(len(t)) - start
        if skipped:
            place[have:size[0]] += skipped
        old = np.arange(len(t)) < have
        n = g & SIZE_MASK
        a, b = [], []
        for d in range(PIVOTS):
            k = np.flatnonzero((place > d) & ~old)
            k = k[near_size(n[start[k] + d], n[k])]
            a.append(g[start[k] + d])
            b.append(g[k])
        a, b = np.concatenate(a), np.concatenate(b)
        fresh = []
        for k, pair in enumerate(zip(a.tolist(), b.tolist())):
            if pair not in seen:
                seen.add(pair)
                fresh.append(k)
        if len(seen) > 300_000:
            seen.clear()
        if fresh:
            yield pa.RecordBatch.from_arrays([pa.array(a[fresh]), pa.array(b[fresh]), pa.array(np.zeros(len(fresh), bool))], ["a", "b", "listed"])
        # lists: rows from the one past the pivots on, and with that one those before it
        total = size.copy()
        total[0] += skipped
        many = np.repeat(total > PIVOTS + 1, size)
        told_before = np.zeros(len(t), bool)
        told_before[:have] = bool(skipped) or count > PIVOTS + 1
        out = np.flatnonzero(many & ~told_before)
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(t[out]), pa.array(g[out]), pa.array(np.ones(len(out), bool))], ["a", "b", "listed"])
        tail = slice(begin[-1], min(begin[-1] + PIVOTS + 1, len(t)))
        hold_t, hold_g = t[tail], g[tail]
        count, last = int(total[-1]), final


def prefix_pairs(sets: DataFrame) -> DataFrame:
    rows = sets.where("prefix IS NOT NULL").select("grp", "prefix").mapInArrow(_prefix_rows, "token long, grp long")
    rows = rows.repartition(partitions(sets.sparkSession), "token").sortWithinPartitions("token", "grp")
    return stored(rows.mapInArrow(_pairs, "a long, b long, listed boolean"), "prefix-pairs")


# -- verification --------------------------------------------------------------


def shareable(total: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether sets of `total` shingles together, whose bitmaps differ in `apart` bits, could be similar enough."""
    return (100 + PERCENT) * ((total - apart) // 2) >= PERCENT * total


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both sizes and bitmaps, those that could be similar enough."""
    for batch in batches:
        n_u, n_v = batch.column("size_u").to_numpy(), batch.column("size_v").to_numpy()
        maps_u, maps_v = batch.column("bitmap_u").to_pylist(), batch.column("bitmap_v").to_pylist()
        width = np.fromiter((min(len(a), len(b)) for a, b in zip(maps_u, maps_v)), np.int64, batch.num_rows)
        good = np.zeros(batch.num_rows, bool)
        for w in np.unique(width).tolist():
            k = np.flatnonzero((width == w) & near_size(n_u, n_v))
            for part in np.array_split(k, 1 + len(k) * w // (4 << 20)):
                a, b = (np.frombuffer(b"".join(folded(m[i], w) for i in part.tolist()), np.uint64).reshape(-1, w // 8) for m in (maps_u, maps_v))
                good[part] = shareable(n_u[part] + n_v[part], np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64))
        yield batch.select(["u", "v"]).filter(pa.array(good))


def plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (u, v) of class ids that could be similar enough."""
    sides = [classes.select(F.col("id").alias(s), F.col("n_shingles").alias(f"size_{s}"), F.col("bitmap").alias(f"bitmap_{s}")) for s in "uv"]
    return pairs.join(sides[0], "u").join(sides[1], "v").mapInArrow(_plausible, "u long, v long").distinct()


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, so that little is moved; of rows with equal id and text that a task meets, one."""
    met: set[tuple[int, bytes]] = set()
    for batch in slices(batches):
        ids, sizes, blobs = [], [], []
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            plain = text.as_buffer() or b""
            told = (key, hashlib.blake2b(plain, digest_size=8).digest())
            if told not in met:
                met.add(told)
                ids.append(key)
                sizes.append(len(plain))
                blobs.append(pa.compress(plain, "zstd", asbytes=True))
        if len(met) > 500_000:
            met.clear()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], ["id", "bytes", "blob"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both texts, those that are similar enough."""
    for batch in batches:
        k = 0
        size = batch.column("bytes_u").to_numpy() + batch.column("bytes_v").to_numpy()
        ends = np.cumsum(size)
        while k < batch.num_rows:
            j = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + (2 << 20), "right")))
            part = batch.slice(k, j - k)
            k = j
            place: dict[bytes, int] = {}  # a text that many pairs have is taken apart once
            texts: list[bytes] = []
            side = np.zeros(2 * part.num_rows, np.int64)
            for s, name in enumerate("uv"):
                for i, (blob, n) in enumerate(zip(part.column(f"blob_{name}").to_pylist(), part.column(f"bytes_{name}").to_pylist())):
                    if blob not in place:
                        place[blob] = len(texts)
                        texts.append(pa.decompress(blob, n, "zstd", asbytes=True) if n else b"")
                    side[2 * i + s] = place[blob]
            value, _, at = sets(Texts(pa.array(texts, pa.binary()).cast(pa.string())).split())
            length = np.diff(at)[side]
            stop = np.cumsum(length)
            both = value[np.repeat(at[side] - (stop - length), length) + np.arange(stop[-1])]  # each pair's sets in a row
            stop = np.concatenate((np.zeros(1, np.int64), stop[1::2]))
            for a, b in zip(stop[:-1].tolist(), stop[1:].tolist()):
                both[a:b].sort()
            same = np.concatenate((np.zeros(1, np.int64), np.cumsum(both[1:] == both[:-1]), np.zeros(1, np.int64)))
            # equal neighbours inside a pair: the one at a pair's beginning has its neighbour in the pair before
            common = np.where(np.diff(stop) > 0, same[np.maximum(stop[1:] - 1, 0)] - same[np.minimum(stop[:-1], len(same) - 1)], 0)
            union = np.diff(stop) - common
            good = pa.array((100 * common >= PERCENT * union) & (union > 0))
            yield part.select(["u", "v"]).filter(good)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) of stored ones whose texts are similar enough."""
    ids = stored(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct(), "needed")
    n = ids.count()
    few = F.broadcast(ids) if n <= SENT_IDS else hashed_side(ids, 100 * n)
    members = stored(texts.join(few, "doc_id", "left_semi").mapInArrow(_zipped, "id long, bytes long, blob binary"), "members")
    u = members.select(F.col("id").alias("u"), F.col("bytes").alias("bytes_u"), F.col("blob").alias("blob_u"))
    v = members.select(F.col("id").alias("v"), F.col("bytes").alias("bytes_v"), F.col("blob").alias("blob_v"))
    return pairs.join(u, "u").join(v, "v").select("u", "v", "bytes_u", "blob_u", "bytes_v", "blob_v").mapInArrow(_verified, "u long, v long")


# -- rounds over long lists ----------------------------------------------------


def dealt(rows: DataFrame, start: int, stop: int) -> DataFrame:
    """Members of lists (list, n, id, root, size, bitmap) dealt to cells of bounded size, in which a list's pivots meet its members.

    A member's place in its list, from 0 to its n, goes by a hash; pivots are those with a
    place from start to stop.  A cell holds BLOCK or so of them and `chunk` or so
    members with later places, so that a list of any length is dealt over many tasks.
    """
    chunk = max(CHUNK, min(BLOCK, stop - start))
    place = F.pmod(F.xxhash64("list", "id"), F.lit(1 << 40)) * F.col("n") / float(1 << 40)
    rows = rows.withColumn("place", place).where(F.col("place") >= start)
    block = lambda x: F.floor((x - start) / BLOCK).cast("int")
    blocks = F.least(block(F.least(F.col("n"), F.lit(stop)) - 1), block(F.col("place")))
    members = rows.select("*", F.lit(False).alias("pivot"), F.explode(F.sequence(F.lit(0), blocks)).alias("block"), F.floor(F.col("place") / chunk).cast("int").alias("chunk"))
    chunks = F.sequence(F.floor(F.col("place") / chunk).cast("int"), F.floor((F.col("n") - 1) / chunk).cast("int"))
    pivots = rows.where(F.col("place") < stop).select("*", F.lit(True).alias("pivot"), block(F.col("place")).alias("block"), F.explode(chunks).alias("chunk"))
    both = members.unionByName(pivots)
    cell = ["list", "block", "chunk"]
    return both.repartition(partitions(rows.sparkSession), *cell).sortWithinPartitions(*cell, F.desc("pivot"), "id")


def _pivot_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a cell's pivots with its members at later places, of other components, that could be similar."""
    now, have = None, 0
    ids, roots, sizes, places, maps = _grown(None, 64)
    found: list[tuple[np.ndarray, int]] = []
    held = 0

    def pairs() -> pa.RecordBatch:
        u = np.concatenate([f[0] for f in found])
        v = np.repeat(np.array([f[1] for f in found]), [len(f[0]) for f in found])
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cells = list(zip(*(batch.column(k).to_pylist() for k in ("list", "block", "chunk"))))
        members, tops, n_of, at = (batch.column(k).to_numpy() for k in ("id", "root", "size", "place"))
        pivot = batch.column("pivot").to_pylist()
        bits = np.frombuffer(b"".join(folded(m, BITMAP // 8) for m in batch.column("bitmap").to_pylist()), np.uint64).reshape(-1, BITMAP // 64)
        for k in range(batch.num_rows):
            if cells[k] != now:
                now, have = cells[k], 0
            if pivot[k]:
                if have == len(ids):
                    ids, roots, sizes, places, maps = _grown((ids, roots, sizes, places, maps), 2 * have)
                ids[have], roots[have], sizes[have], places[have], maps[have] = members[k], tops[k], n_of[k], at[k], bits[k]
                have += 1
            elif have:
                earlier = (places[:have] < at[k]) | ((places[:have] == at[k]) & (ids[:have] < members[k]))
                other = np.flatnonzero(earlier & (roots[:have] != tops[k]) & near_size(sizes[:have], n_of[k]))
                apart = np.bitwise_count(maps[other] ^ bits[k]).sum(axis=1, dtype=np.int64)
                good = other[shareable(sizes[other] + n_of[k], apart)]
                if len(good):
                    found.append((ids[good], int(members[k])))
                    held += len(good)
                    if held > 1 << 16:
                        yield pairs()
                        held = 0
    if found:
        yield pairs()


def _grown(old, size: int):
    new = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size), np.zeros((size, BITMAP // 64), np.uint64)
    for a, b in zip(old or (), new):
        b[:len(a)] = a
    return new


def linked(texts: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """(id, root) of all classes that are similar to another, from pairs of groups and lists of groups."""
    spark = texts.sparkSession
    placed = classes.select("id", "grp", "place")
    groups = placed.groupBy("grp").agg(F.max("place").alias("n"))
    own = groups.where("n > 1").select(F.col("grp").alias("a"), F.col("grp").alias("b"))
    pairs = found.where("NOT listed").select("a", "b").distinct().unionByName(own)
    left = placed.select(F.col("grp").alias("a"), F.col("id").alias("u"), F.col("place").alias("p"))
    right = placed.select(F.col("grp").alias("b"), F.col("id").alias("v"), F.col("place").alias("q"))
    first = pairs.join(left.where(F.col("p") <= PIVOTS), "a").join(right.where(F.col("q") <= PIVOTS), "b")
    first = first.where("a <> b OR u < v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    first = stored(plausible(first, classes), "pairs")
    # lists for the later rounds: shingles with many groups, groups with many members, pairs with such a group
    big = groups.where(F.col("n") > PIVOTS).select("grp")
    lists = found.where("listed").select(F.col("a").alias("list"), F.col("b").alias("grp"))
    with_big = pairs.join(big.withColumnRenamed("grp", "a"), "a", "left_semi").unionByName(pairs.join(big.withColumnRenamed("grp", "b"), "b", "left_semi")).distinct()
    key = F.xxhash64("a", "b").alias("list")
    lists = lists.unionByName(with_big.select(key, F.col("a").alias("grp"))).unionByName(with_big.select(key, F.col("b").alias("grp"))).distinct()
    lists = stored(lists.join(placed, "grp").select("list", "id").distinct(), "lists")
    links = stored(verified(first, texts), "links")
    roots = components(links)
    start, stop = 0, FEW
    while True:
        labelled = lists.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
        open_ = labelled.groupBy("list").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n")).where(f"a <> b AND n > {start}")
        lists = stored(labelled.join(open_.select("list", "n"), "list").select("list", "n", "id", "root"), "lists")
        if lists.isEmpty():
            return roots
        rows = dealt(lists.join(classes.select("id", F.col("n_shingles").alias("size"), "bitmap"), "id"), start, stop)
        more = stored(plausible(rows.mapInArrow(_pivot_pairs, "u long, v long").distinct(), classes), "pairs")
        if not more.isEmpty():
            links = stored(links.unionByName(verified(more, texts)), "links")
            roots = components(links)
        lists = lists.select("list", "id")
        start, stop = stop, stop + MANY


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document (columns doc_id, text): doc_id, n_shingles, component_id."""
    texts = pick(docs, "doc_id", "text")
    often = frequent(texts)
    rows = stored(texts.mapInArrow(lambda it: _rows(it, often), "doc_id long, n_shingles long, one long, two long, grp long, bitmap binary, prefix binary"), "sets")
    classes = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "one", "two", "grp").agg(F.min("doc_id").alias("id"), F.first("bitmap").alias("bitmap"))
    classes = stored(classes.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy("id"))), "classes")
    roots = linked(texts, classes, prefix_pairs(rows))
    names = classes.join(roots, "id", "left").select("n_shingles", "one", "two", "id", F.coalesce("root", "id").alias("root"))
    # rows that repeat a doc_id with other sets are one document, whose classes hang together
    links = rows.where("n_shingles > 0").join(names, ["n_shingles", "one", "two"]).select(F.col("doc_id").alias("u"), F.col("root").alias("v"))
    again = links.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b")
    out = rows.drop("bitmap", "prefix").join(names, ["n_shingles", "one", "two"], "left")
    if not again.isEmpty():
        merged = components(links.unionByName(names.select(F.col("id").alias("u"), F.col("root").alias("v"))))
        out = out.join(merged.select(F.col("id").alias("doc_id"), F.col("root").alias("merged")), "doc_id", "left").withColumn("root", F.coalesce("merged", "root"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of the documents that links hold together, the one with the smallest doc_id, with all columns.

    Of rows that repeat its doc_id one stays, by the hash of its text; rows with null doc_id are linked with nothing and all stay.
    """
    kept = stored(near_duplicates(docs).where("component_id = doc_id").select("doc_id").distinct(), "kept")
    same, name = numbered(docs)
    key, text = name("doc_id"), name("text")
    rows = same.join(hashed_side(kept, 100 * kept.count()), same[key] == kept["doc_id"], "left_semi")
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(text), text))
    one = rows.withColumn("nth", nth).where("nth = 1").drop("nth")
    return one.unionByName(same.where(F.col(key).isNull())).toDF(*docs.columns)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
