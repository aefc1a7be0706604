"""Token ids as wavelet matrices, one compressed file per shard.

A shard is a run of whole documents in ascending order.  Its ids are stored as a
wavelet matrix: one bit-plane per id bit, from the highest, each with the counts
of ones before every block.  That answers, from the one file: the id at a
position (access), how often an id occurs in a range (count), and where its k-th
occurrence is (select), beside reading whole runs.

Spark range-partitions the documents by id, and each task encodes and writes its
own shards; only one count per task reaches the driver.  Files are Parquet with
one shard per file, so that Spark's commit protocol holds when executors are lost
and any store that Spark can write will do.

Cases: null and empty texts hold just the end id; repeated rows are encoded one
by one, ties in doc_id ordered by text; null doc_ids come first; an empty table
gives an empty result; extra columns are ignored.  A document with more ids than
a shard has a shard of its own.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_codec import byte_characters, cut_plain, plain_words
from .shared import partitions, shared_folder
from .textkernel import Texts, pick, slices

#: Ids in a shard; the document that crosses this ends it.
SHARD_IDS = 1 << 21
#: Words whose ids a Python worker keeps.
KEPT_WORDS = 400_000
KEPT_BYTES = 64
END_ID = 2

MAGIC = b"WVM1"
BLOCK = 512  # bits between stored counts


class WaveletMatrix:
    """Ids 0 <= id < 2**32 as bit-planes with rank and select."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        width = max(1, int(ids.max()).bit_length()) if n else 1
        x = ids.astype(np.uint16 if width <= 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for bit in range(width - 1, -1, -1):
            one = (x >> x.dtype.type(bit) & x.dtype.type(1)).astype(bool)
            planes.append(np.packbits(one, bitorder="little"))
            ranks.append(cls._counts(planes[-1]))
            low = x[~one]
            zeros.append(len(low))
            x = np.concatenate((low, x[one]))
        return cls(n, planes, zeros, ranks)

    @staticmethod
    def _counts(plane: np.ndarray) -> np.ndarray:
        """Ones before each block, and in all."""
        step = BLOCK // 8
        padded = np.zeros(-(-len(plane) // step) * step, np.uint8)
        padded[:len(plane)] = plane
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, step // 8).sum(axis=1, dtype=np.uint32)
        return np.concatenate((np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)))

    def dump(self) -> bytes:
        head = MAGIC + struct.pack("<QI", self.n, len(self.planes)) + struct.pack(f"<{len(self.zeros)}Q", *self.zeros)
        return b"".join([head, *(r.astype("<u4").tobytes() for r in self.ranks), *(p.tobytes() for p in self.planes)])

    @classmethod
    def load(cls, blob: bytes) -> WaveletMatrix:
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        n, width = struct.unpack_from("<QI", blob, 4)
        zeros = list(struct.unpack_from(f"<{width}Q", blob, 16))
        at = 16 + 8 * width
        size = -(-n // 8)
        blocks = -(-size // (BLOCK // 8)) + 1
        ranks = [np.frombuffer(blob, "<u4", blocks, at + 4 * blocks * k) for k in range(width)]
        at += 4 * blocks * width
        return cls(n, [np.frombuffer(blob, np.uint8, size, at + size * k) for k in range(width)], zeros, ranks)

    def _bits(self, plane: int, at: np.ndarray) -> np.ndarray:
        return self.planes[plane][at >> 3] >> (at & 7).astype(np.uint8) & np.uint8(1)

    def rank1(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position in a plane."""
        at = np.asarray(at, np.int64)
        block = at // BLOCK
        out = self.ranks[plane][block].astype(np.int64)
        step = BLOCK // 8
        cols = np.arange(step)
        byte = block[..., None] * step + cols
        left = at - block * BLOCK
        bits = np.clip(left[..., None] - 8 * cols, 0, 8)
        mask = ((1 << bits) - 1).astype(np.uint8)
        data = self.planes[plane][np.minimum(byte, max(0, len(self.planes[plane]) - 1))] if self.n else np.zeros_like(mask)
        return out + np.bitwise_count(data & mask).sum(axis=-1, dtype=np.int64)

    def select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) zero or one in a plane."""
        ones = self.ranks[plane].astype(np.int64)
        have = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(have, k, "right")) - 1
        step = BLOCK // 8
        bits = np.unpackbits(self.planes[plane][block * step:(block + 1) * step], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(have[block])])

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at these positions."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.int64)
        for plane in range(len(self.planes)):
            one = self._bits(plane, at).astype(bool)
            before = self.rank1(plane, at)
            out = out << 1 | one
            at = np.where(one, self.zeros[plane] + before, at - before)
        return out

    def _down(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        if value >> len(self.planes):
            return 0, 0
        for plane in range(len(self.planes)):
            a, b = self.rank1(plane, np.array([lo, hi]))
            if value >> (len(self.planes) - 1 - plane) & 1:
                lo, hi = self.zeros[plane] + int(a), self.zeros[plane] + int(b)
            else:
                lo, hi = lo - int(a), hi - int(b)
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id among positions lo <= i < hi."""
        a, b = self._down(value, lo, self.n if hi is None else hi)
        return b - a

    def occurrences(self, value: int, lo: int = 0, hi: int | None = None) -> list[int]:
        """Positions of an id, ascending."""
        a, b = self._down(value, lo, self.n if hi is None else hi)
        out = []
        for at in range(a, b):
            for plane in range(len(self.planes) - 1, -1, -1):
                bit = value >> (len(self.planes) - 1 - plane) & 1
                at = self.select(plane, bit, at - self.zeros[plane] if bit else at)
            out.append(at)
        return out

    def all_ids(self) -> np.ndarray:
        """All ids in order, by undoing the planes' partitions from the last to the first."""
        width = len(self.planes)
        kind = np.uint16 if width <= 16 else np.uint32
        x = np.zeros(self.n, kind)
        for plane in range(width - 1, -1, -1):
            one = np.unpackbits(self.planes[plane], count=self.n, bitorder="little").view(bool)
            y = np.empty_like(x)
            y[~one] = x[:self.zeros[plane]]
            y[one] = x[self.zeros[plane]:] | kind(1 << (width - 1 - plane))
            x = y
        return x


class LibraryEncoder:
    """Ids of texts by the tokenizers library.

    The file's tokenizer drops white space and never looks across it, so that each
    distinct word of a slice is encoded once, and words met before come from a
    bounded memory, found by two 64-bit hashes.  Plain words are cut into pieces
    here, as the library's rules cut them, and many are given to its model at once;
    all others go through the whole library one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.pieces = Tokenizer(self.library.model)
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        suffix = self.library.model.end_of_word_suffix
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.last = np.zeros(1 + max(vocabulary.values()), bool)  # ids that end a piece
        self.last[[k for s, k in vocabulary.items() if s.endswith(suffix)]] = True
        self.shown = {b: c for b, c in enumerate(byte_characters()) if b != 32}
        self.one = self.two = np.zeros(0, np.uint64)  # hashes of the words in memory, ascending by the first
        self.start = self.size = self.used = np.zeros(0, np.int64)  # their ids, and the slice that used them last
        self.ids = np.zeros(0, np.uint32)
        self.turn = 0

    def _plain(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words, and how many each has."""
        data, begin = cut_plain(data, off)
        blank = np.insert(data, begin[1:-1], 32).tobytes().decode("latin-1").translate(self.shown)
        some = begin[:-1][::4000] + np.arange(len(begin) - 1)[::4000]  # where every 4000th piece begins, with blanks
        got = self.pieces.encode_batch_fast([blank[a:b] for a, b in zip(some.tolist(), [*some[1:].tolist(), len(blank)])], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in got])
        ends = np.concatenate(([0], np.flatnonzero(self.last[ids]) + 1))
        if len(ends) != len(begin):
            raise ValueError("pieces and ids don't match")
        return ids, np.diff(ends[np.searchsorted(begin, off)])

    def _encoded(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has."""
        plain = plain_words(data, off)
        size = np.diff(off)
        ids = np.zeros(0, np.uint32)
        count = np.zeros(len(size), np.int64)
        if plain.any():
            ids, count[plain] = self._plain(data[np.repeat(plain, size)], np.concatenate(([0], np.cumsum(size[plain]))))
        if plain.all():
            return ids, count
        raw = data.tobytes()
        others = [raw[off[k]:off[k + 1]].decode() for k in np.flatnonzero(~plain)]
        got = [e.ids for e in self.library.encode_batch_fast(others, add_special_tokens=False)]
        count[~plain] = [len(g) for g in got]
        out = np.empty(count.sum(), np.uint32)
        out[np.repeat(plain, count)] = ids
        out[np.repeat(~plain, count)] = [i for g in got for i in g]
        return out, count

    def _forget(self) -> None:
        """Keeps the half of the words in memory that were used last."""
        keep = self.used >= np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]
        if keep.sum() > 0.75 * len(keep):
            keep = np.arange(len(keep)) % 2 == 0
        size = self.size[keep]
        ends = np.cumsum(size)
        self.ids = self.ids[np.arange(int(size.sum())) + np.repeat(self.start[keep] - ends + size, size)]
        self.one, self.two, self.used, self.size, self.start = self.one[keep], self.two[keep], self.used[keep], size, ends - size

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        t = Texts(column).split()
        if not len(t.start):
            return np.zeros(0, np.uint32), np.zeros(t.n, np.int64)
        self.turn += 1
        if len(self.one) > KEPT_WORDS or len(self.ids) > 20 * KEPT_WORDS:
            self._forget()
        one, two = t.word_hashes(), t.word_hashes(second=True)
        order = np.argsort(one)
        ranked = one[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        which = np.empty(len(one), np.int64)
        which[order] = np.cumsum(new) - 1
        one, first = ranked[new], order[new]
        same = two == two[first][which]
        two = two[first]
        if not same.all():  # two words with one hash: never in practice, but then the texts are encoded as they are
            got = [e.ids for e in self.library.encode_batch_fast([x or "" for x in column.to_pylist()], add_special_tokens=False)]
            return np.array([i for g in got for i in g], np.uint32), np.array([len(g) for g in got], np.int64)
        at = np.searchsorted(self.one, one)
        at[at == len(self.one)] = 0
        known = (self.one[at] == one) & (self.two[at] == two) if len(self.one) else np.zeros(len(one), bool)
        start, size = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        start[known], size[known] = self.start[at[known]], self.size[at[known]]
        self.used[at[known]] = self.turn
        new = np.flatnonzero(~known)
        if len(new):
            begin, length = t.start[first[new]], (t.end - t.start)[first[new]]
            off = np.concatenate(([0], np.cumsum(length)))
            got, count = self._encoded(t.data[np.arange(off[-1]) + np.repeat(begin - off[:-1], length)], off)
            size[new] = count
            start[new] = len(self.ids) + np.cumsum(count) - count
            self.ids = np.concatenate((self.ids, got))
            fresh = new[length <= KEPT_BYTES]
            fresh = fresh[self.one[at[fresh]] != one[fresh]] if len(self.one) else fresh
            order = np.argsort(np.concatenate((self.one, one[fresh])), kind="stable")
            self.one, self.two, self.start, self.size, self.used = (
                np.concatenate(pair)[order] for pair in ((self.one, one[fresh]), (self.two, two[fresh]), (self.start, start[fresh]), (self.size, size[fresh]), (self.used, np.full(len(fresh), self.turn)))
            )
        begin, size = start[which], size[which]
        ends = np.cumsum(size)
        ids = self.ids[np.arange(int(ends[-1])) + np.repeat(begin - ends + size, size)]
        return ids, np.diff(np.concatenate(([0], ends))[t.first])


@functools.lru_cache(maxsize=1)
def encoder_of_worker(path: str) -> LibraryEncoder:
    """One for all tasks that a Python worker runs, so that words met in one are known in the next."""
    return LibraryEncoder(path)


SHARD_SCHEMA = "part int, seq int, start_in_part long, n_tokens long, doc_ids array<long>, lengths array<long>, wavelet binary"


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> None:
    """Encodes all texts and writes them to `folder` in ascending doc_id order, one shard per file."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = encoder_of_worker(tokenizer), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        keys: list = []
        sizes: list[int] = []
        seq = start = 0

        def shard() -> pa.RecordBatch:
            nonlocal seq, start
            ids = np.concatenate(held)
            row = [[part], [seq], [start], [len(ids)], [list(keys)], [list(sizes)], [WaveletMatrix.build(ids).dump()]]
            seq, start = seq + 1, start + len(ids)
            held.clear(), keys.clear(), sizes.clear()
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["part", "seq", "start_in_part", "n_tokens", "doc_ids", "lengths", "wavelet"])

        n = 0
        for batch in slices(batches):
            ids, count = encoder.encode(batch.column("text"))
            ends = np.cumsum(count)
            out = np.insert(ids, ends, end_id)  # an end id after each document
            for key, size, stop in zip(batch.column("doc_id").to_pylist(), (count + 1).tolist(), (ends + np.arange(1, len(ends) + 1)).tolist()):
                if held and size >= shard_ids:  # it gets a shard of its own
                    yield shard()
                    n = 0
                held.append(out[stop - size:stop])
                keys.append(key)
                sizes.append(size)
                n += size
                if n >= shard_ids:
                    yield shard()
                    n = 0
        if held:
            yield shard()

    count = partitions(docs.sparkSession)
    order = pick(docs, "doc_id", "text").withColumn("_tie", F.xxhash64("text"))
    order = order.repartitionByRange(count, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").drop("_tie")
    order.mapInArrow(encode, SHARD_SCHEMA).write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(folder)
    base = _bases(shards)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, _, start, _, keys, sizes, blob = (c[k] for c in batch.columns)
                ids = WaveletMatrix.load(blob.as_buffer().to_pybytes()).all_ids().astype("<u4")
                sizes = sizes.values.to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                starts = base[part.as_py()] + start.as_py() + ends - sizes
                yield pa.RecordBatch.from_arrays([keys.values, pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _bases(shards: DataFrame) -> dict[int, int]:
    """How many ids come before each writing task's."""
    base, so_far = {}, 0
    for row in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # one row per writing task
        base[row.part] = so_far
        so_far += row.n
    return base


def occurrences(spark: SparkSession, folder: str, ids: list[int]) -> DataFrame:
    """Every occurrence of some ids, found in the files by rank and select without unpacking them: token_id, doc_id, start, at (place in the document), n_in_shard (count).

    Shards in which an id doesn't occur cost one count each.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(folder)
    base = _bases(shards)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, _, start, _, keys, sizes, blob = (c[k] for c in batch.columns)
                matrix = WaveletMatrix.load(blob.as_buffer().to_pybytes())
                ends = np.cumsum(sizes.values.to_numpy(zero_copy_only=False))
                for value in ids:
                    count = matrix.count(value)
                    if not count:
                        continue
                    at = np.array(matrix.occurrences(value), np.int64)
                    doc = np.searchsorted(ends, at, "right")
                    begin = ends[doc] - sizes.values.to_numpy(zero_copy_only=False)[doc]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(count, value, np.int64)), keys.values.take(pa.array(doc)), pa.array(begin + base[part.as_py()] + start.as_py()), pa.array(at - begin), pa.array(np.full(count, count, np.int64)),
                    ], ["token_id", "doc_id", "start", "at", "n_in_shard"])

    return shards.mapInArrow(find, "token_id long, doc_id long, start long, at long, n_in_shard long")


def tokens_at(spark: SparkSession, folder: str, positions: DataFrame) -> DataFrame:
    """The ids at positions (column position, from 0 over all documents), read by access: position, token_id. Positions beyond the end have no row."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(folder)
    bases = spark.createDataFrame(sorted(_bases(shards).items()), "part int, base long")
    spans = shards.join(F.broadcast(bases), "part").select("part", "seq", (F.col("base") + F.col("start_in_part")).alias("first"), "n_tokens")
    spans = spans.select("part", "seq", "first", F.explode(F.sequence(F.floor(F.col("first") / SHARD_IDS), F.floor((F.col("first") + F.col("n_tokens") - 1) / SHARD_IDS))).alias("cell"), (F.col("first") + F.col("n_tokens")).alias("stop"))
    asked = positions.select("position").where("position IS NOT NULL").withColumn("cell", F.floor(F.col("position") / SHARD_IDS))  # a join by equal cells, not by ranges
    found = asked.join(spans, "cell").where("position >= first AND position < stop").groupBy("part", "seq", "first").agg(F.collect_set("position").alias("positions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, first, wanted in zip(batch.column("wavelet"), batch.column("first").to_pylist(), batch.column("positions")):
                at = np.sort(wanted.values.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(WaveletMatrix.load(blob.as_buffer().to_pybytes()).access(at - first))], ["position", "token_id"])

    return shards.select("part", "seq", "wavelet").join(found, ["part", "seq"]).select("wavelet", "first", "positions").mapInArrow(read, "position long, token_id long")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark, "token-shards")
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_shards(spark, folder)
