"""The prefix trie of conversations, and sums over its subtrees by depth-band rollup.

Every conversation is rebuilt first: it begins with the head of the first conversation
of its block of five, and goes on with its own turns behind as many.  Each distinct
sequence of first turns is a node; all conversations that begin with it are its members.

One shuffle brings a block's turns together in order, and a stream of them writes for each
conversation and depth the node's key, a chained 128-bit digest of its turns, and the
keys of the nodes above it within its band: BAND depths of the same tens digit, so to say, in
base BAND.  A node whose depth divides by BAND also has the keys above it at such depths
only, within BAND of those, and so on: band roots are the nodes of a tree BAND times
less deep.  Equal keys then become nodes, by partial counts.

The rollup goes up these levels: a node's values are sent to the nodes above it within
its band, so that band roots have their band's sum, and are nodes of the next level with
it.  On the highest level a single band is left, and sums there are whole.  Then it goes down:
whole totals of band roots are sent to the nodes above them in the band above, which
add them to their own band's sums.  A node is thus sent to BAND others at most on each way,
and there are as many rounds as its depth has digits in base BAND.  Sums are added map-side
first, so that the root, which is above all, is a row per task.

Ids of conversations that end in a node are sorted over all tasks and packed into texts there;
a node's digest streams over the packed texts in order, in bounded memory.  A conversation's
turns pass through one task as a stream too: its head of 8 turns, a batch and BAND keys per level
are held.

Cases: null role or text is empty; a null turn comes first; turns of equal number are
ordered by role and text, and rows that repeat are turns of their own; a row with null conv_id
belongs to no conversation and is left out; a conversation whose own turns all go and whose
block has no head is a member of the root only; an empty table has no nodes; extra
columns are ignored.  c - c % 5 is as in SQL, where the remainder has the sign of c.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import partitions, stored
from .textkernel import pick

#: Depths in a band.
BAND = 16
#: Conversations in a block, whose heads are the first one's.
BLOCK = 5
#: Heads have fewer turns than this.
HEAD = 9
#: Bytes of ids that are packed into one text.
PACKED = 1 << 16
#: Rows of an output batch.
ROWS = 4096

ROOT = bytes(16)
PREFIXES = "conv_id long, depth int, key binary, ups array<array<binary>>, bytes long, ends boolean"


def step(key: bytes, role: bytes, text: bytes) -> bytes:
    """The key of the node that a turn leads to."""
    return hashlib.blake2b(key + len(role).to_bytes(8, "little") + role + text, digest_size=16).digest()


class Path:
    """Keys on the way down one conversation: the current one, its depth, and each level's keys of the band it lies in."""

    def __init__(self, band: int):
        self.band, self.key, self.depth = band, ROOT, 0
        self.levels: list[list[bytes]] = []

    def down(self, role: bytes, text: bytes) -> list[list[bytes]]:
        """Goes to the next node; returns for each level that has it the keys above it in the parent's band."""
        self.key = step(self.key, role, text)
        self.depth += 1
        ups, size, level = [], 1, 0
        while self.depth % size == 0:
            if level == len(self.levels):
                self.levels.append([ROOT])
            ups.append(list(self.levels[level]))
            size *= self.band
            if self.depth % size:
                self.levels[level].append(self.key)
            else:
                self.levels[level] = [self.key]
            level += 1
        return ups


def _prefixes(batches: Iterator[pa.RecordBatch], band: int) -> Iterator[pa.RecordBatch]:
    """Reads turns by block, its first conversation first, then by conversation and order; yields rows of PREFIXES."""
    rows: list[list] = []
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.list_(pa.binary())), pa.int64(), pa.bool_())
    names = ["conv_id", "depth", "key", "ups", "bytes", "ends"]

    def flush(keep: int) -> pa.RecordBatch:
        done, rows[:] = rows[:len(rows) - keep], rows[len(rows) - keep:]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], kind) for k, kind in enumerate(kinds)], names)

    block = conv = None
    head: list[tuple[bytes, bytes]] = []
    path, nth, skip = Path(band), 0, 0

    def turn(role: bytes, text: bytes) -> None:
        ups = path.down(role, text)
        rows[-1][-1] = False  # the conversation goes on
        rows.append([conv, path.depth, path.key, ups, len(text), True])

    for batch in batches:
        columns = [batch.column(c) for c in ("block", "conv_id", "head")] + [batch.column(c).cast(pa.binary()) for c in ("role", "text")]
        for of, c, h, role, text in zip(*(x.to_pylist() for x in columns)):
            if of != block:
                block, head = of, []
            if c != conv:
                conv, path, nth = c, Path(band), 0
                rows.append([conv, 0, ROOT, [], 0, True])
                first = c == of
                skip = 0 if first else h
                for got in head[:skip]:
                    turn(*got)
            if first and len(head) < HEAD - 1:
                head.append((role, text))
            if nth >= skip:
                turn(role, text)
            nth += 1
            if len(rows) >= ROWS:
                yield flush(1)
    if rows:
        yield flush(0)


def prefixes(turns: DataFrame, band: int = BAND) -> DataFrame:
    """One row per conversation (columns conv_id, turn, role, text) and depth, after rebuilding: the node it reaches there, the keys above, and whether it ends there."""
    c = F.col("conv_id")
    text = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    rows = pick(turns, "conv_id", "turn", "role", "text").where(c.isNotNull())
    rows = rows.select((c - c % BLOCK).alias("block"), "conv_id", (F.crc32(c.cast("string").cast("binary")) % HEAD).cast("int").alias("head"), "turn", text("role"), text("text"))
    rows = rows.repartition(partitions(turns.sparkSession), "block").sortWithinPartitions("block", c != F.col("block"), "conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select("block", "conv_id", "head", "role", "text").mapInArrow(lambda it: _prefixes(it, band), PREFIXES)


def nodes(reached: DataFrame) -> DataFrame:
    """Nodes (depth, key, ups, bytes of the last text) with conv_id, their smallest member, and n_convs."""
    return reached.groupBy("depth", "key", "ups", "bytes").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))


def rolled_up(tree: DataFrame, values: list[str], band: int = BAND) -> DataFrame:
    """key and the sum of each value over the node's subtree, for nodes (depth, key, ups and the values)."""
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    top = 0
    while band ** (top + 1) <= deepest:
        top += 1
    sums = [F.sum(v).alias(v) for v in values]

    def sent(rows: DataFrame, to: Column) -> DataFrame:
        return rows.select(F.explode(to).alias("key"), *values)

    def at(level: int) -> DataFrame:
        return tree.where(F.col("depth") % band**level == 0).select("depth", "key", F.try_element_at("ups", F.lit(level + 1)).alias("up"))

    bands: list[DataFrame] = []  # each level's sums within bands
    for level in range(top + 1):
        rows = tree.select("depth", "key", F.try_element_at("ups", F.lit(1)).alias("up"), *values) if level == 0 else at(level).join(bands[-1], "key")
        own = F.array("key")
        to = F.when(F.col("depth") % band ** (level + 1) == 0, own).otherwise(F.concat(F.col("up"), own))
        bands.append(stored(sent(rows, to).groupBy("key").agg(*sums), "trie-band"))
    whole = bands[top]
    for level in range(top - 1, -1, -1):
        roots = at(level + 1).select("key")
        above = tree.where((F.col("depth") % band ** (level + 1) == 0) & (F.col("depth") > 0)).select("key", F.slice(F.get("ups", F.lit(level)), 2, band).alias("above"))
        added = sent(above.join(whole, "key"), F.col("above"))
        inner = bands[level].join(roots, "key", "left_anti")
        whole = stored(inner.unionByName(added).groupBy("key").agg(*sums).unionByName(whole), "trie-total")
    return whole


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (key, conv_id) in order; yields runs of a key's ids as text, with their first id."""
    key, first, ids, size = None, 0, [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)], pa.string())], ["key", "first", "ids"])

    for batch in batches:
        for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if k != key or size > PACKED:
                if ids:
                    yield out()
                key, first, ids, size = k, c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
    if ids:
        yield out()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads packed ids by key in order; yields a digest per key."""
    key, digest = None, hashlib.sha256()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["key", "ends_sha256"])

    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if k != key:
                if key is not None:
                    yield out()
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if key is not None:
        yield out()


def end_digests(reached: DataFrame) -> DataFrame:
    """key and the digest of the ids of the conversations that end there."""
    count = partitions(reached.sparkSession)
    ends = reached.where("ends").select("key", "conv_id").repartitionByRange(count, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    packed = ends.mapInArrow(_packed, "key binary, first long, ids string")
    return packed.repartition(count, "key").sortWithinPartitions("key", "first").mapInArrow(_digested, "key binary, ends_sha256 string")


def conversation_trie(turns: DataFrame, band: int = BAND) -> DataFrame:
    """One row per node of the trie of conversations (columns conv_id, turn, role, text)."""
    reached = stored(prefixes(turns, band), "trie-prefixes")
    tree = stored(nodes(reached), "trie-nodes").withColumn("parent", F.try_element_at(F.get("ups", F.lit(0)), F.lit(-1)))
    n_children = tree.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    tree = tree.join(n_children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    valued = tree.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")})
    totals = rolled_up(valued, ["n_leaves", "saved_tokens"], band)
    parents = tree.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = tree.join(parents, "parent", "left").join(totals, "key").join(end_digests(reached), "key", "left")
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
