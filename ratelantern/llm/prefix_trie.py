"""Trie of conversation prefixes from vertical bitmaps.

Conversations are dealt to shards of bounded size, those of one family together. A shard
indexes every (position, turn) as a bitset of its conversations and every length as a bitset of
those that end there. Depth first, the bitset of a node is intersected with the postings of the next
position: the results are its children, their popcounts the numbers of members, and what ends there its end list.

A node is known by a hash of its path, so the nodes of all shards merge by an aggregate. Sums
over subtrees need no descent: a node belongs to its smallest member, and what a member owns is the end
of its path. Let W be the bytes of the part of a member's path that it doesn't own. Then
the tokens saved below a node are the sum over its members of W less the bytes before the node, where positive,
and its leaves are the members that own a leaf. Both are one aggregate of (node, member) rows.

* Null roles and texts are empty. Turns are ordered by turn, null first, then role, then text; repeated
  rows are turns of their own. Rows without a conversation id take no part.
* ``c % divisor`` has the sign of c. A conversation without turns after rebuilding is a member of the root alone.
* An empty table has no node, not even a root.
* Only ``conv_id``, ``turn``, ``role`` and ``text`` are read; other columns do not matter.
* Bounds: a shard holds ``shard_size`` conversations; one conversation (16 bytes a turn) and the digest of
  one end list, which a task streams in order, are not divided.
"""

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ratelantern.llm.common import pieces_for
from ratelantern.session import write_stage

NODE = "h1 long, h2 long, p1 long, p2 long, depth long, bytes long, before long, n_convs long, first long, members array<long>, ends array<long>"
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()
ROOT_PATH = bytes(16)


def turn_lists(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order: a 128-bit name of (role, text) and the bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"))
    at = F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    named = turns.select(
        "conv_id",
        F.struct(
            at.alias("at"),
            F.xxhash64("role", "text").alias("a"),
            F.xxhash64(F.lit(17), "text", "role").alias("b"),
            F.octet_length("text").cast("long").alias("n"),
        ).alias("turn"),
    )
    ordered = F.sort_array(F.collect_list("turn"))
    return named.groupBy("conv_id").agg(F.transform(ordered, lambda t: t.dropFields("at")).alias("turns"))


def shared_heads(turns: DataFrame, divisor: int = 5, modulus: int = 9) -> DataFrame:
    """Every conversation with its first h turns taken from conversation c - c % ``divisor``; h = crc32(c) % ``modulus``."""
    c = F.col("conv_id")
    head = (F.crc32(c.cast("string").cast("binary")) % modulus).cast("int")
    heads = turns.select(c.alias("family"), F.slice("turns", 1, modulus - 1).alias("head"))
    own = F.slice(F.col("turns"), head + 1, F.greatest(F.size("turns") - head, F.lit(0)))
    none = F.slice(F.col("turns"), 1, 0)
    return (
        turns.withColumn("family", c - c % divisor)
        .join(heads, "family", "left")
        .select("conv_id", "family", F.concat(F.coalesce(F.slice(F.col("head"), F.lit(1), head), none), own).alias("turns"))
    )


class Shard:
    """Bitsets of a shard's conversations, as integers: bit i stands for the conversation with the i-th smallest id."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, turns: np.ndarray):
        self.ids, self.offsets = ids, offsets
        length = np.diff(offsets)
        self.length = length.tolist()
        self.names = turns[:, :2].tobytes()
        self.bytes = turns[:, 2].tolist()
        row = np.repeat(np.arange(len(ids)), length)
        position = np.arange(len(turns)) - offsets[:-1][row]
        keys = np.column_stack((position, turns[:, :2]))
        _, posting, held = np.unique(keys, axis=0, return_inverse=True, return_counts=True) if len(keys) else (0, np.zeros(0, int), np.zeros(0, int))
        self.posting = posting.reshape(-1).tolist()
        self.sets: dict[int, int] = {}
        for p, r in zip(self.posting, row.tolist(), strict=True):
            if held[p] > 1:
                self.sets[p] = self.sets.get(p, 0) | 1 << r
        self.ending: dict[int, int] = {}
        for r, n in enumerate(self.length):
            self.ending[n] = self.ending.get(n, 0) | 1 << r

    def rows(self, bits: int) -> list[int]:
        """Which bits are set, ascending."""
        if bits.bit_count() < 8:
            found = []
            while bits:
                found.append((bits & -bits).bit_length() - 1)
                bits &= bits - 1
            return found
        raw = np.frombuffer(bits.to_bytes(len(self.ids) // 8 + 1, "little"), dtype=np.uint8)
        return np.nonzero(np.unpackbits(raw, bitorder="little"))[0].tolist()

    def nodes(self) -> Iterator[tuple]:
        """Path, parent's path, depth, bytes of the last turn and of all before it, members and those that end there."""
        stack = [(((1 << len(self.ids)) - 1), 0, ROOT_PATH, None, 0, 0)] if len(self.ids) else []
        while stack:
            members, depth, path, parent, before, size = stack.pop()
            ends = members & self.ending.get(depth, 0)
            yield path, parent, depth, size, before, self.rows(members), self.rows(ends)
            rest = members ^ ends
            while rest:
                row = (rest & -rest).bit_length() - 1
                at = int(self.offsets[row]) + depth
                child = members & self.sets.get(self.posting[at], 1 << row)
                rest &= ~child
                below = xxhash.xxh3_128_digest(path + self.names[16 * at : 16 * at + 16])
                stack.append((child, depth + 1, below, path, before + size, self.bytes[at]))


def shard_nodes(table: pa.Table) -> pa.Table:
    """All nodes of one shard's trie."""
    table = table.combine_chunks().sort_by("conv_id")
    ids = table["conv_id"].to_numpy().astype(np.int64)
    lists = table["turns"].combine_chunks()
    offsets = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    values = lists.flatten()
    turns = np.column_stack([values.field(i).to_numpy(zero_copy_only=False) for i in range(3)]).astype(np.int64)
    found = list(Shard(ids, offsets, turns).nodes())
    paths = np.frombuffer(b"".join(f[0] for f in found), dtype=np.int64).reshape(-1, 2)
    parents = np.frombuffer(b"".join(f[1] or ROOT_PATH for f in found), dtype=np.int64).reshape(-1, 2)
    is_root = np.array([f[1] is None for f in found], dtype=bool)

    def id_lists(which: int) -> pa.Array:
        at = np.cumsum([0, *(len(f[which]) for f in found)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(ids[np.array([r for f in found for r in f[which]], dtype=np.int64)]))

    return pa.table(
        {
            "h1": paths[:, 0],
            "h2": paths[:, 1],
            "p1": pa.array(parents[:, 0], mask=is_root),
            "p2": pa.array(parents[:, 1], mask=is_root),
            "depth": pa.array([f[2] for f in found], pa.int64()),
            "bytes": pa.array([f[3] for f in found], pa.int64()),
            "before": pa.array([f[4] for f in found], pa.int64()),
            "n_convs": pa.array([len(f[5]) for f in found], pa.int64()),
            "first": ids[np.array([f[5][0] for f in found], dtype=np.int64)],
            "members": id_lists(5),
            "ends": id_lists(6),
        }
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (h1, h2) of rows sorted by (h1, h2, id); holds one batch and one running digest."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["h1", "h2", "ends_sha256"])

    now, running = None, None
    for batch in batches:
        done = []
        h1, h2, ids = (batch.column(c).to_pylist() for c in ("h1", "h2", "id"))
        for key, run in groupby(range(len(ids)), lambda i: (h1[i], h2[i])):
            text = ",".join(str(ids[i]) for i in run).encode()
            if key == now:
                running.update(b"," + text)
            else:
                if now:
                    done.append((*now, running.hexdigest()))
                now, running = key, hashlib.sha256(text)
        yield out(done)
    if now:
        yield out([(*now, running.hexdigest())])


def prefix_trie(conversations: DataFrame, shard_size: int = 4096) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rebuilt = write_stage(shared_heads(turn_lists(conversations)), "trie-conversations")
    shards = pieces_for(rebuilt.count(), shard_size)
    shard: Column = F.pmod(F.xxhash64("family"), F.lit(shards))
    local = write_stage(
        rebuilt.select("conv_id", "turns", shard.alias("shard"))
        .repartition(shards, "shard")
        .groupBy("shard")
        .applyInArrow(lambda table: shard_nodes(table.select(["conv_id", "turns"])), NODE),
        "trie-shard-nodes",
    )
    same = [F.min(c).alias(c) for c in ("p1", "p2", "depth", "bytes", "before", "first")]
    merged = local.groupBy("h1", "h2").agg(*same, F.sum("n_convs").alias("n_convs"))
    children = merged.where("p1 IS NOT NULL").groupBy(F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count("*").alias("n_children"))
    nodes = write_stage(merged.join(children, ["h1", "h2"], "left").fillna(0, ["n_children"]), "trie-nodes")

    # What each conversation owns, and the bytes of its path before that.
    owners = nodes.groupBy(F.col("first").alias("member")).agg(
        F.min_by("before", "depth").alias("unowned"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")
    )
    ended = local.where(F.size("ends") > 0).select("h1", "h2", F.explode("ends").alias("id"), (F.col("before") + F.col("bytes")).alias("all"))
    owned = (
        ended.select(F.col("id").alias("member"), "all")
        .join(owners, "member", "left")
        .select("member", F.coalesce("unowned", "all").alias("unowned"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    )
    sums = (
        local.select("h1", "h2", "before", F.explode("members").alias("member"))
        .join(owned, "member")
        .groupBy("h1", "h2")
        .agg(F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("unowned") - F.col("before"), F.lit(0))).alias("saved_tokens"))
    )
    digests = ended.select("h1", "h2", "id").repartition("h1", "h2").sortWithinPartitions("h1", "h2", "id").mapInArrow(_digests, "h1 long, h2 long, ends_sha256 string")
    parents = nodes.where("n_children > 0").select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("first").alias("parent_conv_id"))
    return (
        nodes.join(sums, ["h1", "h2"])
        .join(digests, ["h1", "h2"], "left")
        .join(parents, ["p1", "p2"], "left")
        .select(
            F.col("first").alias("conv_id"),
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(EMPTY_DIGEST)).alias("ends_sha256"),
        )
    )
