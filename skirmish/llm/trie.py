"""Prefix trie of conversations by truncation peeling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.llm.base import stage

# Ids of one block of a node's list of ended conversations, which is hashed block by block.
_BLOCK = 1024
_EMPTY = hashlib.sha256(b"").hexdigest()


def turn_lists(conversations: DataFrame) -> DataFrame:
    """One row (conv_id, turns) per conversation; a turn is (digest of role and text, bytes of text).

    Turns are ordered by ``turn``, null first, then by role and digest; a null role or text is empty.  Rows with a null
    ``conv_id`` belong to no conversation.  A repeated row is a repeated turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    rows = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", F.struct(
        F.col("turn").alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def regraft(lists: DataFrame, width: int = 5, most: int = 8) -> DataFrame:
    """Each conversation with its beginning replaced by that of the first of its group of ``width`` ids.

    The first h turns come from conversation ``c - c % width`` (all of it, if shorter; none, if absent), the others are the
    conversation's own after its first h; h is crc32 of the id modulo ``most + 1``.
    """
    c = F.col("conv_id")
    own = lists.select(c, "turns", (c - c % width).alias("base"), (F.crc32(c.cast("string").cast("binary")) % (most + 1)).cast("int").alias("h"))
    heads = lists.filter(c % width == 0).select(c.alias("base"), F.slice("turns", 1, most).alias("head"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(0)))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _path(turns: Column) -> Column:
    """Per turn the key of the prefix that ends there and the bytes of all texts so far."""
    none = F.array().cast("array<struct<key:string,upto:bigint>>")
    last = lambda p: F.try_element_at(p, F.lit(-1))
    step = lambda p, t: F.concat(p, F.array(F.struct(
        F.substring(F.sha2(F.concat(F.coalesce(last(p)["key"], F.lit("")), t["digest"]).cast("binary"), 256), 1, 32).alias("key"),
        (F.coalesce(last(p)["upto"], F.lit(0).cast("bigint")) + t["bytes"]).alias("upto"))))
    return F.aggregate(turns, none, step)


def _key(path: Column, depth: Column) -> Column:
    """The key of the prefix of that length; the root's is empty."""
    return F.when(depth > 0, F.try_element_at(path, F.greatest(depth, F.lit(1)))["key"]).otherwise(F.lit(""))


def _upto(path: Column, depth: Column) -> Column:
    return F.when(depth > 0, F.try_element_at(path, F.greatest(depth, F.lit(1)))["upto"]).otherwise(F.lit(0).cast("bigint"))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each key's blocks, which arrive in order; holds one block at a time."""
    key, state = None, None
    for b in batches:
        done = []
        for k, ids in zip(b["key"], b["ids"]):
            if k != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pd.DataFrame(done, columns=["key", "ends"])
    if key is not None:
        yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "ends"])


def _complete(sequences: DataFrame) -> DataFrame:
    """One row per distinct complete sequence: its path, smallest id, number of conversations and digest of their ids."""
    rows = stage(sequences.select("conv_id", _path(F.col("turns")).alias("path")).withColumn("key", _key(F.col("path"), F.size("path"))))
    whole = rows.groupBy("key", "path").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    block = F.floor(F.col("conv_id") / _BLOCK)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    blocks = rows.groupBy("key", block.alias("block")).agg(ids.alias("ids"))
    ends = blocks.repartition("key").sortWithinPartitions("key", "block").select("key", "ids").mapInPandas(_digests, "key string, ends string")
    zero = F.lit(0).cast("long")
    return stage(whole.join(ends, "key").select("path", "conv_id", "n", zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), "ends"))


def _merged(rows: DataFrame) -> DataFrame:
    """One row per node: what its children bring and, where a sequence ends there, that sequence."""
    return rows.groupBy("path").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")], F.max("ends").alias("ends"))


class _Peeling:
    """Nodes found so far, as frames over stored rows."""

    def __init__(self) -> None:
        self.nodes: list[DataFrame] = []

    def emit(self, rows: DataFrame, bottom: int) -> DataFrame:
        """Nodes of rows that share no turn beyond ``bottom``, and what each brings to the node there."""
        p, n, size = F.col("path"), F.col("n"), F.size("path")
        leaves = F.greatest("leaves", F.lit(1).cast("long"))
        depth = F.col("depth")
        # A chain above the row has the row's members and leaves; each of its turns saves the same number of copies.
        saved = F.col("saved") + (n - 1) * (_upto(p, size) - _upto(p, depth - 1))
        here = depth == size
        self.nodes.append(rows.withColumn("depth", F.explode(F.sequence(F.lit(bottom + 1), size))).select(
            _key(p, depth).alias("key"), _key(p, depth - 1).alias("parent"), (depth == bottom + 1).alias("head"), depth.cast("long").alias("depth"),
            "conv_id", n.alias("n_convs"), F.when(here, F.col("children")).otherwise(F.lit(1)).alias("n_children"),
            leaves.alias("n_leaves"), saved.alias("saved_tokens"), F.when(here, F.col("ends")).alias("ends")))
        one = F.lit(1).cast("long")
        return rows.select(F.slice("path", 1, bottom).alias("path"), "conv_id", "n", one.alias("children"), leaves.alias("leaves"),
                           (F.col("saved") + (n - 1) * (_upto(p, size) - _upto(p, F.lit(bottom)))).alias("saved"), F.lit(None).cast("string").alias("ends"))

    def peel(self, rows: DataFrame, top: int, bottom: int) -> DataFrame:
        """Strip stored ``rows``, whose lengths lie in (bottom, top], down to ``bottom``."""
        if top - bottom == 1:
            return self.emit(rows, bottom)
        key = _key(F.col("path"), F.lit(bottom))
        parts = []
        if bottom:
            # A row that is alone with its prefix loses all its turns beyond it at once.
            shared = rows.groupBy(key.alias("at")).agg(F.count("*").alias("_rows")).filter("_rows > 1").select("at", F.lit(True).alias("shared"))
            told = rows.withColumn("at", key).join(shared, "at", "left").withColumn("shared", F.coalesce("shared", F.lit(False))).drop("at")
            rows = stage(told)
            parts.append(self.emit(rows.filter("not shared").drop("shared"), bottom))
            rows = rows.filter("shared").drop("shared")
            most = rows.agg(F.max(F.size("path"))).first()[0]
            if most is None:
                return parts[0]
            top = most
            if top - bottom == 1:
                return parts[0].unionByName(self.emit(rows, bottom))
        middle = (top + bottom) // 2
        upper = self.peel(rows.filter(F.size("path") > middle), top, middle)
        lower = stage(_merged(upper.unionByName(rows.filter(F.size("path") <= middle))))
        low = self.peel(lower, middle, bottom)
        return low.unionByName(parts[0]) if parts else low


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """The trie of all conversations ``(conv_id, turns)``, see :func:`turn_lists`; one row per distinct prefix, the root included.

    Truncation peeling: from the greatest length down, sequences that end at a length join the nodes that survive
    there, all lose their last turns and are grouped anew; a node is complete, with all its sums, when
    it is reached.  Identical conversations are one row before that.  Turns are stripped one by one only where prefixes
    meet: a group of lengths is cut in halves, and rows that share no turn beyond a cut lose all up to it at once,
    so rounds follow the depth of shared prefixes and not the longest conversation.

    Columns, long: conv_id (smallest member), depth, parent_conv_id (that of the parent, null at the root), n_convs (members), n_children,
    n_leaves (childless nodes at or below), saved_tokens (over the node and all below it: members but one, times the
    bytes of the last text); ends_sha256 (of the ids of the members that end there, ascending, joined by commas).

    A conversation without turns belongs to the root.  Without conversations there are no rows.  ``conv_id`` must be unique and not null;
    other columns are ignored.  A conversation's turns, some 100 bytes each, are one row; a node's ids are read as a
    sorted stream in blocks of 1,024, however many they are.  Prefixes are told apart by 128 bits of SHA-256.
    """
    complete = _complete(sequences)
    top = complete.agg(F.max(F.size("path"))).first()[0] or 0
    peeling = _Peeling()
    below = peeling.peel(complete.filter(F.size("path") > 0), top, 0) if top else complete.limit(0)
    root = stage(_merged(below.unionByName(complete.filter(F.size("path") == 0))))
    zero = F.lit(0).cast("long")
    first = root.select(F.lit("").alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(False).alias("head"), zero.alias("depth"), "conv_id", F.col("n").alias("n_convs"),
                        F.col("children").alias("n_children"), F.greatest("leaves", F.lit(1).cast("long")).alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends")
    nodes = first
    for part in peeling.nodes:
        nodes = nodes.unionByName(part)
    nodes = stage(nodes)
    # Inside a chain the parent has the same members; only the heads of chains look theirs up.
    inner = nodes.filter("not head").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    parents = nodes.filter("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    heads = nodes.filter("head").join(parents, "parent")
    return inner.unionByName(heads).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"))
