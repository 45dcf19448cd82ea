"""The prefix trie of conversations: which openings are shared, and what sharing saves.

A conversation is a sequence of (role, text) turns.  Its rolling fingerprints, a
polynomial over the turns' 64-bit hashes, come from numpy scans over sorted rows
(``scans.running``), so a conversation of any length needs no task of its own.
Rows with the same depth and fingerprint are candidates for one node.  Every
group is checked turn by turn against the texts of its representative, the
smallest conversation: each member must have the representative's last turn and
its parent fingerprint.  Texts that differ get new turn hashes, the scan is
repeated, and so on until no group holds two texts; by induction over the depth
each group then is one sequence.  Groups meet as distinct (turn, parent) rows,
summed in each task first, so a turn that a third of all conversations share is
a few rows, and no pairs are formed.

Sums over subtrees need no walk over levels: a node's subtree consists of the
later rows of its members.  Each row of a conversation that is not its node's
representative saves its words, each representative of a childless node is a
leaf; a second scan from the end sums both, and one aggregation rolls the rows
up to their nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import running
from .tables import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Children from which a node's id is broadcast to them; it grows so that at most HUBS nodes have so many.
HUB_CHILDREN = 10_000
HUBS = 500_000
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Trie(NamedTuple):
    """nodes: depth, node, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, n_ends; (depth, node) is a key.

    ends: depth, node, conv_id for every conversation at the node where it ends.
    """

    nodes: DataFrame
    ends: DataFrame


def turn_hash() -> Column:
    """A hash of a turn; equal hashes of different turns cost another scan, not a wrong node."""
    return F.xxhash64("role", "text")


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def _ordered(turns: DataFrame, **scan) -> DataFrame:
    """Scan rows by conv_id and turn (null first), equal turns by role and text."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    coarse = [*order[:2], F.substring("role", 1, 32), F.substring("text", 1, 32), F.monotonically_increasing_id()]
    return running(turns, "conv_id", coarse, order, **scan)


def with_shared_openings(conversations: DataFrame, family: int = 20, openings: int = 4) -> DataFrame:
    """(conv_id, turn, role, text): every conversation c with its first h turns taken from conversation c - c % family.

    h is crc32(decimal c) % openings.  All of that conversation's turns are taken if
    it has fewer, none if it is absent.  ``turn`` counts the original turns from 1;
    turns are ordered by turn (null first), equal ones by role and text.  Null role or
    text becomes empty, rows with a null conv_id are ignored, repeated rows are turns.
    """
    own = stored(_ordered(_turns(conversations)).select("conv_id", F.col("place").alias("turn"), "role", "text"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % openings
    base = F.col("conv_id") - F.col("conv_id") % family
    heads = own.where((F.col("turn") < openings) & (base == F.col("conv_id"))).withColumnRenamed("conv_id", "base")
    takers = own.select("conv_id").distinct().select("conv_id", h.alias("h"), base.alias("base")).where("h > 0")
    taken = heads.join(takers, "base").where("turn <= h").select("conv_id", "turn", "role", "text")  # at most 2 * family takers a base
    return taken.union(own.where(F.col("turn") > h))


def prefix_trie(conversations: DataFrame, members: DataFrame | None = None) -> Trie:
    """The trie of all conversations; ``conversations`` needs conv_id, turn, role and text.

    ``members`` (conv_id) may name conversations without turns.  Turns are ordered by
    turn (null first), equal ones by role and text; null role or text is empty; rows
    with a null conv_id are ignored.  The root has depth 0 and no text.  A node's conv_id
    is its smallest member.  saved_tokens counts the words that need not be repeated
    in the subtree, its top included.  An empty table gives no nodes.
    """
    turns = _turns(conversations).withColumns({"g": turn_hash(), "words": F.regexp_count("text", F.lit(WORD)).cast("long"), "top": F.lit(1)})
    named = turns.select("conv_id") if members is None else turns.select("conv_id").union(members.select(F.col("conv_id").cast("long")).where("conv_id is not null"))
    roots = named.distinct().selectExpr("conv_id", "cast(null as long) as turn", "'' as role", "'' as text", "0L as g", "0L as words", "0 as top")
    rows, tries = roots.union(turns), 0
    while True:
        order = [F.col("conv_id"), F.col("top"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
        coarse = [*order[:3], F.substring("role", 1, 32), F.substring("text", 1, 32), F.monotonically_increasing_id()]
        rolled = running(rows, "conv_id", coarse, order, roll="g").withColumn("depth", F.col("place") - 1)
        rolled = stored(rolled.drop("place"))
        content = ["depth", "fp", "before", "role", "text"]
        found = stored(rolled.groupBy(content).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words")))
        mixed = found.groupBy("depth", "fp").agg(F.min("conv_id").alias("representative"), F.count("*").alias("contents")).where("contents > 1")
        wrong = stored(found.join(mixed, ["depth", "fp"]).where("conv_id <> representative").select(*content, F.lit(True).alias("wrong")))
        if wrong.isEmpty():
            break
        tries += 1
        again = F.when(F.col("wrong"), F.xxhash64(F.lit(tries), "role", "text", "before")).otherwise(F.col("g"))
        rows = rolled.join(wrong, content, "left").withColumn("g", again).select("conv_id", "turn", "role", "text", "g", "words", "top")

    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("before").alias("fp")).agg(F.count("*").alias("n_children"))
    nodes = stored(found.drop("role", "text").join(children, ["depth", "fp"], "left").fillna(0, ["n_children"]))
    first = nodes.select("conv_id", "depth", F.col("n_children").alias("children"))
    flagged = rolled.select("conv_id", "depth", "fp", "words").join(first, ["conv_id", "depth"], "left")
    flagged = flagged.select("conv_id", "depth", "fp", F.when(F.col("children").isNull(), F.col("words")).otherwise(0).alias("spare"), F.when(F.col("children") == 0, 1).otherwise(0).cast("long").alias("leaf"))
    back = [F.col("conv_id"), F.col("depth").desc()]
    summed = stored(running(flagged, "conv_id", back, back, sums=("spare", "leaf")))
    totals = summed.groupBy("depth", "fp").agg(F.sum("run_spare").alias("saved_tokens"), F.sum("run_leaf").alias("n_leaves"), F.count_if(F.col("place") == 1).alias("n_ends"))
    ends = summed.where("place = 1").select("depth", F.col("fp").alias("node"), "conv_id")
    nodes = _with_parents(nodes.join(totals, ["depth", "fp"]), nodes)
    return Trie(nodes.select("depth", F.col("fp").alias("node"), "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends"), ends)


def _with_parents(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds parent_conv_id.  Nodes with very many children are broadcast, at most HUBS of them as each child has one parent."""
    many = F.col("n_children") > max(HUB_CHILDREN, nodes.count() // HUBS)
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("up"), F.col("conv_id").alias("parent"), "n_children")
    hubs = up.where(many).select("depth", F.col("up").alias("before"), F.col("parent").alias("hub"))
    rows = rows.join(F.broadcast(hubs), ["depth", "before"], "left")
    rows = rows.withColumn("up", F.when(F.col("hub").isNull(), F.col("before")).otherwise(F.xxhash64("fp", F.lit("spread"))))
    rows = rows.join(up.where(~many).drop("n_children"), ["depth", "up"], "left")
    return rows.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.coalesce("hub", "parent")))


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256): SHA-256 of each node's ended conversations, decimal, ascending, comma-joined.

    A digest is sequential, so a node's ids go through one task, but as a sorted stream that is never held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            depth, node, conv = (batch.column(i).to_numpy() for i in range(3))
            out = []
            cuts = np.flatnonzero(np.r_[True, (depth[1:] != depth[:-1]) | (node[1:] != node[:-1]), True]) if len(conv) else [0]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                text = ",".join(map(str, conv[lo:hi].tolist())).encode()
                if (now := (int(depth[lo]), int(node[lo]))) == key:
                    digest.update(b"," + text)
                    continue
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = now, hashlib.sha256(text)
            yield _digest_rows(out)
        if key is not None:
            yield _digest_rows([(*key, digest.hexdigest())])

    keys = ["depth", "node"]
    return ends.select(*keys, "conv_id").repartition(*keys).sortWithinPartitions(*keys, "conv_id").mapInArrow(run, "depth long, node long, ends_sha256 string")


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["depth", "node", "ends_sha256"])


def report(trie: Trie) -> DataFrame:
    """One row per node with the digest of the conversations that end there."""
    joined = trie.nodes.join(ends_digests(trie.ends), ["depth", "node"], "left")
    return joined.drop("node", "n_ends").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
