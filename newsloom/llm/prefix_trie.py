"""Prefix trie of conversations: which conversations begin alike, and what sharing saves.

A node of depth d is a distinct sequence of d turns (role, text); its members are the
conversations that begin with it, its subtree is it and all below.

* **Nodes.** Each row gets the XOR of two 64-bit hashes of the turns up to it, each hashed with its
  depth. Prefixes that agree in depth and in both XORs are one node, so nodes come out of one
  aggregation that combines on the map side, and no conversation is gathered anywhere.
* **Shards.** Nodes with more than ``SUBTREE`` rows at and below them are the spine. What hangs
  off the spine are whole subtrees of at most ``SUBTREE`` nodes, dealt by hash into shards. A node
  finds its subtree through its first member, which leaves the spine at one place.
* **Encoding.** A shard writes its subtrees as balanced parentheses, ``(`` where the depth-first
  walk enters a node and ``)`` where it leaves. The excess of opened ones is cut into blocks,
  whose minima are the leaves of a range min-max tree. ``findclose`` climbs and descends it to the
  first place behind a node with a smaller excess, which ends the subtree. The rank of pairs ``()``
  at both ends counts leaves, the rank of ``(`` at both ends cuts the savings of the subtree out
  of a cumulative array in depth-first order.
* **Spine.** Subtrees hand their totals to their first member's row on the spine, spine nodes add
  their own there, and running sums up each conversation, then sums by node, merge what shards
  share. Nothing depends on how long the spine or a conversation is, or how many share a node.

Shards hold about ``SHARD`` nodes plus at most one subtree; running values come from range sorts
(``ranked``). SHA-256 of a node's conversations needs them in one stream, in order; tasks first
join them into texts of ``CHUNK`` ids, so a node where a third of all conversations end sends a
thousandth of their number.

Defined results: null roles and texts are empty. Turns are ordered by number, null first, then
role and text; equal rows are turns of their own. Rows without a conversation id belong to no
conversation and are left out. A conversation without turns is a member of the root and ends
there. Equal conversations share all nodes. An empty table has no trie, not even a root. Other
columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.ranked import placed
from newsloom.session import materialise

SUBTREE = 1024
SHARD = 2048
CHUNK = 4096
BLOCK = 64
HEAD = 5
BASE = 100
NODE = ["depth", "k1", "k2"]


def numbered_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, turn_hash, chars) of every turn."""
    role, text = (F.coalesce(name, F.lit("")) for name in ("role", "text"))
    turns = rows.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    whole = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    hashed = turns.withColumns({"turn_hash": whole, "chars": F.length("text").cast("bigint")})
    return placed(
        hashed, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")],
        keep=["conv_id", "turn_hash", "chars"],
    )


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another, out of ``numbered_turns``.

    Conversation c takes the first h turns of conversation c - c % 100 in place of its own first
    h, with h from the CRC-32 of c. Gives (conv_id, length) of all, and (conv_id, depth, length,
    turn_hash, chars) of their turns, with depths from 1.
    """
    sizes = materialise(turns.groupBy("conv_id").agg((F.max("place") + 1).alias("n")))
    h = F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    heads = F.least("h", F.coalesce("base_n", F.lit(0)))
    plans = materialise(
        sizes.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % BASE})
        .join(bases, "base", "left")
        .select("conv_id", "base", "h", heads.alias("head"),
                (heads + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    )
    # A base has at most BASE conversations, and HEAD turns of it are asked for.
    first = turns.filter(F.col("place") < HEAD).withColumnRenamed("conv_id", "base").join(
        plans, "base").filter("place < head").withColumn("depth", F.col("place") + 1)
    own = turns.join(plans.drop("base"), "conv_id").filter("place >= h").withColumn(
        "depth", F.col("place") - F.col("h") + F.col("head") + 1)
    columns = ["conv_id", "depth", "length", "turn_hash", "chars"]
    return plans.select("conv_id", "length"), first.select(*columns).unionByName(own.select(*columns))


def prefix_rows(turns: DataFrame) -> DataFrame:
    """``turns`` with the key (k1, k2) of the prefix that ends in each, and (p1, p2) before it."""
    hashed = turns.select(
        "conv_id", "depth", "length", "chars",
        *[F.xxhash64(F.lit(seed), "turn_hash", "depth").alias(f"x{seed}") for seed in (1, 2)],
    )
    rows = placed(hashed, ["conv_id"], [F.col("depth")], keep=hashed.columns, xors=["x1", "x2"])
    return rows.select(
        "conv_id", "depth", "length", "chars",
        *[F.col(f"run_x{i}").alias(f"k{i}") for i in (1, 2)],
        *[F.col(f"run_x{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)],
    )


# One shard


def walk(parents: list[int]) -> list[int]:
    """Nodes in the order of a depth-first walk, each again as ~node where it is left."""
    children = [[] for _ in parents]
    stack = []
    for node, parent in enumerate(parents):
        (children[parent] if parent >= 0 else stack).append(node)
    out, stack = [], stack[::-1]
    while stack:
        node = stack.pop()
        out.append(node)
        if node >= 0:
            stack.append(~node)
            stack += children[node][::-1]
    return out


class Parentheses:
    """A forest as balanced parentheses with the directories that queries need."""

    def __init__(self, bits):
        import numpy as np

        self.bits = np.asarray(bits, dtype=np.int64)
        self.excess = np.cumsum(self.bits)
        n_blocks = max(1, -(-len(self.bits) // BLOCK))
        self.blocks = np.full((n_blocks, BLOCK), len(self.bits) + 1, dtype=np.int64)
        self.blocks.reshape(-1)[:len(self.bits)] = self.excess
        self.width = 1 << (n_blocks - 1).bit_length()
        least = np.full(2 * self.width, len(self.bits) + 1, dtype=np.int64)
        least[self.width:self.width + n_blocks] = self.blocks.min(axis=1)
        for i in range(self.width - 1, 0, -1):
            least[i] = min(least[2 * i], least[2 * i + 1])
        self.least = least
        self.opened = np.cumsum(self.bits > 0)
        pair = np.append((self.bits[:-1] > 0) & (self.bits[1:] < 0), False)
        self.pairs = np.cumsum(pair)
        self.is_leaf = pair

    def findclose(self, at):
        """Where the nodes that open at ``at`` close: first excess below theirs."""
        import numpy as np

        target = self.excess[at] - 1
        block, offset = at // BLOCK, at % BLOCK
        here = (self.blocks[block] <= target[:, None]) & (np.arange(BLOCK) > offset[:, None])
        found = here.any(axis=1)
        out = np.where(found, block * BLOCK + here.argmax(axis=1), -1)
        rest = np.flatnonzero(~found)
        if not len(rest):
            return out
        target, node = target[rest], self.width + block[rest]
        climbing = np.ones(len(rest), dtype=bool)
        while climbing.any():
            right = climbing & (node % 2 == 0) & (self.least[np.minimum(node + 1, 2 * self.width - 1)] <= target)
            node = np.where(right, node + 1, np.where(climbing, node // 2, node))
            climbing &= ~right
        while (node < self.width).any():
            inner = node < self.width
            left = 2 * node * inner
            node = np.where(inner, np.where(self.least[left] <= target, left, left + 1), node)
        block = node - self.width
        out[rest] = block * BLOCK + (self.blocks[block] <= target[:, None]).argmax(axis=1)
        return out


def _encoded(nodes):
    import numpy as np
    import pandas as pd

    nodes = nodes.sort_values(["depth", "conv_id", "k1", "k2"], ignore_index=True)
    place = {key: i for i, key in enumerate(zip(nodes["depth"], nodes["k1"], nodes["k2"]))}
    parents = [place.get(key, -1) for key in zip(nodes["depth"] - 1, nodes["p1"], nodes["p2"])]
    order = np.array(walk(parents))
    trie = Parentheses(np.where(order >= 0, 1, -1))
    opens = np.flatnonzero(order >= 0)
    closes = trie.findclose(opens)
    entered = order[opens]
    own = ((nodes["n_convs"] - 1) * nodes["chars"]).to_numpy()[entered]
    savings = np.concatenate([[0], np.cumsum(own)])
    leaves = trie.pairs[closes] - trie.pairs[opens] + trie.is_leaf[opens]
    saved = savings[trie.opened[closes]] - savings[trie.opened[opens] - 1]
    parents = np.array(parents)
    children = np.bincount(parents[parents >= 0], minlength=len(nodes))
    totals = pd.DataFrame({"n_leaves": leaves, "saved_tokens": saved}, index=entered).sort_index()
    first = nodes["conv_id"].to_numpy()
    return nodes.assign(
        hangs=parents < 0, parent_conv_id=np.where(parents < 0, 0, first[parents]),
        n_children=children, n_leaves=totals["n_leaves"], saved_tokens=totals["saved_tokens"],
    )[ENCODED]


ENCODED = ["depth", "k1", "k2", "p1", "p2", "conv_id", "hangs", "parent_conv_id", "n_convs", "n_children",
           "n_leaves", "saved_tokens"]


# What ends where


def _joined_ids(batches):
    import pyarrow as pa

    names = [*NODE, "first", "ids"]
    types = [pa.int64()] * 4 + [pa.string()]

    def packed(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    node, ids, rows = None, [], []
    for batch in batches:
        for *at, conv_id in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id"))):
            if ids and (at != node or len(ids) >= CHUNK):
                rows.append((*node, ids[0], ",".join(map(str, ids))))
                ids = []
            node = at
            ids.append(conv_id)
        if len(rows) > CHUNK:
            yield packed(rows)
            rows = []
    if ids:
        rows.append((*node, ids[0], ",".join(map(str, ids))))
    if rows:
        yield packed(rows)


def _digested(batches):
    import hashlib

    import pyarrow as pa

    def packed(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.string()])],
            names=[*NODE, "ends_sha256"])

    node, digest, rows = None, None, []
    for batch in batches:
        for *at, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
            if at != node:
                if node is not None:
                    rows.append((*node, digest.hexdigest()))
                node, digest = at, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if len(rows) > CHUNK:
            yield packed(rows)
            rows = []
    if node is not None:
        rows.append((*node, digest.hexdigest()))
    if rows:
        yield packed(rows)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) out of the node where each conversation ends."""
    by = [*NODE, "conv_id"]
    joined = ends.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(
        _joined_ids, "depth bigint, k1 bigint, k2 bigint, first bigint, ids string")
    return joined.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(
        _digested, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


# The whole


def all_nodes(rows: DataFrame) -> DataFrame:
    """Every node but the root, with its first member and the number of rows at and below it."""
    return rows.groupBy(*NODE).agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.count(F.lit(1)).alias("n_convs"),
        F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
    )


def _own(nodes: DataFrame) -> Column:
    return (nodes["n_convs"] - 1) * nodes["chars"]


def spine_totals(rows: DataFrame, cuts: DataFrame, parts: DataFrame) -> DataFrame:
    """(depth, k1, k2, n_leaves, saved_tokens) of spine nodes.

    ``parts`` holds what first members bring: (conv_id, depth, n_leaves, saved_tokens) counts for
    the node at that depth and all above it.
    """
    brought = parts.groupBy("conv_id", "depth").agg(
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    spine = rows.select("conv_id", *NODE).join(cuts, "conv_id").filter("depth <= cut").join(
        brought, ["conv_id", "depth"], "left").select(
        "conv_id", *NODE, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_leaves", "saved_tokens")])
    up = placed(spine, ["conv_id"], [F.col("depth").desc()], keep=spine.columns, sums=["n_leaves", "saved_tokens"])
    return up.groupBy(*NODE).agg(
        F.sum("run_n_leaves").alias("n_leaves"), F.sum("run_saved_tokens").alias("saved_tokens"))


def trie(conversations: DataFrame, turns: DataFrame, subtree: int = SUBTREE) -> DataFrame:
    """All nodes of the trie of ``turns`` (conv_id, depth, length, turn_hash, chars).

    ``conversations`` (conv_id, length) has those without turns, too. The result has the key
    (depth, k1, k2) of each node besides what the columns' names say.
    """
    rows = materialise(prefix_rows(turns))
    nodes = materialise(all_nodes(rows))
    spine = materialise(nodes.filter(F.col("weight") > subtree))
    # Rows at and below shrink with depth, so each conversation leaves the spine once.
    cuts = materialise(
        rows.select("conv_id", *NODE).join(spine.select(*NODE), NODE).groupBy("conv_id")
        .agg(F.max("depth").alias("cut")))
    roots = rows.select("conv_id", *NODE).join(cuts, "conv_id", "left").filter(
        F.col("depth") == F.coalesce("cut", F.lit(0)) + 1)
    n_shards = max(1, -(-nodes.count() // SHARD))
    shard = F.pmod(F.xxhash64(*NODE), F.lit(n_shards)).cast("int")
    dealt = nodes.filter(F.col("weight") <= subtree).drop("weight").join(
        materialise(roots.select("conv_id", shard.alias("shard"))), "conv_id")
    encoded = materialise(dealt.groupBy("shard").applyInPandas(
        _encoded, ", ".join(f"{c} {'boolean' if c == 'hangs' else 'bigint'}" for c in ENCODED)))

    hanging = encoded.filter("hangs")
    above = spine.withColumn("saved_tokens", _own(spine))
    kids = materialise(hanging.select(*ENCODED[:5]).unionByName(spine.select(*ENCODED[:5])).groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")
    ).agg(F.count(F.lit(1)).alias("n_children")))
    counted = materialise(above.join(kids, NODE, "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))).drop("weight", "chars"))
    parts = materialise(
        hanging.select("conv_id", (F.col("depth") - 1).alias("depth"), "n_leaves", "saved_tokens").unionByName(
            counted.select("conv_id", "depth", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"),
                           "saved_tokens")))
    totals = spine_totals(rows, cuts, parts)
    shared = counted.drop("saved_tokens").join(totals, NODE)

    root = materialise(_root(conversations, kids, parts))
    # Parents of spine nodes and of whole subtrees are spine nodes or the root.
    parents = spine.select(*NODE, "conv_id").unionByName(root.select(*NODE, "conv_id")).select(
        *[F.col(c).alias(f"_{c}") for c in NODE], F.col("conv_id").alias("parent_conv_id"))
    columns = [c for c in ENCODED if c not in ("hangs", "parent_conv_id")]
    up = shared.select(*columns).unionByName(hanging.select(*columns))
    below = (F.col("depth") - 1 == F.col("_depth")) & (F.col("p1") == F.col("_k1")) & (
        F.col("p2") == F.col("_k2"))
    named = up.join(parents, below)
    found = [*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    everything = encoded.filter("not hangs").select(*found).unionByName(named.select(*found)).unionByName(
        root.select(*found))
    ends = rows.filter("depth = length").select(*NODE, "conv_id").unionByName(
        conversations.filter("length = 0").select(
            *[F.lit(0).cast("bigint").alias(c) for c in NODE], "conv_id"))
    nothing = F.sha2(F.lit(""), 256)
    return everything.join(ends_digest(ends), NODE, "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", nothing))


def _root(conversations: DataFrame, kids: DataFrame, parts: DataFrame) -> DataFrame:
    """The root's row; none without conversations. All sums combine on the map side."""
    counts = [
        conversations.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")),
        parts.agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")),
        kids.filter("depth = 0").agg(F.sum("n_children").alias("n_children")),
    ]
    together = counts[0].unionByName(counts[1], True).unionByName(counts[2], True)

    def known(name: str, least: int) -> Column:
        return F.coalesce(F.max(name), F.lit(least)).cast("bigint").alias(name)
    return together.agg(
        F.max("conv_id").alias("conv_id"), known("n_convs", 0), known("n_children", 0),
        known("n_leaves", 1), known("saved_tokens", 0),
    ).filter("n_convs > 0").select(
        *[F.lit(0).cast("bigint").alias(c) for c in NODE],
        F.lit(None).cast("bigint").alias("parent_conv_id"), "*",
    )
