"""Merkle manifest of a dataset: a root for all rows, a proof for each, and what a claim folds to.

Rows are leaves. Per group they ascend by id; every three consecutive nodes make a node of the
next level, the last run may be shorter, until one is left, the group's subroot. Subroots, in
order of their groups, go on in the same way up to the root. Every digest is SHA-256 of the hex
digests below it.

Cogrouped subtree exchange: ``SPAN`` consecutive nodes are a superblock. Each superblock is
reduced alone to its top; tops are the nodes of the next storey and are cut into superblocks
again, until every group has one top. On the way down each superblock is cogrouped with the one
row of outer nodes that its leaves need above it, and one call finishes its reduction, joins
both parts of each proof and folds the claimed leaves. No call holds more than ``SPAN`` rows,
and no group, storey or root path passes through one task or the driver. Places within a group
come from a range sort (``ranked``), so a group with a third of all rows spreads as well.

A proof is the text of all siblings' digests, level by level from the leaf to the root, left to
right; its path has two digits per level, the node's place in its run and the size of the run.

Defined results: null and empty texts differ, as a null field is written ``-`` and an empty one
``0:``. A null group is the first group, apart from the empty one. Null ids come first within
their group; rows of one id are ordered by their leaves, and equal rows are leaves of their own
with equal digests. A lone row is its group's subroot, and with one group the root; its proof is
empty. An empty table gives an empty table. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from newsloom.llm.ranked import placed
from newsloom.session import materialise

RUN = 3
LEVELS = 6
#: Consecutive nodes that are reduced together.
SPAN = RUN ** LEVELS


def field(value: Column) -> Column:
    """One field so that no two lists of fields give the same text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    )


def leaf_of(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def digest_of(nodes) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels_of(block: int, nodes: int) -> int:
    """How many levels a superblock spans; one that is alone in its tree ends at the top."""
    if block or nodes == SPAN:
        return LEVELS
    levels = 0
    while RUN ** levels < nodes:
        levels += 1
    return levels


def reduced(digests: list[str], block: int) -> list[list[str]]:
    """All levels of a superblock, from its nodes to its top."""
    levels = [digests]
    for _ in range(levels_of(block, len(digests))):
        below = levels[-1]
        levels.append([digest_of(below[i:i + RUN]) for i in range(0, len(below), RUN)])
    return levels


def steps(level: list[str], at: int) -> tuple[list[str], str]:
    """Siblings of a node in its run, and its place in the run with the size of the run."""
    start = at - at % RUN
    run = level[start:start + RUN]
    return run[:at - start] + run[at - start + 1:], f"{at - start}{len(run)}"


def fold(leaf: str, proof: str, path: str) -> str:
    """The root that a leaf and its proof lead to."""
    digest, at, size = leaf, 0, len(leaf)
    for i in range(0, len(path), 2):
        place, run = int(path[i]), int(path[i + 1])
        siblings = [proof[j:j + size] for j in range(at, at + (run - 1) * size, size)]
        at += (run - 1) * size
        digest = digest_of([*siblings[:place], digest, *siblings[place:]])
    return digest


def _tops(key, nodes):
    import pandas as pd

    tree, block = key
    levels = reduced(nodes.sort_values("pos")["digest"].tolist(), block)
    return pd.DataFrame({"tree": [tree], "pos": [block], "digest": [levels[-1][0]]})


def _proved(nodes, outer, block):
    """Proof and path of each node, from its superblock's levels and what lies above it."""
    levels = reduced(nodes["digest"].tolist(), block)
    above = [(outer["proof"].iloc[0], outer["path"].iloc[0])]
    for level in reversed(levels[:-1]):
        now = []
        for at in range(len(level)):
            siblings, place = steps(level, at)
            proof, path = above[at // RUN]
            now.append(("".join(siblings) + proof, place + path))
        above = now
    return [p for p, _ in above], [p for _, p in above]


def _climbed(key, nodes, outer):
    import pandas as pd

    nodes = nodes.sort_values("pos")
    proofs, paths = _proved(nodes, outer, key[1])
    return pd.DataFrame({
        "tree": [key[0]] * len(nodes), "pos": nodes["pos"].tolist(), "proof": proofs, "path": paths,
        "top": [outer["top"].iloc[0]] * len(nodes),
    })


def _finished(key, nodes, outer):
    import pandas as pd

    nodes = nodes.sort_values("pos")
    proofs, paths = _proved(nodes, outer, key[1])
    leaves, claims = nodes["digest"].tolist(), nodes["claimed"].tolist()
    # Leaves nobody disputes all lead over the same top, which is folded once.
    levels = reduced(leaves, key[1])
    agreed = fold(levels[-1][0], outer["proof"].iloc[0], outer["path"].iloc[0])
    folded = [agreed if claim == leaf else fold(claim, proof, path)
              for leaf, claim, proof, path in zip(leaves, claims, proofs, paths)]
    root = outer["root"].iloc[0]
    return pd.DataFrame({
        "name": nodes["name"], "leaf": leaves, "subroot": [outer["top"].iloc[0]] * len(nodes),
        "root": [root] * len(nodes), "proof": proofs, "path": paths, "folded_root": folded,
        "verified": [f == root for f in folded],
    })


def _blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {SPAN}"))


def tops(nodes: DataFrame) -> DataFrame:
    """(tree, pos, digest) of each superblock's top."""
    narrow = _blocked(nodes.select("tree", "pos", "digest"))
    return materialise(narrow.groupBy("tree", "block").applyInPandas(
        _tops, "tree string, pos bigint, digest string"))


def above(nodes: DataFrame) -> DataFrame:
    """(tree, pos, proof, path, top) of each node, from it up to its tree's last node."""
    if nodes.filter("pos > 0").isEmpty():
        return nodes.select(
            "tree", "pos", F.lit("").alias("proof"), F.lit("").alias("path"), F.col("digest").alias("top"))
    outer = above(tops(nodes)).withColumnRenamed("pos", "block")
    cogrouped = _blocked(nodes).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    return materialise(cogrouped.applyInPandas(
        _climbed, "tree string, pos bigint, proof string, path string, top string"))


def manifest(
    docs: DataFrame, leaf: Column, claimed: Column | None = None, id_col: str = "doc_id",
    group_col: str = "source",
) -> DataFrame:
    """Per row its id, leaf, subroot, root, proof and path, and whether its claim is verified.

    ``claimed`` is the leaf that somebody states for the row, its own if not given;
    ``folded_root`` is where that leads with the proof, and the claim is verified if that is the
    root.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(group_col).cast("string").alias("tree"),
        leaf.alias("digest"), (leaf if claimed is None else claimed).alias("claimed"),
    )
    # As text, since a null among them would turn whole numbers into floats in pandas.
    leaves = placed(
        materialise(rows).withColumn("name", F.col("id").cast("string")), ["tree"],
        [F.col("id").asc_nulls_first(), F.col("digest")], keep=["tree", "name", "digest", "claimed"],
    ).withColumnRenamed("place", "pos")

    inner = above(tops(leaves))
    subroots = placed(
        inner.filter("pos = 0").select(F.lit("").alias("all"), F.col("tree").alias("group"), "top"),
        ["all"], [F.col("group").asc_nulls_first()], keep=["all", "group", "top"],
    )
    last = above(subroots.select(
        F.col("all").alias("tree"), F.col("place").alias("pos"), F.col("top").alias("digest"))).drop("tree")
    ways = subroots.join(last.withColumnsRenamed({"top": "root"}), F.col("place") == F.col("pos")).select(
        "group", F.col("proof").alias("last_proof"), F.col("path").alias("last_path"), "root")
    outer = inner.join(ways, F.col("tree").eqNullSafe(F.col("group"))).select(
        "tree", F.col("pos").alias("block"), F.concat("proof", "last_proof").alias("proof"),
        F.concat("path", "last_path").alias("path"), "top", "root",
    )
    cogrouped = _blocked(leaves).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    finished = cogrouped.applyInPandas(_finished, (
        "name string, leaf string, subroot string, root string, proof string, path string, "
        "folded_root string, verified boolean"
    ))
    own = F.col("name").cast(rows.schema["id"].dataType).alias(id_col)
    return finished.select(own, *finished.columns[1:])
