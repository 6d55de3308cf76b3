"""The manifest against a tree built by hand, row by row."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from newsloom.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int, digest string"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def hand_leaf(row):
    return sha("".join(
        "-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def hand_tree(leaves):
    """The top, and per leaf its siblings in order."""
    level, ways = list(leaves), [([], i) for i in range(len(leaves))]
    while len(level) > 1:
        for proof, at in ways:
            run = level[at // 3 * 3:at // 3 * 3 + 3]
            proof += [d for i, d in enumerate(run) if i != at % 3]
        ways = [(proof, at // 3) for proof, at in ways]
        level = [sha("".join(level[i:i + 3])) for i in range(0, len(level), 3)]
    return level[0], [proof for proof, _ in ways]


def hand_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.source].append((r.doc_id, hand_leaf(r)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[name] = hand_tree([leaf for _, leaf in groups[name]])
    root, ways = hand_tree([trees[name][0] for name in names])
    return Counter(
        (doc_id, leaf, trees[name][0], root, "".join(proof + way))
        for name, way in zip(names, ways)
        for (doc_id, leaf), proof in zip(groups[name], trees[name][1])
    )


def got(docs):
    made = merkle.manifest(docs, merkle.leaf_of([F.col(f) for f in FIELDS])).collect()
    assert all(r.verified and r.folded_root == r.root for r in made)
    assert all(merkle.fold(r.leaf, r.proof, r.path) == r.root for r in made)
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in made)


def awkward(spark):
    rows = [
        (1, "a", "en", 3, "abc"), (1, "a", "en", 3, "abc"), (1, "a", "en", 3, "abd"), (None, "a", None, None, None),
        (2, "", "en", 0, ""), (3, None, "en", None, None), (1 << 60, None, "", -1, "x\ny" * 50_000),
        (None, None, None, None, None), (4, "ü", "de", 1, "ß"), (5, "z", "de", 1, "→"), (6, "\U0001f600", "de", 1, "1:2"),
    ]
    return spark.createDataFrame([(*r, "t", 1, "d") for r in rows], COLUMNS)


def test_awkward_rows(spark):
    docs = awkward(spark)
    assert got(docs) == hand_manifest(docs.collect())
    one = docs.filter("doc_id = 4")
    (lone,) = got(one)
    assert lone[1] == lone[2] == lone[3] and lone[4] == ""
    assert merkle.manifest(docs.limit(0), merkle.leaf_of([F.col("text")])).count() == 0


@pytest.mark.parametrize("rows", [merkle.SPAN - 1, merkle.SPAN, merkle.SPAN + 1, 4 * merkle.SPAN + 5])
def test_superblocks(spark, rows):
    """Groups around the size of a superblock, next to small ones."""
    docs = spark.range(rows + 60).selectExpr(
        "id as doc_id", f"if(id < {rows}, 'hot', concat('s', id % 13)) as source", "'en' as lang",
        "id as n_chars", "concat('text ', id) as text",
    ).repartition(7)
    assert got(docs) == hand_manifest(docs.collect())


def test_false_claims_are_found(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "if(id % 3 = 0, 'b', 'a') as source", "concat('t', id) as text")
    leaf = merkle.leaf_of([F.col("doc_id"), F.col("text")])
    false = merkle.leaf_of([F.col("doc_id"), F.lit("t7")])
    made = merkle.manifest(docs, leaf, F.when(F.col("doc_id") % 5 == 2, false).otherwise(leaf)).collect()
    assert {r.doc_id for r in made if r.verified} == {i for i in range(2000) if i % 5 != 2 or i == 7}
    for r in made:
        if not r.verified:
            claim = sha(f"{len(str(r.doc_id))}:{r.doc_id}2:t7")
            assert r.folded_root == merkle.fold(claim, r.proof, r.path) != r.root
