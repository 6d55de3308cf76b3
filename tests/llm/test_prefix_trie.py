"""The prefix trie against one built by hand, with and without a spine."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string, depth string, length int, place int, k1 string"
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def hand_conversations(rows):
    own = defaultdict(list)
    for r in rows:
        if r.conv_id is not None:
            own[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}

    def rebuilt(c):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - c % 100 if c >= 0 else c + -c % 100
        return own.get(base, [])[:h] + own[c][h:]
    return {c: rebuilt(c) for c in own}


def hand_trie(conversations):
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[:d - 1])].add(tuple(turns[:d]))

    totals = {}
    for path in sorted(members, key=len, reverse=True):
        below = [totals[k] for k in kids[path]]
        own = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        totals[path] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    return Counter(
        (min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(kids[path]), *totals[path],
         hashlib.sha256(",".join(map(str, sorted(c for c in cs if len(conversations[c]) == len(path)))).encode()).hexdigest())
        for path, cs in members.items()
    )


def got(df, **options):
    made = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.numbered_turns(df)), **options)
    return Counter(tuple(r) for r in made.select(*RESULT).collect())


def random_rows(seed):
    """Bases, their copies, turnless conversations, nulls, repeated turns and ids on both sides of 0."""
    random.seed(seed)
    rows = []
    for c in [*range(-130, 260, 3), 100, 200, -100]:
        for turn in range(random.choice([1, 2, 3, 5, 6, 7, 9])):
            said = random.choice(["yes", "no", "", None, "a longer answer ü"])
            rows.append((c, None if random.random() < 0.05 else turn, random.choice(["user", "assistant", None]), said))
            if random.random() < 0.1:
                rows.append(rows[-1])
    rows += [(c, t, "user", "same") for c in range(1000, 1060) for t in range(8)]
    rows += [(None, 0, "user", "nobody"), (5000, None, None, None)]
    return [(*r, "x", 1, 2, "y") for r in rows]


@pytest.mark.parametrize("subtree,shard", [(1024, 2048), (40, 30), (1, 4)])
def test_trie(spark, monkeypatch, subtree, shard):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    df = spark.createDataFrame(random_rows(subtree), TURNS).repartition(5)
    assert got(df, subtree=subtree) == hand_trie(hand_conversations(df.collect()))


def test_one_long_conversation_and_none(spark):
    long = spark.range(3000).selectExpr(
        "100L as conv_id", "id as turn", "'user' as role", "concat('t', id) as text")
    twice = long.unionByName(long.withColumn("conv_id", F.lit(101)))
    df = twice.unionByName(long.limit(3).withColumn("conv_id", F.lit(7)))
    assert got(df, subtree=500) == hand_trie(hand_conversations(df.collect()))
    assert got(df.limit(0)) == Counter()
    lone = df.filter("conv_id = 7 and turn = 0")
    assert got(lone) == hand_trie(hand_conversations(lone.collect()))


@pytest.mark.parametrize("deep", [0.0, 0.5, 0.99])
def test_findclose(deep):
    random.seed(1)
    parents = [-1]
    for i in range(1, 6000):
        parents.append(i - 1 if random.random() < deep else random.randrange(-1, i))
    order = prefix_trie.walk(parents)
    trie = prefix_trie.Parentheses([1 if n >= 0 else -1 for n in order])
    left = {~n: i for i, n in enumerate(order) if n < 0}
    opens = np.array([i for i, n in enumerate(order) if n >= 0])
    assert trie.findclose(opens).tolist() == [left[order[i]] for i in opens]


def test_ends_are_joined_in_order(spark):
    """A node where more conversations end than fit into one text."""
    n = 3 * prefix_trie.CHUNK + 5
    ends = spark.range(-7, n).selectExpr("3L as depth", "1L as k1", "-1L as k2", "id as conv_id")
    ends = ends.unionByName(spark.range(2).selectExpr("id as depth", "2L as k1", "2L as k2", "id as conv_id"))
    rows = {r.depth: r.ends_sha256 for r in prefix_trie.ends_digest(ends.repartition(9)).collect()}
    assert rows[3] == hashlib.sha256(",".join(map(str, range(-7, n))).encode()).hexdigest()
    assert rows[0] == hashlib.sha256(b"0").hexdigest() and len(rows) == 3
