from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from txnwatch.llm import prefixtrie


def plain(rows, borrow=True):
    """rows: (conv_id, turn, role, text) without ties. Nodes by their sequences."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(many)] for c, many in own.items()}
    whole = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if borrow else 0
        whole[c] = own.get(c - c % 5, [])[:h] + seq[h:]
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) > len(n) for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs), len(node), parent, len(convs), len(children), len(leaves), saved, digest))
    return sorted(out, key=str)


def made(seed, n=40, hot=True):
    rng = random.Random(seed)
    rows, texts = [], ["", "a", "bé", "c c", None]
    for c in rng.sample(range(200), n):
        for turn in range(rng.randrange(1, 7)):
            rows.append((c, turn if turn or rng.random() < 0.8 else None, rng.choice(["user", "bot", None]), rng.choice(texts)))
    if hot:  # one conversation with a third of all rows
        rows += [(300, turn, "user", f"t{turn % 3}") for turn in range(len(rows) // 2)]
    rows += [(None, 1, "user", "lost"), (10**12 + 3, 5, None, None)]
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame(
        [(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, `depth.x` int"
    ).repartition(3)


def result(spark, rows, last, borrow=True):
    turns = prefixtrie.turns(table(spark, rows))
    c = F.col("conv_id")
    begun = prefixtrie.rebuilt(turns, c - c % 5, F.crc32(c.cast("string")) % 9) if borrow else turns
    found = prefixtrie.trie(begun, turns.select("conv_id").distinct(), last)
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("seed, last", [(0, 1), (1, 40), (2, 1 << 15)])
def test_trie_equals_plain_version(spark, seed, last):
    rows = made(seed)
    assert result(spark, rows, last) == plain(rows)


def test_no_borrowed_turns_repeats_and_ties(spark):
    rows = made(5, n=10, hot=False)
    assert result(spark, rows, 8, borrow=False) == plain(rows, borrow=False)
    # ties and repeated rows are turns of their own, in one order for all conversations
    tied = [(c, 0, r, t) for c in (1, 2, 3) for r, t in (("u", "x"), ("b", "y"), ("b", "y"))]
    got = result(spark, tied, 8, borrow=False)
    assert [(r[1], r[3], r[6]) for r in sorted(got, key=lambda r: r[1])] == [
        (0, 3, 6), (1, 3, 6), (2, 3, 4), (3, 3, 2)
    ]


def test_empty_table_and_turnless_conversations(spark):
    assert result(spark, [], 4) == []
    none = spark.createDataFrame([], "conv_id long, pos long, h1 long, h2 long, bytes long")
    ids = spark.createDataFrame([(4,), (11,)], "conv_id long")
    (root,) = prefixtrie.trie(none, ids).collect()
    assert tuple(root) == (4, 0, None, 2, 0, 1, 0, hashlib.sha256(b"4,11").hexdigest())


@pytest.mark.parametrize("seed", range(3))
def test_list_ranks(spark, seed):
    rng = random.Random(seed)
    order = rng.sample(range(10**6), 200)
    rows = list(zip(order, [*order[1:], None]))
    rng.shuffle(rows)
    arcs = spark.createDataFrame(rows, "id long, next long")
    got = prefixtrie.list_ranks(arcs, [1, 30, 500][seed]).collect()
    assert sorted((r.pos, r.id) for r in got) == list(enumerate(order))


def test_rings_are_no_lists(spark):
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, None)], "id long, next long")
    with pytest.raises(Exception, match="no one list"):
        prefixtrie.list_ranks(ring).count()


def test_long_lists_of_members_are_digested_in_pieces(spark):
    ends = spark.range(5000).select(F.lit(1).cast("long").alias("depth"), F.lit(2).cast("long").alias("k1"),
                                    (F.col("id") % 2).alias("k2"), F.col("id").alias("conv_id"))
    got = {r.k2: r.ends_sha256 for r in prefixtrie.end_digests(ends, piece=7).collect()}
    for k in (0, 1):
        assert got[k] == hashlib.sha256(",".join(map(str, range(k, 5000, 2))).encode()).hexdigest()
