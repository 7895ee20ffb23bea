from __future__ import annotations

import random
from collections import defaultdict

import brute
import pytest

from txnwatch.llm import mixing

SCHEMA = "doc_id long, text string, source string, copy string, size string"


def rows(seed, n, sources=("a", "b", "c", "d", None)):
    rng, out = random.Random(seed), []
    for i in range(n):
        source = "hot" if rng.random() < 0.4 else rng.choice(sources)
        text = rng.choice([None, "", " ", "x " * rng.randrange(1, 60), "y"])
        out.append((i, text, source, "c", "s"))
    return out


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 10, "b": 10, "c": 10},
        {"a": 1, "b": 100, "c": 5, None: 7},
        {"a": 0, "b": 3},
        {"a": 0},
        {"a": 1, "b": 1, "c": 1000, "d": 1, "e": 2, "é": 4, "Z": 9, None: 0},
    ],
)
def test_targets_equal_repeated_sharing(spark, sizes):
    totals = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(totals).collect()}
    assert got == pytest.approx(brute.targets(sizes), abs=1e-9)
    assert all(got[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


@pytest.mark.parametrize("parts", ["2", "5"])
def test_copies_equal_the_plain_version(spark, parts):
    made = rows(3, 300)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(made, SCHEMA)
        got = {r.doc_id: r.copies for r in mixing.mix(df).collect()}
        mixed = mixing.mixture(df)
        counts = defaultdict(int)
        for r in mixed.collect():
            counts[r.doc_id] += 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = dict(zip((r[0] for r in made), brute.copies([(r[0], r[2], r[1]) for r in made])))
    assert got == want
    assert mixed.columns == ["doc_id", "text", "source", "copy", "size", "copy_"]
    assert dict(counts) == {k: v for k, v in want.items() if v}


def test_words_taken_are_near_the_target(spark):
    made = rows(5, 400)
    got = mixing.mix(spark.createDataFrame(made, SCHEMA), keep=["doc_id", "source"]).collect()
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in got:
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert 0 <= r.copies <= 2
    for source in target:
        assert abs(taken[source] - target[source]) <= 2 * largest[source]


def test_ties_repeated_rows_and_no_rows(spark):
    same = [(1, "a b", "s", None, None)] * 5 + [(None, "a b", "s", None, None)] * 3
    got = mixing.mix(spark.createDataFrame(same, SCHEMA)).collect()
    assert sum(r.copies for r in got) in (12, 13)  # of 8 * 1.5
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mixture(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dotted_and_clashing_columns_stay(spark):
    rows = [(k, "s", "one two", k, "t") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, `a.b` int, Copy string")
    mixed = mixing.mixture(docs)
    assert mixed.columns == [*docs.columns, "copy_"]
    got = mixed.collect()
    assert {tuple(r)[:5] for r in got} <= set(rows) and sum(r["copy_"] == 1 for r in got) >= 1
