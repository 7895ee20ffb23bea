from __future__ import annotations

import random

import brute
import pytest
from pyspark.sql import functions as F

from txnwatch.llm import simhash
from txnwatch.llm.links import components

WORDS = [f"w{i}" for i in range(400)]


def texts(seed: int, n: int):
    """Random texts, copies of them with a word or two changed, one with many near copies."""
    rng = random.Random(seed)
    made = [" ".join(rng.choices(WORDS, k=rng.randrange(1, 120))) for _ in range(n // 3)]
    made += made[: n // 10]
    base = rng.choices(WORDS, k=300)
    for _ in range(n - len(made)):
        near = list(base)
        for _ in range(rng.randrange(3)):
            near[rng.randrange(300)] = rng.choice(WORDS)
        made.append(" ".join(near))
    made[:6] = [None, "", " \n\t", "Two Words", "two\twords", "É é"]
    rng.shuffle(made)
    return made


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")


@pytest.mark.parametrize("text", [None, "", "a", "A b", "a b c", "a b c d a b c d", "É Ab c d e"])
def test_fingerprint_equals_the_plain_one(text):
    assert simhash.fingerprint(text) == brute.fingerprint(text)


def test_fingerprint_of_a_long_text(monkeypatch):
    text = " ".join(random.Random(1).choices(WORDS, k=3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SLAB", 100)
    assert simhash.fingerprint(text) == whole == brute.fingerprint(text)


def test_block_coordinates_determine_the_block():
    codes = [p & 0xFFFF for p in simhash.PIVOTS[0]]
    seen = {tuple((x ^ c).bit_count() - x.bit_count() for c in codes) for x in range(1 << 16)}
    assert len(seen) == 1 << 16


@pytest.mark.parametrize("max_group", [1, 5, 64])
def test_components_equal_brute_force(spark, max_group):
    made = texts(max_group, 150)
    rows = [(i * 7 % 150, t, "x", 1) for i, t in enumerate(made)]
    fps = {i: brute.fingerprint(t) for i, t, _, _ in rows}
    want = brute.groups(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = simhash.near_duplicates(docs(spark, rows), max_group=max_group).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == fps
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("bits,max_group", [(0, 1), (1, 1), (1, 64), (2, 1), (2, 64)])
def test_links_of_close_fingerprints(spark, bits, max_group):
    rng = random.Random(bits)
    fps = set()
    for base in (0, -1 % (1 << 64), rng.getrandbits(64)):
        for _ in range(25):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))
    fps = sorted(fps)
    want = brute.groups(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= bits)
    rows = spark.createDataFrame(
        [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long"
    )
    found = components(simhash.links(rows, bits, max_group)).collect()
    got = {r.node: r.component for r in found}
    assert {i: got.get(i, i) for i in range(len(fps))} == want


def test_more_bits_than_blocks_cover_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "fp long, rep long"), 3)


def test_discarded_pairs_are_never_close(spark):
    rng = random.Random(2)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(50)]
    pairs += [(a, a ^ 1 << rng.randrange(63) ^ 1 << rng.randrange(63)) for a, _ in pairs]
    df = spark.createDataFrame(pairs, "x long, y long").select(
        simhash.coordinate_difference(F.col("x"), F.col("y")).alias("d"),
        F.bit_count(F.col("x").bitwiseXOR(F.col("y"))).alias("bits"),
    )
    assert all(r.d <= r.bits for r in df.collect())


def test_null_and_repeated_ids_and_no_rows(spark):
    rows = [(1, "a b c d", None, None), (1, "e f g h", None, None), (None, "a b c d", None, None)]
    rows += [(3, "a b c d", None, None), (3, "a b c d", None, None)]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [
        (0, 0), (1, 1), (1, 1), (3, 1), (3, 1),
    ]
    left = simhash.drop_near_duplicates(docs(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == [
        (0, "a b c d"), (1, "a b c d"), (1, "e f g h"),
    ]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_chains_stars_and_noise(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    links += [(5, 5), (None, 3), (7, None), (3, 2), (129, 40)]
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {n: 0 for n in [*range(41), *range(100, 130)]}
    assert len(got) == 71
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dotted_and_clashing_columns_stay(spark):
    rows = [(1, "a b c d", "x", 1), (2, "a b c d", "y", 2), (None, "a b c d", None, 3), (3, None, "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, gone int")
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0
