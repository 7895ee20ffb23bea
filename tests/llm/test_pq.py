from __future__ import annotations

import random

import brute
import numpy as np
import pytest

from txnwatch.llm import pq

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component_id string, kept int"


def vectors(seed, n, d=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    made = []
    for i in range(n):
        near = centres[rng.integers(6)] if rng.random() < 0.7 else rng.normal(size=d)
        made.append([float(np.float32(x)) for x in near + rng.normal(size=d) * rng.choice([0.0, 0.15, 0.5])])
    made[3] = [2 * x for x in made[2]]
    bad = [None, [], [0.0] * d, [None] + [1.0] * (d - 1), [float("nan")] * d, [float("inf")] * d, [1.0] * (d + 1)]
    made[10 : 10 + len(bad)] = bad
    return made


def plain(rows, least=0.9):
    units = {i: brute.unit(v) for i, v in rows}
    size = len(rows[0][1])
    units = {i: u if u is not None and len(u) == size else None for i, u in units.items()}

    def linked(a, b):
        return units[a] is not None and units[b] is not None and units[a] @ units[b] >= least

    links = {a: sum(a != b and linked(a, b) for b in units) for a in units}
    return links, brute.groups(sorted(units), linked)


@pytest.mark.parametrize("block,lists", [(2048, 256), (8, 256), (16, 3), (64, 1)])
def test_equals_all_pairs(spark, block, lists):
    made = vectors(block, 150)
    rows = list(enumerate(made))
    df = spark.createDataFrame([(i, v, 0, 1, "c", 2) for i, v in rows], SCHEMA)
    got = pq.near_duplicates(df, block=block, max_lists=lists, subspaces=4, codes=8).collect()
    links, component = plain(rows)
    assert {r.vec_id: r.n_links for r in got} == links
    assert {r.vec_id: r.component_id for r in got} == component
    assert all(r.kept == (r.vec_id == r.component_id) for r in got) and len(got) == 150
    assert len(set(component.values())) < 150


@pytest.mark.parametrize("probes", [1, 3])
def test_recall_with_few_probes(spark, probes):
    rng = np.random.default_rng(probes)
    base = rng.normal(size=(120, 16))
    rows = [(i, [float(x) for x in base[i % 120] + rng.normal(size=16) * 0.2]) for i in range(480)]
    df = spark.createDataFrame([(i, v, 0, 1, "c", 2) for i, v in rows], SCHEMA)
    got = pq.near_duplicates(df, max_probes=probes, block=16).collect()
    links, component = plain(rows)
    assert all(r.n_links <= links[r.vec_id] for r in got)
    recall = sum(r.n_links for r in got) / sum(links.values())
    assert recall >= (0.9 if probes == 3 else 0.5)
    assert all(r.component_id >= component[r.vec_id] for r in got)
    assert sum(r.n_links for r in got) % 2 == 0


def test_a_small_training_sample_loses_nothing(spark):
    rows = list(enumerate(vectors(5, 120)))
    df = spark.createDataFrame([(i, v, 0, 1, "c", 2) for i, v in rows], SCHEMA)
    got = pq.near_duplicates(df, max_train=5, max_lists=4).collect()
    assert {r.vec_id: r.n_links for r in got} == plain(rows)[0]


def test_many_equal_vectors_null_ids_repeats_and_no_rows(spark):
    rng = random.Random(1)
    v, w = [rng.random() for _ in range(5)], [-rng.random() for _ in range(5)]
    rows = [(i, v if i % 3 else w, 0, 1, "c", 2) for i in range(60)]
    rows += [(None, v, 0, 1, "c", 2), (59, v, 0, 1, "c", 2)]
    got = pq.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 62
    assert {r.n_links for r in got if r.vec_id and r.vec_id % 3} == {40}
    assert {r.component_id for r in got if r.vec_id is not None} == {0, 1}
    none = [r for r in got if r.vec_id is None]
    assert (none[0].n_links, none[0].component_id, none[0].kept) == (0, None, None)
    assert pq.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    only = spark.createDataFrame([(7, None, 0, 1, "c", 2)], SCHEMA)
    assert [tuple(r) for r in pq.near_duplicates(only).collect()] == [(7, 0, 7, True)]


def test_lookup_distances_and_probes_are_bounds():
    rng = np.random.default_rng(2)
    x = pq.unit(rng.normal(size=(200, 16)))
    quantiser = pq.train(x, 8, 4, 8)
    lists, codes, left = quantiser.encode(x)
    exact = np.sqrt(pq.squared(x, x))
    for number in range(8):
        inside = lists == number
        tables = quantiser.tables(x, number)
        far = np.sqrt(sum(t[:, codes[inside, j]] for j, t in enumerate(tables)))
        assert (far - left[inside] <= exact[:, inside] + 1e-6).all()
    for i, probes in enumerate(quantiser.probes(x, 0.6)):
        assert set(lists[exact[i] <= 0.6]) <= set(probes)
