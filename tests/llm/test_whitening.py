from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from txnwatch.llm import whitening
from txnwatch.llm.queries import QUERIES


def plain(rows, components=16):
    """Exact covariance by fractions, then numpy's eigenvectors."""
    xs = {}
    for vec_id, vector in rows:
        if vector and all(c is not None and math.isfinite(c) for c in vector):
            xs.setdefault(vec_id, []).append([math.floor(64 * c) + 1_000_000 for c in vector])
    fit = sorted({tuple(x) for many in xs.values() for x in many})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    d = len(sums)
    far = np.array([[n * x - s for x, s in zip(row, sums)] for row in fit], object)
    v = np.array([[float(Fraction(int(far[:, i] @ far[:, j]), n**3)) for j in range(d)] for i in range(d)])
    e, vectors = np.linalg.eigh(v)
    e, vectors = e[::-1][:components], vectors[:, ::-1][:, :components]
    out = {}
    for vec_id, many in xs.items():
        for x in many:
            at = [n * a - s for a, s in zip(x, sums)]
            w = (np.array([a / n for a in at]) @ vectors) / np.sqrt(e)
            out.setdefault(vec_id, []).append((sum(a * a for a in at), w))
    return n, e / np.trace(v), out


def compare(got, rows, k):
    n, explained, want = plain(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    assert set(by_id) == set(want)
    signs = {}
    for vec_id, many in by_id.items():
        per_row = [many[i : i + k] for i in range(0, len(many), k)]
        assert len(per_row) == len(want[vec_id])
        for row in per_row:
            assert [r.component for r in row] == list(range(1, k + 1))
            options = [w for dev, w in want[vec_id] if dev == row[0].deviation]
            assert options
            for r in row:
                assert r.n == n and 0 <= r.identity_error < 1e-9
                assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9)
                near = [w[r.component - 1] for w in options]
                assert any(abs(abs(r.whitened) - abs(w)) < 1e-7 for w in near)
                if len(near) == 1 and abs(near[0]) > 1e-3:
                    signs.setdefault(r.component, set()).add(r.whitened * near[0] > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_query_equals_plain_version(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    compare(QUERIES["op13_whitening"](spark, small).collect(), rows, 16)


def vectors(seed, d=5, n=60):
    rng = random.Random(seed)
    rows = [(k, [rng.gauss(3, 2**j) for j in range(d)]) for k in range(n)]
    rows += [(n + k, rows[0][1]) for k in range(n // 2)]  # a third of all rows is one vector
    rows += [(0, rows[0][1]), (None, rows[1][1]), (900, None), (901, []), (902, [1.0, None] + [0.0] * (d - 2))]
    rows += [(903, [math.nan] * d), (904, [math.inf] + [0.0] * (d - 1)), (905, [-0.0] * d)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_repeats_and_unsound_vectors(spark, seed):
    rows = vectors(seed)
    table = spark.createDataFrame(
        [(*r, "x") for r in rows], "vec_id long, embedding array<double>, `whitened.n` string"
    ).repartition(5)
    compare(whitening.whiten(table).collect(), rows, 5)


def test_values_far_apart_stay_exact(spark):
    rng = random.Random(4)
    rows = [(k, [rng.uniform(0, 1e13), rng.uniform(-1, 1)]) for k in range(20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(table)[2]
    xs = [[math.floor(64 * c) for c in v] for _, v in rows]
    means = [Fraction(sum(c), 20) for c in zip(*xs)]
    for i in range(2):
        for j in range(2):
            exact = sum((x[i] - means[i]) * (x[j] - means[j]) for x in xs) / 20
            assert math.isclose(model.covariance[i, j], float(exact), rel_tol=1e-15)
    # (n * x - S)^2 is beyond a bigint
    assert {r.deviation for r in whitening.whiten(table).collect()} == {None}
    too_far = spark.createDataFrame([(1, [1e300, 0.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(too_far).count() == 0


def test_lengths_apart_and_directions_without_spread(spark):
    rows = vectors(1, d=4) + [(2000 + k, [float(k), float(2 * k)]) for k in range(5)]
    rows += [(3000, [1.0, 2.0, 3.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    pair = [r for r in got if 2000 <= (r.vec_id or 0) < 3000]
    assert {(r.component, r.n) for r in pair} == {(1, 5)}  # the second is twice the first
    assert {r.vec_id for r in pair} == {2000 + k for k in range(5)}
    assert not [r for r in got if r.vec_id == 3000]
    compare([r for r in got if (r.vec_id or 0) < 1000], vectors(1, d=4), 4)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(empty).count() == 0
