from __future__ import annotations

import random

import numpy as np
import pytest

from txnwatch.llm import toxicity as tx

DOCS = "doc_id long, text string, p_toxic string, rejected string, doc string"
LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(spark, n, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = rng.choices([f"w{k}" for k in "abcdefghijklmnop"], k=rng.randrange(5, 60))
        toxic, low = rng.random() < 0.3, rng.random() < 0.3
        words += ["nastyword"] * toxic + ["spamword"] * low
        rng.shuffle(words)
        docs.append((i, " ".join(words), "p", "r", "d"))
        labels.append((i, int(not low), int(toxic), "t"))
    return spark.createDataFrame(docs, DOCS), labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark, 400)
    train = spark.createDataFrame(labels[:300], LABELS)
    got = {r.doc_id: r for r in tx.toxicity(docs, train).collect()}
    assert len(got) == 400
    held = labels[300:]
    assert sum(got[i].toxic == bool(t) for i, _, t, _ in held) >= 97
    assert sum((got[i].p_low_quality >= 0.5) == (not q) for i, q, _, _ in held) >= 97


def test_held_out_accuracy_on_the_given_tables(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = labels.toPandas().sample(frac=1, random_state=3)
    cut = len(rows) * 3 // 4
    got = tx.toxicity(docs, spark.createDataFrame(rows[:cut])).toPandas()
    held = rows[cut:].merge(got, on="doc_id", suffixes=("", "_found"))
    clean, bad = held[held.toxic == 0], held[held.toxic == 1]
    assert clean.toxic_found.mean() <= 0.01 and bad.toxic_found.mean() >= 0.9


def test_dropping_keeps_rows_as_they_are(spark):
    docs, labels = corpus(spark, 200)
    more = spark.createDataFrame(
        [(None, None, None, None, None), (1000, "", "x", "y", "z"), (1001, "nastyword", "x", "y", "z")] * 2,
        DOCS,
    )
    every = docs.union(more)
    left = tx.drop_toxic(every, spark.createDataFrame(labels, LABELS))
    assert left.columns == every.columns
    toxic = {i for i, _, t, _ in labels if t} | {1001}
    kept = [r for r in every.collect() if r.doc_id not in toxic]
    assert sorted(map(str, left.collect())) == sorted(map(str, kept))


@pytest.mark.parametrize(
    "labels", [[], [(1, 1, 0, "x")], [(None, 0, 1, "x"), (2, None, 1, "x"), (3, 1, None, "x")]]
)
def test_without_usable_labels_nothing_is_rejected(spark, labels):
    docs, _ = corpus(spark, 20)
    assert tx.drop_toxic(docs, spark.createDataFrame(labels, LABELS)).count() == 20


def test_no_documents_and_repeated_labels(spark):
    docs, labels = corpus(spark, 30)
    twice = spark.createDataFrame(labels * 2, LABELS)
    assert tx.toxicity(docs, twice).count() == 30
    assert tx.toxicity(docs.limit(0), twice).count() == 0


def test_later_models_see_out_of_fold_probabilities():
    """A word that is in one row only predicts that row's label in training, not out of fold."""
    n = 60
    y = np.array([i % 2 for i in range(n)], float)
    rows = tx.Rows(
        np.arange(n, dtype=np.int32), np.ones(n, np.int64), np.stack([y, y], axis=1), np.arange(n) % 3, n
    )
    seen = []
    real, calls = tx.fit, []

    def fit(name, part, labels, earlier, *rest):
        calls.append((name, len(labels)))
        if name == "second":
            seen.append(earlier[:, 0])
        return real(name, part, labels, earlier, *rest)

    tx.fit = fit
    try:
        tx.train_chain(rows, ["first", "second"], 3, 1e-4, 100)
    finally:
        tx.fit = real
    assert calls == [("first", 60), ("first", 40), ("first", 40), ("first", 40), ("second", 60)]
    assert abs(np.corrcoef(seen[0], y)[0, 1]) < 0.3 or seen[0].std() < 1e-6
