from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnwatch.llm import backoff


def plain(texts, order, alpha=0.4):
    docs = [(t or "").split() for t in texts]

    def grams(doc, n):
        return Counter(tuple(doc[i : i + n]) for i in range(len(doc) - n + 1))

    totals = {n: sum((grams(d, n) for d in docs), Counter()) for n in range(1, order + 1)}
    words, out = sum(map(len, docs)), []
    for doc in docs:
        own = {n: grams(doc, n) for n in totals}

        def count(g, own=own):
            return totals[len(g)][g] - own[len(g)][g]

        score, backed, rest = 0, 0, words - len(doc)
        for i in range(len(doc)):
            factor = 1.0
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(doc[i - n + 1 : i + 1])
                if n == 1:
                    value = count(gram) / rest if count(gram) else 1 / (rest + 1)
                    backed += factor < 1 or not count(gram)
                elif count(gram):
                    value, n = count(gram) / count(gram[:-1]), 0
                    backed += factor < 1
                else:
                    factor *= alpha
                    continue
                break
            score += round(math.log(factor * value) * 1e6)
        out.append((len(doc), backed, score / 1e6))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    made = [" ".join(rng.choices("a b c d e f é g\tx".split(" "), k=rng.randrange(30))) for _ in range(n)]
    return [*made, made[0], made[0], None, "", " \n", "alone", "a " * 2000]


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("parts", [1, 4])
def test_equals_plain_counts(spark, order, parts):
    texts = corpus(order, 40)
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, chunk int")
    rows = sorted(backoff.scores(df.coalesce(parts), order).collect())
    want = plain(texts, order)
    assert [(r.n_words, r.n_backed_off) for r in rows] == [w[:2] for w in want]
    # logarithms of numpy and math may round a word's millionths differently
    assert [r.log_score for r in rows] == pytest.approx([w[2] for w in want], abs=1e-5)
    assert all((r.per_word is None) == (r.n_words == 0) for r in rows)


def test_null_ids_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    rows = backoff.scores(df).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"]
    assert len({r.log_score for r in rows}) == 1
    assert backoff.scores(df.limit(0)).count() == 0
    one = backoff.scores(df.limit(1)).first()
    assert one.log_score == pytest.approx(math.log(0.4), abs=1e-5)


def test_ngrams_of_one_chunk_only_stay_there(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = ["in all of them " + " ".join(rng.choices(words, k=300)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    light = df.repartitionByRange(4, "doc_id").select(
        "doc_id", F.col("text").cast("binary"), F.spark_partition_id().alias("part")
    )
    chunks = light.mapInArrow(backoff._states, backoff.STATE).localCheckpoint()
    by, have = backoff.Buckets(sum(len(t.split()) for t in texts)), Counter()
    for row in chunks.collect():
        _, _, sizes, hashed = backoff._open(bytes(row.state))
        for n, (gram, inside) in enumerate(backoff._grams(hashed, backoff._owners(sizes), 3)):
            have.update((n, int(g)) for g in np.unique(gram[inside].view(np.int64)))
    found = backoff.masks(chunks, 3, by)
    rows = backoff.candidates(chunks, found, 3, by).collect()
    sent = Counter((r.bucket >> by.bits, g) for r in rows for g in r.grams)
    shared = {g: k for g, k in have.items() if k > 1}
    assert chunks.count() == 4 and len(shared) > 2000 and len(have) > 20_000
    assert all(sent[g] == k for g, k in shared.items())
    # what only looks shared is a small part of the others
    assert len(sent) - len(shared) < 0.2 * (len(have) - len(shared))


def test_steps_come_back():
    for numbers in ([], [0, 0, 7], [5, 1 << 40, 1 << 63, (1 << 64) - 1], list(range(0, 1 << 20, 300))):
        given = np.array(numbers, np.uint64)
        assert (backoff._unpack_steps(backoff._pack_steps(given)) == given).all()
