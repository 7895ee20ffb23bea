from __future__ import annotations

import random
from collections import Counter

import pytest

from txnwatch.llm import tokencounts as tc

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
CHANGES = "source string, lang string, tokenizer string, sign int, tokens long, docs int"


@pytest.fixture
def rollup(spark, tmp_path):
    return tc.Rollup(spark, str(tmp_path / "rollup"))


def totals(rollup):
    return {tuple(r)[:3]: (r.docs, r.tokens) for r in rollup.totals().collect()}


def test_commits_are_additive_idempotent_and_compactable(spark, rollup):
    rng, want, batches = random.Random(2), {}, []
    for b in range(4):
        rows = []
        for _ in range(30):
            source = "hot" if rng.random() < 0.4 else rng.choice(["a", None])
            rows.append((source, rng.choice(["en", None]), "v1", rng.choice([1, 1, -1, None]), rng.choice([3, 5, None]), 9))
        batches.append(rows)
        for s, lang, v, sign, tokens, _ in rows:
            d, t = want.get((s, lang, v), (0, 0))
            want[s, lang, v] = (d + (sign or 0), t + (sign or 0) * (tokens or 0))
    want = {k: v for k, v in want.items() if any(v)}
    for b, rows in enumerate(batches):
        assert rollup.commit(f"b{b}", spark.createDataFrame(rows, CHANGES))
        if b == 1:
            rollup.compact()
        assert not rollup.commit("b0", spark.createDataFrame(batches[0], CHANGES))
    assert totals(rollup) == want
    rollup.compact()
    assert totals(rollup) == want and rollup.committed() == {"b0", "b1", "b2", "b3"}
    assert not rollup.commit("b2", spark.createDataFrame(batches[2], CHANGES))
    assert totals(rollup) == want


def test_a_batch_without_success_mark_is_written_over(spark, rollup, tmp_path):
    folder = tmp_path / "rollup" / "batch-x"
    rows = [("a", "en", "v1", 1, 7, 0)]
    spark.createDataFrame(rows * 5, CHANGES).write.parquet(str(folder))
    (folder / "_SUCCESS").unlink()
    assert totals(rollup) == {}
    assert rollup.commit("x", spark.createDataFrame(rows, CHANGES))
    assert totals(rollup) == {("a", "en", "v1"): (1, 7)}


def test_empty_batches_and_bad_ids(spark, rollup):
    none = spark.createDataFrame([], CHANGES)
    assert totals(rollup) == {} and rollup.commit("none", none) and not rollup.commit("none", none)
    rollup.compact()
    assert totals(rollup) == {}
    with pytest.raises(ValueError):
        rollup.commit("../x", none)


def test_counts_and_revisions(spark, rollup):
    ranks = tc.read_ranks(VOCABULARY)
    whole = tc.Tokens(ranks).encoding
    texts = ["Hello world", None, "", "naïve café 12 345", "a\n\n b", " word" * 50_000, "x" * 1000]
    docs = spark.createDataFrame(
        [(i, t, "s" if i % 2 else None, "en", "t") for i, t in enumerate(texts)],
        "doc_id long, text string, source string, lang string, tokens string",
    )
    before = tc.count_tokens(docs, ranks, "v1")
    got = {r.doc_id: r.tokens for r in before.collect()}
    assert got == {i: len(whole.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    after = before.where("doc_id <> 3").withColumn("tokenizer", before.tokenizer)
    rollup.commit("1", tc.inserts(before))
    rollup.commit("2", tc.revisions(before, after))
    want = Counter()
    for i, n in got.items():
        if i != 3:
            want["s" if i % 2 else None] += n
    assert {k[0]: v[1] for k, v in totals(rollup).items()} == want
    assert tc.count_tokens(docs.limit(0), ranks, "v1").count() == 0


def test_pieces_do_not_change_counts(monkeypatch):
    rng = random.Random(4)
    tokens = tc.Tokens(tc.read_ranks(VOCABULARY))
    for _ in range(30):
        text = "".join(rng.choices(["a", "Bc", " ", "  ", "\n", "é", "1", "'s", ".", "日", "_"], k=400))
        monkeypatch.setattr(tc, "PIECE", 10)
        pieces = list(tokens.pieces(text))
        assert "".join(pieces) == text
        assert tokens.count(text) == len(tokens.encoding.encode_ordinary(text))
