"""The registered queries on the whole smallest tables, against SQL or plain versions."""

from __future__ import annotations

from collections import Counter, defaultdict
from pathlib import Path

import brute
import corpus_pipeline
import duckdb
import pytest

from txnwatch.llm import linededup, tokencounts, toxicity
from txnwatch.llm.oracle import ORACLES
from txnwatch.llm.queries import QUERIES


@pytest.fixture(scope="module")
def con(small):
    connection = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    yield connection
    connection.close()


def listed(rows):
    return sorted(
        tuple(repr(round(v, 9)) if isinstance(v, float) else str(v) for v in row) for row in rows
    )


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, con, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    names = ", ".join(f'"{c}"' for c in columns)
    want = con.sql(f"SELECT {names} FROM ({ORACLES[name]})").fetchall()
    assert listed(df.select(columns).collect()) == listed(want) and want


def documents(spark, small):
    return [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]


def test_simhash(spark, small):
    fps = {d[0]: brute.fingerprint(d[1]) for d in documents(spark, small)}
    want = brute.groups(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = QUERIES["op5_simhash"](spark, small).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {
        i: (f"{fps[i]:016x}", want[i]) for i in fps
    }


def test_token_counts(spark, small):
    from txnwatch.llm.queries import VERSION, VOCABULARY

    tokens = tokencounts.Tokens(tokencounts.read_ranks(VOCABULARY))
    labels = spark.read.parquet(f"{small}/labels.parquet").collect()
    low = {r.doc_id for r in labels if r.quality == 0}
    toxic = {r.doc_id for r in labels if r.toxic == 1}
    want = defaultdict(Counter)
    for doc_id, text, lang, source, *_ in documents(spark, small):
        if doc_id not in low:
            key = ("quarantine" if doc_id in toxic else source, lang, VERSION)
            want[key].update(docs=1, tokens=tokens.count(text))
    got = QUERIES["op2_token_counts"](spark, small).collect()
    assert {tuple(r)[:3]: {"docs": r.docs, "tokens": r.tokens} for r in got} == want


def test_toxicity_and_decontamination_judge_every_document(spark, small):
    ids = sorted(d[0] for d in documents(spark, small))
    for name, flag in (("op7_toxicity", "toxic"), ("op6_decontamination", "contaminated")):
        got = QUERIES[name](spark, small).select("doc_id", flag).collect()
        assert sorted(r[0] for r in got) == ids and 0 < sum(r[1] for r in got) < len(ids) / 2


def test_pipeline_equals_its_plain_version(spark, small):
    docs = [(d[0], d[3], d[1]) for d in documents(spark, small)]
    labels = spark.read.parquet(f"{small}/labels.parquet")
    chain = toxicity.train(spark.read.parquet(f"{small}/documents.parquet"), labels)
    ids = toxicity.WordIds()

    def toxic(text):
        p = []
        for link in chain:
            found = ids.of(text.encode())
            p.append(link.probability(sum(link.words.get(int(i), 0.0) for i in found), p))
        return p[-1] >= 0.25

    docs = [d for d in docs if not toxic(d[2])]
    cut = brute.boilerplate_cut([(s, t) for _, s, t in docs], linededup.MAX_RATIO, linededup.MIN_PAGES)
    docs = [(i, s, t) for (i, s, _), t in zip(docs, cut)]
    fps = {i: brute.fingerprint(t) for i, _, t in docs}
    groups = brute.groups(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    docs = [d for d in docs if groups[d[0]] == d[0]]

    def plain(text):
        return [w.strip(".,;:!?%*#$&|").lower() for w in brute.words(text)]

    def windows(text):
        w = plain(text)
        return [tuple(w[k : k + 8]) for k in range(len(w) - 7)]

    items = [windows(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]

    def leaks(text):
        found = set(windows(text))
        for item in items:
            hits = [w in found for w in item]
            if sum(hits) >= 0.3 * len(item) > 0 or "t" * 6 in "".join("ft"[h] for h in hits):
                return True
        return False

    docs = [d for d in docs if not leaks(d[2])]
    copies = brute.copies(docs)
    want = Counter({(i, t): n for (i, _, t), n in zip(docs, copies) if n})
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.run(spark, small).collect())
    assert got == want
