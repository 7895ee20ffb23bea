"""A hot key under the settings of a cluster: adaptive execution, generated code, RocksDB state."""

import pytest
from conftest import tx_row
from test_streaming import in_batches, listed, message, write_files

from txnwatch.operators import features as feat
from txnwatch.operators import graph
from txnwatch.operators.scoring import score, user_features
from txnwatch.sources import transactions as src
from txnwatch.streaming import sinks

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.wholeStage": "true",
    "spark.sql.shuffle.partitions": "8",
    # small enough for a few thousand rows to count as a skewed partition
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


@pytest.fixture
def cluster_like(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def hot_rows(n=6000):
    return [
        tx_row(i, "hot" if i % 2 else f"u{i % 400}", float(i), i / 10, "gone" if i % 3 else "hot")
        for i in range(n)
    ]


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_the_score_join_splits_a_hot_user(cluster_like, make_tx):
    rows = hot_rows()
    tx = make_tx(rows).repartition(6)
    last = rows[-1][3]
    table = user_features(feat.baseline(tx, last), feat.intraday_features(tx, last.date()))
    scored = score(tx, table)
    assert "skew=true" in final_plan(scored)
    users = {r.user_id: r.combined_total_count for r in scored.collect()}
    counts = {u: sum(r[1] == u for r in rows) for u in ("hot", "u2")}
    assert scored.count() == len(rows)
    assert {u: users[u] for u in counts} == {u: 2 * n for u, n in counts.items()}


def test_dangling_transfers_of_a_hot_account(cluster_like, make_tx):
    rows = hot_rows()
    accounts = make_tx(rows).select(graph.F.col("user_id").alias("account_id")).distinct()
    accounts = accounts.withColumn("account_type", graph.F.lit("Retail"))
    edges = graph.transaction_edges(make_tx(rows)).repartition(6)
    found = graph.TxnGraph(accounts, accounts, edges, edges).dangling_transfers()
    assert found.count() == sum(r[4] == "gone" for r in rows)


def test_day_totals_of_a_hot_user_in_a_state_store_on_disk(cluster_like, make_tx, tmp_path):
    rows = hot_rows(600)
    folder = write_files(tmp_path / "in", in_batches(rows, 3))
    tx = src.accepted(src.decode_messages(src.stream_message_files(cluster_like, folder, 1)))
    out = str(tmp_path / "out")
    query = sinks.start_intraday(tx, out, str(tmp_path / "cp"), trigger=sinks.WHAT_IS_THERE)
    sinks.finish(query)
    assert any("rocksdbCommitCheckpointLatency" in str(s) for p in query.recentProgress for s in p["stateOperators"])
    days = sinks.current_values(cluster_like, out, ["user_id", "day"])
    want = feat.intraday_totals(make_tx(rows))
    plain = days.withColumn("day", days.day.cast("timestamp_ntz")).select(*want.columns)
    assert listed(plain) == listed(want) and message(rows[0])
