"""Streams over several micro-batches against the batch operators; bad and late input."""

import datetime as dt
import json
import os
import uuid

import pytest
from conftest import at, random_rows, tx_row

from txnwatch.operators import features as feat
from txnwatch.operators import reports
from txnwatch.operators.scoring import score, user_features
from txnwatch.sources import transactions as src
from txnwatch.sources.tables import sync_feature_view
from txnwatch.streaming import features as live
from txnwatch.streaming import sinks
from txnwatch.streaming.late import LateRows


def message(row) -> str:
    fields = dict(zip(src.COLUMNS, row))
    fields["timestamp"] = row[3].isoformat() + "+00:00"
    return json.dumps(fields)


def write_files(folder, batches):
    """One file per batch, with increasing modification times, as the source orders by it."""
    os.makedirs(folder, exist_ok=True)
    for i, lines in enumerate(batches):
        path = f"{folder}/part-{i:03d}.json"
        with open(path, "w") as out:
            out.write("\n".join(lines) + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


@pytest.fixture
def arriving(spark, tmp_path):
    def make(batches):
        folder = write_files(tmp_path / f"in-{uuid.uuid4().hex}", batches)
        return src.decode_messages(src.stream_message_files(spark, folder, files_per_batch=1))

    return make


def in_batches(rows, n=4):
    ordered = sorted(rows, key=lambda r: r[3])
    size = -(-len(ordered) // n)
    return [[message(r) for r in ordered[i : i + size]] for i in range(0, len(ordered), size)]


def collect_stream(spark, df, tmp_path):
    name = uuid.uuid4().hex
    out = str(tmp_path / f"out-{name}")
    sinks.finish(sinks.append_stream(df, out, str(tmp_path / f"cp-{name}")))
    return spark.read.schema(df.schema).parquet(out)


def listed(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_bad_messages_are_separated(spark, arriving, tmp_path):
    lines = [
        message(tx_row(1)),
        "{bad",
        '{"transaction_id":"t","amount":1}',
        '{"transaction_id":"t","user_id":"u","amount":null}',
        '{"transaction_id":"t","user_id":"u","amount":"abc"}',
    ]
    decoded = arriving([lines])
    assert collect_stream(spark, src.accepted(decoded), tmp_path).count() == 1
    assert collect_stream(spark, src.rejected(decoded), tmp_path).count() == 4
    landed = collect_stream(spark, src.landable(decoded), tmp_path)
    assert landed.count() == 3 and landed.columns == src.COLUMNS


def test_timestamp_offsets_are_read(spark, arriving, tmp_path):
    line = message(tx_row(1)).replace("+00:00", "+02:00")
    row = collect_stream(spark, src.landable(arriving([[line]])), tmp_path)
    got = row.select(row.timestamp.cast("timestamp_ntz").alias("t")).collect()[0]["t"]
    assert got == at(0) - dt.timedelta(hours=2)


def test_alerts_equal_batch(spark, make_tx, arriving, tmp_path):
    rows = random_rows(21, 60)
    got = collect_stream(spark, live.alerts_stream(src.landable(arriving(in_batches(rows)))), tmp_path)
    want = reports.stateless_alerts(make_tx(rows))
    assert listed(got.drop("timestamp")) == listed(want.drop("timestamp"))


def test_scores_equal_batch(spark, make_tx, arriving, tmp_path):
    rows = [r for r in random_rows(22, 60) if r[2] is not None]
    tx = make_tx(rows)
    table = user_features(
        feat.baseline(tx, at(300)), feat.intraday_features(tx, at(0).date())
    )
    got = collect_stream(
        spark, live.score_stream(src.accepted(arriving(in_batches(rows))), table), tmp_path
    )
    assert listed(got.drop("timestamp")) == listed(score(tx, table).drop("timestamp"))


def test_sliding_windows_equal_batch_for_closed_windows(spark, make_tx, arriving, tmp_path):
    rows = [r for r in random_rows(23, 80, users=2, span=40) if r[2] is not None]
    tx = src.accepted(arriving(in_batches(rows, 4)))
    got = collect_stream(spark, live.sliding_features_stream(tx, 15, "0 seconds"), tmp_path)
    batch = feat.sliding_features(make_tx(rows), 15)
    last = max(r[3] for r in rows)
    columns = batch.columns
    closed = [r for r in batch.collect() if r["window_end"] <= last]
    plain = got.withColumns({c: got[c].cast("timestamp_ntz") for c in ("window_start", "window_end")})
    assert len(closed) > 20
    assert listed(plain.select(*columns)) == sorted(tuple(map(str, r)) for r in closed)


def test_one_query_and_folder_per_window_size(spark, make_tx, arriving, tmp_path):
    rows = [tx_row(i, "u", 10.0 + i, i * 10) for i in range(8)]
    tx = src.accepted(arriving(in_batches(rows, 2)))
    queries = sinks.start_sliding_features(
        tx, str(tmp_path / "o"), str(tmp_path / "c"), trigger=sinks.WHAT_IS_THERE, sizes=(15, 30),
        delay="0 seconds",
    )
    sinks.finish(*queries.values())
    for size in (15, 30):
        got = spark.read.parquet(str(tmp_path / "o" / f"user_features_{size}m"))
        batch = feat.sliding_features(make_tx(rows), size).collect()
        assert got.count() == sum(r["window_end"] <= rows[-1][3] for r in batch)


def run_intraday(spark, tx, tmp_path):
    name = uuid.uuid4().hex
    out = str(tmp_path / f"up-{name}")
    query = sinks.start_intraday(tx, out, str(tmp_path / f"cp-{name}"), trigger=sinks.WHAT_IS_THERE)
    sinks.finish(query)
    return out


def test_intraday_upserts_keep_the_last_value(spark, make_tx, arriving, tmp_path):
    rows = [r for r in random_rows(24, 90, span=60 * 30) if r[2] is not None]
    out = run_intraday(spark, src.accepted(arriving(in_batches(rows, 5))), tmp_path)
    updates = spark.read.option("basePath", out).parquet(out)
    assert updates.select("batch_id").distinct().count() >= 5
    days = sinks.current_values(spark, out, ["user_id", "day"])
    want = feat.intraday_totals(make_tx(rows))
    plain = days.withColumn("day", days.day.cast("timestamp_ntz")).select(*want.columns)
    assert listed(plain) == listed(want)
    assert updates.count() > plain.count()

    newest = sinks.current_values(spark, out, ["user_id"], ("day",))
    assert newest.count() == len({r[1] for r in rows})
    before = listed(newest)
    sinks.compact(spark, out, ["user_id"], ("day",))
    after = sinks.current_values(spark, out, ["user_id"], ("day",))
    assert listed(after) == before
    assert all("-snapshots/upto=" in f for f in after.inputFiles())
    after.limit(1).withColumn("intraday_tx_count", after.intraday_tx_count + 1).write.parquet(
        f"{out}/batch_id=1000"
    )
    assert len(sinks.current_values(spark, out, ["user_id"], ("day",)).inputFiles()) > len(after.inputFiles())
    sinks.compact(spark, out, ["user_id"], ("day",), expire=True)
    last = listed(sinks.current_values(spark, out, ["user_id"], ("day",)))
    assert len(last) == len(before) and sum(a != b for a, b in zip(last, before)) == 1


def test_late_rows_are_dropped_after_the_watermark(spark, arriving, tmp_path):
    day = dt.timedelta(days=1)
    batches = [
        [tx_row(1, "u", 1.0, at(0))],
        [tx_row(2, "u", 2.0, at(0) + 3 * day)],
        [tx_row(3, "u", 4.0, at(0) + 3 * day)],
        [tx_row(4, "u", 8.0, at(1))],
    ]
    lines = [[message(r) for r in b] for b in batches]
    out = run_intraday(spark, src.accepted(arriving(lines)), tmp_path)
    totals = {
        r["day"].day: r["intraday_total_spend"]
        for r in sinks.current_values(spark, out, ["user_id", "day"]).collect()
    }
    assert totals == {at(0).day: 1.0, (at(0) + 3 * day).day: 6.0}


def test_a_longer_delay_keeps_late_rows(spark, arriving, tmp_path):
    batches = [[message(tx_row(i, "u", float(i), m))] for i, m in ((1, 0), (2, 3000), (4, 3000), (8, 1))]
    tx = src.accepted(arriving(batches))
    out = str(tmp_path / "late")
    sinks.finish(sinks.start_intraday(tx, out, str(tmp_path / "cp-late"), delay="30 days",
                                      trigger=sinks.WHAT_IS_THERE))
    rows = sinks.current_values(spark, out, ["user_id", "day"]).collect()
    assert sum(r["intraday_total_spend"] for r in rows) == 15.0


def test_a_restarted_stream_does_not_count_twice(spark, tmp_path):
    folder = tmp_path / "in"
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    first = [message(tx_row(1, "u", 1.0, 0))]
    second = [message(tx_row(2, "u", 2.0, 1))]
    for batches in ([first], [first, second]):
        write_files(folder, batches)
        tx = src.accepted(src.decode_messages(src.stream_message_files(spark, str(folder), 1)))
        sinks.finish(sinks.start_intraday(tx, out, checkpoint, trigger=sinks.WHAT_IS_THERE))
    rows = sinks.current_values(spark, out, ["user_id", "day"]).collect()
    assert [(r["intraday_tx_count"], r["intraday_total_spend"]) for r in rows] == [(2, 3.0)]


def test_table_appends_feed_alerts(spark, make_tx, tmp_path):
    table = str(tmp_path / "raw")
    make_tx([tx_row(1, amount=60000.0), tx_row(2, amount=1.0)]).write.parquet(table)
    tx = src.stream_table(spark, table, spark.read.parquet(table).schema)
    out, checkpoint = str(tmp_path / "alerts"), str(tmp_path / "cp")
    sinks.finish(sinks.append_stream(live.alerts_stream(tx), out, checkpoint))
    make_tx([tx_row(3, amount=70000.0)]).write.mode("append").parquet(table)
    sinks.finish(sinks.append_stream(live.alerts_stream(tx), out, checkpoint))
    assert sorted(r["transaction_id"] for r in spark.read.parquet(out).collect()) == [
        "t0001", "t0003"]


def test_alerts_can_go_to_a_catalog_table(spark, arriving, tmp_path):
    stream = live.alerts_stream(src.landable(arriving([[message(tx_row(1, amount=60000.0))]])))
    sinks.finish(sinks.append_table_stream(stream, "streamed_alerts", str(tmp_path / "cp")))
    assert spark.table("streamed_alerts").count() == 1
    spark.sql("DROP TABLE streamed_alerts")


def test_the_stream_scores_against_a_written_view(spark, make_tx, tmp_path):
    tx = make_tx([r for r in random_rows(3, 40) if r[2] is not None])
    features = feat.hybrid_features(tx, dt.datetime(2024, 1, 31), dt.date(2024, 1, 10))
    view = sync_feature_view(features, str(tmp_path / "view"), 4)
    assert listed(view) == listed(features)
    plan = score(tx, view)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    assert all("/view/sync=4/" in f for f in view.inputFiles())


def test_rejected_messages_keep_their_text(spark):
    good = message(tx_row(1))
    bad = ["{bad", good[:30], '{"transaction_id":"t","amount":1}']
    rows = spark.createDataFrame([(m.encode(),) for m in [good, *bad]], "value binary")
    assert sorted(r[0] for r in src.rejected_messages(rows).collect()) == sorted(bad)


def test_panes_fire_every_five_seconds_and_only_grow(spark, make_tx, tmp_path):
    rows = [r for r in random_rows(31, 60, users=2, span=60 * 26) if r[2] is not None]
    folder, out = str(tmp_path / "in"), str(tmp_path / "panes")
    write_files(folder, [[message(r) for r in rows[0::3]]])
    tx = src.accepted(src.decode_messages(src.stream_message_files(spark, folder, 1)))
    query = sinks.start_intraday(tx, out, str(tmp_path / "cp"), delay="9 days",
                                 trigger=sinks.EVERY_5_SECONDS)
    try:
        query.processAllAvailable()
        first = len(sinks.numbered_folders(spark, out, "batch_id"))
        write_files(folder, [[message(r) for r in rows[k::3]] for k in range(3)])
        query.processAllAvailable()
    finally:
        query.stop()
    assert first and len(sinks.numbered_folders(spark, out, "batch_id")) >= first + 2
    totals = ["intraday_tx_count", "intraday_total_spend"]
    panes = sinks.pane_changes(spark, out, ["user_id", "day"], totals).collect()
    assert all(p.added_intraday_tx_count > 0 for p in panes) and max(p.pane for p in panes) >= 3
    last = sorted((p.user_id, p.day, p.intraday_tx_count) for p in panes if p.is_last)
    want = feat.intraday_totals(make_tx(rows)).collect()
    assert last == sorted((r.user_id, r.day, r.intraday_tx_count) for r in want)
    for p in panes:  # what panes add sums up to the pane
        upto = [q for q in panes if (q.user_id, q.day) == (p.user_id, p.day) and q.batch_id <= p.batch_id]
        assert sum(q.added_intraday_tx_count for q in upto) == p.intraday_tx_count
        assert sorted(q.pane for q in upto) == list(range(1, len(upto) + 1))


def test_late_rows_are_counted_beyond_the_batches_a_query_remembers(spark, arriving, tmp_path):
    day = dt.timedelta(days=1)
    on_time = [[message(tx_row(k, "u", 1.0, at(0) + 30 * day))] for k in range(2)]
    late = [[message(tx_row(10 + k, f"u{k}", 1.0, at(k)))] for k in range(104)]
    listener = LateRows(spark, str(tmp_path / "late"))
    assert listener.rows().count() == 0
    spark.streams.addListener(listener)
    try:
        query = sinks.start_intraday(src.accepted(arriving([*on_time, *late])), str(tmp_path / "o"),
                                     str(tmp_path / "c"), trigger=sinks.WHAT_IS_THERE)
        listener.wait(query)
    finally:
        spark.streams.removeListener(listener)
    rows = listener.rows().collect()
    assert len(rows) == 104 and {r.dropped for r in rows} == {1}
    assert {r.query_id for r in rows} == {str(query.id)} and len({r.batch_id for r in rows}) == 104
    assert sinks.dropped_rows(query) < 104


def test_a_running_scorer_sees_the_next_whole_sync(spark, tmp_path):
    view, folder, out = str(tmp_path / "view"), str(tmp_path / "in"), str(tmp_path / "out")

    def features(count, spend):
        return spark.createDataFrame(
            [("u", count, spend, 0, 0.0)],
            "user_id string, baseline_tx_count long, baseline_total_spend double, "
            "intraday_tx_count long, intraday_total_spend double",
        )

    files = [[message(tx_row(k, "u", 100.0 * k, k))] for k in range(5)]
    write_files(folder, files[:1])
    tx = src.accepted(src.decode_messages(src.stream_message_files(spark, folder, 1)))
    query = sinks.start_synced_scoring(tx, view, out, str(tmp_path / "cp"),
                                       trigger={"processingTime": "0 seconds"})
    try:
        query.processAllAvailable()
        sync_feature_view(features(1, 10.0), view, 0)
        write_files(folder, files[:2])
        query.processAllAvailable()
        sync_feature_view(features(2, 20.0), view, 1)
        sync_feature_view(features(7, 70.0), view, 2)
        os.remove(f"{view}/sync=2/_SUCCESS")  # one that is not whole
        write_files(folder, files[:4])
        query.processAllAvailable()
        sync_feature_view(features(7, 70.0), view, 2)
        write_files(folder, files)
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.read.parquet(out).orderBy("transaction_id").collect()
    assert [(r.sync, r.combined_total_count) for r in got] == [(None, 0), (0, 1), (1, 2), (1, 2), (2, 7)]


def put(spark, path, batch_id, rows):
    df = spark.createDataFrame(rows, "user_id string, day int, n long")
    df.write.parquet(f"{path}/batch_id={batch_id}")


def test_compaction_rewrites_only_buckets_with_changed_keys(spark, tmp_path):
    path = str(tmp_path / "store")
    users = [f"u{k}" for k in range(40)]
    put(spark, path, 0, [(u, 1, 1) for u in users])
    everything = sinks.compact(spark, path, ["user_id"], ("day",), buckets=8)
    assert everything == list(range(8))
    put(spark, path, 1, [("u3", 2, 5)])
    put(spark, path, 2, [("u3", 1, 9)])  # later batch, older day
    touched = sinks.compact(spark, path, ["user_id"], ("day",), buckets=8)
    assert len(touched) == 1
    written = [d for d in os.listdir(f"{path}-snapshots/upto=2") if d.startswith("bucket=")]
    assert written == [f"bucket={touched[0]}"]
    values = {r.user_id: (r.day, r.n) for r in sinks.current_values(spark, path, ["user_id"], ("day",)).collect()}
    assert values == {u: (1, 1) for u in users} | {"u3": (2, 5)}

    one = sinks.current_value(spark, path, {"user_id": "u3"}, ("day",), buckets=8)
    assert [(r.day, r.n) for r in one.collect()] == [(2, 5)]
    assert {f.split("-snapshots/")[1].split("/part")[0] for f in one.inputFiles()} == {
        f"upto=2/bucket={touched[0]}"
    }
    put(spark, path, 3, [("new", 7, 7)])
    for user, want in (("new", [(7, 7)]), ("u4", [(1, 1)]), ("nobody", [])):
        got = sinks.current_value(spark, path, {"user_id": user}, ("day",), buckets=8).collect()
        assert [(r.day, r.n) for r in got] == want

    sinks.compact(spark, path, ["user_id"], ("day",), expire=True, buckets=8)
    assert not sinks.numbered_folders(spark, path, "batch_id")
    after = {r.user_id: (r.day, r.n) for r in sinks.current_values(spark, path, ["user_id"], ("day",)).collect()}
    assert after == values | {"new": (7, 7)}
    assert sinks.compact(spark, path, ["user_id"], ("day",), buckets=8) == []


def test_a_cut_off_compaction_is_not_read(spark, tmp_path):
    path = str(tmp_path / "store")
    put(spark, path, 0, [("a", 1, 1), ("b", 1, 1)])
    sinks.compact(spark, path, ["user_id"], ("day",), buckets=4)
    put(spark, path, 1, [("a", 2, 2)])
    sinks.compact(spark, path, ["user_id"], ("day",), buckets=4)
    os.remove(f"{path}-snapshots/upto=1/_SUCCESS")
    got = sinks.current_values(spark, path, ["user_id"], ("day",)).collect()
    assert sorted((r.user_id, r.n) for r in got) == [("a", 2), ("b", 1)]
    assert all("/upto=1/" not in f for f in sinks.current_values(spark, path, ["user_id"], ("day",)).inputFiles())


def test_the_stream_compacts_by_itself(spark, make_tx, arriving, tmp_path):
    rows = [r for r in random_rows(33, 60, span=60 * 30) if r[2] is not None]
    out = str(tmp_path / "own")
    rule = sinks.Compaction(["user_id"], ("day",), every=2, expire=True, buckets=4)
    sinks.finish(
        sinks.start_intraday(src.accepted(arriving(in_batches(rows, 5))), out, str(tmp_path / "cp-own"),
                             trigger=sinks.WHAT_IS_THERE, compaction=rule)
    )
    assert sinks.numbered_folders(spark, f"{out}-snapshots", "upto")
    assert len(sinks.numbered_folders(spark, out, "batch_id")) <= 2
    got = sinks.current_values(spark, out, ["user_id"], ("day",)).collect()
    newest = {}
    for r in feat.intraday_totals(make_tx(rows)).collect():
        newest[r.user_id] = max(newest.get(r.user_id, (r.day, 0)), (r.day, r.intraday_tx_count))
    assert {r.user_id: r.intraday_tx_count for r in got} == {u: n for u, (_, n) in newest.items()}


def test_three_sizes_from_one_table_of_panes(spark, make_tx, arriving, tmp_path):
    rows = [r for r in random_rows(41, 80, users=2, span=90) if r[2] is not None]
    markers = [tuple(r) for r in live.end_markers(make_tx(rows)).collect()]
    batches = [*in_batches(rows, 3), [message((*r[:3], r[3], *r[4:])) for r in markers]]
    tx = src.accepted(arriving(batches))
    panes, cp = str(tmp_path / "panes"), str(tmp_path / "cp")
    source = sinks.start_panes(tx, panes, cp, trigger=sinks.WHAT_IS_THERE)
    sinks.finish(source)
    assert sum(p["numInputRows"] for p in source.recentProgress) == len(rows) + 2
    queries = sinks.start_windows(spark, panes, str(tmp_path), cp, sinks.WHAT_IS_THERE)
    sinks.finish(*queries.values())
    for size in (15, 30, 60):
        got = spark.read.parquet(str(tmp_path / f"user_features_{size}m"))
        want = feat.sliding_features(make_tx(rows), size)
        plain = got.withColumns({c: got[c].cast("timestamp_ntz") for c in ("window_start", "window_end")})
        assert listed(plain.select(*want.columns)) == listed(want)  # those of the last hour too


def test_runs_of_windows_over_several_batches_without_state(spark, make_tx, tmp_path):
    """State, shuffles and files once grew with the window length."""
    rows = [r for r in random_rows(42, 80, users=2, span=150) if r[2] is not None]
    markers = [tuple(r) for r in live.end_markers(make_tx(rows)).collect()]
    batches = [*in_batches(rows, 3), [message(r) for r in markers]]
    panes, cp, stored = str(tmp_path / "panes"), str(tmp_path / "cp"), {}
    for upto in (2, 3, 4):
        folder = write_files(tmp_path / "in", batches[:upto])
        tx = src.accepted(src.decode_messages(src.stream_message_files(spark, folder, 1)))
        sinks.finish(sinks.start_panes(tx, panes, cp, trigger=sinks.WHAT_IS_THERE))
        queries = sinks.start_windows(
            spark, panes, str(tmp_path), cp, sinks.WHAT_IS_THERE, (15, 60), as_runs=True
        )
        sinks.finish(*queries.values())
        for query in queries.values():
            assert all(not p["stateOperators"] for p in query.recentProgress)
    for size in (15, 60):
        path = tmp_path / f"user_features_{size}m"
        assert len(list(path.glob("batch_id=*"))) == 3
        stored[size] = spark.read.parquet(str(path)).count()
        got = sinks.read_windows(spark, str(tmp_path), size)
        want = feat.sliding_features(make_tx(rows), size)
        plain = got.withColumns({c: got[c].cast("timestamp_ntz") for c in ("window_start", "window_end")})
        assert listed(plain.select(*want.columns)) == listed(want)
    assert max(stored.values()) < 6 * len(rows)


def test_windows_closed_by_the_watermark(spark, make_tx, arriving, tmp_path):
    """Also those that end between the last whole pane and the watermark."""
    rows = [tx_row(1, "u", 1.0, 0), tx_row(2, "u", 2.0, 30), tx_row(3, "v", 4.0, 95.5)]
    source = sinks.start_panes(
        src.accepted(arriving(in_batches(rows, 1))), str(tmp_path / "panes"), str(tmp_path / "cp"),
        trigger=sinks.WHAT_IS_THERE,
    )
    sinks.finish(source)
    until = sinks.closed_until(source)
    assert until == at(35.5)
    queries = sinks.start_windows(
        spark, str(tmp_path / "panes"), str(tmp_path), str(tmp_path / "cp"), sinks.WHAT_IS_THERE,
        (15,), until=until,
    )
    sinks.finish(*queries.values())
    got = spark.read.parquet(str(tmp_path / "user_features_15m")).collect()
    assert sorted(r["window_end"] for r in got) == [at(k) for k in (*range(1, 16), *range(31, 36))]
