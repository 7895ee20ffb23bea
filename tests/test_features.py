"""Batch features against plain Python on small random tables with one hot user."""

import datetime as dt
from collections import defaultdict

import pytest
from conftest import START, as_dicts, at, random_rows, tx_row

from txnwatch.operators import features as feat
from txnwatch.operators.keyed import latest_per_key
from txnwatch.operators.scoring import user_features
from txnwatch.session import local_rows

MINUTE = dt.timedelta(minutes=1)
AS_OF = at(150)


def cents(amount):
    return int((amount * 100 + 0.5) // 1)


def stats(rows):
    amounts = [r[2] for r in rows if r[2] is not None]
    total = sum(cents(a) for a in amounts) / 100.0 if amounts else None
    return {
        "tx_count": len(rows),
        "total_spend": total,
        "avg_amount": total / len(amounts) if amounts else None,
        "max_amount": max(amounts, default=None),
        "near_threshold_count": sum(9000 <= a < 10000 for a in amounts),
        "distinct_merchants": len({r[4] for r in rows if r[4]}),
        "distinct_countries": len({r[7] for r in rows if r[7]}),
    }


def by_user(rows):
    users = defaultdict(list)
    for r in rows:
        users[r[1]].append(r)
    return users


def brute_windows(rows, size):
    out = {}
    for user, own in by_user(rows).items():
        starts = set()
        for r in own:
            minute = r[3].replace(second=0, microsecond=0)
            starts.update(minute - i * MINUTE for i in range(size))
        for start in starts:
            end = start + size * MINUTE
            out[user, start, end] = stats([r for r in own if start <= r[3] < end])
    return out


def keyed(dicts):
    return {
        (d.pop("user_id"), d.pop("window_start"), d.pop("window_end")): d for d in dicts
    }


@pytest.mark.parametrize(("seed", "size"), [(1, 15), (2, 30), (3, 60), (4, 1)])
def test_sliding_features(make_tx, seed, size):
    rows = random_rows(seed, 120)
    assert keyed(as_dicts(feat.sliding_features(make_tx(rows), size))) == brute_windows(rows, size)


def test_sliding_window_ends_are_exclusive(make_tx):
    rows = [tx_row(1, when=0), tx_row(2, when=15), tx_row(3, when=14.99)]
    found = keyed(as_dicts(feat.sliding_features(make_tx(rows), 15)))
    assert found["u", at(0), at(15)]["tx_count"] == 2
    assert found["u", at(1), at(16)]["tx_count"] == 2
    assert found["u", at(15), at(30)]["tx_count"] == 1


@pytest.mark.parametrize("size", [15, 60])
def test_latest_sliding_features_equal_the_full_table(make_tx, size):
    tx = make_tx(random_rows(5, 150, span=220))
    for as_of in (AS_OF, at(150.5), at(400)):
        full = feat.latest_windows(feat.sliding_features(tx, size), as_of)
        direct = feat.latest_sliding_features(tx, size, as_of)
        assert keyed(as_dicts(direct)) == keyed(as_dicts(full))


def brute_hour(rows):
    out = {}
    for own in by_user(rows).values():
        for r in own:
            since = r[3] - 60 * MINUTE
            s = stats([x for x in own if since <= x[3] <= r[3]])
            s.pop("near_threshold_count")
            out[r[0]] = {f"{k}_1h": v for k, v in s.items()}
    return out


@pytest.mark.parametrize(
    ("seed", "width", "whole"), [(7, 1, False), (8, 5, False), (9, 60, False), (10, 1, True)]
)
def test_rolling_hour(make_tx, seed, width, whole):
    rows = random_rows(seed, 150, span=260, whole_minutes=whole)
    got = {}
    for d in as_dicts(feat.rolling_hour(make_tx(rows), width)):
        d.pop("user_id")
        got[d.pop("transaction_id")] = d
    assert got == brute_hour(rows)


def test_rolling_hour_includes_a_row_exactly_one_hour_old(make_tx):
    just_out = at(60) + dt.timedelta(microseconds=1)
    rows = [
        tx_row(1, amount=99.0, when=0, merchant="a"),
        tx_row(2, amount=1.0, when=60, merchant="b"),
        tx_row(3, amount=2.0, when=just_out, merchant="b"),
    ]
    got = {d["transaction_id"]: d for d in as_dicts(feat.rolling_hour(make_tx(rows)))}
    assert (got["t0002"]["tx_count_1h"], got["t0002"]["max_amount_1h"]) == (2, 99.0)
    assert (got["t0003"]["tx_count_1h"], got["t0003"]["max_amount_1h"]) == (2, 2.0)
    assert [got[f"t000{i}"]["distinct_merchants_1h"] for i in (1, 2, 3)] == [1, 2, 1]


def test_hourly_features_are_the_last_rolling_row(make_tx):
    rows = random_rows(11, 200, span=2000)
    as_of = at(2000)
    since = as_of - dt.timedelta(hours=24)
    recent = [r for r in rows if r[3] >= since]
    want = {}
    for user, own in by_user(recent).items():
        last = max(own, key=lambda r: r[3])
        want[user] = brute_hour(recent)[last[0]]
    got = {d.pop("user_id"): d for d in as_dicts(feat.hourly_features(make_tx(rows), as_of))}
    assert got == want


def test_hybrid_features_equal_the_two_views(make_tx):
    rows = random_rows(12, 200, span=60 * 24 * 25)
    tx, as_of = make_tx(rows), START + dt.timedelta(days=24)
    day = (START + dt.timedelta(days=23)).date()
    joined = user_features(feat.baseline(tx, as_of), feat.intraday_features(tx, day))
    fused = feat.hybrid_features(tx, as_of, day)
    pick = lambda df: sorted(tuple(r) for r in df.select(*sorted(joined.columns)).collect())
    assert pick(fused) == pick(joined)


def test_baseline_can_stop_at_midnight(make_tx):
    as_of = dt.datetime(2024, 1, 20, 12)
    rows = [
        tx_row(1, when=as_of - dt.timedelta(days=14)),
        tx_row(2, when=as_of - dt.timedelta(days=14, seconds=1)),
        tx_row(3, when=dt.datetime(2024, 1, 20)),
        tx_row(4, when=dt.datetime(2024, 1, 19, 23, 59, 59)),
    ]
    tx = make_tx(rows)
    count = lambda df: df.collect()[0]["baseline_tx_count"]
    assert count(feat.baseline(tx, as_of)) == 3
    assert count(feat.baseline(tx, as_of, include_today=False)) == 2


def test_intraday_days_split_at_utc_midnight(make_tx):
    rows = [
        tx_row(1, amount=1.0, when=dt.datetime(2024, 1, 1, 23, 59, 59)),
        tx_row(2, amount=2.0, when=dt.datetime(2024, 1, 2)),
        tx_row(3, amount=None, when=dt.datetime(2024, 1, 2, 1)),
    ]
    got = {d["day"].day: d for d in as_dicts(feat.intraday_totals(make_tx(rows)))}
    assert (got[1]["intraday_tx_count"], got[1]["intraday_total_spend"]) == (1, 1.0)
    assert (got[2]["intraday_tx_count"], got[2]["intraday_total_spend"]) == (2, 2.0)


def test_missing_windows_stay_null(make_tx, spark):
    f60 = feat.latest_sliding_features(make_tx([tx_row(1)]), 60, at(200))
    none = f60.filter("false")
    row = feat.multi_window_features(f60, none, none).collect()[0]
    assert (row["tx_count_60m"], row["tx_count_30m"], row["tx_count_15m"]) == (1, None, None)


def test_empty_input(make_tx):
    empty = make_tx([])
    assert feat.sliding_features(empty, 15).count() == 0
    assert feat.rolling_hour(empty).count() == 0
    assert feat.hourly_features(empty, AS_OF).count() == 0
    assert feat.latest_sliding_features(empty, 15, AS_OF).count() == 0


def test_latest_per_key_breaks_ties_by_the_other_columns(spark):
    df = local_rows(spark, [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z")], "k STRING, o INT, v STRING")
    assert [tuple(r) for r in latest_per_key(df, ["k"], ["o"]).collect()] == [("a", 2, "z")]


def test_small_fractions_and_large_amounts_are_summed_exactly(make_tx):
    rows = [tx_row(i, "small", 0.004, 0) for i in range(1000)]
    rows += [tx_row(2000 + i, "minus", -0.005, 0) for i in range(3)]
    rows += [tx_row(3000, "large", 1e13, 0), tx_row(3001, "large", 0.25, 0)]
    rows += [tx_row(4000, "odd", float("nan"), 0), tx_row(4001, "odd", 1.5, 0)]
    tx = make_tx(rows)
    want = {"small": 4.0, "minus": -0.015, "large": 1e13 + 0.25, "odd": 1.5}
    hour = {r.user_id: r.total_spend_1h for r in feat.rolling_hour(tx).collect()}
    windows = {r.user_id: r.total_spend for r in feat.sliding_features(tx, 15).collect()}
    days = {r.user_id: r.intraday_total_spend for r in feat.intraday_totals(tx).collect()}
    assert hour == windows == days == want


@pytest.mark.parametrize("size", [15, 60])
@pytest.mark.parametrize("when", [at(150), at(150) + dt.timedelta(seconds=40), at(3), at(-5)])
def test_newest_windows_are_those_of_all_windows(make_tx, size, when):
    tx = make_tx(random_rows(12, 80, span=200))
    order = lambda r: (-r["window_end"].timestamp(), r["user_id"])
    whole = [r for r in as_dicts(feat.sliding_features(tx, size)) if r["window_end"] <= when]
    bounded = as_dicts(feat.newest_windows(tx, size, when, 5))
    assert sorted(bounded, key=order)[:5] == sorted(whole, key=order)[:5]
    assert len(bounded) <= len(whole) and all(b in whole for b in bounded)
