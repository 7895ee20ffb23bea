"""Graph patterns: planted rows, plain Python on random graphs, and edge cases."""

from collections import Counter, defaultdict

import pytest
from conftest import START, as_dicts, at, random_rows, tx_row

from txnwatch.functions import wording as W
from txnwatch.functions.timing import MINUTE
from txnwatch.operators import graph, paths, subgraph
from txnwatch.session import local_rows
from txnwatch.sources import planted


def edges_of(make_tx, rows):
    return graph.transaction_edges(make_tx(rows))


def brute_chains(rows, gap=None):
    ok = lambda a, b: a[3] < b[3] and (gap is None or (b[3] - a[3]).total_seconds() <= gap * 60)
    out = []
    for t1 in rows:
        if not t1[4] or t1[2] is None or t1[2] <= 5000:
            continue
        for t2 in rows:
            if t2[1] != t1[4] or not ok(t1, t2):
                continue
            out += [
                (t1, t2, t3) for t3 in rows if t3[4] and t3[1] == t2[4] and ok(t2, t3)
            ]
    return out


def brute_cycles(rows):
    return [
        (t1, t2, t3)
        for t1 in rows
        for t2 in rows
        if t2[1] == t1[4] and t1[3] < t2[3]
        for t3 in rows
        if t3[1] == t2[4] and t3[4] == t1[1] and t2[3] < t3[3]
    ]


def ids(chain):
    return tuple(t[0] for t in chain)


@pytest.fixture(scope="module")
def planted_graph(spark):
    tx = planted.planted_transactions(
        spark, START, planted.KNOWN_ROWS + planted.SMURFING_ROWS
    )
    return graph.TxnGraph.from_transactions(tx, planted.entities(spark), planted.ownership(spark))


def test_planted_patterns_are_found_once(planted_graph):
    g = planted_graph
    chains = as_dicts(paths.layering_chains(g.transfers))
    assert [[c[f"account_{x}"] for x in "abcd"] for c in chains] == [
        ["Layer_Alice", "Layer_Bob", "Layer_Charlie", "Layer_Dave"]
    ]
    cycles = as_dicts(paths.circular_transfers(g.transfers))
    assert [(c["originating_account"], c["init_amount"], c["return_amount"]) for c in cycles] == [
        ("Circ_Eve", 2500.0, 2300.0)
    ]
    assert [tuple(r) for r in graph.smurfing_sinks(g.transfers).collect()] == [
        ("Sink_1", 4, 38000.0)
    ]
    owners = as_dicts(graph.owner_risk(g.transfers, g.owns, g.entities))
    assert [(o["sender"], o["receiving_account"], o["beneficiary"]) for o in owners] == [
        ("Innocent_Retail", "Shady_Shell_Corp", "Cartel_Boss")
    ]
    assert [tuple(r) for r in g.dangling_ownership().collect()] == [("Jane_Doe", "Shell_Corp_1")]


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_and_counts(make_tx, seed):
    rows = random_rows(seed, 70, span=60, whole_minutes=True)
    edges, want = edges_of(make_tx, rows), brute_chains(rows)
    got = as_dicts(paths.layering_chains(edges))
    assert sorted(tuple(c[f"transaction_{i}"] for i in (1, 2, 3)) for c in got) == sorted(
        map(ids, want)
    )
    starts, ends = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for t1, _, t3 in want:
        for side, account in ((starts, t1[1]), (ends, t3[4])):
            side[account][0] += 1
            side[account][1] += int(t1[2] * 100 + 0.5)
    for found, side in (
        (paths.layering_sources(edges), starts),
        (paths.layering_sinks(edges), ends),
    ):
        assert {r[0]: [int(r[1]), round(r[2] * 100)] for r in found.collect()} == dict(side)


@pytest.mark.parametrize("k", [1, 3, 25, 10_000])
def test_layering_top_is_a_prefix_of_all_chains(make_tx, k):
    rows = random_rows(3, 60, span=60)
    want = sorted(brute_chains(rows), key=lambda c: (-c[0][2], ids(c)))[:k]
    got = as_dicts(paths.layering_top(edges_of(make_tx, rows), k))
    assert [tuple(c[f"transaction_{i}"] for i in (1, 2, 3)) for c in got] == list(map(ids, want))


@pytest.mark.parametrize("gap", [3, 20])
def test_layering_with_a_gap_limit(make_tx, gap):
    rows = random_rows(4, 70, span=80, whole_minutes=True)
    got = as_dicts(paths.layering_chains(edges_of(make_tx, rows), gap * MINUTE))
    assert sorted(tuple(c[f"transaction_{i}"] for i in (1, 2, 3)) for c in got) == sorted(
        map(ids, brute_chains(rows, gap))
    )


@pytest.mark.parametrize("seed", [5, 6])
def test_cycles(make_tx, seed):
    rows = random_rows(seed, 70, span=60, whole_minutes=True)
    edges = edges_of(make_tx, rows)
    want = brute_cycles(rows)
    assert want
    got = as_dicts(paths.circular_transfers(edges))
    assert sorted(tuple(c[f"transaction_{i}"] for i in (1, 2, 3)) for c in got) == sorted(
        map(ids, want)
    )
    first = sorted(want, key=lambda c: (c[0][1], c[0][4], c[1][4], ids(c)))[:4]
    top = as_dicts(paths.circular_top(edges, 4))
    assert [tuple(c[f"transaction_{i}"] for i in (1, 2, 3)) for c in top] == list(map(ids, first))


def test_equal_times_do_not_chain(make_tx):
    rows = [
        tx_row(1, "a", 6000.0, 0, "b"),
        tx_row(2, "b", 1.0, 0, "c"),
        tx_row(3, "c", 1.0, 1, "d"),
    ]
    edges = edges_of(make_tx, rows)
    assert paths.layering_chains(edges).count() == 0
    assert paths.layering_sources(edges).count() == 0


def test_layering_needs_more_than_the_minimum(make_tx):
    def chain(amount):
        return edges_of(make_tx, [tx_row(1, "a", amount, 0, "b"), tx_row(2, "b", 1.0, 1, "c"),
                                  tx_row(3, "c", 1.0, 2, "d")])

    assert paths.layering_chains(chain(5000.0)).count() == 0
    assert paths.layering_chains(chain(5000.01)).count() == 1


def test_smurfing_needs_more_than_three_deposits(make_tx):
    rows = [tx_row(i, f"s{i}", 9500.0, i, "three") for i in range(3)]
    rows += [tx_row(10 + i, f"s{i}", 9500.0, i, "four") for i in range(4)]
    rows += [tx_row(20 + i, f"s{i}", a, i, "edge") for i, a in enumerate((9000.0, 10000.0) * 3)]
    found = graph.smurfing_sinks(edges_of(make_tx, rows)).collect()
    assert [tuple(r) for r in found] == [("four", 4, 38000.0)]


def test_accounts_keep_one_row_per_type(make_tx, spark):
    tx = make_tx([tx_row(1, "a", merchant="b"), tx_row(2, "b", merchant="c")])
    g = graph.TxnGraph.from_transactions(tx, planted.entities(spark), planted.ownership(spark))
    assert sorted(tuple(r) for r in g.accounts.collect()) == [
        ("a", "Retail"), ("b", "Merchant/P2P"), ("b", "Retail"), ("c", "Merchant/P2P")]
    types = {r["account_id"]: r["account_types"] for r in g.account_ids().collect()}
    assert types["b"] == ["Retail", "Merchant/P2P"]


def test_bound_drops_edges_with_missing_nodes(make_tx, spark):
    tx = make_tx([tx_row(1, "a", merchant="b"), tx_row(2, "a", merchant="gone")])
    accounts = graph.account_nodes(tx).filter("account_id <> 'gone'")
    g = graph.TxnGraph(
        accounts, planted.entities(spark), graph.transaction_edges(tx), planted.ownership(spark)
    ).bound()
    assert [r["transaction_id"] for r in g.transfers.collect()] == ["t0001"]
    assert g.owns.count() == 0


def test_findings_of_the_planted_graph(planted_graph):
    found = subgraph.findings(planted_graph)
    nodes = {r["id"]: r["group"] for r in
             subgraph.subgraph_nodes(found, planted_graph.accounts).collect()}
    assert nodes["Layer_Bob"] == "Retail" and nodes["Layer_Dave"] == "Merchant/P2P"
    assert nodes["Cartel_Boss"] == "High Risk" and nodes["Sink_1"] == "Merchant/P2P"
    links = as_dicts(subgraph.subgraph_links(found))
    assert len(links) == 3 + 3 + 4 + 2
    closing = {"source": "Circ_Grace", "target": "Circ_Eve", "amount": 2300.0, "currency": "USD",
               "pattern": W.CIRCULAR, "label": "$2,300"}
    assert closing in links
    owns = [x for x in links if x["label"] == "OWNS"]
    assert [(x["source"], x["target"]) for x in owns] == [("Cartel_Boss", "Shady_Shell_Corp")]
    texts = {r["anomaly_type"]: (r["heading"], r["summary"])
             for r in subgraph.anomaly_summaries(found).collect()}
    assert texts[W.LAYERING] == (
        W.HEADINGS[W.LAYERING], W.SUMMARIES[W.LAYERING] % ("Layer_Alice", "Layer_Dave"))
    assert "Cartel_Boss" in texts[W.OWNER][1]
    verdict = subgraph.graph_verdict(found).collect()[0]
    assert verdict["heading"] == W.NETWORK_HEADING
    assert "Layer_Alice, Layer_Bob, Layer_Charlie." in verdict["summary"]
    first = {r["node_id"]: r["anomaly_type"] for r in subgraph.anomaly_of_node(found).collect()}
    assert first["Circ_Eve"] == W.CIRCULAR and first["Sink_1"] == W.SMURFING
    prompt = subgraph.graph_prompt(found).collect()[0][0]
    assert "Accounts found: Layer_Alice, Layer_Bob" in prompt and '"source":"Circ_Grace"' in prompt


def test_nothing_found(make_tx, spark):
    tx = make_tx([tx_row(1, "a", 1.0, 0, "b")])
    g = graph.TxnGraph.from_transactions(tx, planted.entities(spark), planted.ownership(spark))
    found = subgraph.findings(g)
    verdict = subgraph.graph_verdict(found).collect()[0]
    assert tuple(verdict) == (W.NOTHING_HEADING, W.NOTHING_SUMMARY)
    assert subgraph.subgraph_links(found).count() == 0


def test_few_nodes_use_the_alert_wording(make_tx, spark):
    tx = make_tx([tx_row(1, "a", 9500.0, 0, "b")])
    g = graph.TxnGraph.from_transactions(tx, planted.entities(spark), planted.ownership(spark))
    verdict = subgraph.graph_verdict(subgraph.findings(g)).collect()[0]
    assert verdict["heading"] == W.ALERT_HEADING


def test_element_json_leaves_out_missing_values(spark):
    df = local_rows(spark, [("a", None)], "account_id STRING, account_type STRING")
    out = graph.element_json(df, "Account", ["account_id", "account_type"], "node").collect()
    assert out[0]["node"] == '{"labels":["Account"],"properties":{"account_id":"a"}}'


def test_times_are_kept_to_the_microsecond(make_tx):
    import datetime as dt

    tick = dt.timedelta(microseconds=1)
    rows = [
        tx_row(1, "a", 6000.0, at(0), "b"),
        tx_row(2, "b", 1.0, at(0) + tick, "c"),
        tx_row(3, "c", 1.0, at(0) + 2 * tick, "d"),
    ]
    assert int(paths.layering_sources(edges_of(make_tx, rows)).collect()[0]["paths"]) == 1


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_cycle_counts_of_a_busy_pair(make_tx, seed):
    rows = random_rows(seed, 60, users=3, span=60, whole_minutes=True)
    busy = [tx_row(500 + k, "u0", 1.0, (k * 7) % 60, "u1") for k in range(40)]
    rows = rows + busy
    want = Counter((a[1], b[1], c[1]) for a, b, c in brute_cycles(rows))
    got = paths.circular_counts(edges_of(make_tx, rows)).collect()
    assert {tuple(r)[:3]: int(r.cycles) for r in got} == want and max(want.values()) > 40


def test_cycle_counts_of_nothing(make_tx):
    assert paths.circular_counts(edges_of(make_tx, [])).count() == 0
    assert paths.circular_counts(edges_of(make_tx, [tx_row(1, "a", 1.0, 0, "b")])).count() == 0


def test_dangling_transfers_name_both_ends(spark, make_tx):
    rows = [tx_row(k, "hot", 1.0, k, "gone") for k in range(30)]
    rows += [tx_row(40, "hot", 1.0, 0, None), tx_row(41, "gone", 1.0, 0, "gone"), tx_row(42, "hot", 1.0, 0, "hot")]
    rows += [tx_row(43, None, 1.0, 0, "hot"), tx_row(44, None, 1.0, 0, None)]
    accounts = spark.createDataFrame([("hot", "Retail"), ("hot", "Merchant/P2P"), (None, "Retail")],
                                     "account_id string, account_type string")
    owners = spark.createDataFrame([("o1", "Low Risk")], "entity_id string, risk_level string")
    owns = spark.createDataFrame([("o1", "hot"), ("o2", "hot"), ("o1", "lost")],
                                 "owner_entity string, owned_account string")
    g = graph.TxnGraph(accounts, owners, edges_of(make_tx, rows), owns)
    got = {r.transaction_id: (r.source_missing, r.target_missing) for r in g.dangling_transfers().collect()}
    want = {f"t{k:04d}": (False, True) for k in range(30)}
    want |= {"t0040": (False, True), "t0041": (True, True), "t0043": (True, False), "t0044": (True, True)}
    assert got == want
    kinds = [tuple(r) for r in g.dangling().where("kind = 'ownership'").collect()]
    assert sorted(k[2:] for k in kinds) == [("o1", "lost", False, True), ("o2", "hot", True, False)]
    assert g.dangling().count() == len(want) + 2
