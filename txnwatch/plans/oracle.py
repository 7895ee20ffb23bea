"""The same results as plain SQL, written independently of the operators, for checking."""

from __future__ import annotations

from txnwatch.functions import wording as W
from txnwatch.schemas import TABLES

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
TODAY = "TIMESTAMP '2024-01-30 00:00:00'"

TX = """tx AS (
  SELECT 'txn_' || event_id AS transaction_id, 'user_' || user_id AS user_id,
         round(value * 150, 2) AS amount, ts AS "timestamp",
         CASE WHEN k < 50 THEN 'merchant_' || k ELSE 'user_' || ((user_id + k) % 15) END AS merchant,
         event_type AS category, 'GBP' AS currency,
         CASE event_id % 6 WHEN 0 THEN 'GB' WHEN 1 THEN 'US' WHEN 2 THEN 'DE'
                           WHEN 3 THEN 'FR' WHEN 4 THEN 'SG' ELSE 'AE' END AS country
  FROM (SELECT *, CAST(props->>'$.k' AS INT) AS k FROM events))"""


def spend(column: str = "amount") -> str:
    return f"CAST(sum(CAST({column} AS DECIMAL(18,2))) AS DOUBLE)"


def money(x: str) -> str:
    c = f"CAST(floor(({x}) * 100 + 0.5) AS BIGINT)"
    return f"(CAST({c} // 100 AS VARCHAR) || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0'))"


def fill(template: str, *values: str) -> str:
    """SQL expression for a template with its %s marks replaced by expressions."""
    pieces = ["'" + p.replace("'", "''") + "'" for p in template.split("%s")]
    out = [pieces[0]]
    for value, piece in zip(values, pieces[1:], strict=True):
        out += [f"({value})", piece]
    return "(" + " || ".join(out) + ")"


def sliding(name: str, size: int) -> str:
    return f"""{name} AS (
  SELECT user_id, ws AS window_start, ws + INTERVAL {size} MINUTE AS window_end,
         count(*) AS tx_count, {spend()} AS total_spend, {spend()} / count(*) AS avg_amount,
         max(amount) AS max_amount,
         count(*) FILTER (amount >= 9000 AND amount < 10000) AS near_threshold_count,
         count(DISTINCT merchant) AS distinct_merchants,
         count(DISTINCT country) AS distinct_countries
  FROM (SELECT *, unnest(generate_series(
            time_bucket(INTERVAL 1 MINUTE, "timestamp") - INTERVAL {size - 1} MINUTE,
            time_bucket(INTERVAL 1 MINUTE, "timestamp"), INTERVAL 1 MINUTE)) AS ws FROM tx)
  GROUP BY user_id, ws)"""


def newest(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT * FROM {source} WHERE window_end <= {NOW}
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY window_end DESC) = 1)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


F15, F30, F60 = (sliding(f"s{m}", m) + ",\n" + newest(f"f{m}", f"s{m}") for m in (15, 30, 60))

HOUR_COLUMNS = f"""count(*) OVER w AS tx_count_1h,
  CAST(sum(CAST(amount AS DECIMAL(18,2))) OVER w AS DOUBLE) AS total_spend_1h,
  CAST(sum(CAST(amount AS DECIMAL(18,2))) OVER w AS DOUBLE) / count(*) OVER w AS avg_amount_1h,
  max(amount) OVER w AS max_amount_1h,
  count(DISTINCT merchant) OVER w AS distinct_merchants_1h,
  count(DISTINCT country) OVER w AS distinct_countries_1h"""
HOUR_WINDOW = """WINDOW w AS (PARTITION BY user_id ORDER BY "timestamp"
  RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)"""
HOURLY = f"""hourly AS (
  SELECT user_id, {HOUR_COLUMNS}
  FROM tx WHERE "timestamp" >= {NOW} - INTERVAL 24 HOUR
  {HOUR_WINDOW}
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY "timestamp" DESC, transaction_id) = 1)"""

BASE = f"""base AS (
  SELECT user_id, count(*) AS baseline_tx_count, {spend()} AS baseline_total_spend
  FROM tx WHERE "timestamp" >= {NOW} - INTERVAL 14 DAY GROUP BY user_id)"""
DAYS = f"""days AS (
  SELECT user_id, date_trunc('day', "timestamp")::TIMESTAMP AS day, count(*) AS intraday_tx_count,
         {spend()} AS intraday_total_spend
  FROM tx GROUP BY ALL)"""
INTRA = f"""intra AS (SELECT * FROM days WHERE day = {TODAY})"""
FEATURES = [BASE, DAYS, INTRA]
FOUR = """coalesce(baseline_tx_count, 0) AS baseline_tx_count,
  coalesce(baseline_total_spend, 0.0::DOUBLE) AS baseline_total_spend,
  coalesce(intraday_tx_count, 0) AS intraday_tx_count,
  coalesce(intraday_total_spend, 0.0::DOUBLE) AS intraday_total_spend"""
LOOKUP = "LEFT JOIN base USING (user_id) LEFT JOIN intra USING (user_id)"

ALERTS = """alerts AS (
  SELECT transaction_id, user_id, amount, "timestamp",
         CASE WHEN amount >= 50000 THEN 'LARGE_MOVEMENT'
              WHEN country IN ('FR', 'FRANCE') THEN 'JURISDICTION_SCAN'
              ELSE 'MANUAL_REVIEW_SUGGESTION' END AS alert_type
  FROM tx WHERE amount >= 50000 OR country IN ('FR', 'FRANCE'))"""

SCORED = f"""joined AS (SELECT transaction_id, tx.user_id, amount, {FOUR} FROM tx {LOOKUP}),
summed AS (
  SELECT *, baseline_total_spend + intraday_total_spend AS combined_total_spend,
         baseline_tx_count + intraday_tx_count AS combined_total_count FROM joined),
averaged AS (
  SELECT *, (combined_total_spend + amount) / (combined_total_count + 1) AS average FROM summed),
judged AS (
  SELECT *, average > 0 AND amount > 2 * average AND amount > 500 AS is_alert FROM averaged)"""
SYNC = "CAST(substr(transaction_id, 5) AS BIGINT) % 2"
SCORED_SYNCED = SCORED.replace(
    "LEFT JOIN intra USING (user_id)", f"LEFT JOIN intra ON intra.user_id = tx.user_id AND {SYNC} = 1"
)
SCORE = f"""SELECT transaction_id, user_id, amount, average AS current_15_day_avg, is_alert,
  CASE WHEN is_alert THEN 'Unusual spend: Amount ($' || {money("amount")}
    || ') is > 2x the 15-day moving average ($' || {money("average")} || ')'
    ELSE '' END AS reason,
  combined_total_spend, combined_total_count FROM judged"""

CHAINS = """chains AS (
  SELECT t1.user_id AS account_a, t1.merchant AS account_b, t2.merchant AS account_c,
         t3.merchant AS account_d, t1.transaction_id AS transaction_1,
         t2.transaction_id AS transaction_2, t3.transaction_id AS transaction_3,
         t1.amount AS amount_1, t2.amount AS amount_2, t3.amount AS amount_3
  FROM tx t1 JOIN tx t2 ON t2.user_id = t1.merchant AND t1."timestamp" < t2."timestamp"
             JOIN tx t3 ON t3.user_id = t2.merchant AND t2."timestamp" < t3."timestamp"
  WHERE t1.amount > 5000)"""
CYCLES = """cycles AS (
  SELECT t1.user_id AS originating_account, t1.merchant AS intermediary_1,
         t2.merchant AS intermediary_2, t1.amount AS init_amount, t2.amount AS middle_amount,
         t3.amount AS return_amount, t1.transaction_id AS transaction_1,
         t2.transaction_id AS transaction_2, t3.transaction_id AS transaction_3
  FROM tx t1 JOIN tx t2 ON t2.user_id = t1.merchant AND t1."timestamp" < t2."timestamp"
             JOIN tx t3 ON t3.user_id = t2.merchant AND t3.merchant = t1.user_id
                       AND t2."timestamp" < t3."timestamp")"""
OWNERS = """ents(entity_id, risk_level) AS (VALUES ('Shell_Corp_1', 'Monitor'),
  ('Jane_Doe', 'Low Risk'), ('Cartel_Boss', 'High Risk'), ('Shady_Shell_Corp', 'High Risk')),
owns(owner_entity, owned_account) AS (VALUES ('Jane_Doe', 'Shell_Corp_1'),
  ('Cartel_Boss', 'merchant_7')),
hits AS (
  SELECT tx.user_id AS sender, amount AS transfer_amount, merchant AS receiving_account,
         owner_entity AS beneficiary, transaction_id
  FROM tx JOIN owns ON merchant = owned_account
          JOIN ents ON owner_entity = entity_id AND risk_level = 'High Risk')"""
NODES = """nodes AS (
  SELECT DISTINCT user_id AS account_id, 'Retail' AS account_type FROM tx
  UNION SELECT DISTINCT merchant, 'Merchant/P2P' FROM tx)"""


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# One row per finding: place, number, node names, first, last; and one row per link.
FOUND = f"""l3 AS (SELECT *, row_number() OVER (ORDER BY amount_1 DESC, transaction_1,
    transaction_2, transaction_3) AS n FROM chains QUALIFY n <= 3),
c3 AS (SELECT *, row_number() OVER (ORDER BY originating_account, intermediary_1, intermediary_2,
    transaction_1, transaction_2, transaction_3) AS n FROM cycles QUALIFY n <= 3),
s5 AS (SELECT *, row_number() OVER (ORDER BY transaction_id) AS n FROM tx
    WHERE amount > 9000 AND amount < 10000 QUALIFY n <= 5),
o3 AS (SELECT *, row_number() OVER (ORDER BY transaction_id, beneficiary) AS n FROM hits
    QUALIFY n <= 3),
found AS (
  SELECT 1 AS place, n, {_sql(W.LAYERING)} AS anomaly_type,
         [account_a, account_b, account_c, account_d] AS ids FROM l3
  UNION ALL SELECT 2, n, {_sql(W.CIRCULAR)},
         [originating_account, intermediary_1, intermediary_2] FROM c3
  UNION ALL SELECT 3, n, {_sql(W.SMURFING)}, [user_id, merchant] FROM s5
  UNION ALL SELECT 4, n, {_sql(W.OWNER)}, [sender, receiving_account, beneficiary] FROM o3),
spots AS (
  SELECT place, n, anomaly_type, i AS pos, ids[i] AS id
  FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM found)),
firsts AS (
  SELECT * FROM spots QUALIFY row_number() OVER (PARTITION BY id ORDER BY place, n, pos) = 1),
links AS (
  SELECT {_sql(W.LAYERING)} AS pattern, account_a AS source, account_b AS target, amount_1 AS amount FROM l3
  UNION ALL SELECT {_sql(W.LAYERING)}, account_b, account_c, amount_2 FROM l3
  UNION ALL SELECT {_sql(W.LAYERING)}, account_c, account_d, amount_3 FROM l3
  UNION ALL SELECT {_sql(W.CIRCULAR)}, originating_account, intermediary_1, init_amount FROM c3
  UNION ALL SELECT {_sql(W.CIRCULAR)}, intermediary_1, intermediary_2, middle_amount FROM c3
  UNION ALL SELECT {_sql(W.CIRCULAR)}, intermediary_2, originating_account, return_amount FROM c3
  UNION ALL SELECT {_sql(W.SMURFING)}, user_id, merchant, amount FROM s5
  UNION ALL SELECT {_sql(W.OWNER)}, sender, receiving_account, transfer_amount FROM o3
  UNION ALL SELECT {_sql(W.OWNER)}, beneficiary, receiving_account, 0.0 FROM o3)"""
GRAPH = [TX, CHAINS, CYCLES, OWNERS, FOUND]


def _pick(values: dict[str, str]) -> str:
    cases = " ".join(f"WHEN {_sql(k)} THEN {v}" for k, v in values.items())
    return f"CASE anomaly_type {cases} END"


# Distinct names of a finding in path order: the first occurrence of each stays.
DISTINCT_IDS = "list_filter(ids, lambda x, i: list_position(ids, x) = i)"

MULTI = [TX, F15, F30, F60]
MULTI_JOIN = "FROM f60 LEFT JOIN f30 USING (user_id) LEFT JOIN f15 USING (user_id)"


def _n(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '0')"


def _m(x: str) -> str:
    return f"coalesce({money(x)}, '0.00')"


PROMPT = fill(
    W.RECOMMENDATION,
    "f60.user_id",
    _n("f15.tx_count"), _m("f15.total_spend"), _m("f15.max_amount"),
    _n("f30.tx_count"), _m("f30.total_spend"),
    _n("f60.tx_count"), _m("f60.total_spend"), _m("f60.avg_amount"),
    _n("f60.distinct_merchants"), _n("f60.distinct_countries"), _n("f60.near_threshold_count"),
)
PROMPTS = f"""prompts AS (
  SELECT f60.user_id, {PROMPT} AS prompt, f60.near_threshold_count > 0 AS refused {MULTI_JOIN})"""
MADE = """made AS (
  SELECT user_id, CASE WHEN refused THEN NULL ELSE CAST(length(prompt) AS VARCHAR) END
           AS recommendation,
         CASE WHEN refused THEN 'refused' ELSE '' END AS status,
         CASE WHEN refused THEN 'near threshold' END AS safety_attributes FROM prompts)"""
PROMPT_1H = fill(
    W.RECOMMENDATION_1H,
    "user_id", "CAST(tx_count_1h AS VARCHAR)", money("total_spend_1h"), money("avg_amount_1h"),
    "CAST(distinct_merchants_1h AS VARCHAR)", "CAST(distinct_countries_1h AS VARCHAR)",
    money("max_amount_1h"),
)


def _described(name: str, source: str) -> str:
    text = _sql(TABLES[name][1] + " Rows: ")
    return f"""SELECT {_sql(name)} AS table_name, 'description' AS option_name,
      {text} || count(*) || '.' AS option_value FROM {source}"""


DESCRIPTIONS = "descriptions AS (" + " UNION ALL ".join(
    _described(n, s)
    for n, s in [("raw_transactions", "tx"), ("aml_alerts", "alerts"),
                 ("account_nodes", "nodes"), ("user_features", "hourly")]
) + ")"
DESCRIBED = [TX, ALERTS, NODES, HOURLY, DESCRIPTIONS]

TX_COLUMNS = [
    ("transaction_id", "string"), ("user_id", "string"), ("amount", "double"),
    ("timestamp", "timestamp_ntz"), ("merchant", "string"), ("category", "string"),
    ("currency", "string"), ("country", "string"),
]
PROFILE = "profile AS (" + " UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS column_name, '{t}' AS data_type, count(*) AS row_count,
      count(*) - count("{c}") AS null_count, count(DISTINCT "{c}") AS distinct_count FROM tx"""
    for i, (c, t) in enumerate(TX_COLUMNS, 1)
) + ")"

REPLIES = """replies AS (
  SELECT 'doc_' || doc_id AS id,
         '```json' || chr(10) || CAST(to_json({'heading': lang, 'summary': text}) AS VARCHAR)
         || chr(10) || '```' AS reply FROM documents
  UNION ALL SELECT 'turn_' || conv_id || '_' || turn, text FROM conversations),
cleaned AS (
  SELECT id, trim(regexp_replace(reply, '```(json)?', '', 'g'), ' ' || chr(9) || chr(13) || chr(10))
    AS body FROM replies),
parsed AS (
  SELECT id, CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN body END AS body
  FROM cleaned)"""

ALL_TX = 'transaction_id, user_id, amount, "timestamp", merchant, category, currency, country'
SLIDING_OUT = """user_id, window_start, window_end, tx_count, total_spend, avg_amount, max_amount,
  near_threshold_count, distinct_merchants, distinct_countries"""
BY_DAY = "SELECT user_id, day, intraday_tx_count, intraday_total_spend FROM days"


def all_oracles() -> dict[str, str]:
    tx = with_(TX)
    hourly = with_(TX, HOURLY)
    users = with_(TX, *FEATURES)
    alerts = with_(TX, ALERTS, *FEATURES)
    found = with_(*GRAPH)
    multi = with_(*MULTI)
    four = "transaction_id, user_id, alert_type, amount"
    sql = {
        "parse_transactions": tx
        + """SELECT transaction_id, user_id, amount, false AS is_rejected FROM tx
  UNION ALL VALUES (NULL, NULL, NULL, true), ('t_no_user', NULL, 1.0, true),
                   ('t_text_amount', 'user_x', NULL, true)""",
        "load_history": tx + f"SELECT {ALL_TX} FROM tx",
        "stream_land_raw": tx + f"SELECT {ALL_TX} FROM tx",
        "injected_patterns": tx
        + """SELECT transaction_id, user_id, amount, merchant, category, currency, country FROM tx
  UNION ALL SELECT *, 'USD', 'US' FROM (VALUES
    ('plant_1', 'Layer_Alice', 6000.0, 'Layer_Bob', 'P2P_Transfer'),
    ('plant_2', 'Layer_Bob', 5900.0, 'Layer_Charlie', 'P2P_Transfer'),
    ('plant_3', 'Layer_Charlie', 5800.0, 'Layer_Dave', 'P2P_Transfer'),
    ('plant_4', 'Circ_Eve', 2500.0, 'Circ_Frank', 'P2P_Transfer'),
    ('plant_5', 'Circ_Frank', 2400.0, 'Circ_Grace', 'P2P_Transfer'),
    ('plant_6', 'Circ_Grace', 2300.0, 'Circ_Eve', 'P2P_Transfer'),
    ('plant_7', 'Innocent_Retail', 15000.0, 'Shady_Shell_Corp', 'Investment'))""",
        "feature_view_snapshot": tx
        + ", nights(night) AS (VALUES (TIMESTAMP '2024-01-30'), (TIMESTAMP '2024-01-31'))"
        + f""", history AS (
  SELECT user_id, night AS feature_timestamp, count(*) AS baseline_tx_count,
         {spend()} AS baseline_total_spend
  FROM tx JOIN nights ON "timestamp" >= night - INTERVAL 14 DAY AND "timestamp" < night
  GROUP BY ALL)
SELECT user_id, baseline_tx_count, baseline_total_spend, feature_timestamp FROM history
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY feature_timestamp DESC) = 1""",
        "table_descriptions": with_(*DESCRIBED) + "SELECT * FROM descriptions",
        "catalog_descriptions": with_(*DESCRIBED) + "SELECT * FROM descriptions",
        "column_profile": with_(TX, PROFILE)
        + "SELECT column_name, row_count, null_count, distinct_count FROM profile",
        "stateless_alerts": with_(TX, ALERTS) + f"SELECT {four} FROM alerts",
        "stream_alerts": with_(TX, ALERTS) + f"SELECT {four} FROM alerts",
        "risk_tiers": hourly
        + """SELECT user_id, tx_count_1h, total_spend_1h, distinct_countries_1h,
  CASE WHEN total_spend_1h > 5000 AND distinct_countries_1h > 2 THEN 'HIGH RISK'
       WHEN total_spend_1h > 2000 OR tx_count_1h > 20 THEN 'MEDIUM RISK'
       ELSE 'LOW RISK' END AS risk_level FROM hourly""",
        "multi_country_users": hourly
        + """SELECT user_id, distinct_countries_1h, total_spend_1h, tx_count_1h FROM hourly
WHERE distinct_countries_1h > 1""",
        "suspicious_users": hourly
        + """SELECT user_id, distinct_countries_1h, total_spend_1h, tx_count_1h FROM hourly
WHERE distinct_countries_1h > 2 OR total_spend_1h > 5000""",
        "top_spenders": hourly
        + """SELECT user_id, total_spend_1h, tx_count_1h FROM hourly
ORDER BY total_spend_1h DESC, user_id LIMIT 10""",
        "amount_bands": tx
        + f"""SELECT CASE WHEN amount BETWEEN 9000 AND 9999 THEN 'structuring'
    WHEN amount BETWEEN 1 AND 10 THEN 'micro_deposit'
    WHEN amount BETWEEN 500 AND 15000 THEN 'high_value' ELSE 'normal' END AS band,
  count(*) AS tx_count, {spend()} AS total_amount FROM tx GROUP BY band""",
        "text_risk_level": """SELECT doc_id,
  CASE WHEN contains(t, 'Risk Assessment: High') OR contains(t, 'High Risk') THEN 'High'
       WHEN contains(t, 'Risk Assessment: Medium') OR contains(t, 'Medium Risk') THEN 'Medium'
       ELSE 'Low' END AS risk_level
FROM (SELECT doc_id, coalesce(CASE WHEN toxic = 1 THEN 'Risk Assessment: High. '
        WHEN quality = 0 THEN 'Medium Risk. ' ELSE '' END || text, '') AS t
      FROM documents LEFT JOIN labels USING (doc_id))""",
        "category_summary": tx
        + f"""SELECT category, count(*) AS transaction_count, {spend()} AS total_amount,
  {spend()} / count(*) AS avg_amount, count(DISTINCT user_id) AS unique_users
FROM tx WHERE "timestamp" >= {NOW} - INTERVAL 1 HOUR GROUP BY category""",
        "category_summary_all": tx
        + f"""SELECT category, count(*) AS transaction_count, {spend()} AS total_amount,
  {spend()} / count(*) AS avg_amount, count(DISTINCT user_id) AS unique_users
FROM tx GROUP BY category""",
        "newest_transactions": tx
        + f"""SELECT {ALL_TX} FROM tx ORDER BY "timestamp" DESC, transaction_id LIMIT 10""",
        "latest_per_table": with_(TX, *[sliding(f"s{m}", m) for m in (15, 30, 60)])
        + " UNION ALL ".join(
            f"""(SELECT 'user_features_{m}m' AS table_name, user_id, window_end, tx_count
  FROM s{m} WHERE window_end <= {NOW} ORDER BY window_end DESC, user_id LIMIT 5)"""
            for m in (15, 30, 60)
        ),
        "latest_per_user": with_(TX, F60)
        + "SELECT user_id, window_end, tx_count, total_spend FROM f60",
        "multi_window_features": multi
        + f"""SELECT f60.user_id, f15.tx_count AS tx_count_15m, f30.tx_count AS tx_count_30m,
  f60.tx_count AS tx_count_60m, f15.total_spend AS total_spend_15m,
  f30.total_spend AS total_spend_30m, f60.total_spend AS total_spend_60m,
  f15.max_amount AS max_amount_15m {MULTI_JOIN}""",
        "intraday_totals": users + BY_DAY,
        "stream_intraday": users + BY_DAY,
        "stream_intraday_upsert": users
        + BY_DAY
        + " QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC) = 1",
        "baseline_14d": users
        + """SELECT *, CAST(0 AS BIGINT) AS intraday_tx_count,
  CAST(0 AS DOUBLE) AS intraday_total_spend FROM base""",
        "rolling_1h_all": tx
        + f"SELECT transaction_id, user_id, {HOUR_COLUMNS} FROM tx {HOUR_WINDOW}",
        "user_features_1h": hourly + "SELECT * FROM hourly",
        "score_transactions": with_(TX, *FEATURES, SCORED) + SCORE,
        "stream_score": with_(TX, *FEATURES, SCORED) + SCORE,
        "stream_score_synced": with_(TX, *FEATURES, SCORED_SYNCED)
        + SCORE.replace(" FROM judged", f", {SYNC} AS sync FROM judged"),
        "stream_intraday_panes": users
        + BY_DAY.replace(" FROM ", ", true AS growing FROM ", 1),
        "stream_late_rows": tx
        + "SELECT count(DISTINCT user_id) AS dropped, count(*) AS counted FROM tx",
        "enriched_alerts": alerts
        + f"""SELECT {four}, "timestamp", {FOUR} FROM (
  SELECT * FROM alerts ORDER BY "timestamp" DESC, transaction_id LIMIT 20) {LOOKUP}""",
        "alert_ratio": alerts
        + f""", joined AS (SELECT transaction_id, amount, {FOUR} FROM alerts {LOOKUP}),
averaged AS (SELECT *, CASE WHEN baseline_tx_count + intraday_tx_count > 0
    THEN (baseline_total_spend + intraday_total_spend) / (baseline_tx_count + intraday_tx_count)
    ELSE 0.0::DOUBLE END AS avg15d FROM joined),
rated AS (SELECT *, CASE WHEN avg15d > 0 THEN amount / avg15d ELSE 0.0::DOUBLE END AS ratio FROM averaged)
SELECT transaction_id, avg15d, ratio, ratio > 2 AS over_2x, amount >= 50000 AS is_high_value
FROM rated""",
        "live_activity": with_(TX, F15)
        + """SELECT user_id, tx_count, total_spend, max_amount, '15m' AS duration FROM f15
ORDER BY window_end DESC, user_id LIMIT 5""",
        "feed_rollup": with_(TX, F15)
        + """SELECT max(total_spend) AS top_spend, count(*) AS active_users FROM (
  SELECT * FROM f15 ORDER BY window_end DESC, user_id LIMIT 5)""",
        "hybrid_lookup": with_(TX, F15, *FEATURES)
        + f""", recent AS (SELECT user_id FROM f15 GROUP BY user_id
  ORDER BY max(window_end) DESC, user_id LIMIT 5),
joined AS (SELECT user_id, {FOUR} FROM recent {LOOKUP})
SELECT *, baseline_total_spend + intraday_total_spend AS combined_spend,
  baseline_tx_count + intraday_tx_count AS combined_count FROM joined""",
        "account_nodes": with_(TX, NODES) + "SELECT * FROM nodes",
        "transaction_edges": tx
        + """SELECT user_id AS source_account, merchant AS target_account, amount, "timestamp",
  transaction_id, currency, country FROM tx""",
        "dangling_edges": with_(TX, OWNERS)
        + """, nodes AS (SELECT account_id FROM (SELECT user_id AS account_id FROM tx WHERE early
    UNION SELECT merchant FROM tx WHERE early) WHERE account_id IS NOT NULL),
sent AS (SELECT transaction_id, user_id AS a,
    CASE WHEN category <> 'signup' THEN merchant END AS b FROM tx)
SELECT 'transfer' AS kind, transaction_id AS edge_id, a AS from_id, b AS to_id,
  a NOT IN (SELECT account_id FROM nodes) AS from_missing,
  b IS NULL OR b NOT IN (SELECT account_id FROM nodes) AS to_missing
FROM sent WHERE from_missing OR to_missing
UNION ALL SELECT 'ownership', NULL, owner_entity, owned_account,
  owner_entity NOT IN (SELECT entity_id FROM ents) AS f,
  owned_account NOT IN (SELECT account_id FROM nodes) AS t FROM owns WHERE f OR t""".replace(
            "WHERE early", "WHERE \"timestamp\" < TIMESTAMP '2024-01-01 06:00:00'"
        ),
        "circular_counts": with_(TX, CYCLES)
        + """SELECT originating_account, intermediary_1, intermediary_2, count(*) AS cycles
FROM cycles GROUP BY ALL""",
        "layering_paths": with_(TX, CHAINS)
        + f"""SELECT account_a AS first_account, count(*) AS paths,
  {spend("amount_1")} AS total_first_amount FROM chains GROUP BY account_a""",
        "layering_exits": with_(TX, CHAINS)
        + f"""SELECT account_d AS last_account, count(*) AS paths,
  {spend("amount_1")} AS total_first_amount FROM chains GROUP BY account_d""",
        "layering_top": with_(TX, CHAINS)
        + """SELECT account_a, account_b, account_c, account_d, transaction_1, transaction_2,
  transaction_3 FROM chains
ORDER BY amount_1 DESC, transaction_1, transaction_2, transaction_3 LIMIT 100""",
        "circular_transfers": with_(TX, CYCLES)
        + "SELECT * EXCLUDE (middle_amount) FROM cycles",
        "smurfing_sinks": tx
        + f"""SELECT merchant AS target_account, count(*) AS structuring_deposit_count,
  {spend()} AS total_structured_amount FROM tx
WHERE amount > 9000 AND amount < 10000 GROUP BY merchant HAVING count(*) > 3""",
        "smurfing_pairs": tx
        + """SELECT user_id AS sender, transaction_id, amount, merchant AS target FROM tx
WHERE amount > 9000 AND amount < 10000 ORDER BY transaction_id LIMIT 5""",
        "owner_risk": with_(TX, OWNERS)
        + "SELECT sender, transfer_amount, receiving_account, beneficiary FROM hits",
        "subgraph_nodes": with_(*GRAPH, NODES)
        + """SELECT id, CASE WHEN place = 4 AND pos = 3 THEN 'High Risk'
    WHEN (id, 'Retail') IN (SELECT (account_id, account_type) FROM nodes) THEN 'Retail'
    ELSE 'Merchant/P2P' END AS "group" FROM firsts""",
        "subgraph_links": found
        + "SELECT source, target, CAST(amount AS DOUBLE) AS amount, 'GBP' AS currency, pattern,"
        + r" '$' || regexp_replace(format('{:,.2f}', amount::DOUBLE), '\.?0+$', '') AS label"
        + " FROM links WHERE amount > 0 UNION ALL"
        + " SELECT source, target, CAST(amount AS DOUBLE), 'USD', pattern, 'OWNS' FROM links"
        + " WHERE amount = 0",
        "anomaly_summaries": found
        + "SELECT anomaly_type, "
        + _pick({p: _sql(h) for p, h in W.HEADINGS.items()})
        + " AS heading, "
        + _pick(
            {
                W.LAYERING: fill(W.SUMMARIES[W.LAYERING], "ids[1]", "list_last(distinct_ids)"),
                W.CIRCULAR: fill(W.SUMMARIES[W.CIRCULAR], "ids[1]"),
                W.SMURFING: fill(W.SUMMARIES[W.SMURFING], "ids[1]"),
                W.OWNER: fill(W.SUMMARIES[W.OWNER], "ids[3]"),
            }
        )
        + f" AS summary FROM (SELECT *, {DISTINCT_IDS} AS distinct_ids FROM found)",
        "graph_verdict": found
        + f""", counted AS (SELECT (SELECT count(*) FROM firsts) AS n,
  (SELECT count(*) FROM links) AS m,
  (SELECT string_agg(id, ', ' ORDER BY place, n, pos) FROM (
     SELECT * FROM firsts ORDER BY place, n, pos LIMIT 3)) AS names)
SELECT CASE WHEN n > 6 THEN {_sql(W.NETWORK_HEADING)} WHEN n > 0 THEN {_sql(W.ALERT_HEADING)}
    ELSE {_sql(W.NOTHING_HEADING)} END AS heading,
  CASE WHEN n > 0 THEN {fill(W.VERDICT_SUMMARY, "n", "m", "names")}
    ELSE {_sql(W.NOTHING_SUMMARY)} END AS summary FROM counted""",
        "anomaly_of_node": found + "SELECT id AS node_id, anomaly_type FROM firsts",
        "recommendation_prompts": with_(*MULTI, PROMPTS) + "SELECT user_id, prompt FROM prompts",
        "generate_text": with_(*MULTI, PROMPTS, MADE) + "SELECT * FROM made",
        "recent_recommendations": with_(*MULTI, PROMPTS, MADE)
        + """SELECT user_id, recommendation, status FROM made WHERE recommendation IS NOT NULL
ORDER BY user_id LIMIT 20""",
        "null_audit": with_(*MULTI, PROMPTS, MADE)
        + """SELECT count(*) AS total, count(*) FILTER (recommendation IS NULL) AS null_count,
  min(status) FILTER (recommendation IS NULL) AS sample_status FROM made""",
        "recommendation_prompts_1h": hourly + f"SELECT user_id, {PROMPT_1H} AS prompt FROM hourly",
        "transaction_prompts": tx
        + "SELECT transaction_id, "
        + fill(W.TRANSACTION, money("amount"), "merchant", "country")
        + " AS prompt FROM tx",
        "ideation_prompts": with_(*DESCRIBED)
        + "SELECT table_name AS source_table, "
        + fill(W.IDEAS_STREAMING, "table_name", "option_value")
        + " AS prompt FROM descriptions WHERE table_name = 'raw_transactions'",
        "grounded_prompt": with_(*DESCRIBED, PROFILE)
        + """, lines AS (SELECT string_agg('Table: raw_transactions | Column: ' || column_name
    || ' | Type: ' || data_type || ' (' || null_count || ' nulls, ' || distinct_count
    || ' distinct)', chr(10) ORDER BY position) AS schema_text FROM profile),
tables AS (SELECT string_agg('Table: ' || table_name || ' | Description: ' || option_value,
    chr(10) ORDER BY table_name) AS table_text FROM descriptions)
SELECT """
        + fill(W.GROUNDED, "schema_text", "table_text")
        + " AS prompt FROM lines, tables",
        "response_text": """SELECT doc_id AS id, json_extract_string(
  to_json({'candidates': [{'content': {'parts': [{'text': text}]}}]}),
  '$.candidates[0].content.parts[0].text') AS text FROM documents""",
        "graph_inference_parse": "WITH "
        + REPLIES
        + f"""SELECT id,
  coalesce(nullif(json_extract_string(body, '$.heading'), ''), {_sql(W.NOTHING_HEADING)}) AS heading,
  coalesce(nullif(json_extract_string(body, '$.summary'), ''), {_sql(W.NOTHING_SUMMARY)}) AS summary
FROM parsed""",
    }
    hop = """e{0} AS (SELECT user_id AS src{0}, merchant AS dst{0}, transaction_id AS id{0},
  amount AS amount{0}, "timestamp" AS at{0} FROM tx)"""
    sql["layering_chains_1h"] = (
        with_(TX, *[hop.format(i) for i in (1, 2, 3)])
        + """SELECT src1 AS account_a, dst1 AS account_b, dst2 AS account_c, dst3 AS account_d,
  id1 AS transaction_1, id2 AS transaction_2, id3 AS transaction_3,
  '{"labels":["Transfer"],"properties":{"account_a":"' || src1 || '","account_b":"' || dst1
  || '"}}' AS first_hop
FROM e1 JOIN e2 ON src2 = dst1 AND at2 > at1 AND at2 <= at1 + INTERVAL 1 HOUR
JOIN e3 ON src3 = dst2 AND at3 > at2 AND at3 <= at2 + INTERVAL 1 HOUR WHERE amount1 > 5000"""
    )
    sql["circular_6h"] = (
        with_(TX, *[hop.format(i) for i in (1, 2, 3)])
        + """SELECT src1 AS originating_account, dst1 AS intermediary_1, dst2 AS intermediary_2,
  amount1 AS init_amount, amount3 AS return_amount,
  id1 AS transaction_1, id2 AS transaction_2, id3 AS transaction_3
FROM e1 JOIN e2 ON src2 = dst1 AND at2 > at1 AND at2 <= at1 + INTERVAL 6 HOUR
JOIN e3 ON src3 = dst2 AND dst3 = src1 AND at3 > at2 AND at3 <= at2 + INTERVAL 6 HOUR"""
    )
    ideas = (
        with_(*DESCRIBED)
        + "SELECT table_name AS source_table, CAST(length(prompt) AS VARCHAR) AS new_feature_ideas"
        + " FROM (" + " UNION ALL ".join(
            "SELECT table_name, " + fill(t, "table_name", "option_value") + " AS prompt FROM descriptions"
            for t in (W.IDEAS_STREAMING, W.IDEAS_BATCH)
        ) + ")"
    )
    sql["feature_ideation"] = ideas
    sql["recent_ideas"] = ideas + " ORDER BY source_table, new_feature_ideas"
    sql["graph_inference"] = (
        f"SELECT {_sql(W.GRAPH_PROMPT.split()[0])} AS heading, summary FROM ({sql['graph_verdict']})"
    )
    sql["table_round_trip"] = users + BY_DAY
    sql["generate_text_once"] = sql["generate_text"]
    sql["stream_rejected"] = """SELECT left('{"transaction_id":"txn_' || event_id
  || '","user_id":"user_' || user_id, 30) AS message FROM events WHERE event_id % 6 = 5"""
    for m in (15, 30, 60):
        sql[f"sliding_features_{m}m"] = (
            with_(TX, sliding("s", m)) + f"SELECT {SLIDING_OUT} FROM s"
        )
        if m > 15:
            sql[f"stream_sliding_{m}m"] = sql[f"sliding_features_{m}m"]
    sql["stream_sliding_15m"] = (
        with_(TX, sliding("s", 15))
        + f"SELECT {SLIDING_OUT} FROM s"
        + ' WHERE window_end <= (SELECT max("timestamp") FROM tx) - INTERVAL 1 HOUR'
    )
    return sql
