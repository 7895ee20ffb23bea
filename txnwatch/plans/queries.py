"""Every operator as a named query over a folder of driver tables."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.functions import replies, rules
from txnwatch.functions import wording as W
from txnwatch.functions.timing import HOUR, instant, type_of
from txnwatch.operators import features as feat
from txnwatch.operators import graph, paths, profile, reports, scoring, subgraph, text
from txnwatch.schemas import TABLES
from txnwatch.session import local_rows, shared_folder
from txnwatch.sources import planted
from txnwatch.sources import transactions as src
from txnwatch.sources.catalog import create_table, describe_table
from txnwatch.sources.catalog import table_descriptions as listed_descriptions
from txnwatch.sources.tables import (
    append_files,
    append_to_table,
    feature_view,
    replace_table,
    sync_feature_view,
    write_clustered,
)
from txnwatch.streaming import features as live
from txnwatch.streaming import sinks
from txnwatch.streaming.late import LateRows

AS_OF = dt.datetime(2024, 1, 31)
TODAY = dt.date(2024, 1, 30)
FIRST_HOURS = dt.datetime(2024, 1, 1, 6)
# Fixture: the high-risk owner holds a merchant of the event table.
OWNERSHIP_ROWS = (
    ("Jane_Doe", "Shell_Corp_1", "UBO_extracted_from_PDF"),
    ("Cartel_Boss", "merchant_7", "SAR_parsed_from_PDF"),
)
BAD_MESSAGES = (
    "{bad",
    '{"transaction_id":"t_no_user","amount":1}',
    '{"transaction_id":"t_text_amount","user_id":"user_x","amount":"abc"}',
)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        _QUERIES[name] = fn
        return fn

    return register


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


# Shared inputs --------------------------------------------------------------------------

transactions = src.transactions


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.hourly_features(transactions(spark, sf_dir), AS_OF)


def latest(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    return feat.latest_sliding_features(transactions(spark, sf_dir), size, AS_OF)


def multi_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.multi_window_features(*[latest(spark, sf_dir, m) for m in (60, 30, 15)])


def user_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feat.hybrid_features(transactions(spark, sf_dir), AS_OF, TODAY)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.transaction_edges(transactions(spark, sf_dir))


def txn_graph(spark: SparkSession, sf_dir: str) -> graph.TxnGraph:
    return graph.TxnGraph.from_transactions(
        transactions(spark, sf_dir),
        planted.entities(spark),
        planted.ownership(spark, OWNERSHIP_ROWS),
    )


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subgraph.findings(txn_graph(spark, sf_dir))


# Sources and sinks ----------------------------------------------------------------------


@query("parse_transactions")
def parse_transactions(spark, sf_dir):
    messages = src.encode_messages(transactions(spark, sf_dir))
    bad = local_rows(spark, [(m.encode(),) for m in BAD_MESSAGES], "value BINARY")
    return src.decode_messages(messages.unionByName(bad)).select(
        "transaction_id", "user_id", "amount", "is_rejected"
    )


@query("load_history")
def load_history(spark, sf_dir):
    folder = shared_folder(spark, "load_history")
    lines = src.encode_messages(transactions(spark, sf_dir)).select(F.col("value").cast("string"))
    lines.write.text(f"{folder}/json")
    append_files(src.read_history(spark, f"{folder}/json"), f"{folder}/raw", "timestamp")
    return _plain_time(spark.read.parquet(f"{folder}/raw")).select(*src.COLUMNS)


@query("table_round_trip")
def table_round_trip(spark, sf_dir):
    """Create a catalog table, append by name, replace it, write it clustered, read it back."""
    folder = shared_folder(spark, "tables")
    database = f"txnwatch_{folder.rsplit('-', 1)[1]}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{folder}'")
    tx = transactions(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    early = F.col("timestamp") < F.lit(AS_OF - dt.timedelta(days=15))
    raw = create_table(spark, "raw_transactions", database)
    raw = create_table(spark, "raw_transactions", database)
    append_to_table(tx.filter(early).select(*reversed(tx.columns)), raw)
    append_to_table(tx.filter(~early), raw)
    replace_table(spark.table(raw).filter("amount IS NOT NULL"), f"{database}.known")
    write_clustered(feat.intraday_totals(spark.table(f"{database}.known")), f"{database}.days", buckets=8)
    return _plain_time(spark.table(f"{database}.days"), "day")


@query("injected_patterns")
def injected_patterns(spark, sf_dir):
    rows = planted.planted_transactions(spark, dt.datetime(2024, 1, 30, 12))
    return planted.inject(transactions(spark, sf_dir), rows).drop("timestamp")


@query("feature_view_snapshot")
def feature_view_snapshot(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    nights = [AS_OF - dt.timedelta(days=1), AS_OF]
    history = [
        feat.baseline(tx.filter(F.col("timestamp") < instant(n, type_of(tx))), n).withColumn(
            "feature_timestamp", instant(n, type_of(tx))
        )
        for n in nights
    ]
    view = feature_view(history[0].unionByName(history[1]))
    return view.select("user_id", "baseline_tx_count", "baseline_total_spend", "feature_timestamp")


def described_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    tx = transactions(spark, sf_dir)
    return {
        "raw_transactions": tx,
        "aml_alerts": reports.stateless_alerts(tx),
        "account_nodes": graph.account_nodes(tx),
        "user_features": hourly(spark, sf_dir),
    }


@query("table_descriptions")
def table_descriptions(spark, sf_dir):
    tables = described_tables(spark, sf_dir)
    rows = [
        df.agg(F.count(F.lit(1)).cast("string").alias("n")).select(
            F.lit(name).alias("table_name"),
            F.lit("description").alias("option_name"),
            F.concat(F.lit(f"{TABLES[name][1]} Rows: "), "n", F.lit(".")).alias("option_value"),
        )
        for name, df in tables.items()
    ]
    result = rows[0]
    for row in rows[1:]:
        result = result.unionByName(row)
    return result


@query("catalog_descriptions")
def catalog_descriptions(spark, sf_dir):
    """The same tables written to a database, described there, and listed from its catalog."""
    folder = shared_folder(spark, "catalog")
    database = f"txnwatch_{folder.rsplit('-', 1)[1]}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{folder}'")
    for name, df in described_tables(spark, sf_dir).items():
        replace_table(df, f"{database}.{name}")
        rows = spark.table(f"{database}.{name}").count()
        describe_table(spark, f"{database}.{name}", f"{TABLES[name][1]} Rows: {rows}.")
    return listed_descriptions(spark, database)


@query("column_profile")
def column_profile(spark, sf_dir):
    return profile.column_profile(transactions(spark, sf_dir))


# Rules and reports ----------------------------------------------------------------------


@query("stateless_alerts")
def stateless_alerts(spark, sf_dir):
    return reports.stateless_alerts(transactions(spark, sf_dir)).drop("timestamp")


@query("risk_tiers")
def risk_tiers(spark, sf_dir):
    return reports.risk_tiers(hourly(spark, sf_dir))


@query("multi_country_users")
def multi_country_users(spark, sf_dir):
    return reports.multi_country_users(hourly(spark, sf_dir))


@query("suspicious_users")
def suspicious_users(spark, sf_dir):
    return reports.suspicious_users(hourly(spark, sf_dir))


@query("top_spenders")
def top_spenders(spark, sf_dir):
    return reports.top_spenders(hourly(spark, sf_dir))


@query("amount_bands")
def amount_bands(spark, sf_dir):
    return reports.amount_bands(transactions(spark, sf_dir))


@query("text_risk_level")
def text_risk_level(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    note = (
        F.when(F.col("toxic") == 1, "Risk Assessment: High. ")
        .when(F.col("quality") == 0, "Medium Risk. ")
        .otherwise("")
    )
    return documents.join(labels, "doc_id", "left").select(
        "doc_id", rules.text_risk_level(F.concat(note, "text")).alias("risk_level")
    )


@query("category_summary")
def category_summary(spark, sf_dir):
    return reports.category_summary(transactions(spark, sf_dir), AS_OF)


@query("category_summary_all")
def category_summary_all(spark, sf_dir):
    return reports.category_summary(transactions(spark, sf_dir), hours=None)


@query("newest_transactions")
def newest_transactions(spark, sf_dir):
    return reports.newest_transactions(transactions(spark, sf_dir))


@query("latest_per_table")
def latest_per_table(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    return reports.newest_per_table(
        {f"user_features_{m}m": feat.newest_windows(tx, m, AS_OF, 5) for m in (15, 30, 60)}
    )


@query("live_activity")
def live_activity(spark, sf_dir):
    return reports.live_activity(latest(spark, sf_dir, 15))


@query("feed_rollup")
def feed_rollup(spark, sf_dir):
    return reports.feed_rollup(live_activity(spark, sf_dir))


# Features -------------------------------------------------------------------------------


def _sliding(size: int) -> Query:
    def run(spark, sf_dir):
        return feat.sliding_features(transactions(spark, sf_dir), size)

    return run


for _size in (15, 30, 60):
    query(f"sliding_features_{_size}m")(_sliding(_size))


@query("latest_per_user")
def latest_per_user(spark, sf_dir):
    windows = feat.sliding_features(transactions(spark, sf_dir), 60)
    return feat.latest_windows(windows, AS_OF).select(
        "user_id", "window_end", "tx_count", "total_spend"
    )


@query("multi_window_features")
def multi_window_features(spark, sf_dir):
    return multi_window(spark, sf_dir).select(
        "user_id",
        *[f"tx_count_{m}m" for m in (15, 30, 60)],
        *[f"total_spend_{m}m" for m in (15, 30, 60)],
        "max_amount_15m",
    )


@query("intraday_totals")
def intraday_totals(spark, sf_dir):
    return feat.intraday_totals(transactions(spark, sf_dir))


@query("baseline_14d")
def baseline_14d(spark, sf_dir):
    return feat.baseline(transactions(spark, sf_dir), AS_OF)


@query("rolling_1h_all")
def rolling_1h_all(spark, sf_dir):
    return feat.rolling_hour(transactions(spark, sf_dir))


@query("user_features_1h")
def user_features_1h(spark, sf_dir):
    return hourly(spark, sf_dir)


# Scoring --------------------------------------------------------------------------------


@query("score_transactions")
def score_transactions(spark, sf_dir):
    scored = scoring.score(transactions(spark, sf_dir), user_features(spark, sf_dir))
    return scored.drop("timestamp")


@query("enriched_alerts")
def enriched_alerts(spark, sf_dir):
    alerts = reports.stateless_alerts(transactions(spark, sf_dir))
    return scoring.enriched_alerts(alerts, user_features(spark, sf_dir))


@query("alert_ratio")
def alert_ratio(spark, sf_dir):
    alerts = reports.stateless_alerts(transactions(spark, sf_dir))
    return scoring.alert_ratio(alerts, user_features(spark, sf_dir))


@query("hybrid_lookup")
def hybrid_lookup(spark, sf_dir):
    users = reports.recent_users(latest(spark, sf_dir, 15))
    return scoring.hybrid_lookup(users, user_features(spark, sf_dir))


# Graph ----------------------------------------------------------------------------------


@query("account_nodes")
def account_nodes(spark, sf_dir):
    return graph.account_nodes(transactions(spark, sf_dir))


@query("transaction_edges")
def transaction_edges(spark, sf_dir):
    return edges(spark, sf_dir)


@query("dangling_edges")
def dangling_edges(spark, sf_dir):
    """Edges of the whole time between the accounts known after six hours; payments of
    category "signup" arrive without a receiver."""
    tx = transactions(spark, sf_dir)
    known = tx.filter(F.col("timestamp") < instant(FIRST_HOURS, type_of(tx)))
    receiver = F.when(F.col("category") != "signup", F.col("merchant"))
    whole = txn_graph(spark, sf_dir)
    return graph.TxnGraph(
        graph.account_nodes(known),
        whole.entities,
        graph.transaction_edges(tx.withColumn("merchant", receiver)),
        whole.owns,
    ).dangling()


@query("layering_paths")
def layering_paths(spark, sf_dir):
    found = paths.layering_sources(edges(spark, sf_dir))
    return found.withColumn("paths", F.col("paths").cast("bigint"))


@query("layering_exits")
def layering_exits(spark, sf_dir):
    found = paths.layering_sinks(edges(spark, sf_dir))
    return found.withColumn("paths", F.col("paths").cast("bigint"))


@query("layering_top")
def layering_top(spark, sf_dir):
    return paths.layering_top(edges(spark, sf_dir), 100).select(
        *[f"account_{x}" for x in "abcd"], *[f"transaction_{i}" for i in (1, 2, 3)]
    )


@query("layering_chains_1h")
def layering_chains_1h(spark, sf_dir):
    """Every chain whose hops follow each other within an hour, its first hop as an element."""
    chains = paths.layering_chains(edges(spark, sf_dir), max_gap=HOUR)
    chains = graph.element_json(chains, "Transfer", ["account_a", "account_b"], "first_hop")
    return chains.select(
        *[f"account_{x}" for x in "abcd"], *[f"transaction_{i}" for i in (1, 2, 3)], "first_hop"
    )


@query("circular_transfers")
def circular_transfers(spark, sf_dir):
    return paths.circular_transfers(edges(spark, sf_dir)).select(
        "originating_account", "intermediary_1", "intermediary_2", "init_amount", "return_amount",
        *[f"transaction_{i}" for i in (1, 2, 3)],
    )


@query("circular_counts")
def circular_counts(spark, sf_dir):
    counted = paths.circular_counts(edges(spark, sf_dir))
    return counted.withColumn("cycles", F.col("cycles").cast("bigint"))


@query("circular_6h")
def circular_6h(spark, sf_dir):
    """Every cycle whose transfers follow each other within six hours."""
    return paths.rapid_cycles(edges(spark, sf_dir), 6 * HOUR)


@query("smurfing_sinks")
def smurfing_sinks(spark, sf_dir):
    return graph.smurfing_sinks(edges(spark, sf_dir))


@query("smurfing_pairs")
def smurfing_pairs(spark, sf_dir):
    return graph.smurfing_pairs(edges(spark, sf_dir)).drop("currency")


@query("owner_risk")
def owner_risk(spark, sf_dir):
    g = txn_graph(spark, sf_dir)
    return graph.owner_risk(g.transfers, g.owns, g.entities).select(
        "sender", "transfer_amount", "receiving_account", "beneficiary"
    )


@query("subgraph_nodes")
def subgraph_nodes(spark, sf_dir):
    return subgraph.subgraph_nodes(findings(spark, sf_dir), txn_graph(spark, sf_dir).accounts)


@query("subgraph_links")
def subgraph_links(spark, sf_dir):
    return subgraph.subgraph_links(findings(spark, sf_dir))


@query("anomaly_summaries")
def anomaly_summaries(spark, sf_dir):
    return subgraph.anomaly_summaries(findings(spark, sf_dir)).drop("place", "row_no")


@query("graph_verdict")
def graph_verdict(spark, sf_dir):
    return subgraph.graph_verdict(findings(spark, sf_dir))


@query("anomaly_of_node")
def anomaly_of_node(spark, sf_dir):
    return subgraph.anomaly_of_node(findings(spark, sf_dir))


# Text -----------------------------------------------------------------------------------


def make_stub() -> text.Model:
    """Stand-in for a text model: answers with the prompt's length, and refuses prompts of
    users with near-threshold payments."""

    def model(prompts: list[str], **options) -> list[dict]:
        return [
            {"text": None, "status": "refused", "safety": "near threshold"}
            if not p.endswith("(Last 60m): 0")
            else {"text": str(len(p)), "status": "", "safety": None}
            for p in prompts
        ]

    return model


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = text.recommendation_prompts(multi_window(spark, sf_dir))
    made = text.generate_text(prompts, make_stub, max_output_tokens=256, temperature=0.3)
    return made.drop("prompt")


@query("recommendation_prompts")
def recommendation_prompts(spark, sf_dir):
    return text.recommendation_prompts(multi_window(spark, sf_dir))


@query("recommendation_prompts_1h")
def recommendation_prompts_1h(spark, sf_dir):
    return text.recommendation_prompts_1h(hourly(spark, sf_dir))


@query("transaction_prompts")
def transaction_prompts(spark, sf_dir):
    return text.transaction_prompts(transactions(spark, sf_dir)).drop("user_id")


@query("generate_text")
def generate_text(spark, sf_dir):
    return recommendations(spark, sf_dir)


@query("generate_text_once")
def generate_text_once(spark, sf_dir):
    """The same prompts through a table of answers, run twice: the second run sends none, and its
    model would answer otherwise."""
    prompts = text.recommendation_prompts(multi_window(spark, sf_dir))
    answers = f"{shared_folder(spark, 'answers')}/table"
    options = {"max_output_tokens": 256, "temperature": 0.3}
    for make in (make_stub, make_counting_stub):
        made = text.generate_text_once(prompts, make, answers, "stub", wave=100, **options)
    return made.drop("prompt")


@query("recent_recommendations")
def recent_recommendations(spark, sf_dir):
    made = recommendations(spark, sf_dir).withColumn("generated_at", F.lit(AS_OF))
    return reports.recent_recommendations(made)


@query("null_audit")
def null_audit(spark, sf_dir):
    return reports.null_audit(recommendations(spark, sf_dir))


@query("ideation_prompts")
def ideation_prompts(spark, sf_dir):
    described = table_descriptions(spark, sf_dir)
    return text.ideation_prompts(described.filter(F.col("table_name") == "raw_transactions"))


def make_counting_stub() -> text.Model:
    """Stand-in for a text model: answers with the prompt's length."""

    def model(prompts: list[str], **options) -> list[dict]:
        return [{"text": str(len(p)), "status": "", "safety": None} for p in prompts]

    return model


def feature_ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both wordings for every described table, sent to a model."""
    described = table_descriptions(spark, sf_dir)
    asked = text.ideation_prompts(described, W.IDEAS_STREAMING).unionByName(
        text.ideation_prompts(described, W.IDEAS_BATCH)
    )
    made = text.generate_text(asked, make_counting_stub, max_output_tokens=1024)
    return made.select("source_table", F.col("recommendation").alias("new_feature_ideas"))


@query("feature_ideation")
def feature_ideation(spark, sf_dir):
    return feature_ideas(spark, sf_dir)


@query("recent_ideas")
def recent_ideas(spark, sf_dir):
    made = feature_ideas(spark, sf_dir).withColumn("generated_at", F.lit(AS_OF))
    return reports.recent_ideas(made, None).drop("generated_at")


def make_graph_stub() -> text.Model:
    """Stand-in for a text model: a heading of the prompt's first word, and no summary."""

    def model(prompts: list[str], **options) -> list[dict]:
        return [{"text": json.dumps({"heading": p.split()[0]}), "status": "", "safety": None} for p in prompts]

    return model


@query("graph_inference")
def graph_inference(spark, sf_dir):
    """Findings, prompt, model, parsed reply; what the reply lacks comes from the verdict."""
    asked = subgraph.graph_prompt_and_verdict(findings(spark, sf_dir))
    both = text.generate_text(asked, make_graph_stub, tasks=1)
    parsed = replies.heading_and_summary(
        F.col("recommendation"), F.col("heading"), F.col("summary")
    )
    return both.select(parsed.alias("parsed")).select("parsed.*")


@query("grounded_prompt")
def grounded_prompt(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    measured = profile.column_profile(tx)
    columns = profile.column_metadata(tx, "raw_transactions").join(measured, "column_name")
    detail = F.format_string(
        "%s (%d nulls, %d distinct)", "data_type", "null_count", "distinct_count"
    )
    return text.grounded_prompt(
        columns.withColumn("data_type", detail), table_descriptions(spark, sf_dir)
    )


@query("response_text")
def response_text(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    part = F.struct(F.col("text").alias("text"))
    content = F.struct(F.struct(F.array(part).alias("parts")).alias("content"))
    response = F.to_json(F.struct(F.array(content).alias("candidates")))
    return documents.select(
        F.col("doc_id").alias("id"), replies.response_text(response).alias("text")
    )


@query("graph_inference_parse")
def graph_inference_parse(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    answer = F.to_json(F.struct(F.col("lang").alias("heading"), F.col("text").alias("summary")))
    fenced = documents.select(
        F.format_string("doc_%d", "doc_id").alias("id"),
        F.concat(F.lit("```json\n"), answer, F.lit("\n```")).alias("reply"),
    )
    free = turns.select(
        F.format_string("turn_%d_%d", "conv_id", "turn").alias("id"), F.col("text").alias("reply")
    )
    parsed = replies.heading_and_summary(
        F.col("reply"), F.lit(W.NOTHING_HEADING), F.lit(W.NOTHING_SUMMARY)
    )
    return fenced.unionByName(free).select("id", parsed.alias("parsed")).select("id", "parsed.*")


# Streaming ------------------------------------------------------------------------------


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of JSON messages, decoded again.

    The path is a pattern because a streaming source lists folders or patterns, while the
    table may be a single file.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = src.stream_table(spark, f"{sf_dir}/event[s].parquet", schema)
    return src.decode_messages(src.encode_messages(src.events_as_transactions(events)))


def _plain_time(df: DataFrame, *columns: str) -> DataFrame:
    names = columns or ("timestamp",)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in names})


def _run_append(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    folder = shared_folder(spark, name)
    sinks.finish(sinks.append_stream(df, f"{folder}/data", f"{folder}/checkpoint"))
    return spark.read.schema(df.schema).parquet(f"{folder}/data")


@query("stream_land_raw")
def stream_land_raw(spark, sf_dir):
    landed = _run_append(spark, src.landable(arriving(spark, sf_dir)), "stream_land_raw")
    return _plain_time(landed)


@query("stream_rejected")
def stream_rejected(spark, sf_dir):
    """Messages cut short on their way, every sixth one, kept in a sink of their own."""
    cut = F.substring(F.col("value").cast("string"), 1, 30).cast("binary")
    sent = src.encode_messages(arriving(spark, sf_dir), "country").select(
        F.when(F.col("country") == "AE", cut).otherwise(F.col("value")).alias("value")
    )
    return _run_append(spark, src.rejected_messages(sent), "stream_rejected")


@query("stream_alerts")
def stream_alerts(spark, sf_dir):
    alerts = live.alerts_stream(src.landable(arriving(spark, sf_dir)))
    return _run_append(spark, alerts, "stream_alerts").drop("timestamp")


def _land_messages(tx: DataFrame, folder: str, files: int, mode: str = "append") -> None:
    """Messages as ``files`` files or more, each with rows of all times."""
    lines = src.encode_messages(tx).select(F.col("value").cast("string"))
    lines.repartition(files).write.mode(mode).text(folder)


@query("stream_intraday_panes")
def stream_intraday_panes(spark, sf_dir):
    """Day totals that fire a pane per micro-batch, over eight files of mixed times in four
    batches: the last pane of each day, and whether its panes only grew."""
    folder = shared_folder(spark, "stream_intraday_panes")
    _land_messages(transactions(spark, sf_dir), f"{folder}/in", 8)
    messages = src.stream_message_files(spark, f"{folder}/in", files_per_batch=2)
    sinks.finish(
        sinks.start_intraday(
            src.accepted(src.decode_messages(messages)), f"{folder}/data", f"{folder}/checkpoint",
            delay="400 days", trigger=sinks.WHAT_IS_THERE,
        )
    )
    totals = ["intraday_tx_count", "intraday_total_spend"]
    panes = sinks.pane_changes(spark, f"{folder}/data", ["user_id", "day"], totals)
    last = panes.groupBy("user_id", "day").agg(
        *(F.max(F.when(F.col("is_last"), F.col(t))).alias(t) for t in totals),
        F.every(F.col("added_intraday_tx_count") > 0).alias("growing"),
    )
    return _plain_time(last, "day")


@query("stream_late_rows")
def stream_late_rows(spark, sf_dir):
    """All transactions, then one of each user sent again ten days before the first: the rows
    that were dropped as too late, by the table that the listener keeps, and those counted."""
    folder = shared_folder(spark, "stream_late_rows")
    tx = transactions(spark, sf_dir)
    start = tx.agg(F.min("timestamp").alias("start"))
    late = (
        tx.groupBy("user_id").agg(F.min("transaction_id").alias("transaction_id"))
        .join(tx.drop("user_id"), "transaction_id")
        .crossJoin(F.broadcast(start))
        .withColumn("timestamp", F.col("start") - F.expr("INTERVAL 10 DAYS"))
        .select(*tx.columns)
    )
    listener = LateRows(spark, f"{folder}/late")
    spark.streams.addListener(listener)
    try:
        for sent in (tx, late):
            _land_messages(sent, f"{folder}/in", 4)
            messages = src.stream_message_files(spark, f"{folder}/in")
            running = sinks.start_intraday(
                src.accepted(src.decode_messages(messages)), f"{folder}/data",
                f"{folder}/checkpoint", trigger=sinks.WHAT_IS_THERE,
            )
            listener.wait(running)
    finally:
        spark.streams.removeListener(listener)
    days = sinks.current_values(spark, f"{folder}/data", ["user_id", "day"])
    counted = days.agg(F.sum("intraday_tx_count").alias("counted"))
    dropped = listener.rows().agg(F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped"))
    return dropped.crossJoin(F.broadcast(counted))


@query("stream_score_synced")
def stream_score_synced(spark, sf_dir):
    """Even transactions arrive after the view's first sync (baselines only), odd ones after the
    second (today's totals too); each is scored with the newest sync of its batch."""
    folder = shared_folder(spark, "stream_score_synced")
    tx = transactions(spark, sf_dir)
    whole = user_features(spark, sf_dir)
    today = ["intraday_tx_count", "intraday_total_spend"]
    early = whole.withColumns({c: F.lit(0).cast(whole.schema[c].dataType) for c in today})
    odd = F.pmod(F.regexp_extract("transaction_id", r"(\d+)$", 1).cast("bigint"), F.lit(2))
    for sync, features in enumerate((early, whole)):
        sync_feature_view(features, f"{folder}/view", sync)
        _land_messages(tx.where(odd == sync), f"{folder}/in", 4)
        messages = src.stream_message_files(spark, f"{folder}/in", files_per_batch=2)
        sinks.finish(
            sinks.start_synced_scoring(
                src.accepted(src.decode_messages(messages)), f"{folder}/view", f"{folder}/data",
                f"{folder}/checkpoint", trigger=sinks.WHAT_IS_THERE,
            )
        )
    return spark.read.parquet(f"{folder}/data").drop("timestamp", "batch_id")


@query("stream_score")
def stream_score(spark, sf_dir):
    # the view is written once, so a micro-batch reads a small table and not the history
    view = sync_feature_view(user_features(spark, sf_dir), shared_folder(spark, "view"), 0)
    scored = live.score_stream(src.accepted(arriving(spark, sf_dir)), view)
    return _run_append(spark, scored, "stream_score").drop("timestamp")


@query("stream_sliding_15m")
def stream_sliding_15m(spark, sf_dir):
    """Windows closed by the watermark, an hour before the last row."""
    folder = shared_folder(spark, "stream_sliding_15m")
    return _windows(spark, src.accepted(arriving(spark, sf_dir)), folder, 15, bounded=False)


def _windows(spark: SparkSession, tx: DataFrame, folder: str, size: int, bounded: bool) -> DataFrame:
    """Windows of one size from a table of minute panes: all of a run that ends with markers
    (``bounded``), or those closed by the watermark."""
    source = sinks.start_panes(tx, f"{folder}/panes", f"{folder}/cp", trigger=sinks.WHAT_IS_THERE)
    sinks.finish(source)
    windows = sinks.start_windows(
        spark, f"{folder}/panes", folder, f"{folder}/cp", sinks.WHAT_IS_THERE, (size,),
        until=None if bounded else sinks.closed_until(source), as_runs=True,
    )
    sinks.finish(*windows.values())
    closed = sinks.read_windows(spark, folder, size)
    return _plain_time(closed.drop("last_updated"), "window_start", "window_end")


def _windows_of_panes(size: int) -> Query:
    """All windows of one size, those of the last hour too, from a table of minute panes."""

    def run(spark, sf_dir):
        name = f"stream_sliding_{size}m"
        folder = shared_folder(spark, name)
        tx = transactions(spark, sf_dir)
        _land_messages(tx, f"{folder}/in", 8)
        _land_messages(live.end_markers(tx), f"{folder}/in", 1)
        messages = src.accepted(src.decode_messages(src.stream_message_files(spark, f"{folder}/in")))
        return _windows(spark, messages, folder, size, bounded=True)

    return run


for _size in (30, 60):
    query(f"stream_sliding_{_size}m")(_windows_of_panes(_size))


def _intraday(spark: SparkSession, sf_dir: str, name: str) -> str:
    folder = shared_folder(spark, name)
    tx = src.accepted(arriving(spark, sf_dir))
    sinks.finish(
        sinks.start_intraday(
            tx, f"{folder}/data", f"{folder}/checkpoint", trigger=sinks.WHAT_IS_THERE
        )
    )
    return f"{folder}/data"


@query("stream_intraday")
def stream_intraday(spark, sf_dir):
    path = _intraday(spark, sf_dir, "stream_intraday")
    return _plain_time(sinks.current_values(spark, path, ["user_id", "day"]), "day")


@query("stream_intraday_upsert")
def stream_intraday_upsert(spark, sf_dir):
    path = _intraday(spark, sf_dir, "stream_intraday_upsert")
    return _plain_time(sinks.current_values(spark, path, ["user_id"], ("day",)), "day")


