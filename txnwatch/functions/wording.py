"""Pattern names, report texts and prompt templates.

Templates are filled with ``format_string`` in the order of their %s marks.
"""

LAYERING = "Multi-Hop Layering"
CIRCULAR = "Circular Activity"
SMURFING = "Structuring & Smurfing"
OWNER = "UBO Risk Flag"

HEADINGS = {
    LAYERING: "Layering Sequence Detected",
    CIRCULAR: "Circular Asset Transfer",
    SMURFING: "Structuring into Sink Account",
    OWNER: "Hidden Beneficiary Match",
}

SUMMARIES = {
    LAYERING: (
        "A rapid 3-hop sequence detected originating from %s, concluding at %s. "
        "The structure aims to obfuscate tracing limits."
    ),
    CIRCULAR: (
        "Funds looped through intermediaries to return directly to %s. "
        "This topology indicates illicit commingling."
    ),
    SMURFING: (
        "Sub-threshold payments ($9,000-$10,000) are funnelled from %s to avoid AML triggers. "
        "Immediate CTR compliance review required."
    ),
    OWNER: (
        "A retail account sent funds to a shell corporation explicitly tied to %s "
        "via corporate ownership lines."
    ),
}

NETWORK_HEADING = "GQL: Syndicate Network Flagged"
ALERT_HEADING = "GQL: Layering & Structuring Alert"
VERDICT_SUMMARY = (
    "Detected %s isolated entities engaging in %s suspicious transfers matching deep-graph "
    "signatures (Structuring, Layering, Circular Activity). Confirmed actors include %s. "
    "Freezing workflows initiated."
)
NOTHING_HEADING = "No Anomalies Found"
NOTHING_SUMMARY = (
    "The graph engine did not detect any structural anomalies matching the layering topology "
    "logic in this time window."
)

# Own wording from here to the next mark: these go to a model only.
GRAPH_PROMPT = """A transfer graph was searched for known laundering patterns.
Accounts found: %s
Transfers between them: %s

Name the threat in one line and describe what happened in at most two sentences, using the \
accounts and transfers above. Answer with this JSON object and nothing else:
{"heading": "text", "summary": "text"}
"""

# Prompts whose text is itself an output.
ADVICE_INTRO = (
    "You are a financial advisor AI for an AML compliance platform. "
    "Based on the following real-time spending patterns, provide: "
    "1) A risk assessment (LOW/MEDIUM/HIGH) with reasoning, "
    "2) A personalized savings tip or product recommendation, "
)

RECOMMENDATION = ADVICE_INTRO + """3) Any AML red flags (e.g., sudden velocity spikes).

User: %s
--- Recent Activity (Last 15m) ---
Tx Count: %s
Total Spend: £%s
Max Tx: £%s
--- Medium Term (Last 30m) ---
Tx Count: %s
Total Spend: £%s
--- Long Term (Last 60m) ---
Tx Count: %s
Total Spend: £%s
Avg Tx: £%s
Distinct Merchants: %s
Distinct Countries: %s
--- AML Indicators ---
Near-Threshold Transactions (Last 60m): %s"""

RECOMMENDATION_1H = ADVICE_INTRO + """3) Any AML red flags if applicable.

User: %s
Transactions in last hour: %s
Total spend in last hour: £%s
Average transaction: £%s
Distinct merchants: %s
Distinct countries: %s
Max single transaction: £%s"""

TRANSACTION = """Evaluate this single transaction for immediate anomalies (Stateless Scan):
Amount: £%s
Merchant: %s
Country: %s"""

# Own wording from here on: these go to a model only.
IDEAS_STREAMING = """Propose five to seven features that a live transaction monitor does not \
have yet. They should help to find fraud, money laundering, or users who are about to leave.
Give for each: a name, the SQL that computes it, and what it would reveal.

Table: %s
What it holds: %s
Its columns: transaction_id, user_id, amount, timestamp, merchant, category, currency, country
Known features, over sliding windows of 15, 30 and 60 minutes: count, total, mean and largest \
amount.

Worth considering: how the short windows compare with the long one, hours of the day, amounts \
kept below a reporting limit, accounts that wake up, payments that cross borders one after \
another, and users unlike their peers."""

IDEAS_BATCH = """Propose five to seven features for this table that would help to find fraud and \
money laundering. Give for each: a name, the SQL that computes it, and what it would reveal.

Table: %s
What it holds: %s
Its columns: transaction_id, user_id, amount, timestamp, merchant, category, currency, country
Known features over one hour: tx_count_1h, total_spend_1h, avg_amount_1h, max_amount_1h, \
distinct_merchants_1h, distinct_countries_1h

Worth considering: hours of the day, changes of pace, round amounts, amounts kept below a \
reporting limit, accounts that wake up, and payments that cross borders one after another."""

GROUNDED = """These are all tables of a system that watches payments as they arrive.

Columns:
%s

Tables:
%s

Using only them, write three SQL queries that could run all the time and would find money \
laundering that the system misses now. Name the laundering method each is aimed at."""
