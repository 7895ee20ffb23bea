"""Secret scans: patterns, and sliding-window entropy over candidate strings.

Only DataFrame functions are used. Nothing is shuffled: every text is scanned in its row.

Positions come from a text's pieces between matches: the start of a match is the length of all
pieces and matches before it. For each candidate (a run of letters, digits and the signs of
base64) the Shannon entropy of every window of ``WINDOW`` characters is kept by incremental
counts: a step adds the entering and removes the leaving character in a count per character of
the class, and the sum of n * log2(n) changes by the two counts alone. The largest entropy of a
window is held against the threshold of the candidate's character class. Words, samples and the
like between signs are taken out of a candidate before, so they neither hide nor make a secret.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns. In ``assign``, letters stand for either case.
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# A run that fails on length is passed over whole, so asking for the length finds the same.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_VALUE = 6
BASE = ("assign", "access", "hex")

#: Candidates of the entropy scan, and the signs that cut them into pieces.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
SIGNS = r"[-_/=+]"
WINDOW = 20
#: Character classes, the narrowest first, with pattern, alphabet and threshold in bits: about the
#: second percentile of a window of random characters (of base32 for the two with one case, as
#: 32 of their 36 characters are common alphabets too), so some 98 % of random windows pass.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CLASSES = (
    ("entropy_hex", r"^[0-9A-Fa-f]+$", DIGITS + "abcdefABCDEF", 2.94),
    ("entropy_lower", r"^[a-z0-9]+$", LOWER + DIGITS, 3.38),
    ("entropy_upper", r"^[A-Z0-9]+$", UPPER + DIGITS, 3.38),
    ("entropy_alnum", r"^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS, 3.66),
    ("entropy_base64", r"^[A-Za-z0-9+/_=-]+$", UPPER + LOWER + DIGITS + "+/_=-", 3.66),
)
#: Pieces that are no part of a secret: words of three letters or more, numbers of two to four
#: digits with at most one letter before them, samples, and letters or digits in order. A candidate
#: is judged without them.
ALLOW = (
    r"^(?:[A-Z]?[a-z]{2,}|[A-Z]{3,}|[A-Za-z]?[0-9]{2,4})$",
    r"(?i)example|sample|dummy|placeholder|changeme|x{6}",
    r"(?i)abcdefgh|0123456789|1234567890",
)
#: What is left must hold a digit.
NEEDED = r"[0-9]"
KINDS = (*BASE, *(c[0] for c in CLASSES))
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def spans(text: Column, pattern: str, kind: int, keep: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end, value) in code points.

    With ``keep``, the value is group 2 and matches with a shorter one are dropped."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if keep else matches
    empty = F.array().cast(SPAN)

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.length(F.get(acc["gaps"], i))
        end = start + F.length(F.get(acc["m"], i))
        value = F.get(acc["g"], i)
        span = F.struct(
            start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value")
        )
        longer = F.concat(acc["out"], F.array(span).cast(SPAN))
        if keep:
            longer = F.when(F.length(value) >= keep, longer).otherwise(acc["out"])
        return F.struct(end.alias("at"), longer.alias("out"), acc["m"].alias("m"), acc["g"].alias("g"), acc["gaps"].alias("gaps"))

    # the pieces ride in the state: outside of it they would be cut anew at every step
    start = F.struct(
        F.lit(0).alias("at"), empty.alias("out"), matches.alias("m"), values.alias("g"),
        F.split(text, pattern, -1).alias("gaps"),
    )
    n = F.regexp_count(text, F.lit(pattern))
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    whole = F.aggregate(steps, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), whole).otherwise(empty)


def window_entropy(value: Column, alphabet: str, window: int = WINDOW) -> Column:
    """Largest Shannon entropy in bits of a window of ``window`` characters of ``value``; 0 for
    shorter values."""
    weigh = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 2)))
    size = len(alphabet) + 1

    def number(i: Column) -> Column:
        return F.position(F.substr(value, i, F.lit(1)), F.lit(alphabet))

    def gain(n: Column) -> Column:
        return F.get(weigh, n + 1) - F.get(weigh, n)

    def step(acc: Column, i: Column) -> Column:
        enters, full = number(i), i > window
        leaves = F.when(full, number(i - window)).otherwise(F.lit(-1))
        before = F.get(acc["n"], enters)
        # the leaving character's count once the entering one is in
        after = F.get(acc["n"], leaves) + F.when(enters == leaves, 1).otherwise(0)
        total = acc["s"] + gain(before) - F.when(full, gain(after - 1)).otherwise(0.0)
        counts = F.transform(
            acc["n"],
            lambda n, k: n + F.when(k == enters, 1).otherwise(0) - F.when(k == leaves, 1).otherwise(0),
        )
        bits = F.lit(math.log2(window)) - total / window
        best = F.when(i >= window, F.greatest(acc["best"], bits)).otherwise(acc["best"])
        return F.struct(counts.alias("n"), total.alias("s"), best.alias("best"))

    zero = F.struct(
        F.array_repeat(F.lit(0), size).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best")
    )
    return F.aggregate(F.sequence(F.lit(1), F.length(value)), zero, step, lambda a: a["best"])


def judged(value: Column) -> Column:
    """``value`` without the pieces of the allow list, the rest joined by ``/``."""

    def open_(piece: Column) -> Column:
        allowed = piece.rlike(ALLOW[0])
        for pattern in ALLOW[1:]:
            allowed = allowed | piece.rlike(pattern)
        return ~allowed

    return F.array_join(F.filter(F.split(value, SIGNS, -1), open_), "/")


def _of_class(k: int):
    """Whether a judged candidate is of class ``k``, and of no narrower one."""

    def run(s: Column) -> Column:
        found = s["left"].rlike(CLASSES[k][1])
        for _, narrower, _, _ in CLASSES[:k]:
            found = found & ~s["left"].rlike(narrower)
        return found

    return run


def _mixed(alphabet: str, bits: float):
    return lambda s: window_entropy(s["left"], alphabet) >= F.lit(bits)


def _as_kind(kind: int):
    return lambda s: F.struct(
        s["span"]["start"].alias("start"), F.lit(kind).alias("kind"), s["span"]["end"].alias("end"),
        s["span"]["value"].alias("value"),
    )


def entropy_spans(text: Column) -> Column:
    """Candidates that have, without their allowed pieces, a digit and a window above the
    threshold of their character class. The span is the whole candidate."""
    empty = F.array().cast(SPAN)
    candidates = F.transform(
        spans(text, CANDIDATE, 0), lambda s: F.struct(s.alias("span"), judged(s["value"]).alias("left"))
    )
    candidates = F.filter(
        candidates, lambda s: (F.length(s["left"]) >= WINDOW) & s["left"].rlike(NEEDED)
    )
    found = []
    for k, (_, _, alphabet, bits) in enumerate(CLASSES):
        of_class = F.filter(candidates, _of_class(k))
        found.append(F.transform(F.filter(of_class, _mixed(alphabet, bits)), _as_kind(len(BASE) + k)))
    return F.when(text.rlike(CANDIDATE), F.concat(*found)).otherwise(empty)


def joined(found: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            found,
            lambda s: F.concat_ws(
                ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, base and all: sorted arrays of spans with their
    start, kind (number in ``KINDS``), end and value.

    A null or empty text has no spans. Rows that repeat are scanned each. Other columns are not
    read. Spans of the entropy scan may overlap base spans; base spans are never removed.
    """
    text = F.coalesce("text", F.lit(""))
    base = F.sort_array(
        F.concat(
            spans(text, ASSIGN, 0, keep=MIN_VALUE), spans(text, ACCESS, 1), spans(text, HEX, 2)
        )
    )
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), base.alias("base"), entropy_spans(text).alias("more")
    )
    return rows.select("doc_id", "base", F.sort_array(F.concat("base", "more")).alias("all"))


def secrets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""
    found = scan(docs)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{name}") for k, name in enumerate(BASE)),
        (F.size("all") - F.size("base")).cast("long").alias("n_entropy"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("all")).alias("spans"),
    )
