"""Benchmark decontamination by template windows.

Words are canonicalised to templates: numbers, units and names become typed placeholders, other
words lose their case and outer punctuation. A name is a capitalised word, not all in capitals, that
does not start a sentence, in a text that does not capitalise most of its words. Windows of ``window`` template words are hashed and
hash-joined between documents and benchmark items, so a question whose numbers or names were
changed still meets its original. Windows with few literal words, and whole texts of fewer than
``SHORTEST`` words, are hashed as their words stand. A hit counts only if its slots are consistent: within
the window, and over all windows of the item that lie at the same distance from their place in the
document, equal benchmark values stand for equal document values and different ones for different
ones. A window whose words all stand as in the item always counts. Hits are counted per part of a
document, so pieces scattered over a long text don't add up.

Documents are read in Arrow batches and whole; a word is canonicalised once per task. Windows
whose hash no benchmark item has are dropped where they are made, if the benchmark's windows are
counted to be at most ``max_filter`` (8 bytes each); a larger benchmark is joined without that
filter, with the same result. Verdicts depend on the text alone and are keyed by its hash, so
copies are judged once and rows with null or repeated ids are treated like all others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.llm.tables import checked, kept

WINDOW, SHORTEST, MIN_LITERAL, MIN_SHARE = 8, 5, 4, 0.3
#: Hits of an item belong to one part of a document while their distances from the item's places
#: differ by at most this many words from one to the next.
GAP = 8
#: Consecutive windows that tell whatever the item's length: 13 copied words.
MIN_RUN = 6
#: Units of measure and money.
UNITS = frozenset(
    "mm cm km ft yd mi mg kg lb oz ml gal sec min hr hrs ms hz khz mhz ghz kw mw kj cal kcal pa "
    "kpa bar percent % $ € £ usd eur gbp cents dollars euros pounds meters metres kilometers "
    "kilometres miles feet inches grams kilograms liters litres seconds minutes hours days weeks "
    "months years".split()
)
#: A number, perhaps with a sign of money before it or a unit of any short name behind it.
NUMBER = re.compile(r"[$€£]?[+-]?\d+(?:[.,:/]\d+)*(?:%|[a-z€£$]{1,4})?", re.IGNORECASE)
EDGES = "\"'()[]{}<>.,;:!?…“”‘’«»*_`"
LITERAL, NUM, UNIT, NAME = range(4)
CHUNK = 1 << 21
HIT = "text_key long, window_hash long, place int, slots array<long>"


class Words(dict):
    """Numbers words; numpy tables hold what is known of each."""

    def __init__(self):
        super().__init__()
        self.value = np.empty(1 << 14, np.uint64)
        self.kind = np.empty(1 << 14, np.uint8)
        self.capital = np.empty(1 << 14, bool)
        self.ends = np.empty(1 << 14, bool)

    def __missing__(self, raw: bytes) -> int:
        i = len(self)
        if i == len(self.value):
            for name in ("value", "kind", "capital", "ends"):
                setattr(self, name, np.resize(getattr(self, name), 2 * i))
        word = raw.decode("utf-8", "replace")
        bare = word.strip(EDGES)
        low = bare.lower()
        self.value[i] = xxhash.xxh64_intdigest(low.encode())
        self.kind[i] = NUM if NUMBER.fullmatch(bare) else UNIT if low in UNITS else LITERAL
        self.capital[i] = bare[:1].isupper() and not (bare.isupper() and len(bare) > 1)
        self.ends[i] = not bare or word.rstrip("\"')]}”’»")[-1:] in (".", "!", "?", ":", "…")
        self[raw] = i
        return i


class Windows:
    """Template windows of texts, many at a time."""

    def __init__(self, lengths: list[int], known: np.ndarray | None):
        rng = np.random.default_rng(6)
        self.factors = rng.integers(0, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.kinds = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
        self.lengths, self.known, self.words = lengths, known, Words()
        self.exact = rng.integers(0, 1 << 63, dtype=np.uint64)
        if known is not None:
            self.bits = np.zeros(1 << 22, bool)
            self.bits[known >> np.uint64(42)] = True

    def _is_known(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return self.known[at] == hashes

    def of(
        self, texts: list[bytes], names: bool = True
    ) -> Iterator[tuple[int, int, int, list[int]]]:
        """(number of the text, window hash, its place, slot values with 0 for literal words).
        Without ``names``, all names are literal words."""
        if len(self.words) > 1_000_000:  # memory is bounded whatever the vocabulary
            self.words = Words()
        split = [t.split() for t in texts]
        sizes = [len(s) for s in split]
        n = sum(sizes)
        if not n:
            return
        get = self.words.__getitem__
        ids = np.fromiter((get(w) for s in split for w in s), np.int64, n)
        owner = np.repeat(np.arange(len(texts)), sizes)
        starts = np.cumsum(sizes) - sizes
        kind, ends = self.words.kind[ids], self.words.ends[ids]
        opens = np.ones(n, bool)
        opens[1:] = ends[:-1] | (owner[1:] != owner[:-1])
        capital = self.words.capital[ids]
        # where most words are capitalised, that tells no names
        titles = 2 * np.bincount(owner, capital, len(texts)) > np.array(sizes)
        kind[(kind == LITERAL) & capital & ~opens & ~titles[owner] & names] = NAME
        value = self.words.value[ids]
        literal = kind == LITERAL
        template = np.where(literal, value, self.kinds[kind])
        slot = np.where(literal, np.uint64(0), (value ^ self.kinds[kind]) | np.uint64(1))
        before = np.concatenate([[0], np.cumsum(literal)])
        for i in (i for i, size in enumerate(sizes) if 0 < size < SHORTEST):
            whole = value[starts[i] : starts[i] + sizes[i]].tobytes()
            key = xxhash.xxh64_intdigest(whole, seed=sizes[i])
            if self.known is None or self._is_known(np.array([key], np.uint64))[0]:
                yield i, key, 0, [0] * sizes[i]
        for length in self.lengths:
            m = n - length + 1
            if m <= 0:
                continue
            sums = np.full(m, np.uint64(length))
            for k in range(length):
                sums += template[k : k + m] * self.factors[k]
            sums ^= sums >> np.uint64(29)
            sums *= self.factors[0]
            dense = before[length:] - before[:m] < MIN_LITERAL
            at = np.flatnonzero(dense)
            exact = np.full(len(at), np.uint64(length) ^ self.exact)
            for k in range(length):
                exact += value[at + k] * self.factors[k]
            exact ^= exact >> np.uint64(29)
            sums[at] = exact * self.factors[1]
            if self.known is None:
                at = np.arange(m)
            else:
                at = np.flatnonzero(self.bits[sums >> np.uint64(42)])
                at = at[self._is_known(sums[at])]
            at = at[owner[at] == owner[at + length - 1]]
            for i in at:
                place = int(i - starts[owner[i]])
                slots = [0] * length if dense[i] else slot[i : i + length].view(np.int64).tolist()
                yield int(owner[i]), int(sums[i]), place, slots


def _hits(lengths: list[int], known: np.ndarray | None, whole: bool = False):
    """Arrow function: (key, text) to distinct windows with their places. ``whole``, for
    benchmark items: again without names, for texts in capitals; an item of fewer than WINDOW
    words is one window of its own length, others have none of less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(lengths, known)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            start = 0
            while start < len(keys):
                chunk, held = [], 0
                while start + len(chunk) < len(keys) and held < CHUNK:
                    chunk.append(texts[start + len(chunk)].as_py() or b"")
                    held += len(chunk[-1])
                found = set()
                sizes = [len(t.split()) for t in chunk] if whole else None
                for names in (True, False) if whole else (True,):
                    for i, window, place, slots in windows.of(chunk, names):
                        if not whole or len(slots) == min(WINDOW, sizes[i]):
                            found.add((keys[start + i], _signed(window), place, tuple(slots)))
                start += len(chunk)
                if found:
                    key, window, place, slots = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key, pa.int64()),
                            pa.array(window, pa.int64()),
                            pa.array(place, pa.int32()),
                            pa.array(slots, pa.list_(pa.int64())),
                        ],
                        ["text_key", "window_hash", "place", "slots"],
                    )

    return run


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def text_key() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Windows of (item_id, text): window_hash, place, slots, item_id, windows (of the item)."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary"))
    lengths = list(range(SHORTEST, WINDOW + 1))
    found = items.mapInArrow(_hits(lengths, None, whole=True), HIT).withColumnRenamed(
        "text_key", "item_id"
    )
    found = found.distinct()
    sizes = found.groupBy("item_id").agg(F.count_distinct("place").alias("windows"))
    joined = found.join(
        sizes.withColumnRenamed("item_id", "_item"), F.col("item_id").eqNullSafe(F.col("_item"))
    )
    return joined.drop("_item")


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    min_share: float = MIN_SHARE,
    max_filter: int = 4_000_000,
    min_run: int = MIN_RUN,
) -> DataFrame:
    """(text_key, item_id, hits, windows) of texts holding at least ``min_share`` of the
    windows of an item in one part, or ``min_run`` consecutive ones, with consistent slots."""
    asked = kept(benchmark_windows(benchmark), "benchmark-windows")
    distinct = asked.select("window_hash", F.size("slots").alias("length")).distinct()
    n = distinct.count()
    known = None
    lengths = list(range(SHORTEST, WINDOW + 1))
    if n <= max_filter:
        rows = distinct.toPandas()
        known = np.unique(rows["window_hash"].to_numpy(np.int64).view(np.uint64))
        lengths = sorted({int(x) for x in rows["length"] if x >= SHORTEST})
    hits = docs.select(text_key(), F.col("text").cast("binary")).mapInArrow(
        _hits(lengths, known), HIT
    )
    pair = hits.withColumnRenamed("place", "at").join(
        asked.withColumnRenamed("slots", "asked"), "window_hash"
    )
    slots = F.array_distinct(F.filter(F.arrays_zip("asked", "slots"), lambda x: x["asked"] != 0))
    aligned = pair.where(F.size("slots") == F.size("asked")).select(
        *("text_key", "item_id", "windows", "place", (F.col("at") - F.col("place")).alias("shift")),
        slots.alias("pairs"),
    )
    found = kept(_in_parts(_consistent(aligned.distinct())), "benchmark-hits")
    keys = ["text_key", "item_id", "windows"]
    parts = found.groupBy(*keys, "part").agg(F.count_distinct("place").alias("hits"))
    hits = parts.groupBy(*keys).agg(F.max("hits").alias("hits"))
    # a run of windows is whole if each of its windows is a hit at the same shift
    starts = F.explode(F.sequence(F.col("place") - F.lit(min_run - 1), F.col("place")))
    runs = (
        found.where(F.col("windows") >= min_run)
        .select("text_key", "item_id", "shift", starts.alias("start"))
        .groupBy("text_key", "item_id", "shift", "start")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") == min_run)
        .select(F.col("text_key").alias("_key"), F.col("item_id").alias("_item"))
        .distinct()
    )
    joined = hits.join(
        runs, (F.col("text_key") == F.col("_key")) & F.col("item_id").eqNullSafe(F.col("_item")), "left"
    )
    enough = F.col("hits") >= F.ceil(F.col("windows") * F.lit(min_share))
    return joined.where(enough | F.col("_key").isNotNull()).select(*keys[:2], "hits", "windows")


def _consistent(aligned: DataFrame) -> DataFrame:
    """Windows without slots that contradict others of the same text, item and shift, as
    (text_key, item_id, windows, place, shift). Verbatim windows always stay."""
    group = ["text_key", "item_id", "shift"]
    pairs = aligned.repartition("text_key", "item_id").select(
        *group, "windows", "place", "pairs", F.explode_outer("pairs").alias("pair")
    )
    pairs = pairs.select(
        *group, "windows", "place", "pairs",
        F.col("pair.asked").alias("asked"), F.col("pair.slots").alias("slot"),
    )
    of_asked, of_slot = Window.partitionBy(*group, "asked"), Window.partitionBy(*group, "slot")
    clash = (F.min("slot").over(of_asked) != F.max("slot").over(of_asked)) | (
        F.min("asked").over(of_slot) != F.max("asked").over(of_slot)
    )
    other = F.coalesce(F.col("asked") != F.col("slot"), F.lit(False))
    return (
        pairs.withColumn("clash", F.coalesce(clash, F.lit(False)))
        .groupBy(*group, "windows", "place", "pairs")
        .agg(F.max("clash").alias("clash"), F.max(other).alias("other"))
        .where("NOT (clash AND other)")
        .select("text_key", "item_id", "windows", "place", "shift")
        .distinct()
    )


def _in_parts(found: DataFrame) -> DataFrame:
    """``found`` with the part of the document, numbered per text and item along the shifts."""
    along = Window.partitionBy("text_key", "item_id").orderBy("shift")
    apart = F.col("shift") - F.lag("shift").over(along) > GAP
    new = found.withColumn("_new", F.coalesce(apart.cast("int"), F.lit(0)))
    running = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # rows of equal shifts have no gap between them, so their order doesn't matter
    return new.withColumn("part", F.sum("_new").over(running)).drop("_new")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, contaminated, n_items (benchmark
    items found in it), item_id (that with most windows found, then the smallest), hits and
    windows (of that item).

    Null and empty texts match nothing. An item of fewer than 5 words is found in texts that are
    just its words, and windows with fewer than 4 literal words only as they stand. Items that repeat an item_id count
    as one; a null item_id is an item of its own. An empty documents or benchmark table gives
    no matches.
    """
    best = (
        matches(docs, benchmark, **options)
        .groupBy("text_key")
        .agg(
            F.count("*").alias("n_items"),
            F.max_by(F.struct("item_id", "hits", "windows"), F.struct("hits", -F.col("item_id"))).alias("best"),
        )
        .select(F.col("text_key").alias("_key"), "n_items", "best")
    )
    best = checked(best, "contaminated")
    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("_text_key"))
    return rows.join(best, rows["_text_key"] == best["_key"], "left").select(
        "doc_id",
        F.col("_key").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        "best.item_id",
        "best.hits",
        "best.windows",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found, unchanged."""
    found = matches(docs, benchmark, **options).select(F.col("text_key").alias("_key")).distinct()
    found = checked(found, "contaminated-texts")
    return docs.join(found, text_key() == found["_key"], "left_anti").select(
        *(docs[f"`{c}`"] for c in docs.columns)
    )
