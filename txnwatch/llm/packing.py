"""Best-fit packing of token sequences by a configuration linear program.

A configuration is a multiset of lengths that fits one sequence. The program asks for the fewest
sequences whose configurations cover the length histogram (at most ``capacity`` numbers, whatever
the corpus). It is solved by multiplicative weights: every length has a price, its length times
exp(-RATE * share covered so far); a knapsack dynamic program over the capacity prices the best
configuration; random walks back through its table draw WALKS configurations of nearly that
price, which are added so that no length is covered more than once per round, and prices fall by
what was covered. The dual bound (total price over the best configuration's price) is a number
of sequences below which there is no packing.

Rounding: whole multiples of the configurations are taken as far as the histogram allows, those
of the longest pieces first; of several limits from which a fraction counts as once (LEAST), that
with the fewest sequences is kept. Lengths up to a 64th of the capacity stay out of the
program; they and all that is left go to the fullest sequences with room for them, longest first.
Every step handles a configuration with its multiplicity, so the work on the driver depends on
the number of different lengths and not on the number of documents.

Documents are then dealt in parallel: a piece's rank among those of its length (its place in its
partition plus the partitions before) tells its configuration, sequence and offset.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.llm.tables import fresh, kept

CAPACITY, END = 4096, 1
RATE, NEAR, ROUNDS, WALKS, LEAST = 0.1, 0.01, 80, 48, (0.0, 0.1, 0.5, 1.0)
#: Bytes encoded at a time; words a task remembers, and the longest of them in bytes.
SLAB, MAX_WORDS, MAX_WORD = 1 << 20, 500_000, 64
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Marks at the end of a word. Words of Latin letters before them take a shorter way if these
#: probes show that the tokenizer lower-cases, cuts marks off and then encodes bytes.
MARKS = ".,;:!?"
PROBES = ("ab", "Ab", "ABC.", "é", "Éa,", "ß", "über?!", "ñandú...", "ÿ", "µª", "they;", "I", "s", "t:")


class Words(dict):
    """Ids of words as little-endian 32-bit numbers, looked up after the first time."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.bytewise = tokenizer, _byte_letters()
        self.simple = True
        self.simple = all(self[w.encode()] == self._encoded(w) for w in PROBES)
        self.clear()

    def _encoded(self, text: str) -> bytes:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return struct.pack(f"<{len(found)}I", *found)

    def _spelt(self, letters: str) -> bytes:
        """A word of lower-case letters goes to the tokenizer's model as it is."""
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self.bytewise)
        found = [t.id for t in self.tokenizer.model.tokenize(letters)]
        return struct.pack(f"<{len(found)}I", *found)

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > MAX_WORD:
            return self._encoded(word.decode("utf-8", "replace"))
        if len(self) > MAX_WORDS:  # memory is bounded whatever the vocabulary
            self.clear()
        text = word.decode("utf-8", "replace")
        letters = text.rstrip(MARKS)
        if not (self.simple and letters.isalpha() and (letters.isascii() or max(letters) < "\u0100")):
            ids = self._encoded(text)
        elif letters == text:
            small = letters.lower()
            ids = self._spelt(small) if small == letters else self[small.encode()]
        else:
            ids = self[letters.encode()] + self[text[len(letters) :].encode()]
        self[word] = ids
        return ids


def _byte_letters() -> dict[int, int]:
    """Letters that byte-level vocabularies write bytes as: printable ones stay, others follow
    from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


class TokenIds:
    """Ids of texts. Tokens never span ASCII white space, so words are looked up."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.words = Words(Tokenizer.from_str(tokenizer_json))
        if self.words._encoded("a b") != self.words._encoded("a") + self.words._encoded("b"):
            raise ValueError("the tokenizer's tokens depend on white space")

    def of(self, raw: bytes) -> Iterator[bytes]:
        """The ids of a text, slab by slab."""
        start = 0
        while start < len(raw):
            cut = SPACE.search(raw, start + SLAB)
            stop = cut.start() if cut else len(raw)
            yield b"".join(map(self.words.__getitem__, raw[start:stop].split()))
            start = stop


def pieces(
    docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end: int = END
) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every row of ``docs`` (doc_id, text, anything else).

    A document is its ids followed by ``end``; only a longer one than ``capacity`` is cut, into
    pieces of that many ids and a last one of what is left. ``ids`` are little-endian unsigned
    32-bit numbers. A null or empty text is the one id ``end``. Rows with null or repeated ids
    are documents of their own. Very long texts are encoded and cut a megabyte at a time.
    """
    tokenizer = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    names = ["doc_id", "piece", "start", "length", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, size = TokenIds(tokenizer.value), 4 * capacity
        tail, rows, held = np.array([end], "<u4").tobytes(), [], 0

        def cuts(raw: bytes) -> Iterator[bytes]:
            waiting = b""
            for part in encoder.of(raw):
                waiting += part
                while len(waiting) > size:
                    yield waiting[:size]
                    waiting = waiting[size:]
            waiting += tail
            yield waiting[:size]
            if len(waiting) > size:
                yield waiting[size:]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for k, doc_id in enumerate(ids):
                start = 0
                for number, piece in enumerate(cuts(texts[k].as_py() or b"")):
                    rows.append((doc_id, number, start, len(piece) // 4, piece))
                    start, held = start + len(piece) // 4, held + len(piece)
                    if held > 8 * SLAB:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)

    schema = "doc_id long, piece int, start long, length long, ids binary"
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return read.mapInArrow(run, schema)


def _worth(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """Highest price of a configuration for every capacity up to ``capacity``."""
    best = np.zeros(capacity + 1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(int(lengths[0]), capacity + 1):
        k = upto[c]
        best[c] = max(best[c - 1], (prices[:k] + best[c - lengths[:k]]).max())
    return best


def _walks(lengths, demand, prices, best, capacity, rng) -> np.ndarray:
    """Random configurations of nearly the best price, as counts (walk, length); none has more
    of a length than there is."""
    counts = np.zeros((WALKS, len(lengths)), np.int32)
    room, going = np.full(WALKS, capacity), np.arange(WALKS)
    while len(going):
        left = room[going, None] - lengths[None, :]
        may = (left >= 0) & (counts[going] < demand[None, :])
        value = np.where(may, prices[None, :] + best[np.maximum(left, 0)], -1.0)
        goal = np.minimum(best[room[going]] * (1 - NEAR), value.max(axis=1))
        # long mates first, as short ones fit anywhere later
        near = np.where(may & (value >= goal[:, None]), rng.random(value.shape) * lengths, -1.0)
        chosen = near.argmax(axis=1)
        some = may.any(axis=1)
        going, chosen = going[some], chosen[some]
        counts[going, chosen] += 1
        room[going] -= lengths[chosen]
    return counts


def configurations(
    lengths: np.ndarray, demand: np.ndarray, capacity: int, rng: np.random.Generator
) -> tuple[list[tuple[np.ndarray, np.ndarray, float]], float]:
    """Fractional solution as (places of lengths, counts, amount), and the dual bound."""
    prices, covered = lengths.astype(float), np.zeros(len(lengths))
    amounts: dict[bytes, float] = {}
    bound = 0.0
    for _ in range(ROUNDS):
        best = _worth(lengths, prices, capacity)
        bound = max(bound, float((demand * prices).sum() / best[-1]))
        drawn = _walks(lengths, demand, prices, best, capacity, rng)
        steps = np.where(drawn > 0, demand / np.maximum(drawn, 1), np.inf).min(axis=1)
        gain = (steps[:, None] * drawn).sum(axis=0) / demand
        steps, gain = steps / gain.max(), gain / gain.max()
        covered += gain
        for counts, step in zip(drawn, steps):
            at = np.flatnonzero(counts)
            key = np.stack([at, counts[at]]).astype(np.int32).tobytes()
            amounts[key] = amounts.get(key, 0.0) + float(step)
        prices = lengths * np.exp(-RATE * covered)
        prices *= len(lengths) / prices.sum()
    scale = bound / sum(amounts.values())
    solution = []
    for key, amount in amounts.items():
        at, counts = np.frombuffer(key, np.int32).reshape(2, -1)
        solution.append((at, counts, amount * scale))
    return solution, bound


class Groups:
    """Sequences of equal content, found by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: list[list[tuple[dict[int, int], int]]] = [[] for _ in range(capacity + 1)]

    def add(self, content: dict[int, int], times: int) -> None:
        if times:
            room = self.capacity - sum(size * n for size, n in content.items())
            self.by_room[room].append((content, times))

    def place(self, size: int, number: int) -> None:
        """Put ``number`` pieces where the least room is left, the rest in new sequences."""
        room = size
        while number and room <= self.capacity:
            if not self.by_room[room]:
                room += 1
                continue
            content, times = self.by_room[room].pop()
            number = self._fill(content, times, size, number, room // size)
        if number:
            per = self.capacity // size
            self._fill({}, -(-number // per), size, number, per)

    def _fill(self, content, times: int, size: int, number: int, per: int) -> int:
        full = min(times, number // per)
        self.add({**content, size: per}, full)
        number, times = number - full * per, times - full
        if times and number:
            self.add({**content, size: number}, 1)
            number, times = 0, times - 1
        self.add(content, times)
        return number

    def all(self) -> list[tuple[dict[int, int], int]]:
        return [group for groups in self.by_room for group in groups]


def plan(
    histogram: dict[int, int], capacity: int = CAPACITY, seed: int = 11
) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Configurations with how many sequences have each (numbers of pieces by length), which
    hold ``histogram`` exactly; and a number of sequences below which there is no packing."""
    if histogram and not 0 < min(histogram) <= max(histogram) <= capacity:
        raise ValueError("lengths must lie between 1 and the capacity")
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[int(x)] for x in lengths], np.int64)
    fewest = -(-sum(size * n for size, n in histogram.items()) // capacity)
    solution, long_ones = [], np.flatnonzero(lengths > capacity // 64)
    if int((lengths[long_ones] * demand[long_ones]).sum()) > capacity:
        solution, bound = configurations(
            lengths[long_ones], demand[long_ones], capacity, np.random.default_rng(seed)
        )
        fewest = max(fewest, int(np.ceil(bound - 1e-6 * bound)))
        solution = [(long_ones[at], counts, amount) for at, counts, amount in solution]
    rounded = [_rounded(lengths, demand, solution, least, capacity) for least in LEAST]
    return min(rounded, key=lambda groups: sum(times for _, times in groups)), fewest


def _rounded(lengths, demand, solution, least: float, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole multiples of the solution's configurations, those from ``least`` on once at least;
    the rest by best fit."""
    left, groups = demand.copy(), Groups(capacity)
    # the longest pieces have the fewest configurations; of those the simplest go first
    for at, counts, amount in sorted(
        solution, key=lambda s: (-s[0][-1], s[1].sum(), -s[2], s[0].tobytes())
    ):
        whole = max(int(amount >= least), int(amount))
        times = int(min((left[at] // counts).min(), whole))
        if times:
            left[at] -= times * counts
            groups.add({int(lengths[i]): int(n) for i, n in zip(at, counts)}, times)
    for i in reversed(np.flatnonzero(left)):
        groups.place(int(lengths[i]), int(left[i]))
    return groups.all()


class Dealer:
    """Sequence and offset of the piece with a rank among those of its length."""

    def __init__(self, groups: Sequence[tuple[dict[int, int], int]]):
        rows, base = [], 0
        for content, times in groups:
            offset = 0
            for size, per in sorted(content.items(), reverse=True):
                rows.append((size, base, times, per, offset))
                offset += size * per
            base += times
        rows.sort(key=lambda r: r[:2])
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.size, self.base, times, self.per, self.offset = table.T
        held = np.cumsum(times * self.per) - times * self.per
        first = np.searchsorted(self.size, self.size)
        self.before = held - held[first]
        self.keys = (self.size << 44) | self.before

    def deal(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.keys, (length << 44) | rank, "right") - 1
        nth = rank - self.before[row]
        per = self.per[row]
        return self.base[row] + nth // per, self.offset[row] + nth % per * self.size[row]


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (length: bigint, anything else) with sequence_id and offset.

    Each sequence holds at most ``capacity``; offsets in it run on from 0 without gaps. Rows that
    repeat are packed one by one. Rows whose length is null or zero take no place and get nulls;
    a length over the capacity or below zero raises. An empty table gives an empty result. If
    ``parts`` has a column sequence_id or offset, the new one's name has underscores behind it.
    """
    names = parts.columns
    part, at, nth, size, before = (fresh(f"_{n}", parts) for n in ("part", "at", "nth", "size", "before"))
    sequence, offset = fresh("sequence_id", parts), fresh("offset", parts)
    whole = fresh("_row", parts)
    stored = kept(
        parts.select(
            F.struct(*(F.col(f"`{c}`") for c in names)).alias(whole),
            F.coalesce(F.col("length").cast("long"), F.lit(0)).alias(size),
            F.spark_partition_id().alias(part),
            F.monotonically_increasing_id().alias(at),
        ),
        "pack-pieces",
    )
    counts = kept(stored.groupBy(part, size).agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy(size).agg(F.sum("n")).collect() if r[0]}
    dealer = Dealer(plan(histogram, capacity)[0])
    earlier = Window.partitionBy(size).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        part, size, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before)
    )
    inside = Window.partitionBy(part, size).orderBy(at)
    ranked = (
        stored.withColumn(nth, F.row_number().over(inside))
        .join(starts, [part, size])
        .select(whole, size, (F.col(before) + F.col(nth) - 1).alias(nth))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (1, 2))
            some = length > 0
            both = [np.zeros(len(length), np.int64) for _ in range(2)]
            if some.any():
                both[0][some], both[1][some] = dealer.deal(length[some], rank[some])
            columns = [batch.column(0), *(pa.array(c, pa.int64(), mask=~some) for c in both)]
            yield pa.RecordBatch.from_arrays(columns, [whole, sequence, offset])

    schema = ranked.select(
        whole, F.lit(None).cast("long").alias(sequence), F.lit(None).cast("long").alias(offset)
    ).schema
    return ranked.mapInArrow(run, schema).select(f"{whole}.*", sequence, offset)
