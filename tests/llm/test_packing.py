from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from txnwatch.llm import packing
from txnwatch.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for size in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= size]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= size
        else:
            rooms.append(capacity - size)
    return len(rooms)


def checked(rows, capacity):
    """Sequences are full to their end, without gaps or overlaps."""
    held = defaultdict(list)
    for length, sequence, offset in rows:
        held[sequence].append((offset, length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_query_equals_the_tokenizer(spark, small):
    want = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        own = ids(r.text)
        for piece, start in enumerate(range(0, len(own), 4096)):
            part = own[start : start + 4096]
            want[r.doc_id, piece] = (start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    got = QUERIES["op11_packing"](spark, small).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    assert len(got) == len(want)
    n = checked([(r.length, r.sequence_id, r.offset) for r in got], 4096)
    assert n == -(-sum(length for _, length, _ in want.values()) // 4096)


@pytest.mark.parametrize("text", [
    None, "", " \n\t ", "It's DON'T we're", "a\x1cb\x85c x　y ́a", "İstanbul ǅ ΣΑΣ",
    "12345 6a7 <|endoftext|> z", "a\x00b", "x" * 5000, " ".join(["word"] * 9000), "áb á " * 40,
])
def test_pieces_of_odd_texts(spark, text, monkeypatch):
    docs = spark.createDataFrame([(5, text)], "doc_id long, text string")
    found = packing.pieces(docs, open(PATH).read(), capacity=64).orderBy("piece").collect()
    whole = b"".join(r.ids for r in found)
    assert np.frombuffer(whole, "<u4").tolist() == ids(text)
    assert [r.start for r in found] == list(range(0, len(whole) // 4, 64))
    assert all(r.length == 64 for r in found[:-1]) and 0 < found[-1].length <= 64


def test_ids_slab_by_slab(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice(["ab ", "c", "D\n", "é", " ", "1"]) for _ in range(5000))
    monkeypatch.setattr(packing, "SLAB", 50)
    monkeypatch.setattr(packing, "MAX_WORDS", 20)
    encoder = packing.TokenIds(open(PATH).read())
    assert np.frombuffer(b"".join(encoder.of(text.encode())), "<u4").tolist() == ids(text)[:-1]


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_the_histogram(seed):
    rng = random.Random(seed)
    top = rng.choice([400, 150, 60])
    histogram = dict(Counter(rng.randrange(1, top) for _ in range(1500)))
    groups, fewest = packing.plan(histogram, 400, seed)
    held = Counter()
    for content, times in groups:
        assert times > 0 and sum(size * n for size, n in content.items()) <= 400
        for size, n in content.items():
            held[size] += n * times
    assert held == histogram
    lengths = [size for size, n in histogram.items() for _ in range(n)]
    used = sum(times for _, times in groups)
    assert -(-sum(lengths) // 400) <= fewest <= used
    assert used <= best_fit_decreasing(lengths, 400) * 1.03


def test_program_beats_best_fit_where_configurations_matter():
    histogram = {1366: 900, 1365: 900, 2730: 100}
    groups, fewest = packing.plan(histogram)
    lengths = [size for size, n in histogram.items() for _ in range(n)]
    assert fewest <= sum(t for _, t in groups) <= 730 < best_fit_decreasing(lengths, 4096)


def test_plan_does_not_grow_with_counts():
    histogram = {size: 10**9 for size in range(100, 4000, 13)}
    groups, fewest = packing.plan(histogram)
    one_each = best_fit_decreasing([size for size in histogram for _ in range(20)], 4096)
    assert len(groups) < 10_000
    assert fewest <= sum(t for _, t in groups) <= 1.02 * one_each * 10**9 / 20


def test_one_length_in_a_third_of_rows_and_clashing_columns(spark):
    rng = random.Random(9)
    rows = [(7 if rng.random() < 0.4 else rng.randrange(1, 65), k, "x", k) for k in range(3000)]
    rows += [(None, -1, None, 0), (0, -2, "", 0), rows[0], rows[0]]
    parts = spark.createDataFrame(rows, "length long, `a.b` long, _row string, offset long").repartition(7)
    found = packing.pack(parts, 64)
    assert found.columns == ["length", "a.b", "_row", "offset", "sequence_id", "offset_"]
    got = found.collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(rows)
    empty = [r for r in got if not r.length]
    assert len(empty) == 2 and all(r.sequence_id is None and r.offset_ is None for r in empty)
    n = checked([(r.length, r.sequence_id, r.offset_) for r in got if r.length], 64)
    assert n <= -(-sum(r[0] or 0 for r in rows) // 64) * 1.02


def test_empty_tables_and_bad_lengths(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(packing.pieces(docs, open(PATH).read())).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(65,)], "length long"), 64)
