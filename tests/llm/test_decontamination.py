from __future__ import annotations

import random

import pytest

from txnwatch.llm import decontamination as dc

QUESTION = (
    "Yesterday afternoon old Anna walked 12 km with her brother Peter before they met Anna again "
    "near the river and paid 30 dollars for lunch."
)
DOCS = "doc_id long, text string, item_id string, windows string, _key long"


def found(spark, texts, items, **options):
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], DOCS)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = dc.contamination(docs, benchmark, **options).collect()
    assert len(rows) == len(texts)
    return {r.doc_id: r.item_id for r in rows if r.contaminated}


def filler(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"fill{rng.randrange(5000)}" for _ in range(n))


@pytest.mark.parametrize("max_filter", [4_000_000, 0])
def test_finds_exact_and_reparameterised_items(spark, max_filter):
    renamed = QUESTION.replace("Anna", "Maria").replace("12", "7").replace("Peter", "Tom")
    texts = [
        f"{filler(1)} {QUESTION} {filler(2)}",
        f"{filler(3)}. {renamed.replace(' ', chr(10))} {filler(4)}",
        filler(5),
        None,
        "",
        f"{filler(6)} {QUESTION.upper()} {filler(7)}",
        "12 km 13 km 14 km 15 km 16 km 17 km 18 km",
    ]
    got = found(spark, texts, [QUESTION, filler(9), None, "", "12 km"], max_filter=max_filter)
    assert got == {0: 0, 1: 0, 5: 0}


def test_items_in_capitals_or_title_case_are_found(spark):
    item = filler(1, 30)
    assert set(found(spark, [item.upper(), item.title(), filler(2).title()], [item])) == {0, 1}


def test_slots_must_be_consistent(spark):
    item = "then Anna told that Anna has 5 of those and Bert has 5 too"
    texts = [
        item.replace("Anna", "Cora").replace("5", "9"),
        item.replace("told that Anna", "told that Dora"),
        item.replace("Anna", "Bert"),
    ]
    assert set(found(spark, texts, [item], min_share=1.0)) == {0}


def test_short_items(spark):
    items = ["one two three four five", "six seven eight nine", "ten eleven twelve with nine more words"]
    texts = [f"zero {items[0]} zero", f"zero {items[1]} zero", f"zero {items[2]}"]
    assert found(spark, texts, items) == {0: 0, 2: 2}


def test_windows_equal_a_plain_search(spark):
    rng = random.Random(6)
    vocabulary = [f"v{k}" for k in "abcdefghij"]
    items = [" ".join(rng.choices(vocabulary, k=12)) for _ in range(6)]
    texts = []
    for _ in range(40):
        cut = rng.choice(items).split()[rng.randrange(4) :][: rng.randrange(4, 13)]
        texts.append(" ".join([*rng.choices(vocabulary, k=9), *cut, *rng.choices(vocabulary, k=5)]))

    def windows(text):
        w = text.split()
        return {tuple(w[i : i + 8]) for i in range(len(w) - 7)}

    want = set()
    for i, text in enumerate(texts):
        for item in items:
            hits, all_ = len(windows(text) & windows(item)), len(windows(item))
            if hits >= -(-all_ * 3 // 10):
                want.add(i)
    assert set(found(spark, texts, items)) == want and 0 < len(want) < 40


def test_long_items_short_items_and_dense_items(spark):
    long, dense = filler(1, 400), "12 km + 13 km + 14 km = 39 km"
    part = " ".join(long.split()[100:113])
    parts = " ".join(f"{' '.join(long.split()[k : k + 10])} gap{k} gap" for k in (20, 60, 120))
    texts = [f"{filler(2)} {part} {filler(3)}", f"{filler(4)} {parts}", f"{filler(5)} {dense} {filler(6)}"]
    texts += ["Six seven\neight nine.", filler(7), dense.replace("14", "15").replace("39", "40")]
    assert found(spark, texts, [long, dense, "six seven eight nine"], min_share=0.9) == {0: 0, 2: 1, 3: 2}


def test_dropping_keeps_the_rest_as_it_is(spark):
    rows = [(None, filler(1), "x", "y", 1), (None, QUESTION, "x", "y", 1), (2, None, None, None, None)]
    rows += [(3, filler(1), "x", "y", 1)] * 2
    docs = spark.createDataFrame(rows, DOCS)
    benchmark = spark.createDataFrame([(None, QUESTION), (None, QUESTION)], "item_id long, text string")
    left = dc.drop_contaminated(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in docs.collect() if r.text != QUESTION)
    assert dc.drop_contaminated(docs, benchmark.limit(0)).count() == 5
    assert dc.contamination(docs.limit(0), benchmark).count() == 0


FAR = (
    "A baker sold exactly 5 loaves of brown bread before noon today and later she packed another 5 "
    "loaves for her oldest neighbour down the road."
)


def test_slots_are_compared_across_windows(spark):
    texts = [
        FAR.replace("5", "9"),
        FAR.replace("5", "9", 1).replace("5", "11"),
        FAR,
        f"{filler(1)}. {FAR.replace('5', '9')} {filler(2)}. {FAR.replace('5', '11')}",
    ]
    assert set(found(spark, texts, [FAR], min_share=1.0, min_run=100)) == {0, 2, 3}
    # a verbatim window counts even if another one of its values was changed
    part = found(spark, [FAR.replace("5", "9", 1), FAR.replace("5", "9")], [FAR], min_share=0.6, min_run=100)
    assert set(part) == {0, 1}


def test_different_values_must_not_become_one(spark):
    item = FAR.replace("5", "7", 1)
    texts = [item.replace("5", "7"), item.replace("7", "3"), item.replace("7", "3").replace("5", "3")]
    assert set(found(spark, texts, [item], min_share=1.0, min_run=100)) == {1}


def test_scattered_pieces_do_not_add_up(spark):
    item = filler(11, 40)
    words = item.split()
    pieces = [" ".join(words[k : k + 10]) for k in (0, 10, 20, 30)]
    apart = " ".join(f"{p} {filler(20 + k)}" for k, p in enumerate(pieces))
    near = " ".join(f"{p} one more" for p in pieces)
    assert set(found(spark, [apart, near], [item])) == {1}


def plain_matches(text, item, min_share=dc.MIN_SHARE, min_run=dc.MIN_RUN):
    """Templates of numbers only, one window at a time."""
    words, asked = text.lower().split(), item.lower().split()

    def windows(w):
        for i in range(len(w) - 7):
            kinds = tuple("#" if x.isdigit() else x for x in w[i : i + 8])
            if sum(k != "#" for k in kinds) < dc.MIN_LITERAL:
                kinds = ("as it stands", *w[i : i + 8])
            yield i, kinds

    all_, groups = list(windows(asked)), {}
    for at, kinds in windows(words):
        for place, other in all_:
            if kinds == other:
                pairs = {
                    (a, b)
                    for a, b in zip(asked[place : place + 8], words[at : at + 8])
                    if a.isdigit() and kinds[0] != "as it stands"
                }
                groups.setdefault(at - place, []).append((place, pairs))
    good = []
    for shift, hits in groups.items():
        pairs = set().union(*(p for _, p in hits))
        bad = {p for p in pairs for q in pairs if p != q and (p[0] == q[0] or p[1] == q[1])}
        places = {place for place, own in hits if not own & bad or all(a == b for a, b in own)}
        if any(set(range(k, k + min_run)) <= places for k in places):
            return True
        good += [(shift, place) for place in places]
    good.sort()
    parts, last = [], None
    for shift, place in good:
        if last is None or shift - last > dc.GAP:
            parts.append(set())
        parts[-1].add(place)
        last = shift
    return any(len(p) >= -(-len(all_) * min_share // 1) for p in parts)


@pytest.mark.parametrize("seed", range(3))
def test_numbers_runs_and_slots_equal_a_plain_search(spark, seed):
    rng = random.Random(seed)
    letters = [f"v{k}" for k in "abcdefgh"]

    def make(n):
        return [str(rng.randrange(2, 6)) if rng.random() < 0.25 else rng.choice(letters) for _ in range(n)]

    items = [make(rng.randrange(12, 30)) for _ in range(6)]
    texts = []
    for _ in range(80):
        words = rng.choice(items)
        swap = {str(k): str(rng.randrange(2, 8)) for k in range(2, 6)}
        cut = [swap.get(w, w) if rng.random() < 0.95 else str(rng.randrange(9)) for w in words]
        k = rng.randrange(len(cut))
        if rng.random() < 0.3:
            cut = [*cut[:k], "extra", *cut[k:]]
        texts.append(" ".join([*make(rng.randrange(20)), *cut[rng.randrange(6) :], *make(rng.randrange(20))]))
    rows = [" ".join(i) for i in items]
    want = {i for i, t in enumerate(texts) if any(plain_matches(t, item) for item in rows)}
    assert set(found(spark, texts, rows)) == want and 0 < len(want) < 80
