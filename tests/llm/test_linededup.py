from __future__ import annotations

import random

import brute
import pytest

from txnwatch.llm import linededup

SCHEMA = "doc_id long, text string, source string, host string, pages long, hashes string, _any int"


def pages(seed, n):
    rng, out = random.Random(seed), []
    for i in range(n):
        host = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None])
        lines = [rng.choice(["menu", " menu\t", "foot", "", f"line {rng.randrange(40)}"])]
        lines += [f"own {i} {k}" for k in range(rng.randrange(3))]
        lines += [rng.choice(["", "rare", "foot\r", "word " * 50])] * rng.randrange(3)
        text = rng.choice(["\n".join(lines)] * 8 + [None, "", "\n\n"])
        out.append((i, text, host, "h", 1, "x", 2))
    return out


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("ratio,least", [(0.1, 3), (0.3, 1), (0.0, 2)])
def test_equals_the_plain_version(spark, monkeypatch, broadcast, ratio, least):
    if not broadcast:
        monkeypatch.setattr(linededup, "MAX_BROADCAST", -1)
    made = pages(4, 160)
    df = spark.createDataFrame(made, SCHEMA)
    got = linededup.drop_boilerplate(df, max_ratio=ratio, min_pages=least, counted="n")
    assert got.columns == [*df.columns, "n"]
    cut = brute.boilerplate_cut([(r[2], r[1]) for r in made], ratio, least)
    rows = sorted(got.collect())
    assert [r.text for r in rows] == cut
    assert [tuple(r)[2:7] for r in rows] == [r[2:] for r in made]
    lost = [0 if t is None else t.count("\n") - c.count("\n") for (_, t, *_), c in zip(made, cut)]
    assert sum(r.n for r in rows) >= sum(lost) > 0


def test_unchanged_and_emptied_texts_and_no_rows(spark):
    rows = [(i, t, "s", None, None, None, None) for i, t in enumerate(["x", "x", "x", "x\ny", None])]
    got = sorted(linededup.drop_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [r.text for r in got] == ["", "", "", "y", None]
    assert linededup.drop_boilerplate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lines_on_about_every_tenth_page_go_and_rare_ones_stay(spark):
    texts = ["often\n" * (i % 23 == 0) + "seldom\n" * (i % 50 == 1) + f"own {i}" for i in range(250)]
    texts += ["often\n" * (i % 11 == 0) + f"own {i}" for i in range(250, 500)]
    rows = [(i, t, "s", None, None, None, None) for i, t in enumerate(texts)]
    left = [r.text for r in linededup.drop_boilerplate(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sum("often" in t for t in texts) < 50 and not any("often" in t for t in left)
    assert sum("seldom" in t for t in left) == 5


def test_no_python_in_the_plan(spark):
    df = linededup.drop_boilerplate(spark.createDataFrame(pages(1, 20), SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
