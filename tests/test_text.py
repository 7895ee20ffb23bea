import os
import sys
import uuid
from collections import Counter

from conftest import tx_row
from pyspark import cloudpickle

from txnwatch.functions import wording as W
from txnwatch.operators import text
from txnwatch.session import local_rows

# the models below are sent to Python workers, which cannot import this file
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def prompts(spark, values):
    return local_rows(spark, [(i, p) for i, p in enumerate(values)], "id BIGINT, prompt STRING")


def echo():
    def model(batch, **options):
        return [{"text": f"{p}/{options.get('max_output_tokens')}", "status": ""} for p in batch]

    return model


def fragile():
    def model(batch, **options):
        if "bad" in batch:
            raise RuntimeError("refused")
        return [{"text": p.upper(), "status": ""} for p in batch]

    return model


def short():
    return lambda batch, **options: [{"text": "x"}] * (len(batch) - 1)


def rows(df):
    return {r["id"]: (r["recommendation"], r["status"]) for r in df.collect()}


def test_options_reach_the_model(spark):
    made = text.generate_text(prompts(spark, ["a", "b"]), echo, max_output_tokens=7)
    assert rows(made) == {0: ("a/7", ""), 1: ("b/7", "")}


def test_a_failing_prompt_does_not_take_others_with_it(spark):
    made = text.generate_text(prompts(spark, ["a", "bad", None, "c"]), fragile, tasks=1)
    assert rows(made) == {
        0: ("A", ""),
        1: (None, "error: refused"),
        2: (None, "no prompt"),
        3: ("C", ""),
    }


def test_a_model_that_loses_answers_is_an_error(spark):
    made = rows(text.generate_text(prompts(spark, ["a", "b"]), short, tasks=1))
    assert all(t is None and s.startswith("error") for t, s in made.values())


def test_recommendation_prompt_shows_missing_windows_as_zero(spark):
    columns = {
        "tx_count_15m": None, "total_spend_15m": None, "max_amount_15m": None,
        "tx_count_30m": 1, "total_spend_30m": 1234567.5, "tx_count_60m": 2,
        "total_spend_60m": 3.0, "avg_amount_60m": 1.5, "distinct_merchants_60m": 1,
        "distinct_countries_60m": 2, "near_threshold_count_60m": 0,
    }
    types = ", ".join(
        f"{c} {'DOUBLE' if 'spend' in c or 'amount' in c else 'BIGINT'}" for c in columns
    )
    df = local_rows(spark, [("u", *columns.values())], f"user_id STRING, {types}")
    prompt = text.recommendation_prompts(df).collect()[0]["prompt"]
    assert "(Last 15m) ---\nTx Count: 0\nTotal Spend: £0.00\nMax Tx: £0.00\n" in prompt
    assert "Tx Count: 1\nTotal Spend: £1234567.50\n" in prompt
    assert prompt.endswith("Near-Threshold Transactions (Last 60m): 0")


def test_transaction_prompt_is_null_if_a_value_is_missing(make_tx):
    tx = make_tx([tx_row(1, amount=5.0), tx_row(2, amount=None)])
    got = {r["transaction_id"]: r["prompt"] for r in text.transaction_prompts(tx).collect()}
    assert got["t0001"].endswith("Amount: £5.00\nMerchant: m\nCountry: GB")
    assert got["t0002"] is None


def test_ideation_prompts_in_both_wordings(spark):
    described = local_rows(
        spark, [("t1", "description", "about t1"), ("t2", "description", None),
                ("t1", "owner", "x")],
        "table_name STRING, option_name STRING, option_value STRING")
    for template in (W.IDEAS_STREAMING, W.IDEAS_BATCH):
        got = {r[0]: r[1] for r in text.ideation_prompts(described, template).collect()}
        assert set(got) == {"t1", "t2"}
        assert "Table: t1\nWhat it holds: about t1\n" in got["t1"]
        assert "What it holds: N/A\n" in got["t2"]


def counting(folder, failing=None, answer="a"):
    """A model that leaves a file per prompt it is asked, and breaks down on one prompt."""

    def make():
        def model(batch, **options):
            for p in batch:
                (folder / f"{uuid.uuid4().hex}").write_text(p)
            if failing in batch:
                os._exit(1)  # takes the whole task with it
            return [{"text": f"{answer}:{p}", "status": ""} for p in batch]

        return model

    return make


def asked(folder):
    return Counter(f.read_text() for f in folder.iterdir())


def test_equal_prompts_are_sent_once_and_answers_are_kept(spark, tmp_path):
    calls, answers = tmp_path / "calls", str(tmp_path / "answers")
    calls.mkdir()
    df = prompts(spark, ["p", "q", "p", None, "p", ""])
    once = {"answers": answers, "model_name": "m", "wave": 2}
    got = rows(text.generate_text_once(df, counting(calls), **once))
    assert got == {0: ("a:p", ""), 1: ("a:q", ""), 2: ("a:p", ""), 3: (None, "no prompt"),
                   4: ("a:p", ""), 5: ("a:", "")}
    assert asked(calls) == {"p": 1, "q": 1, "": 1}
    more = prompts(spark, ["q", "new"])
    got = rows(text.generate_text_once(more, counting(calls, answer="b"), **once))
    assert got == {0: ("a:q", ""), 1: ("b:new", "")}
    # other options and another model are other questions; how to send them is not
    text.generate_text_once(more, counting(calls), tasks=1, batch_size=1, **once).collect()
    assert asked(calls)["q"] == 1
    text.generate_text_once(more, counting(calls), max_output_tokens=9, **once).collect()
    text.generate_text_once(more, counting(calls), **{**once, "model_name": "n"}).collect()
    assert asked(calls)["q"] == 3


def test_a_failed_task_pays_for_its_wave_only(spark, tmp_path):
    calls, answers = tmp_path / "calls", str(tmp_path / "answers")
    calls.mkdir()
    df = prompts(spark, [f"p{k}" for k in range(40)])
    once = {"answers": answers, "model_name": "m", "wave": 8}
    try:
        text.generate_text_once(df, counting(calls, failing="p7"), **once)
        raise AssertionError("the broken model must end the run")
    except Exception as error:  # noqa: BLE001 - the worker's end, in Spark's words
        assert "must end" not in str(error)
    before = asked(calls)
    stored = set(text._answered(spark, answers).select("recommendation").toPandas()["recommendation"])
    got = rows(text.generate_text_once(df, counting(calls), **once))
    assert len(got) == 40 and all(s == "" for _, s in got.values())
    again = {p for p, n in asked(calls).items() if n > before[p]}
    assert not again & {a.removeprefix("a:") for a in stored}


def test_errors_are_not_kept(spark, tmp_path):
    df = prompts(spark, ["bad", "good"])
    once = {"answers": str(tmp_path / "answers"), "model_name": "m", "pause": 0.0, "batch_size": 1}
    assert rows(text.generate_text_once(df, fragile, **once)) == {0: (None, "no answer"), 1: ("GOOD", "")}
    assert rows(text.generate_text_once(df, echo, **once)) == {0: ("bad/None", ""), 1: ("GOOD", "")}


def test_all_waves_are_one_job(spark, tmp_path):
    """A job per wave read all prompts again for every wave."""
    df = prompts(spark, [f"p{k}" for k in range(60)])
    answers = str(tmp_path / "answers")
    got = rows(text.generate_text_once(df, echo, answers, "m", wave=4))
    assert got == {k: (f"p{k}/None", "") for k in range(60)}
    folders = list((tmp_path / "answers").glob("wave=*"))
    assert len(folders) == 1 and len(list(folders[0].glob("*.parquet"))) > 5


def test_waves_of_a_limited_number_of_tasks(spark, tmp_path):
    df = prompts(spark, [f"p{k}" for k in range(60)])
    answers = str(tmp_path / "answers")
    got = rows(text.generate_text_once(df, echo, answers, "m", wave=4, tasks=5))
    assert got == {k: (f"p{k}/None", "") for k in range(60)}
    folders = list((tmp_path / "answers").glob("wave=*"))
    assert 1 < len(folders) <= 3 and all(len(list(f.glob("*.parquet"))) <= 5 for f in folders)
