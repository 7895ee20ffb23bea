"""Prompts from features and metadata, and a text model applied to them in batches."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnwatch.functions import wording as W
from txnwatch.functions.money import money_text
from txnwatch.session import local_rows, shared_folder, written


def _count(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("0"))


def _money(column: str) -> Column:
    return F.coalesce(money_text(F.col(column)), F.lit("0.00"))


def recommendation_prompts(features: DataFrame) -> DataFrame:
    """Prompt per user from ``multi_window_features``; missing windows show as zero."""
    prompt = F.format_string(
        W.RECOMMENDATION,
        F.col("user_id"),
        _count("tx_count_15m"), _money("total_spend_15m"), _money("max_amount_15m"),
        _count("tx_count_30m"), _money("total_spend_30m"),
        _count("tx_count_60m"), _money("total_spend_60m"), _money("avg_amount_60m"),
        _count("distinct_merchants_60m"), _count("distinct_countries_60m"),
        _count("near_threshold_count_60m"),
    )
    return features.select("user_id", prompt.alias("prompt"))


def recommendation_prompts_1h(hourly: DataFrame) -> DataFrame:
    """Prompt per user from the rolling-hour table; NULL if any value is missing."""
    values = [
        F.col("user_id"),
        F.col("tx_count_1h").cast("string"),
        money_text(F.col("total_spend_1h")),
        money_text(F.col("avg_amount_1h")),
        F.col("distinct_merchants_1h").cast("string"),
        F.col("distinct_countries_1h").cast("string"),
        money_text(F.col("max_amount_1h")),
    ]
    return hourly.select("user_id", _null_if_any(W.RECOMMENDATION_1H, values).alias("prompt"))


def transaction_prompts(tx: DataFrame) -> DataFrame:
    """Prompt per transaction; works on batch and streaming frames."""
    values = [money_text(F.col("amount")), F.col("merchant"), F.col("country")]
    prompt = _null_if_any(W.TRANSACTION, values)
    return tx.select("transaction_id", "user_id", prompt.alias("prompt"))


def _null_if_any(template: str, values: list[Column]) -> Column:
    """Fill a template; like string concatenation, NULL if a value is NULL."""
    known = values[0].isNotNull()
    for value in values[1:]:
        known = known & value.isNotNull()
    return F.when(known, F.format_string(template, *values))


def ideation_prompts(descriptions: DataFrame, template: str = W.IDEAS_STREAMING) -> DataFrame:
    """Prompt per described table (columns table_name, option_name, option_value)."""
    description = F.coalesce(F.col("option_value"), F.lit("N/A"))
    return descriptions.filter(F.col("option_name") == "description").select(
        F.col("table_name").alias("source_table"),
        F.format_string(template, F.col("table_name"), description).alias("prompt"),
    )


def grounded_prompt(columns: DataFrame, descriptions: DataFrame) -> DataFrame:
    """One prompt from all column lines and table descriptions, in a fixed order."""
    column_line = F.concat(
        F.lit("Table: "), "table_name",
        F.lit(" | Column: "), "column_name",
        F.lit(" | Type: "), "data_type",
    )
    table_line = F.concat(
        F.lit("Table: "), "table_name", F.lit(" | Description: "), "option_value"
    )

    def lines(df: DataFrame, line: Column, name: str, *order: str) -> DataFrame:
        # metadata only: one short line per column or table
        ordered = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
        return df.agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias(name))

    schema_text = lines(columns, column_line, "schema_text", "table_name", "ordinal_position")
    described = descriptions.filter(F.col("option_name") == "description")
    table_text = lines(described, table_line, "table_text", "table_name")
    return schema_text.crossJoin(table_text).select(
        F.format_string(W.GROUNDED, "schema_text", "table_text").alias("prompt")
    )


# A model takes a list of prompts and options and returns one dict per prompt with the
# keys ``text``, ``status`` and ``safety`` (all strings or None).
Model = Callable[..., list[dict[str, Any]]]

RESULT_FIELDS = ("recommendation", "status", "safety_attributes")


def generate_text(
    rows: DataFrame,
    make_model: Callable[[], Model],
    batch_size: int = 64,
    tasks: int | None = None,
    retries: int = 2,
    pause: float = 0.5,
    **options: Any,
) -> DataFrame:
    """Input columns plus text, status and safety notes for the ``prompt`` column.

    ``make_model`` runs once per task. Prompts are sent in batches. A batch that fails is sent
    again after a pause, up to ``retries`` times; a batch of one that still fails gives a NULL
    text and the error as status. Of a larger one the first prompt is then sent alone: if that
    fails too, the model is taken to be down and all get its error, otherwise each is sent alone.
    Model calls are slow, so rows are dealt over ``tasks`` tasks (default: as many as the
    cluster runs at once), not left in the few partitions their size would suggest.
    """
    fields = [T.StructField(name, T.StringType()) for name in RESULT_FIELDS]
    schema = T.StructType([*rows.schema.fields, *fields])
    tasks = tasks or rows.sparkSession.sparkContext.defaultParallelism
    rows = rows.repartition(tasks, *rows.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for frame in batches:
            for start in range(0, len(frame), batch_size):
                part = frame.iloc[start : start + batch_size]
                replies = _ask(model, part["prompt"].tolist(), options, retries, pause)
                yield part.assign(
                    recommendation=[r.get("text") for r in replies],
                    status=[r.get("status") for r in replies],
                    safety_attributes=[r.get("safety") for r in replies],
                )

    return rows.mapInPandas(run, schema)


ANSWERS = "prompt_key STRING, " + ", ".join(f"{name} STRING" for name in RESULT_FIELDS)


def generate_text_once(
    rows: DataFrame,
    make_model: Callable[[], Model],
    answers: str,
    model_name: str,
    wave: int = 10_000,
    **options: Any,
) -> DataFrame:
    """``generate_text`` with a table of answers in the folder ``answers``, keyed by model, prompt
    and options: prompts that it holds are not sent again, and equal prompts are sent once.

    New prompts are dealt into waves of about ``wave`` prompts. A task sends one wave and stores
    its answers when it is whole, so a run that fails, or is repeated, pays for the waves only
    that were being sent. One job sends all waves, as many at a time as the cluster runs; with
    ``tasks``, jobs of that many waves follow each other. Errors are not stored,
    so they are tried again by the next run and have no answer in this one. Options of
    ``generate_text`` itself (``batch_size``, ``tasks``, ``retries``, ``pause``) are no part of the key."""
    spark = rows.sparkSession
    own = {k: options.pop(k) for k in ("batch_size", "tasks", "retries", "pause") if k in options}
    salt = json.dumps([model_name, sorted(options.items())])
    key = F.sha2(F.concat(F.lit(salt), F.col("prompt")), 256)
    asked = rows.filter("prompt IS NOT NULL").select(key.alias("prompt_key"), "prompt")
    new = asked.groupBy("prompt_key").agg(F.min("prompt").alias("prompt"))
    new = written(new.join(_answered(spark, answers), "prompt_key", "left_anti"), "prompts")
    waves = -(-new.count() // wave)
    at_once = own.pop("tasks", None) or waves
    jobs = -(-waves // at_once) if waves else 0
    if jobs > 1:  # split once, so that a job reads its own prompts only
        place = F.pmod(F.xxhash64("prompt_key"), F.lit(jobs)).alias("job")
        path = shared_folder(spark, "prompts_by_job")
        new.select("*", place).repartition("job").write.partitionBy("job").parquet(path)
        new = spark.read.parquet(path)
    for number in range(jobs):
        part = new.filter(F.col("job") == number).drop("job") if jobs > 1 else new
        made = generate_text(part, make_model, tasks=min(at_once, waves), **own, **options)
        made = made.drop("prompt").filter("status IS NULL OR NOT startswith(status, 'error')")
        # version 2: a task's file is in place once the task is done, whatever happens to the job
        made.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(
            f"{answers.rstrip('/')}/wave={uuid.uuid4().hex}"
        )
    found = _answered(spark, answers)
    keyed = rows.withColumn("_prompt_key", key)
    joined = keyed.join(found, F.col("_prompt_key") == F.col("prompt_key"), "left")
    nothing = F.when(F.col("prompt").isNull(), F.lit("no prompt")).otherwise(F.lit("no answer"))
    status = F.when(F.col("prompt_key").isNull(), nothing).otherwise(F.col("status"))
    return joined.withColumn("status", status).drop("_prompt_key", "prompt_key")


def _answered(spark: SparkSession, answers: str) -> DataFrame:
    """Stored answers of whole waves, also those of a job that failed later, one per key."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{answers.rstrip('/')}/wave=*/*.parquet")
    files = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    waves = sorted({str(f.getPath().getParent()) for f in files.globStatus(pattern) or []})
    if not waves:
        return local_rows(spark, [], ANSWERS)
    return spark.read.schema(ANSWERS).parquet(*waves).dropDuplicates(["prompt_key"])


def _ask(
    model: Model, prompts: list, options: dict[str, Any], retries: int = 2, pause: float = 0.5
) -> list[dict[str, Any]]:
    asked = [i for i, p in enumerate(prompts) if p is not None]
    replies: list[dict[str, Any]] = [{"status": "no prompt"} for _ in prompts]
    for i, answer in zip(asked, _answers(model, [prompts[i] for i in asked], options, retries, pause)):
        replies[i] = answer
    return replies


def _answers(
    model: Model, prompts: list[str], options: dict[str, Any], retries: int, pause: float
) -> list[dict[str, Any]]:
    for attempt in range(retries + 1):
        try:
            answers = model(prompts, **options) if prompts else []
            if len(answers) != len(prompts):
                raise ValueError(f"{len(answers)} answers for {len(prompts)} prompts")
            return answers
        except Exception as error:  # noqa: BLE001 - one bad prompt must not fail the job
            failed = {"status": f"error: {error}"}
            if attempt < retries:
                time.sleep(pause * 2**attempt)
    if len(prompts) == 1:
        return [failed]
    first = _answers(model, prompts[:1], options, 0, pause)
    if first[0].get("status") == failed["status"]:
        return [failed] * len(prompts)
    return first + [_answers(model, [p], options, 0, pause)[0] for p in prompts[1:]]
