from __future__ import annotations

import datetime as dt
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from txnwatch.session import build_session, local_rows  # noqa: E402

SMALL = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 10, 9, 0)
TX_SCHEMA = (
    "transaction_id STRING, user_id STRING, amount DOUBLE, timestamp TIMESTAMP_NTZ, "
    "merchant STRING, category STRING, currency STRING, country STRING"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        master="local[4]",
        **{
            "spark.sql.shuffle.partitions": "2",
            "spark.default.parallelism": "2",
            "spark.sql.adaptive.enabled": "false",
            # compiling generated code takes longer than running it on a few rows
            "spark.sql.codegen.wholeStage": "false",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.streaming.stateStore.providerClass": (
                "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
            ),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(minutes: float) -> dt.datetime:
    return START + dt.timedelta(minutes=minutes)


def tx_row(i, user="u", amount=10.0, when=0.0, merchant="m", category="Food", country="GB"):
    stamp = when if isinstance(when, dt.datetime) else at(when)
    return (f"t{i:04d}", user, amount, stamp, merchant, category, "GBP", country)


@pytest.fixture(scope="session")
def make_tx(spark):
    def make(rows):
        return local_rows(spark, list(rows), TX_SCHEMA)

    return make


def random_rows(seed: int, n: int, users: int = 4, span: int = 200, whole_minutes=False):
    """Rows with ties, missing values, amounts near every limit, and one user with a third
    of all rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = "hot" if rng.random() < 0.34 else f"u{rng.randrange(users)}"
        other = rng.choice(["hot", "shop", None, *[f"u{k}" for k in range(users)]])
        amount = rng.choice(
            [None, 5000.0, 5000.01, 9000.0, 9000.01, 9999.99, 10000.0, 50000.0]
            + [round(rng.uniform(-5, 20000), 2) for _ in range(6)]
        )
        minutes = rng.randrange(span) if whole_minutes else rng.randrange(span * 6) / 6
        country = rng.choice(["GB", "FR", None])
        rows.append(tx_row(i, user, amount, minutes, other, country=country))
    return rows


@pytest.fixture(scope="session")
def small() -> str:
    return SMALL


def as_dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]
