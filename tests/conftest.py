from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("labelloom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def complaint(record_id: int, text: str | None, product: str | None, issue: str | None) -> tuple:
    return (record_id, text, product, issue)


SCHEMA = "record_id bigint, consumer_complaint_narrative string, product string, issue string"


def long_text(prefix: str, i: int) -> str:
    return f"{prefix} narrative number {i} that is long enough to pass the length filter"
