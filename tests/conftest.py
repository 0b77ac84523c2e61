from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tidewell.session import get_spark

    session = get_spark(
        "tests",
        "local[8]",
        {
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column over literal inputs."""
    from pyspark.sql import functions as F

    def value(column, **inputs):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()] or [F.lit(0)])
        return row.select(column.alias("v")).first()["v"]

    return value
