import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def engine(spark):
    from graphloom.plans.engine import Engine

    e = Engine(spark)
    e.run("CREATE GRAPH g")
    e.run("USE GRAPH g")
    return e


@pytest.fixture
def ask(engine):
    """Runs a statement; rows as tuples."""

    def run(text, params=None):
        df = engine.run(text, params)
        return None if df is None else [tuple(r) for r in df.collect()]

    return run
