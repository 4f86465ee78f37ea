import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from umbra.functions.session import ship_package

    yield ship_package(session)
    session.stop()


@pytest.fixture
def units(spark):
    """A table of units from texts: doc_id counts from 0, or (doc_id, ctx, ord, text) as they are."""

    def make(*texts):
        rows = [t if isinstance(t, tuple) else (i, "", 0, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, ctx string, ord int, text string")

    return make
