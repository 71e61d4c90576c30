import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("zonewright-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def customer(spark):
    return spark.read.parquet("/root/testdata/sf0.001/customer.parquet")


@pytest.fixture
def plan():
    """The executed plan of a DataFrame as text."""

    def text(df):
        return df._jdf.queryExecution().executedPlan().toString()

    return text


@pytest.fixture
def same_rows():
    """Equal as bags of rows, column order included."""

    def check(left, right):
        assert left.columns == right.columns
        assert left.exceptAll(right).count() == 0
        assert right.exceptAll(left).count() == 0

    return check
