import os
import sys
from datetime import timedelta

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("TZ", "UTC")

from pyspark.sql import SparkSession  # noqa: E402
from timebase import T0  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoints')}")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture
def records(spark):
    """records([(key, seconds, payload...)], "v string"): records in the given order of arrival; None for no event time."""
    from tidemark.flow import Flow
    from tidemark.schema import from_iterable

    def make(rows, schema="v string", key="string"):
        full = f"key {key}, event_time timestamp, {schema}"
        return Flow(from_iterable(spark, [(k, None if s is None else T0 + timedelta(seconds=s), *rest) for k, s, *rest in rows], full))

    return make
