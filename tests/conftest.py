import pathlib
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = pathlib.Path(__file__).resolve().parent.parent
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

SNAPSHOT = "relative_path string, hash string, file_size_bytes long"


@pytest.fixture(scope="session")
def testdata():
    return "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("snapledger-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from snapledger.sources.ship import ship

    ship(session)
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """A snapshot from (path, hash, size) tuples."""
    return lambda *rows: spark.createDataFrame(list(rows), SNAPSHOT)


@pytest.fixture
def rows():
    """The rows of a DataFrame as a sorted list of tuples; nulls sort first."""

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=lambda t: [(v is not None, v) for v in t])

    return collect


@pytest.fixture
def conf(spark):
    """Set session configuration for one test."""
    saved = {}

    def set_conf(key, value):
        saved.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield set_conf
    for key, value in saved.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
