import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="batchloom-test-")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("batchloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse")
        .config("spark.checkpoint.dir", f"{scratch}/checkpoints")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def location(tmp_path):
    return str(tmp_path)


@pytest.fixture
def database(spark, location):
    """A fresh database; tables go below ``location``."""
    import uuid

    from batchloom.sinks.tables import ensure_database

    name = f"db_{uuid.uuid4().hex}"
    ensure_database(spark, name, f"{location}/{name}")
    return name
