import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(os.environ.get("TEST_MASTER", "local[8]")).appName("foliospark-tests")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "8g")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    from foliospark.functions.storage import release
    yield (made := session())
    release(made)
