import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def db(spark, tmp_path):
    from larkspan.session import Database

    d = Database.create(spark, str(tmp_path / "db"))
    yield d
    d.close()


@pytest.fixture
def rdb(spark, tmp_path):
    """A database with a replica."""
    from larkspan.session import Database

    d = Database.create(spark, str(tmp_path / "db"), replica_dir=str(tmp_path / "replica"))
    yield d
    d.close()


def run(db, *statements):
    for s in statements:
        r = db.execute(s)
    return r
