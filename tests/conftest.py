import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def texts(spark):
    """One text column ``v`` with an ``i`` that keeps the order."""

    def make(values):
        return spark.createDataFrame(list(enumerate(values)), "i int, v string")

    return make


@pytest.fixture
def apply(texts):
    """Evaluate a Column function over a list of texts."""

    def run(function, values):
        from pyspark.sql import functions as F

        rows = texts(values).select("i", function(F.col("v")).alias("r")).orderBy("i").collect()
        return [r.r for r in rows]

    return run


def shuffled_rows(spark, make):
    """Rows that the jobs of ``make`` write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    group = f"shuffled-{make.__name__}-{id(make)}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        make()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    tracker, total = spark.sparkContext.statusTracker(), 0
    for job in tracker.getJobIdsForGroup(group):
        for stage in tracker.getJobInfo(job).stageIds:
            total += store.lastStageAttempt(stage).shuffleWriteRecords()
    return total
