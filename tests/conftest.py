import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("runscope-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture
def contents_of(spark):
    """Builds log_contents from ``{path: text}``; the path starts with the cluster."""
    from pyspark.sql import functions as F

    from runscope.sources.tables import with_file_columns

    def build(files, modified=None):
        rows = [
            (path.split("/")[0], path, (modified or {}).get(path, "2024-01-01 00:00:00"), content)
            for path, content in files.items()
        ]
        df = spark.createDataFrame(rows, "cluster_id STRING, file_path STRING, m STRING, content STRING")
        return with_file_columns(
            df.withColumn("last_modified", F.col("m").cast("timestamp_ntz")).drop("m")
        )

    return build
