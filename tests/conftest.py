import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from tidyshelf.storage import prepare_session

    return prepare_session(session)


@pytest.fixture
def each(spark):
    """Apply a Column function to texts and return the results in order."""
    from pyspark.sql import functions as F

    def run(fn, texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
        rows = df.select("i", fn(F.col("t")).alias("r")).orderBy("i").collect()
        return [r["r"] for r in rows]

    return run
