import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers import the data source from here
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


from checks import own_folder  # noqa: E402
from modcensus import runtime  # noqa: E402

runtime.use_folder(own_folder)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("modcensus-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column_values(spark):
    """Evaluate a function of string columns over a list of tuples."""
    def values(function, rows):
        from pyspark.sql import functions as F

        width = len(rows[0])
        names = [f"c{i}" for i in range(width)]
        schema = "id INT, " + ", ".join(f"{name} STRING" for name in names)
        frame = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], schema)
        result = frame.select("id", function(*[F.col(n) for n in names]).alias("v")).collect()
        return [row.v for row in sorted(result)]

    return values
