import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from rosterlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", 4, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Apply a column expression to texts and return the values in order."""
    from pyspark.sql import functions as F

    def run(texts, expression):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
        return [r[0] for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").select("out").collect()]
    return run
