import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from harborwatch.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session(master="local[8]", shuffle_partitions=4, app="harborwatch-tests")


@pytest.fixture()
def value(spark):
    """Evaluate one column expression over named values."""
    def run(expr, **cols):
        row = spark.range(1).select(*[F.lit(v).cast(t).alias(k) for k, (t, v) in cols.items()])
        return row.select(expr.alias("x")).collect()[0]["x"]

    return run
