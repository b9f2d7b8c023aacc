import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from odd_rows import ODD, SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def wide(spark):
    """The same with extra columns that clash with the operators' own names."""
    df = spark.createDataFrame(ODD, SCHEMA)
    for c in ("size", "score", "key", "fp", "shard", "slot", "taken", "copies", "deleted", "spans", "found", "n_lines", "root", "start"):
        df = df.withColumn(c, df.doc_id)
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
