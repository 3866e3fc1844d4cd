import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from curasift.session import local_session
    s = local_session("*", shuffle_partitions=8, app="curasift-tests")
    yield s
    s.stop()


def one(spark, expr, **cols):
    """Evaluate a Column expression over a one-row DataFrame of string columns."""
    names = list(cols)
    df = spark.createDataFrame([tuple(cols[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return df.select(expr).first()[0]
