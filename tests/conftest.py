import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from linktide.session import local_session

    session = local_session("8", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_links(spark):
    """Links from (src, dst, amount[, neuron[, price]]); each its own author by default."""

    def make(rows):
        full = [
            (100 + i if len(r) < 4 else r[3], r[0], r[1], r[2], r[4] if len(r) > 4 else 1.0, 1, i)
            for i, r in enumerate(rows)
        ]
        return spark.createDataFrame(
            full,
            "neuron bigint, src bigint, dst bigint, amount bigint, price double, valence int, ord int",
        )

    return make
