import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def odd(spark):
    from helpers import DOCS, odd_docs, with_clashes

    df = with_clashes(spark.createDataFrame(odd_docs(), DOCS)).cache()
    df.count()
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
