import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from fixfold.session import get_spark

    s = get_spark(master="local[*]", shuffle_partitions=8)
    yield s


def rows(df, *cols):
    """Collected rows as sorted tuples of the given columns."""
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
