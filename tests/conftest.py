import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strata.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", shuffle_partitions=8, app="strata-tests")
    yield s


def rows(df, *cols):
    """Collect selected columns as sorted tuples (None sorts first)."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()), key=lambda t: tuple((x is not None, x) for x in t))


def columns(schema):
    """(name, type) pairs, ignoring nullability (stored tables read back nullable)."""
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]
