import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import connect, same  # noqa: E402

from ctxforge.llm import catalog  # noqa: E402


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, sf, name):
    same(catalog.queries()[name](spark, sf), connect(sf), catalog.oracle_sql()[name])
