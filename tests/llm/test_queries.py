"""The registered queries of the text problems against their SQL, on the smallest tables."""

import os

import pytest

from siltstone.llm import packing, queries
from tests.helpers import duck, rows


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, data, name):
    if name == "p6_check" and not os.path.exists(packing.TOKENIZERS):
        pytest.skip("no vocabulary files here")
    assert rows(queries.QUERIES[name](spark, data).toPandas()) == rows(duck(data).execute(queries.SQL[name]).df())
