"""Queries of this subpackage beside their SQL."""

import pytest

from quern.llm import oracles, queries
from tests.conftest import SF
from tests.oracle import connect, differences


@pytest.mark.parametrize("name", ["op2_secret_scan", "op12_prefix_trie", "op13_spelling_variants"])
def test_query_equals_its_sql(spark, name):
    assert differences(spark, connect(SF), queries.queries()[name], oracles.oracle_sql()[name], SF) == []
