import pytest

from quern import plans
from tests.conftest import SF
from tests.oracle import connect, differences

SQL = plans.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    assert differences(spark, con, plans.queries()[name], SQL[name], SF) == []


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(SQL)))
def test_queries_without_sql_judge_each_text_once(spark, name):
    assert name in ("detectors_lookaround", "detector_findings")
    rows = plans.queries()[name](spark, SF).collect()
    ids = [r["id"] for r in rows]
    assert len(ids) == len(set(ids))
    # the rule texts, which hit each detector and just miss it, have ids from -1 down
    found = {r["id"] for r in rows if any(v for k, v in r.asDict().items() if k != "id" and v not in ("", None))}
    assert {i for i in found if -1_000_000 < i < 0}
