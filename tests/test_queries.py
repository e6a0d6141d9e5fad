import pytest

from lotgraph import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, oracle, name):
    oracle(spark, plans.QUERIES[name], plans.ORACLES[name])


def test_whole_engines_run(spark):
    assert set(plans.QUERIES) == set(plans.ORACLES)
    sf = "/root/testdata/sf0.001"
    assert plans.QUERIES["forward_predict"](spark, sf).count() > 0
    assert plans.QUERIES["backward_diagnose"](spark, sf).where("rank = 1").count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
