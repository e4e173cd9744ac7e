"""Small tables in one file that make many rows are dealt to all cores."""

import pytest

from veilspan.plans import model


@pytest.mark.parametrize("query", [model.ner11_expand_addresses, model.ner12_merge_addresses, model.ner13_merge_persons])
def test_customers_of_addresses_are_dealt(spark, query):
    assert query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
