"""The keyed stream with more rules than travel with its function."""

import random

import pytest
from test_stateful import PAGES, RULES, documents

from veilspan.plans import rulebook
from veilspan.streaming import progressive, stateful


def test_stored_rules_are_found_by_their_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "FILE_RULES", 20)
    rows = [("suppress", f"é{k}", None) for k in range(0, 300, 2)] + [("override", f"é{k}", f"L{k}") for k in range(0, 300, 3)] + [("override", None, "N"), ("suppress", "", None)]
    stored = stateful.store_rules(spark.createDataFrame(rows, RULES), str(tmp_path / "rules"))
    assert stored._buckets == 12
    suppressed, labels = {n for k, n, _ in rows if k == "suppress"}, {n: x for k, n, x in rows if k == "override"}
    for norm in [*(f"é{k}" for k in range(310)), "", None, "x"]:
        assert (norm in stored) == (norm in suppressed) and stored.get(norm, "own") == labels.get(norm, "own")


@pytest.mark.parametrize("most", [3, 1])
def test_any_number_of_rules_gives_the_same_spans(spark, tmp_path, most):
    pages = documents(random.Random(8))
    rules = spark.createDataFrame([("suppress", "lefebvre", None), ("override", "anderson", "ORGANIZATION"), ("suppress", "du*pont_", None), ("force", "vu", "DATE")], RULES)
    spark.createDataFrame(pages, PAGES).write.parquet(f"{tmp_path}/in")
    found = []
    for most_rules in (stateful.MOST_RULES, most):
        base = f"{tmp_path}/{most_rules}"
        stateful.start(spark.readStream.schema(PAGES).parquet(f"{tmp_path}/in"), f"{base}/out", f"{base}/checkpoint", rulebook._name_spans, rules, most_rules=most_rules).awaitTermination()
        found.append(sorted(map(repr, spark.read.schema(progressive.STEP).parquet(f"{base}/out").collect())))
    assert found[0] == found[1] and any("ORGANIZATION" in r for r in found[0]) and not any("norm_text='lefebvre'" in r for r in found[0])
