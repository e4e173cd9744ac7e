"""Pairs of names, and rows that a foreign key would reject."""

from veilspan.operators import store
from veilspan.plans import scalars

SF = "/root/testdata/sf0.001"


def test_fuzzy_forms_are_made_before_the_pairs(spark):
    plan = scalars.fn06_similarity(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan[: plan.index("Join")], plan[plan.index("Join") :]
    assert "levenshtein" in above and "translate(" not in above and below.count("AS c_fuzzy") == below.count("AS s_fuzzy") == 1


def test_pairs_of_few_files_take_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for query in (scalars.fn06_similarity, scalars.fn07_levenshtein):
            assert query(spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_orphans_are_told_by_their_own_key(spark):
    """Whatever columns the parents have besides the key: here a parent's user is its own id."""
    children = spark.createDataFrame([(1, 100), (2, 3)], "event_id long, id long")
    parents = spark.createDataFrame([(3, 3), (10, 3)], "id long, user_id long")
    assert [tuple(r) for r in store.orphans(children, parents, "id").collect()] == [(100, 1)]
