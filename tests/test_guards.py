"""Plan guards: bounded broadcast and parallelism spreading."""

from quarry.plans.guards import guarded_broadcast, row_count_at_most, spread
from quarry.plans.inspect import plan_text


def test_guarded_broadcast_only_below_bound(spark):
    small = spark.range(10).withColumnRenamed("id", "k")
    big = spark.range(1000).withColumnRenamed("id", "k")
    assert row_count_at_most(small, 10) and not row_count_at_most(small, 9)
    fact = spark.range(100000).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan_text(fact.join(guarded_broadcast(small, 100), "k"))
        assert "BroadcastHashJoin" not in plan_text(fact.join(guarded_broadcast(big, 100), "k"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))


def test_spread_is_part_of_the_plan(spark):
    one = spark.range(100).coalesce(1)
    assert spread(one, "id", partitions=5).rdd.getNumPartitions() == 5
    runs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    plan = plan_text(spread(one, "id"))
    assert "REPARTITION_BY_NUM" in plan
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == runs  # planning runs no job
