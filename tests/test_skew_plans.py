"""Plans of skewed joins that must not depend on Spark's estimates."""

from patientflow.plans.skew import salted_join


def test_repeated_rows_are_not_broadcast(spark):
    left, right = spark.range(50).selectExpr("id % 3 AS k", "id AS a"), spark.range(40).selectExpr("id % 4 AS k", "id AS b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        j = salted_join(left, right, ["k"])
        rows = sorted((r.k, r.a, r.b) for r in j.collect())
        assert "Broadcast" not in j._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == sorted((a % 3, a, b) for a in range(50) for b in range(40) if a % 3 == b % 4)
