"""Calls are counted by their seconds before anything is put in order."""

from quire.operators import review as V


def test_costs_order_values_alone(spark):
    calls = [("m", i, s, i % 3 == 0, 2.0, 1, 1) for i, s in enumerate([None, 1.0, 1.0, 2.0, 4.0, 9.0, 9.0])] + [("k", 1, 3.0, False, 1.0, 0, 0), ("k", 2, 4.0, False, 1.0, 0, 0), ("n", 1, None, True, 1.0, 0, 0)]
    prices = spark.createDataFrame([("m", 1.0, 0.5, 2.0), ("k", 1.0, 0.0, 0.0), ("n", 2.0, 0.0, 0.0)], "model string, fresh_price double, cached_price double, output_price double")
    found = V.cost_summary(spark.createDataFrame(calls, "model string, call long, seconds double, failed boolean, fresh double, cached long, output long"), prices)
    assert sorted(map(tuple, found.collect())) == [("k", 2, 0, 2.0, 3.5, 4.0), ("m", 7, 3, 31.5, 3.0, 9.0), ("n", 1, 1, 2.0, None, None)]
    assert "call#" not in found._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [model")[1].split("Aggregate [model")[0]
