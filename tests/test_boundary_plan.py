"""Texts of scanned lines move once: selections and links are made from blocks and regions that hold none."""

from quire import plans


def test_texts_move_once(spark):
    for name in ("trn17_selections", "trn17_links"):
        plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "heading" not in plan and "STEP" not in plan and r"(\d+)[.)]" not in plan
