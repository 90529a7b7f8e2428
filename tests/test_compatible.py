"""Compatibility composition, in Python only where it can change a text."""

import unicodedata

from pyspark.sql import functions as F

from quire.functions.text import nfkc


def test_compatible_forms(spark):
    texts = ["plain", "é à “x” – ñ", "é", "½ cup", "ﬁ", "가", "a b", "ŀ", "x‑y", "…", "𝐀", "á̧", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", nfkc(F.col("t")).alias("n"))
    assert [(r.t, r.n) for r in rows.collect()] == [(t, t if t is None else unicodedata.normalize("NFKC", t)) for t in texts]
    # The Python step is given what remains of a condition, not every text.
    assert "octet_length" in rows._jdf.queryExecution().optimizedPlan().toString()
