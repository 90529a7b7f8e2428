"""Boxes of reports."""

from quire.operators import reports as R

RAW = "source string, page long, kind string, quoted string, proposed string, region array<double>"


def test_boxes(spark):
    boxes = [None, [0.0, 0.0, 1.0, 1.0], [0.1, 0.1, 0.13, 0.2], [0.1, 0.1, 0.119, 0.2], [0.2, 0.1, 0.1, 0.2], [0.0, 0.0, 1.1, 1.0], [-0.1, 0.0, 1.0, 1.0], [0.1, 0.2], [0.1, None, 0.5, 0.6], [], [0.3, 0.3, 0.3, 0.6]]
    raw = spark.createDataFrame([("s", 1, "text", "one", "two", b) for b in boxes], RAW)
    texts = spark.createDataFrame([("s", 1, "has one line")], "source string, page long, text string")
    got = R.intake_reports(raw, texts).collect()
    reasons = {str(r.region): r.reason for r in got}
    assert [reasons[str(b)] for b in boxes] == [None, None, None, "box too small", *["no box"] * 7]
    # The box is part of what is claimed.
    assert len({r.report_id for r in got}) == len(boxes)
