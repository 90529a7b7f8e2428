"""Text of spans against a walk over the nodes."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import structure as D


@pytest.mark.parametrize("size", [1, 5, 4096])
def test_spans(spark, size):
    rng = random.Random(size)
    nodes, bounds, want = [], [], {}
    for doc in range(4):
        own = [(doc, -2, None, "first")]
        for pre in range(rng.randint(5, 30)):
            tag = rng.choice([None, None, "p", "img", "b", "br"])
            own.append((doc, pre * 2, tag, None if tag else rng.choice(["", "ab", "é日x", " long text here "])))
        nodes += own
        texts = [n for n in own if n[3] is not None]
        for k in range(6):
            span, out = f"{doc}-{k}", []
            for part in range(rng.randint(1, 2)):
                a, b = sorted(rng.choices(range(len(texts)), k=2))
                a, b = texts[a], texts[b]
                x, y = rng.randint(0, len(a[3])), rng.randint(0, len(b[3]))
                if a is b:
                    x, y = sorted((x, y))
                bounds.append((span, part, doc, a[1], x, b[1], y))
                body = ""
                for _, pre, tag, text in own:
                    if a[1] <= pre <= b[1]:
                        piece = text if text is not None else {"p": "\n", "br": "\n", "img": " [uninterpreted image] "}.get(tag, "")
                        body += piece[x if pre == a[1] else 0 : y if pre == b[1] else None]
                out.append(body)
            want[span] = "\n".join(out).strip()
    frame = spark.createDataFrame(nodes, "doc long, preorder int, tag string, text string").repartition(3)
    ends = spark.createDataFrame(bounds, "span string, part int, doc long, start_pre int, start_offset int, end_pre int, end_offset int")
    got = D.span_text(ends, frame, D.separators(F.col("tag")), size)
    assert {r.span: r.text for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join" in line and (">=" in line or "<=" in line) for line in plan.splitlines())
    assert D.span_text(ends.limit(0), frame).count() == 0
