"""Queries and their SQL state the same rule on rows that the smallest tables lack."""

import datetime

import duckdb
import pytest

from quire import plans

HTML = '<html><body><nav><ul><li><a href="/a">A &amp; b</a></li></ul></nav><div class="ad">Ad</div><article><h1>{}</h1><p>One &amp; two.</p></article><footer>&copy; 2020</footer></body></html>'


def both(spark, folder, name, view):
    ours = plans.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"create view {view} as select * from '{folder}/{view}.parquet/*.parquet'")
    theirs = con.execute(f"select {', '.join(ours.columns)} from ({plans.SQL[name]})").fetchall()
    return sorted(map(tuple, ours.collect()), key=repr), sorted(theirs, key=repr)


@pytest.mark.parametrize("name", ["doc03_leaves", "rec02_profile"])
def test_cut_character_names(spark, tmp_path, name):
    heads = ["Salt &amp; pepper", "Salt &amp", "A &lt; b &gt", "Cut &am"]
    spark.createDataFrame([(i, HTML.format(h)) for i, h in enumerate(heads)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    ours, theirs = both(spark, tmp_path, name, "pages")
    assert ours == theirs
    assert [r[-1] for r in ours if "h1" in r] == ["Salt & pepper", "Salt &", "A < b >", "Cut &am"]


def test_generation_rounds_halves_to_even(spark, tmp_path):
    at = datetime.datetime(2024, 1, 30)
    rows = [(1, 1, at, "view", 2.5, '{"k": 2}'), (2, 2, at, "view", 3.5, '{"k": 4}'), (3, 3, at, "view", 0.5, '{"k": 1}')]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    ours, theirs = both(spark, tmp_path, "use14_sessions", "events")
    assert ours == theirs
    assert [r[-1] for r in ours] == ["live", "live", "superseded"]
