"""Ordered folds by islands and chunks give what a scan of each whole key gives."""

import random
import re
import unicodedata
from collections import Counter, defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quire.functions.islands import with_islands
from quire.operators import consensus as C
from quire.operators import reports as R

START = datetime(2024, 1, 1)


def by_key(rows):
    keys = defaultdict(list)
    for row in rows:
        keys[row[0]].append(row[1:])
    return keys


def scan_limit(rows, most, seconds):
    out = set()
    for key, events in by_key(rows).items():
        held = []
        for id_, at in sorted(events, key=lambda e: (e[1], e[0])):
            held = [h for h in held if (at - h).total_seconds() < seconds]
            out.add((key, id_, len(held) < most))
            if len(held) < most:
                held.append(at)
    return out


def scan_sections(rows, near=8):
    out = []
    for book, pages in by_key(rows).items():
        held, slugs = [], Counter()
        for page, title in sorted((p, t or "") for p, t in pages):
            name = C.key_of(title)
            found = next((i for i in range(len(held) - 1, -1, -1) if page - held[i][1] <= near and C.alike(held[i][0], name)), None)
            if found is None:
                slug = re.sub(r"[^a-z0-9]+", "-", unicodedata.normalize("NFKD", title).encode("ascii", "ignore").decode().lower()).strip("-")[:60] or f"page-{page}"
                slugs[slug] += 1
                held.append((name, page, slug if slugs[slug] == 1 else f"{slug}-{slugs[slug]}"))
                found = len(held) - 1
            else:
                held[found] = (held[found][0], page, held[found][2])
            out.append((book, page, held[found][2]))
    return sorted(out)


def scan_personal(rows, most):
    out = set()
    for owner, ops in by_key(rows).items():
        places, seen, revision = set(), {}, 0
        for seq, op, kind, place in sorted(ops):
            if op in seen:
                result = "repeated" if seen[op] == (kind, place) else "conflict"
            else:
                seen[op] = (kind, place)
                if kind == "save" and place not in places and len(places) >= most:
                    result = "full"
                else:
                    changed = (place not in places) == (kind == "save")
                    (places.add if kind == "save" else places.discard)(place)
                    revision += changed
                    result = "done" if changed else "same"
            out.add((owner, seq, result, revision))
    return out


def plan(df):
    return df._jdf.queryExecution().toString()


def test_islands(spark):
    at = [-30, -21, -12, 0, 8, 9, 17, 18, 27, 40, 50_000, 50_009]
    rows = spark.createDataFrame([(1, x) for x in at] + [(None, 3), (None, 11), (2, None)], "k long, at long")
    got = {(r.k, r.at): r.island for r in with_islands(rows, "k", "at", 9).collect()}
    assert got == {(1, -30): -30, (1, -21): -21, (1, -12): -12, (1, 0): 0, (1, 8): 0, (1, 9): 0, (1, 17): 0, (1, 18): 0, (1, 27): 27, (1, 40): 40, (1, 50_000): 50_000, (1, 50_009): 50_009, (None, 3): 3, (None, 11): 3, (2, None): None}


def test_rolling_limit_by_islands(spark):
    draw = random.Random(1)
    rows = [(0 if draw.random() < 0.6 else draw.randrange(1, 6), i, START + timedelta(seconds=draw.randrange(200_000))) for i in range(3000)]
    rows += [(9, 5000 + i, START + timedelta(seconds=600 * i)) for i in range(50)]
    for most, seconds in ((1, 600), (3, 120), (2, 7200)):
        df = R.rolling_limit(spark.createDataFrame(rows, "user long, id long, at timestamp"), "user", most, seconds)
        assert {(r.user, r.id, r.admitted) for r in df.collect()} == scan_limit(rows, most, seconds)
        assert df.count() == len(rows)
    assert "FlatMapGroups" not in plan(df)


def test_sections_by_islands(spark):
    draw = random.Random(2)
    titles = ["Breads and rolls", "Breads and rollz", "Breads und rolls", "Soups", "Soup", "Été", None, "!!", "Cold sauces of the house", "Cold sauces of the horse"]
    rows = [("hot" if draw.random() < 0.5 else f"b{draw.randrange(3)}", draw.randrange(4000), draw.choice(titles)) for _ in range(1500)]
    df = C.assemble_sections(spark.createDataFrame(rows, "book string, page long, title string"))
    assert sorted(map(tuple, df.collect())) == scan_sections(rows)
    assert "FlatMapGroups" not in plan(df)


def test_personal_by_chunks(spark, monkeypatch):
    monkeypatch.setattr(C, "PART", 70)
    draw = random.Random(3)
    rows = [(0 if draw.random() < 0.5 else draw.randrange(1, 5), i * 3, draw.randrange(900), "remove" if draw.random() < 0.3 else "save", draw.randrange(12)) for i in range(2000)]
    rows += [(7, 9000 + i, i, "save" if i % 2 == 0 else "remove", i // 2) for i in range(40)]
    for most in (1, 7, 12):
        df = C.fold_personal(spark.createDataFrame(rows, "owner long, seq long, op long, kind string, place long"), most)
        got = list(map(tuple, df.collect()))
        assert set(got) == scan_personal(rows, most) and len(got) == len(rows)
    assert any(r[2] == "full" for r in scan_personal(rows, 7))
    assert "FlatMapGroups" not in plan(df)
