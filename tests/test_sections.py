"""Sections over pages: goldens, and a plain scan of whole books."""

import random
import re
import unicodedata
from difflib import SequenceMatcher

from quire.operators import sections as S

PAGES = "book string, page long"
BLOCKS = "book string, page long, n long, title string, kind string, part string, continues boolean, text string"


def built(spark, pages, blocks):
    out = S.assemble(spark.createDataFrame(pages, PAGES).repartition(3), spark.createDataFrame(blocks, BLOCKS).repartition(2))
    return [sorted(map(tuple, df.collect()), key=repr) for df in out]


def test_titles_continuations_and_footers(spark):
    pages = [("b", p) for p in (1, 2, 3, 4, 5, 6, 20)]
    blocks = [
        ("b", 1, 1, "Bean Stew", "recipe", "ingredients", False, "2 cups beans"),
        ("b", 1, 2, None, None, "footer", False, "12"),
        ("b", 2, 1, None, None, "text", True, "and stir"),
        ("b", 2, 2, "Breads", "chapter", "text", None, "Breads"),
        ("b", 3, 1, None, "passage", "text", True, "goes on with the stew, not the chapter"),
        ("b", 4, 1, "Bean  STEW", "recipe", "text", False, "again"),
        ("b", 6, 1, "Late title", "recipe", "footer", False, "Late title"),
        ("b", 20, 1, "Bean Stew", "recipe", "text", True, "out of reach"),
    ]
    sections, parts, order = built(spark, pages, blocks)
    assert [(s[1], s[2], s[3], s[4], s[5], s[6]) for s in sections] == [
        ("bean-stew", "Bean Stew", "recipe", 1, 4, 4), ("bean-stew-2", "Bean Stew", "recipe", 20, 20, 1), ("breads", "Breads", "chapter", 2, 2, 1),
        ("late-title", "Late title", "passage", 6, 6, 1), ("untitled-p005", None, "passage", 5, 5, 1),
    ]
    assert ("b", 2, 1, "bean-stew") in order and ("b", 2, 2, "breads") in order
    assert [(p[1], p[2], p[4]) for p in parts if p[4] in ("footer", "graphic")] == [("bean-stew", 1, "footer"), ("late-title", 6, "footer"), ("untitled-p005", 5, "graphic")]


def test_a_title_printed_on_the_page_before(spark):
    blocks = [("b", 1, 1, None, None, "footer", False, "The  Soups\nof winter"), ("b", 2, 1, "Soups of Winter", "recipe", "text", True, "x"), ("b", 3, 1, None, None, "graphic", False, None), ("b", 4, 1, "Rye", "recipe", "text", True, "y")]
    sections, *_ = built(spark, [("b", p) for p in (1, 2, 3, 4)], blocks)
    # The soup's title names the folio page's section; rye doesn't go on with a picture.
    assert [(s[1], s[2], s[4], s[5]) for s in sections] == [("rye", "Rye", 4, 4), ("untitled-p001", "Soups of Winter", 1, 2), ("untitled-p003", None, 3, 3)]


def scan(pages, blocks):
    """All sections of a book, looked through without horizons being used to forget any."""
    norm = lambda s: " ".join(re.findall(r"[a-z0-9]+", "".join(c for c in unicodedata.normalize("NFKD", s or "").casefold() if not unicodedata.combining(c))))
    alike = lambda a, b: a == b or SequenceMatcher(None, a, b).ratio() >= 0.88
    out = []
    for book in sorted({b for b, _ in pages}):
        found, on, names = [], {}, {}
        for page in sorted({p for b, p in pages if b == book}):
            on[page] = []
            own = sorted((x for x in blocks if x[:2] == (book, page)), key=lambda x: (x[5] == "footer", x[2])) or [(book, page, None, None, None, "graphic", False, None)]
            for _, _, n, title, kind, part, goes, text in own:
                title, part, s = (title or "").strip(), part or "text", None
                if part in ("footer", "graphic"):
                    s = on[page][-1] if on[page] else None
                else:
                    if title and goes:
                        for q in reversed(on.get(page - 1, [])):
                            if not q["name"] and norm(title) in " ".join(norm(t) for p, t in q["texts"] if p == max(x for x, _ in q["texts"])):
                                s = q
                                s["name"] = norm(title)
                                break
                    if title and not s:
                        s = next((q for q in reversed(found) if q["name"] and page - q["last"] <= (8 if goes else 2) and alike(q["name"], norm(title))), None)
                    if goes and not s:
                        near = next((on[p] for p in (page - 1, page - 2, page - 3) if on.get(p)), [])
                        pick = [q for q in near if q["kind"] != "chapter"] or near
                        if pick and not (title and not pick[-1]["name"] and all(k in ("footer", "graphic") for k in pick[-1]["kinds"])):
                            s = pick[-1]
                if s is None:
                    base = norm(title).replace(" ", "-")[:60] or f"untitled-p{page:03d}"
                    names[base] = names.get(base, 0) + 1
                    plain_kind = kind if kind in S.KINDS and part not in ("footer", "graphic") else "passage"
                    s = {"id": base if names[base] == 1 else f"{base}-{names[base]}", "name": norm(title), "kind": plain_kind, "kinds": [], "texts": []}
                    found.append(s)
                s["last"] = page
                s["kinds"].append(part)
                s["texts"].append((page, text))
                if not any(q is s for q in on[page]):
                    on[page].append(s)
                out.append((book, s["id"], page, n, part, text))
    return sorted(out, key=repr)


def test_random_books(spark):
    rng = random.Random(6)
    titles = ["Rye bread", "Rye breads", "Soups", "Été", "Cold sauces of the house", "Cold sauces of the horse", None, None, None]
    pages = [(book, p) for book in ("x", "y") for p in sorted(rng.sample(range(1, 130), 70))] + [("x", 500)]
    blocks = []
    for book, page in pages:
        for n in range(rng.randint(0, 3)):
            part = rng.choice(["text", "text", "ingredients", "footer", None])
            blocks.append((book, page, n, rng.choice(titles), rng.choice(["recipe", "chapter", "odd", None]), part, rng.random() < 0.5, rng.choice(["rye bread", "soups and", "x"])))
    sections, parts, order = built(spark, pages, blocks)
    assert parts == scan(pages, blocks)
    assert len({(p[0], p[1]) for p in parts}) == len(sections)
    assert {(p[0], p[2], p[1]) for p in parts} == {(o[0], o[1], o[3]) for o in order}


def test_nothing_and_nulls(spark):
    assert built(spark, [], []) == [[], [], []]
    _, parts, _ = built(spark, [("b", 1), (None, 2), ("b", None)], [("b", 9, 1, "T", None, None, None, None), (None, 2, 1, "T", None, None, None, None)])
    assert parts == [("b", "untitled-p001", 1, None, "graphic", None)]
