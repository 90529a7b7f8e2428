"""HTML documents to node rows, with the standard library's parser inside mapInPandas."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

NAV_SCHEMA = "doc long, ordinal int, id string, parent string, kind string, label string, href string"
NODE_SCHEMA = "doc long, id string, parent string, child_ordinal int, preorder int, subtree_end int, kind string, tag string, slot string, anchor string, class string, href string, text string"
#: Elements without an end tag, and elements that a same sibling closes.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


class _Tree(HTMLParser):
    """Nodes in document order; an element's interval ends with its last descendant."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[int] = []
        self.children: dict[int, int] = {}

    def _add(self, kind: str, **more) -> int:
        parent = self.open[-1] if self.open else -1
        k = self.children.get(parent, 0)
        self.children[parent] = k + 1
        i = len(self.rows)
        self.rows.append({"parent": parent, "child_ordinal": k, "preorder": i, "subtree_end": i, "kind": kind, **more})
        return i

    def handle_starttag(self, tag, attrs):
        while self.open and self.rows[self.open[-1]]["tag"] in CLOSES.get(tag, ()):
            self._close()
        held = dict(attrs)
        i = self._add("element", tag=tag, anchor=held.get("id"), cls=held.get("class"), href=held.get("src" if tag == "content" else "href"), role=held.get("epub:type"))
        if tag not in VOID:
            self.open.append(i)

    def handle_startendtag(self, tag, attrs):
        before = len(self.open)
        self.handle_starttag(tag, attrs)
        while len(self.open) > before:
            self._close()

    def _close(self):
        i = self.open.pop()
        self.rows[i]["subtree_end"] = len(self.rows) - 1

    def handle_endtag(self, tag):
        if any(self.rows[i]["tag"] == tag for i in self.open):
            while self.rows[self.open[-1]]["tag"] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if data:
            tail = self.children.get(self.open[-1] if self.open else -1, 0) > 0
            self._add("text", tag=None, text=data, slot="tail" if tail else "text")

    def handle_comment(self, data):
        self._add("comment", tag=None, text=None)


def _parsed(html: str | None) -> list[dict]:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    while tree.open:
        tree._close()
    return tree.rows


def capture(doc: int, html: str | None) -> list[tuple]:
    name = lambda i: f"{doc}:{i}" if i >= 0 else None
    return [
        (doc, name(r["preorder"]), name(r["parent"]), r["child_ordinal"], r["preorder"], r["subtree_end"], r["kind"], r["tag"], r.get("slot"), r.get("anchor"), r.get("cls"), r.get("href"), r.get("text"))
        for r in _parsed(html)
    ]


def capture_nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The node table of every document: preorder intervals, parents, text slots; one document at a time."""
    columns = [c.split()[0] for c in NODE_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 50):
                part = batch.iloc[at : at + 50]
                rows = [r for doc, html in zip(part["doc"], part["html"]) for r in capture(doc, html)]
                yield pd.DataFrame(rows, columns=columns)

    return pages.select(F.col(id_col).alias("doc"), F.col(html_col).alias("html")).mapInPandas(run, NODE_SCHEMA)


#: What a part of the authored type of a nav element makes of it.
NAV_KINDS = {"toc": "toc", "landmarks": "landmark", "page-list": "page_list"}


def nav_entries(doc: int, html: str | None) -> list[tuple]:
    """Navigation of one document: items of nav elements and points of an ncx, with the entry above each.

    An item's label and target are its first link's, or the label is that of a
    span of its own; an item with neither is no entry and hands its parent on.
    """
    rows = _parsed(html)
    link: list[int | None] = [None] * (len(rows) + 1)
    own: dict[tuple[int, str], int] = {}
    for i in range(len(rows) - 1, -1, -1):
        r = rows[i]
        link[i] = i if r["tag"] == "a" and r.get("href") else link[i + 1]
        if r["tag"] in ("span", "navlabel", "content"):
            own[r["parent"], r["tag"]] = i

    def label(i: int | None) -> str:
        if i is None:
            return ""
        return " ".join("".join(r.get("text") or "" for r in rows[i : rows[i]["subtree_end"] + 1]).split())

    out: list[tuple] = []
    above: list[tuple[int, str]] = []
    kind, until = "", -1
    for i, r in enumerate(rows):
        while above and above[-1][0] < i:
            above.pop()
        if r["tag"] == "nav" and i > until:
            kind = next((k for part, k in NAV_KINDS.items() if part in (r.get("role") or "")), "other")
            until = r["subtree_end"]
        if r["tag"] == "li" and i <= until:
            a = link[i + 1]
            a = a if a is not None and a <= r["subtree_end"] else None
            at, target, what = (a if a is not None else own.get((i, "span"))), rows[a]["href"] if a is not None else "", kind
            if at is None:
                continue
        elif r["tag"] == "navpoint":
            at, what = own.get((i, "navlabel")), "ncx"
            target = (rows[own[i, "content"]].get("href") or "") if (i, "content") in own else ""
        else:
            continue
        out.append((doc, len(out), f"{doc}:{i}", above[-1][1] if above else None, what, label(at), target))
        above.append((r["subtree_end"], f"{doc}:{i}"))
    return out


def navigation(documents: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """doc, ordinal, id, parent, kind, label, href of navigation documents; `resolve_links` gives the targets and their state."""
    columns = [c.split()[0] for c in NAV_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 50):
                part = batch.iloc[at : at + 50]
                yield pd.DataFrame([r for doc, html in zip(part["doc"], part["html"]) for r in nav_entries(doc, html)], columns=columns)

    return documents.select(F.col(id_col).alias("doc"), F.col(html_col).alias("html")).mapInPandas(run, NAV_SCHEMA)
