"""Sections over the pages of a book: continuations, owned footers and graphics.

A block of a page goes on with an earlier section or opens a new one. What it
may go on with lies at most NEAR pages back, so a book is cut into islands at
wider gaps, and islands are read in order with the sections of the last pages
as state: their plain titles, last pages and kinds, and the words of untitled
ones on the page before. Texts don't stay longer.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions.islands import CHUNK, before, meet, with_islands

#: Pages over which a title is looked for and a continuation goes, a repeated title's pages without a sign of continuation, likeness, kinds of sections, parts that hold no words of a section.
NEAR, CARRY, AGAIN, LIKE = 8, 3, 2, 0.88
KINDS = ("recipe", "passage", "chapter", "reference_entry", "menu")
WORDLESS = ("footer", "graphic")


def plain(text: str | None) -> str:
    """Lower-case letters and digits of ASCII, without accents, in words."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text or "").casefold() if not unicodedata.combining(c))
    return " ".join(re.findall(r"[a-z0-9]+", bare))


def similar(a: str, b: str) -> bool:
    if a == b:
        return True
    found = SequenceMatcher(None, a, b)
    return found.real_quick_ratio() >= LIKE and found.quick_ratio() >= LIKE and found.ratio() >= LIKE


@dataclass
class _Open:
    """A section that later pages may go on with."""

    first: int
    opening: int
    slug: str
    kind: str
    name: str = ""
    last: int = 0
    wordless: bool = True
    #: Plain words on its last page, while it has no title.
    words: list[str] = field(default_factory=list)


class _Shelf:
    """Open sections of an island in the order of their opening, and those of each recent page in the order in which they came to it."""

    def __init__(self):
        self.open: list[_Open] = []
        self.pages: dict[int, list[_Open]] = {}
        self.openings = 0

    def turn(self, page: int) -> None:
        """A new page: what is out of reach goes."""
        self.open = [s for s in self.open if page - s.last <= NEAR]
        self.pages = {p: own for p, own in self.pages.items() if page - p <= CARRY} | {page: []}
        self.openings = 0

    def titled_late(self, page: int, name: str) -> _Open | None:
        """An untitled section of the page before that has the title's words: its title was printed there."""
        return next((s for s in reversed(self.pages.get(page - 1, [])) if not s.name and name in " ".join(s.words)), None)

    def titled_alike(self, page: int, name: str, continues: bool) -> _Open | None:
        """The last section with a like title; without a sign of continuation it has to be close."""
        near = (s for s in reversed(self.open) if s.name and (continues or page - s.last <= AGAIN))
        return next((s for s in near if similar(s.name, name)), None)

    def carried(self, page: int, name: str) -> _Open | None:
        """The last section, no chapter if there is another, of the nearest page before that has one. A title doesn't go on with a mere picture or folio."""
        own = next((self.pages[p] for p in range(page - 1, page - 1 - CARRY, -1) if self.pages.get(p)), [])
        last = next((s for s in reversed(own) if s.kind != "chapter"), own[-1] if own else None)
        return None if last is None or (name and not last.name and last.wordless) else last

    def place(self, page: int, title: str | None, kind: str | None, part: str, continues: bool, text: str | None) -> tuple[_Open, bool]:
        """The section of a block, and whether it is a new one."""
        name, found = plain(title), None
        if part in WORDLESS:
            found = self.pages[page][-1] if self.pages[page] else None
        else:
            if name and continues and (found := self.titled_late(page, name)):
                found.name = name
            if name and not found:
                found = self.titled_alike(page, name, continues)
            if continues and not found:
                found = self.carried(page, name)
        new = found is None
        if new:
            found = _Open(page, self.openings, name.replace(" ", "-")[:60] or f"untitled-p{page:03d}", kind if kind in KINDS and part not in WORDLESS else "passage", name)
            self.openings += 1
            self.open.append(found)
        if found.last != page:
            found.words = []
        found.last = page
        found.wordless &= part in WORDLESS
        if not found.name:
            found.words.append(plain(text))
        if not any(s is found for s in self.pages[page]):
            self.pages[page].append(found)
        return found, new


def assemble(pages: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sections, parts, page_sections) of books.

    pages: book, page. blocks: book, page, n, title, kind, part, continues, text.
    sections: book, section, title, kind, first_page, last_page, pages.
    parts: book, section, page, n, part, text; every block is one, and a page without blocks is a graphic.
    page_sections: book, page, pos, section, in the order in which they come to the page.

    Footers come after the page's other blocks and belong to its last section. A section's name is
    its title's, or its page's, with a number from the second such section of the book on.

    Defined results: a null title, kind or part is none, a passage, a text; a null sign of continuation is no sign;
    blocks of unknown pages and null books or pages are left out; of blocks with one number the text decides the order.
    """
    own = blocks.select("book", F.col("page").cast("long").alias("page"), F.col("n").cast("long").alias("n"), F.nullif(F.trim("title"), F.lit("")).alias("title"), "kind", F.coalesce("part", F.lit("text")).alias("part"), F.coalesce("continues", F.lit(False)).alias("continues"), "text")
    known = pages.where("book is not null and page is not null").select("book", F.col("page").cast("long").alias("page")).distinct()
    rows = known.join(own, ["book", "page"], "left").withColumn("part", F.coalesce("part", F.lit("graphic")))
    rows = with_islands(rows, "book", "page", NEAR + 1).withColumn("late", (F.col("part") == "footer").cast("int"))
    order = ["page", "late", F.col("n").asc_nulls_first(), "text"]
    rows = rows.repartition("book", "island").sortWithinPartitions("book", "island", *order)
    rows = rows.select("book", "island", "page", "n", "title", "kind", "part", "continues", "text")
    schema = "book string, page long, n long, part string, text string, title string, kind string, first long, opening long, slug string, opens boolean, pos long"
    form = to_arrow_schema(T.StructType.fromDDL(schema))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, shelf, at = None, _Shelf(), None
        for batch in batches:
            out = []
            for book, island, page, n, title, kind, part, continues, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (book, island) != here:
                    here, shelf, at = (book, island), _Shelf(), None
                if page != at:
                    at = page
                    shelf.turn(page)
                section, new = shelf.place(page, title, kind, part, bool(continues), text)
                named = title if section.name and section.name == plain(title) else None
                pos = next(i for i, s in enumerate(shelf.pages[page], 1) if s is section)
                out.append((book, page, n, part, text, named, section.kind, section.first, section.opening, section.slug, new, pos))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), form)] if out else [pa.array([], f.type) for f in form], schema=form)

    placed = rows.mapInArrow(scan, schema)
    opened = placed.where("opens").select("book", "slug", "first", "opening", F.floor(F.col("first") / (NEAR + 1) / CHUNK).alias("chunk"))
    numbered = before(opened, ["book", "slug"], "chunk", ["first", "opening"], {"k": F.lit(1)}, F.sum).select("book", "first", "opening", "k")
    named = meet(placed, numbered, ["book", "first", "opening"], "inner").withColumn("section", F.when(F.col("k") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", "k")))
    title = F.min_by("title", F.when(F.col("title").isNotNull(), F.struct("page", "n")))
    sections = named.groupBy("book", "section").agg(title.alias("title"), F.first("kind").alias("kind"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.countDistinct("page").alias("pages"))
    page_sections = named.groupBy("book", "page", "section").agg(F.min("pos").alias("pos")).select("book", "page", "pos", "section")
    return sections, named.select("book", "section", "page", "n", "part", "text"), page_sections
