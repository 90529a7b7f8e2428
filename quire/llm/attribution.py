"""Token counts by section, from offsets of tokens in the whole document.

A document is encoded once, as a whole. Each token has a character span; a
section has one too. Spans are joined as intervals: the sections that a
token's first and last characters lie in. A token inside one section counts
there; one that crosses a boundary is allocated by an explicit rule:

    "start"     the section of its first character
    "majority"  the section with most of its characters, the earlier of equals
    "share"     every section, by its part of the characters

A token whose bytes end inside a character covers that character too; the
shares of a document's tokens sum to their number under every rule.

Sections are the lines of the text; a line's "\\n" belongs to it. Defined
results: a null or empty text has no sections; repeated rows give equal rows;
a null id keeps its rows; texts of any length are encoded whole. An empty table
gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import _encoder, _shared


def line_starts(raw: np.ndarray) -> np.ndarray:
    """First bytes of the lines of a text that isn't empty."""
    ends = np.flatnonzero(raw[:-1] == 10) + 1
    return np.concatenate([[0], ends])


def allocate(sizes: np.ndarray, raw: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, characters) of each section; sizes: bytes of the tokens, starts: first bytes of the sections."""
    heads = (raw & 0xC0) != 0x80
    char = np.cumsum(heads) - 1  # the character that each byte lies in
    n_chars = int(heads.sum())
    edges = char[starts]
    length = np.diff(np.append(edges, n_chars))
    ends = np.cumsum(sizes)
    first, last = char[ends - sizes], char[ends - 1]
    one = np.searchsorted(edges, first, "right") - 1
    two = np.searchsorted(edges, last, "right") - 1
    out = np.bincount(one[one == two], minlength=len(starts)).astype(float)
    for i in np.flatnonzero(one != two):
        sections = np.arange(one[i], two[i] + 1)
        held = np.minimum(np.append(edges, n_chars)[sections + 1], last[i] + 1) - np.maximum(edges[sections], first[i])
        if rule == "start":
            out[one[i]] += 1
        elif rule == "majority":
            out[sections[np.argmax(held)]] += 1
        else:
            out[sections] += held / held.sum()
    return out, length


def section_tokens(docs: DataFrame, ranks: str, pattern: str, rule: str = "majority", by_space: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, section, n_chars, n_tokens: a row per section of every document."""
    if rule not in ("start", "majority", "share"):
        raise ValueError(f"no such rule: {rule}")
    raw = _shared(docs, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(raw.value, pattern, by_space)
        length = coder.vocabulary.sizes
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ids, sections, chars, tokens = [], [], [], []
            for name, text, found in zip(names, texts, coder.encode(texts)):
                if not text:
                    continue
                data = np.frombuffer(text.encode(), np.uint8)
                count, size = allocate(length[found], data, line_starts(data), rule)
                ids += [name] * len(count)
                sections.append(np.arange(len(count)))
                chars.append(size)
                tokens.append(count)
            if ids:
                columns = [pa.array(np.concatenate(x)) for x in (sections, chars, tokens)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], names=["doc_id", "section", "n_chars", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, section long, n_chars long, n_tokens double")
