"""EPUB archives: a row per document of the package, with media type, reading order and bytes."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

MOST_MEMBER, MOST_ARCHIVE = 32 << 20, 4 << 30
SCHEMA = "archive string, path string, media_type string, ordinals array<int>, size long, content binary, error string"
_CONTAINER = "{urn:oasis:names:tc:opendocument:xmlns:container}rootfile"
_OPF = "{http://www.idpf.org/2007/opf}"


def members(name: str, raw: bytes) -> list[tuple]:
    """Rows of one archive; an archive that breaks a rule gives one row with the reason."""
    try:
        if len(raw) > MOST_ARCHIVE:
            raise ValueError("archive too large")
        with zipfile.ZipFile(io.BytesIO(raw)) as archive:
            infos = archive.infolist()
            names = [i.filename for i in infos]
            if len(set(names)) < len(names):
                raise ValueError("member repeats")
            if any(i.file_size > MOST_MEMBER for i in infos):
                raise ValueError("member too large")
            package = ElementTree.fromstring(archive.read("META-INF/container.xml")).find(f".//{_CONTAINER}").attrib["full-path"]
            tree = ElementTree.fromstring(archive.read(package))
            folder = posixpath.dirname(package)
            items = {i.attrib["id"]: (posixpath.normpath(posixpath.join(folder, unquote(i.attrib["href"]))), i.attrib.get("media-type")) for i in tree.iter(f"{_OPF}item")}
            order: dict[str, list[int]] = {}
            for k, ref in enumerate(tree.iter(f"{_OPF}itemref")):
                order.setdefault(items[ref.attrib["idref"]][0], []).append(k)
            rows = []
            for path, kind in items.values():
                data = archive.read(path)
                rows.append((name, path, kind, order.get(path, []), len(data), data, None))
            return rows
    except (ValueError, KeyError, AttributeError, zipfile.BadZipFile, ElementTree.ParseError) as problem:
        return [(name, None, None, [], len(raw), None, str(problem) or type(problem).__name__)]


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """The members of all archives under a path; an archive is read by one task."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, raw in zip(batch["path"], batch["content"]):
                yield pd.DataFrame(members(name, raw), columns=columns)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.epub").load(path)
    return files.select("path", "content").mapInPandas(run, SCHEMA)


def occurrences(members: DataFrame) -> DataFrame:
    """archive, ordinal, path: the reading order, in which a document may come twice."""
    return members.select("archive", F.explode("ordinals").alias("ordinal"), "path")
