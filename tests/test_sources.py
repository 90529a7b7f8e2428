"""Readers and writers on files made here."""

import hashlib
import json
import zipfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F, types as T

from quire.functions.html import capture_nodes
from quire.operators import reports as R
from quire.operators import structure as D
from quire.sources import epub
from quire.sources import library as L

PACKAGE = """<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="one%20x.xhtml" media-type="application/xhtml+xml"/><item id="b" href="../img/p.png" media-type="image/png"/></manifest>
<spine><itemref idref="a"/><itemref idref="a"/></spine></package>"""
CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o/book.opf"/></rootfiles></container>'


def archive(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members:
            z.writestr(name, text)


@pytest.mark.filterwarnings("ignore:Duplicate name")
def test_epub(spark, tmp_path):
    good = [("META-INF/container.xml", CONTAINER), ("o/book.opf", PACKAGE), ("o/one x.xhtml", "<p>hi</p>"), ("img/p.png", "png")]
    archive(tmp_path / "good.epub", good)
    archive(tmp_path / "twice.epub", [*good, good[2]])
    archive(tmp_path / "lost.epub", good[:2])
    (tmp_path / "broken.epub").write_bytes(b"no zip")
    rows = epub.read_epub(spark, str(tmp_path))
    found = {(r.archive.rsplit("/", 1)[1], r.path): r for r in rows.collect()}
    assert found[("good.epub", "o/one x.xhtml")].ordinals == [0, 1] and bytes(found[("good.epub", "o/one x.xhtml")].content) == b"<p>hi</p>"
    assert found[("good.epub", "img/p.png")].media_type == "image/png"
    assert found[("twice.epub", None)].error == "member repeats"
    assert found[("lost.epub", None)].error and found[("broken.epub", None)].error
    assert epub.occurrences(rows).count() == 2


def test_contract(spark, tmp_path):
    lines = ['{"id": "a", "n": 1}', '{"id": "b", "n": 2, "more": 0}', '{"id": "c"}', '{"id": "d", "n": "x"}', "{broken"]
    (tmp_path / "rows.jsonl").write_text("\n".join(lines))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    rows, errors = L.read_contract(spark, str(tmp_path), schema)
    assert [tuple(r) for r in rows.collect()] == [("a", 1)]
    assert sorted((r.value[:9], r.reason) for r in errors.collect()) == [('{"id": "b', "other keys"), ('{"id": "c', "other keys"), ('{"id": "d', "not valid"), ("{broken", "not valid")]


def test_reports(spark, tmp_path):
    fields = ["source", "page", "kind", "quoted", "proposed"]
    content = R.claim_id(*[F.col(c) for c in fields])
    row = {"source": "s", "page": 1, "kind": "text", "quoted": "2 g", "proposed": "3 g"}
    right = hashlib.sha256("\x1f".join(str(row[c]) for c in fields).encode()).hexdigest()
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.json").write_text(json.dumps({**row, "report_id": right, "created_at": "2024-01-02T00:00:00Z"}))
    (tmp_path / "b.json").write_text(json.dumps({**row, "report_id": "forged", "created_at": "2024-01-01T00:00:00Z"}))
    assert [r.report_id for r in L.read_reports(spark, str(tmp_path), content).collect()] == [right]


def _publish(spark, path, **more):
    search = spark.createDataFrame([("a", 1, True), ("b", 2, False), ("b", 3, None), ("c", 4, True), (None, 5, True)], "source string, section long, searchable boolean")
    L.write_publication({"sections": spark.range(3), "search": search, **more}, path)


def test_publication_is_written_once(spark, tmp_path):
    path = str(tmp_path / "p")
    _publish(spark, path)
    assert L.read_publication(spark, path, "sections").count() == 3
    # Only what may be searched is there.
    assert sorted(r.section for r in L.read_publication(spark, path, "search").collect()) == [1, 4, 5]
    with pytest.raises(AnalysisException):
        _publish(spark, path)
    with pytest.raises(KeyError):
        L.read_publication(spark, path, "other")
    assert L.changed_tables(spark, path) == []
    spark.range(1).write.mode("append").parquet(f"{path}/sections")
    assert L.changed_tables(spark, path) == ["sections"]


def test_a_read_of_some_sources_opens_their_buckets(spark, tmp_path):
    path = str(tmp_path / "p")
    _publish(spark, path)
    rows = L.read_publication(spark, path, "search", ["a", "c"])
    assert sorted(r.section for r in rows.collect()) == [1, 4]
    assert "PartitionFilters: [" in rows._jdf.queryExecution().executedPlan().toString().replace("[]", "")


def test_a_half_written_publication_is_not_read(spark, tmp_path):
    path = str(tmp_path / "p")
    broken = spark.range(2).select(F.raise_error(F.lit("lost")).cast("string").alias("source"))
    with pytest.raises(Exception, match="lost"):
        _publish(spark, path, images=broken)
    for read in (L.read_manifest, lambda s, p: L.read_publication(s, p, "sections")):
        with pytest.raises(AnalysisException):
            read(spark, path)


def test_roundtrip(spark):
    pages = spark.createDataFrame([(1, "<p>a<b>b</b>c</p>"), (2, "<p>x</p>"), (3, "")], "page_id long, html string")
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    documents = spark.createDataFrame([(1, digest("abc")), (2, digest("other")), (3, digest(""))], "doc long, body_sha256 string")
    assert [r.doc for r in D.roundtrip(capture_nodes(pages), documents).orderBy("doc").collect()] == [2, 3]
