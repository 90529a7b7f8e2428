"""The stored index finds what a search over the fresh index finds, and opens fewer blocks."""

import random
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quire.functions import text as T
from quire.operators import search as S, stored_index as I

WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="module")
def sections(spark):
    rng = random.Random(3)
    rows = [(i * 3, " ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 40))), rng.choice(["en", "de"])) for i in range(400)]
    rows += [(5000, None, "en"), (5001, "", "en"), (5002, "Été à Łódź w1", "en")]
    return spark.createDataFrame(rows, "doc long, text string, lang string").repartition(3)


@pytest.fixture(scope="module")
def queries(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.sample(WORDS, rng.randint(1, 4)))) for i in range(40)] + [(90, "w0 w1"), (91, "w0 nowhere"), (92, ""), (93, None), (94, "ete w1")]
    return spark.createDataFrame(rows, "query_id long, query string")


def stored(spark, sections, tmp, **layout):
    path = f"{tmp}/{uuid.uuid4().hex}"
    I.write_index(sections, path, layout=I.Layout(**layout))
    return I.read_index(spark, path)


def rows_of(df):
    return sorted(map(tuple, df.select("query_id", "doc", "score", "pos", "next_offset").collect()))


@pytest.mark.parametrize("layout", [dict(buckets=4, block=8, ahead=1), dict(buckets=1, block=1000), dict(buckets=64, block=1, ahead=2)])
def test_same_hits(spark, sections, queries, tmp_path, layout):
    index, fresh = stored(spark, sections, tmp_path, **layout), S.build_index(sections)
    visible = S.scope(sections, lang="en")
    for limit, offset in ((3, 0), (5, 4)):
        assert rows_of(I.search(queries, index, visible, limit, offset)) == rows_of(S.search(queries, fresh, visible, limit, offset))
    assert rows_of(I.search_any(queries, index, ["w3"], 4)) == rows_of(S.search_any(queries, fresh, ["w3"], 4))


def test_blocks_are_skipped(spark, sections, tmp_path):
    index = stored(spark, sections, tmp_path, buckets=4, block=4, ahead=2)
    queries = spark.createDataFrame([(1, "w0 w50")], "query_id long, query string")
    terms = S.query_terms(queries)
    wanted = terms.join(index.terms, "term").select("query_id", "bucket", "term", "n_terms", "idf")
    runs = I.bounded_runs(wanted, index.blocks, False)
    last = rows_of(I.search_any(queries, index, [], 3))[-1]
    could = runs.where(F.col("bound") <= last[2]).count()
    assert 0 < could < runs.count() / 2


def test_a_search_reads_its_partitions(spark, sections, tmp_path):
    index = stored(spark, sections, tmp_path, buckets=32)
    terms = S.query_terms(spark.createDataFrame([(1, "w0")], "query_id long, query string"))
    plan = I.top_hits(terms, index, True, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket")
    heads = I.bounded_runs(terms.withColumn("bucket", I._bucket(index.layout)).withColumn("idf", F.lit(1.0)), index.blocks, True)
    assert "impacts" not in heads._jdf.queryExecution().executedPlan().toString()


def test_nothing(spark, sections, queries, tmp_path):
    index = stored(spark, sections.limit(0), tmp_path)
    assert I.search(queries, index, None, 5).count() == 0
    full = stored(spark, sections, tmp_path)
    assert I.search(queries.limit(0), full, None, 5).count() == 0


def test_an_unfinished_index_is_not_read(spark, sections, tmp_path):
    S.build_index(sections).counts.write.parquet(f"{tmp_path}/half/counts")
    with pytest.raises(AnalysisException):
        I.read_index(spark, f"{tmp_path}/half")


def test_expansions_come_after_a_querys_own_words(spark, sections):
    queries = spark.createDataFrame([(1, "w9")], "query_id long, query string")
    more = spark.createDataFrame([("w9", f"a{i:02}") for i in range(60)], "term string, extra string")
    assert S.search_any(queries, S.build_index(sections), [], 5, more).count() == 5


def test_accents(spark):
    rng = random.Random(1)
    places = [(0x20, 0x250), (0x300, 0x370), (0x370, 0x2000), (0xAC00, 0xD7A3), (0x3000, 0x9FFF), (0x1D100, 0x1D200)]
    texts = ["".join(chr(rng.randrange(*rng.choice(places))) for _ in range(20)) for _ in range(400)] + [None, "", "abc", "한글 Été"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.strip_accents(F.col("t")).alias("bare")).collect()
    assert all(r["bare"] == (None if r["t"] is None else T._bare(r["t"])) for r in got)


def test_a_posting_moves_once_for_all_queries(spark, sections, queries, tmp_path):
    index, fresh = stored(spark, sections, tmp_path, buckets=4, block=16), S.build_index(sections)
    for every in (True, False):
        terms = S.query_terms(queries)
        hits = I.top_hits(terms, index, every, 3, sections.where("doc % 2 = 0"))
        assert "Join [query_id" not in hits._jdf.queryExecution().executedPlan().toString()
        slow = sorted((r["query_id"], r["score"], r["doc"]) for r in S._score_pairs(terms, fresh, every, sections.where("doc % 2 = 0")).collect())
        got = sorted((r["query_id"], r["score"], r["doc"]) for r in hits.collect())
        first = lambda rows: [r for i, r in enumerate(rows) if i < 3 or rows[i - 3][0] != r[0]]
        assert first(got) == first(slow)
        joined = sorted((r["query_id"], r["score"], r["doc"]) for r in I._joined_hits(terms, index, every, 3, sections.where("doc % 2 = 0")).collect())
        assert first(joined) == first(slow)


def test_blocks_of_runs_over_batches():
    rows = [(1, ["a", "b"], ["a"]), (2, [], []), (3, [], ["b", "b"]), (3, ["c"], []), (4, ["a"], ["a"]), (9, ["c"], []), (9, [], ["c", "a"])]
    kind = pa.list_(pa.string())
    whole = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], kind)], names=["doc", "words_0", "words_1"])
    want = {
        (7, "a"): [(1, 6.0, 3)], (7, "b"): [(1, 5.0, 3), (3, 2.0, 3)], (7, "c"): [(3, 5.0, 3)], (7, None): [(1, 0.0, 3), (3, 0.0, 3)],
        (8, "a"): [(4, 6.0, 2), (9, 1.0, 3)], (8, "c"): [(9, 6.0, 3)], (8, None): [(4, 0.0, 2), (9, 0.0, 3)],
    }
    for step in (1, 2, 3, 7):
        found = [r for b in I._run_blocks((whole.slice(i, step) for i in range(0, 7, step)), [5.0, 1.0], 2, 7) for r in b.to_pylist()]
        assert {(r["run"], r["term"]): list(zip(r["docs"], r["tfs"], r["lengths"])) for r in found} == want and len(found) == len(want)
