"""Search queries over documents, parts and benchmark phrases."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.operators import search as S, stored_index as I

from .registry import SQL, query, shared_folder, table

WORDS = r"regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}_]+')"
POSTINGS = f"""
words as (select doc_id as doc, unnest({WORDS}) as term from documents),
postings as (select term, doc, count(*) as tf from words group by all),
stats as (select doc, sum(tf) as length from postings group by doc),
vocab as (select term, count(*) as df from postings group by term),
q as (select item_id as query_id, list_distinct({WORDS}) as words from benchmark),
terms as (select query_id, unnest(words) as term, len(words) as n_terms from q),
whole as (select count(*) as n_docs, avg(length) as avg_length from stats),
parts as (select query_id, doc, n_terms,
  case when ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n_docs - df + 0.5) / (df + 0.5)) end
  * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length)) as part
  from terms join vocab using (term) join postings using (term) join stats using (doc), whole),
scored as (select query_id, doc, round(-sum(part), 6) as score, count(*) as n, max(n_terms) as n_terms from parts group by query_id, doc)"""


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text", "lang", "source")


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark text, whole."""
    shared_folder(spark)
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"select doc_id, array_to_string({WORDS}, ' ') as words from documents")
def sea01_tokenize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(S.tokens(F.col("text")), " ").alias("words"))


@query(f"with words as (select doc_id as doc, unnest({WORDS}) as term from documents) select term, doc, count(*)::double as tf from words group by all")
def sea02_index(spark: SparkSession, d: str) -> DataFrame:
    return S.build_index(_sections(spark, d)).postings


#: Indexes that this driver has written, by application, folder and fields: the first query on a folder writes it, later ones read it.
_WRITTEN: dict[tuple, str] = {}


def _stored(spark: SparkSession, d: str, titled: bool = False) -> I.StoredIndex:
    key = spark.sparkContext.applicationId, d, titled
    if key not in _WRITTEN:
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        I.write_index(_titled(spark, d) if titled else _sections(spark, d), path, {"title": 5.0, "text": 1.0} if titled else None)
        _WRITTEN[key] = path
    return I.read_index(spark, _WRITTEN[key])


@query(f"""with words as (select doc_id as doc, unnest({WORDS}) as term from documents), df as (select term, count(distinct doc) as df from words group by 1), n as (select count(distinct doc) as n from words)
select term, df, df as postings, round(case when ln((n - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n - df + 0.5) / (df + 0.5)) end, 9) as idf from df, n""")
def sea02_stored(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the stored index, with the number of postings in their blocks."""
    index = _stored(spark, d)
    held = index.blocks.groupBy("bucket", "term").agg(F.sum("n").alias("postings"))
    return index.terms.join(held, ["bucket", "term"]).select("term", "df", "postings", F.round("idf", 9).alias("idf"))


@query(f"""with {POSTINGS},
visible as (select * from scored s join documents d on d.doc_id = s.doc where n = n_terms and d.lang = 'en'),
ranked as (select query_id, doc, score, row_number() over (partition by query_id order by score, doc) as pos, count(*) over (partition by query_id) as hits from visible)
select query_id, doc, score, pos, case when hits > 10 then 10 end as next_offset from ranked where pos <= 10""")
def sea03_search(spark: SparkSession, d: str) -> DataFrame:
    docs = _sections(spark, d)
    return S.search(_queries(spark, d), S.build_index(docs), S.scope(docs, lang="en"), limit=10).select("query_id", "doc", "score", "pos", "next_offset")


@query(None)
def sea03_stored(spark: SparkSession, d: str) -> DataFrame:
    """sea03_search on a stored index."""
    hits = I.search(_queries(spark, d), _stored(spark, d), S.scope(_sections(spark, d), lang="en"), limit=10)
    return hits.select("query_id", "doc", "score", "pos", "next_offset")


SQL["sea03_stored"] = SQL["sea03_search"]

TITLED = r"""
titled as (select doc_id as doc, split_part(text, chr(10), 1) as title, text from documents),
words as (select doc, unnest(regexp_extract_all(lower(strip_accents(title)), '[\p{L}\p{N}_]+')) as term, 5.0 as w from titled
  union all select doc, unnest(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}_]+')), 1.0 from titled),
postings as (select term, doc, sum(w) as tf, count(*) as n from words group by all),
stats as (select doc, sum(n) as length from postings group by doc),
vocab as (select term, count(*) as df from postings group by term)"""


def _titled(spark: SparkSession, d: str) -> DataFrame:
    return _sections(spark, d).withColumn("title", F.substring_index("text", "\n", 1))


@query(f"""with {TITLED},
q as (select item_id as query_id, {WORDS} as words from benchmark), o as (select query_id, unnest(words) as term, generate_subscripts(words, 1) as pos from q),
f as (select query_id, term, min(pos) as pos from o where term not in ('the', 'of', 'and') group by all), terms as (select query_id, term from f qualify row_number() over (partition by query_id order by pos) <= 40),
whole as (select count(*) as n_docs, avg(length) as avg_length from stats),
parts as (select query_id, doc,
  case when ln((n_docs - df + 0.5) / (df + 0.5)) <= 0 then 1e-6 else ln((n_docs - df + 0.5) / (df + 0.5)) end
  * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length)) as part
  from terms join vocab using (term) join postings using (term) join stats using (doc), whole),
scored as (select query_id, doc, round(-sum(part), 6) as score from parts group by query_id, doc),
ranked as (select *, row_number() over (partition by query_id order by score, doc) as pos, count(*) over (partition by query_id) as hits from scored)
select query_id, doc, score, pos, case when hits > 20 then 20 end as next_offset from ranked where pos <= 20""")
def sea04_search_any(spark: SparkSession, d: str) -> DataFrame:
    index = S.build_index(_titled(spark, d), {"title": 5.0, "text": 1.0})
    return S.search_any(_queries(spark, d), index, ["the", "of", "and"], limit=20).select("query_id", "doc", "score", "pos", "next_offset")


@query(None)
def sea04_stored(spark: SparkSession, d: str) -> DataFrame:
    """sea04_search_any on a stored index."""
    return I.search_any(_queries(spark, d), _stored(spark, d, True), ["the", "of", "and"], limit=20).select("query_id", "doc", "score", "pos", "next_offset")


SQL["sea04_stored"] = SQL["sea04_search_any"]


@query(f"""with {POSTINGS},
ranked as (select query_id, doc, score, row_number() over (partition by query_id order by score, doc) as pos from scored where n = n_terms),
held as (select r.*, md5(text) as span from ranked r join documents d on d.doc_id = r.doc where pos <= 50 and length(text) >= 40),
one as (select *, row_number() over (partition by query_id, span order by pos, doc) as k from held),
passage as (select query_id, doc, span, score, row_number() over (partition by query_id order by pos, doc) as passage from one where k = 1)
select * from passage where passage <= 10""")
def sea05_passages(spark: SparkSession, d: str) -> DataFrame:
    docs = _sections(spark, d)
    hits = S.search(_queries(spark, d), S.build_index(docs), None, limit=50)
    return S.passages(hits, docs.withColumn("span", F.md5("text")), limit=10)


@query(f"""with {TITLED.replace("from documents)", "from (select doc_id, replace(text, 'ß', 'ss') as text from documents))")},
q as (select item_id as query_id, list_distinct({WORDS}) as words from (select item_id, replace(text, 'ß', 'ss') as text from benchmark)),
terms as (select query_id, unnest(words) as term from q),
near as (select query_id, t.term, v.term as match, 1 - levenshtein(t.term, v.term) / greatest(length(t.term), 1) as gain from terms t
  join vocab v on left(v.term, 1) = left(t.term, 1) and abs(length(v.term) - length(t.term)) <= 2 where levenshtein(t.term, v.term) <= 2),
best as (select query_id, doc, near.term, max(gain * tf) as gain from near join postings p on p.term = match group by all),
by_doc as (select query_id, doc, sum(gain) as gain from best group by all),
by_target as (select query_id, source as target, round(max(gain), 6) as gain from by_doc join documents d on d.doc_id = doc group by all),
ranked as (select *, row_number() over (partition by query_id order by gain desc, target) as pos from by_target)
select * from ranked where pos <= 10""")
def sea06_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Sharp s is spelled out, as DuckDB counts the edits of bytes."""
    docs = _titled(spark, d).withColumns({c: F.replace(c, F.lit("ß"), F.lit("ss")) for c in ("title", "text")})
    index = S.build_index(docs, {"title": 5.0, "text": 1.0})
    targets = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("target"))
    queries = _queries(spark, d).withColumn("query", F.replace("query", F.lit("ß"), F.lit("ss")))
    return S.search_fuzzy(queries, index, targets, limit=10)


#: Hits of the relaxed search on English and German documents: each target's best document, of as many first words as are enough.
RELAXED = f"""{TITLED.replace("from documents)", "from (select doc_id, replace(text, 'ß', 'ss') as text from documents))")},
q as (select item_id as query_id, {WORDS} as words from (select item_id, replace(text, 'ß', 'ss') as text from benchmark)),
o as (select query_id, unnest(words) as term, generate_subscripts(words, 1) as at_word from q),
terms as (select query_id, term, row_number() over (partition by query_id order by min(at_word)) - 1 as place from o group by query_id, term),
near as (select query_id, place, v.term as match, 1 - levenshtein(t.term, v.term) / greatest(length(t.term), 1) as gain from terms t
  join vocab v on left(v.term, 1) = left(t.term, 1) and abs(length(v.term) - length(t.term)) <= 1 where levenshtein(t.term, v.term) <= 1),
shown as (select doc_id as doc, n_chars as target, source as edition, lang as kind from documents where lang in ('en', 'de') and doc_id % 10 > 0),
best as (select query_id, doc, place, max(gain * tf) as gain from near join postings p on p.term = match join shown using (doc) group by all),
run as (select *, row_number() over (partition by query_id, doc order by place) - 1 as n from best),
scored as (select query_id, doc, count(*) as words, round(sum(gain), 6) as gain from run where n = place group by all),
one as (select s.*, target, edition, kind from scored s join shown using (doc) qualify row_number() over (partition by query_id, target order by words desc, gain desc, doc) = 1),
upto as (select query_id, words, sum(count(*)) over (partition by query_id order by words desc) as upto from one group by query_id, words),
least as (select query_id, coalesce(max(words) filter (upto >= 5), 1) as least from upto group by 1),
hits as (select one.* from one join least using (query_id) where words >= least)"""


def _relaxed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sharp s is spelled out, as DuckDB counts the edits of bytes."""
    docs = _titled(spark, d).withColumns({c: F.replace(c, F.lit("ß"), F.lit("ss")) for c in ("title", "text")})
    state = F.when(F.col("doc_id") % 10 == 0, "candidate").otherwise("supported")
    units = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("n_chars").alias("target"), F.col("source").alias("edition"), F.col("lang").alias("kind"), state.alias("state"))
    queries = _queries(spark, d).withColumn("query", F.replace("query", F.lit("ß"), F.lit("ss")))
    index = S.build_index(docs, {"title": 5.0, "text": 1.0})
    return S.search_relaxed(queries, index, units, limit=5, offset=1, enough=5, edits=1, kinds=["en", "de"], candidates=False)


@query(f"""with {RELAXED}, ranked as (select *, row_number() over (partition by query_id order by words desc, gain desc, doc) as pos, count(*) over (partition by query_id) as n from hits)
select query_id, doc, target, words, gain, pos, case when n > 6 then 6 end as next_offset from ranked where pos between 2 and 6""")
def sea06_relaxed(spark: SparkSession, d: str) -> DataFrame:
    return _relaxed(spark, d)[0]


@query(f"with {RELAXED} select query_id, 'edition' as facet, edition as value, count(*) as n from hits group by all union all select query_id, 'kind', kind, count(*) from hits group by all")
def sea06_facets(spark: SparkSession, d: str) -> DataFrame:
    return _relaxed(spark, d)[1]


def _books(spark: SparkSession, d: str) -> DataFrame:
    """Parts as books: brand is the author, type the tag, name and size the source."""
    part = table(spark, d, "part")
    return part.select(
        F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title"), F.array("p_brand").alias("authors"), F.array("p_type").alias("tags"),
        F.concat_ws(":", "p_name", "p_size").alias("source_id"),
    )


@query("""select concat_ws(':', p_name, p_size) as source_id, arg_min(p_name, p_partkey) as title, array_to_string(list(p_partkey order by p_partkey), ',') as book_ids
from part where contains(lower(p_name), 'ring') or contains(lower(p_brand), 'ring') or contains(lower(p_type), 'ring') group by 1""")
def sea07_catalog(spark: SparkSession, d: str) -> DataFrame:
    return S.search_catalog(_books(spark, d), "RING").withColumn("book_ids", F.array_join("book_ids", ","))


@query("select doc_id as doc, source from documents where source in ('src1', 'src2') and lang = 'de' and n_chars > 100")
def sea08_scope(spark: SparkSession, d: str) -> DataFrame:
    docs = _sections(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "n_chars"), "doc")
    return S.scope(docs, ["src1", "src2"], "de", F.col("n_chars") > 100).select("doc", "source")


@query(f"""with {POSTINGS},
ranked as (select query_id, doc, row_number() over (partition by query_id order by score, doc) as pos from scored where n = n_terms),
held as (select query_id, doc, {WORDS} as words from ranked r join documents d on d.doc_id = r.doc where pos <= 3),
placed as (select query_id, doc, len(words) as n, unnest(words) as term, generate_subscripts(words, 1) - 1 as place from held),
counted as (select query_id, doc, n, place, sum(case when t.term is null then 0 else 1 end) over (partition by query_id, doc order by place rows between current row and 39 following) as held
  from placed p left join terms t using (query_id, term)),
best as (select query_id, doc, arg_min(place, (-held, place)) as place from counted where place + 40 <= n or place = 0 group by all)
select query_id, doc, left(case when place > 0 then '…' else '' end || array_to_string(words[place + 1:place + 40], ' ') || case when place + 40 < len(words) then '…' else '' end, 500) as snippet
from best join held using (query_id, doc)""")
def sea09_snippets(spark: SparkSession, d: str) -> DataFrame:
    docs, queries = _sections(spark, d), _queries(spark, d)
    hits = S.search(queries, S.build_index(docs), None, limit=3)
    return S.snippets(hits, docs, S.query_terms(queries))


@query("""with a as (select concat_ws(':', p_name, p_size) as source_id, array_to_string(list(p_partkey order by p_partkey), ',') as aliases from part group by 1)
select l_orderkey as hit, l_linenumber as line, source_id, aliases from lineitem join part on p_partkey = l_partkey join a on a.source_id = concat_ws(':', p_name, p_size)""")
def sea10_aliases(spark: SparkSession, d: str) -> DataFrame:
    books = _books(spark, d)
    lines = table(spark, d, "lineitem").join(books, F.col("l_partkey") == F.col("book_id"))
    hits = lines.select(F.col("l_orderkey").alias("hit"), F.col("l_linenumber").alias("line"), "source_id")
    return S.attach_aliases(hits, books, ",")


@query("""select event_id, user_id, event_type, value from (select *, row_number() over (partition by user_id, event_type order by value desc, event_id) as k from events) where k = 1""")
def sea11_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return S.first_of(table(spark, d, "events"), ["user_id", "event_type"], [F.desc("value"), "event_id"]).select("event_id", "user_id", "event_type", "value")


@query("""with r as (select source, doc_id % 64 as bucket, doc_id, sha256(concat_ws(chr(31), doc_id::varchar, coalesce(lang, chr(0)), coalesce(text, chr(0)))) as d from documents),
i as (select source, bucket, sha256(string_agg(d, '' order by doc_id)) as d from r group by all)
select source, sha256(string_agg(d, '' order by bucket)) as digest from i group by source""")
def sea13_digest(spark: SparkSession, d: str) -> DataFrame:
    return S.units_digest(table(spark, d, "documents"), "source", "doc_id", ["lang", "text"])


@query("""with n as (select user_id, event_type, count(*) as n from events group by all), t as (select user_id, sum(n) as t from n group by all),
p as (select user_id as subject, event_type as choice, round(n / t, 6) as probability from n join t using (user_id) where user_id % 3 > 0)
select subject, choice, probability, row_number() over (partition by subject order by probability desc, choice) as pos from p""")
def sea14_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Shares of event types as decisions; users divisible by 3 are spoiled and must be refused."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").count()
    total = n.groupBy("user_id").agg(F.sum("count").alias("t"))
    p = n.join(total, "user_id").select("user_id", "event_type", F.when(F.col("user_id") % 3 == 0, F.lit(1.5)).otherwise(F.round(F.col("count") / F.col("t"), 6)).alias("p"))
    results = p.groupBy(F.col("user_id").alias("subject")).agg(F.map_from_entries(F.collect_list(F.struct("event_type", "p"))).alias("probabilities"))
    return S.rank_decisions(results)[0]
