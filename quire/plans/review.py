"""Transcription, review and evaluation queries over documents, labels, lines, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions.text import phrase_form
from quire.operators import graphs as G, review as V

from .registry import query, shared_folder, table


@query(r"""select doc_id, lower(regexp_replace(text, '[^\p{L}]', '', 'g')) as key, array_to_string(regexp_extract_all(text, '(\d+(?:[./]\d+)?)', 1), ' ') as quantities,
trim(regexp_replace(regexp_replace(split_part(text, chr(10), 1), '^\s*[•*·-]\s+', ''), '\t+', ' | ', 'g')) as line from documents""")
def trn01_forms(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    return doc.select("doc_id", V.wording_key(F.col("text")).alias("key"), F.array_join(V.quantities(F.col("text")), " ").alias("quantities"), V.clean_line(F.substring_index("text", "\n", 1)).alias("line"))


@query("""with l as (select l_orderkey as key, l_linenumber as first, l_linenumber as last, 5 as lines from lineitem),
f as (select key from (select *, coalesce(lag(last) over (partition by key order by first, last), 0) as before from l) where first <> before + 1)
select key, 'gap or overlap' as rule from f union all select key, 'end' from l group by key having max(last) <> max(lines)""")
def trn07_blocks(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    return V.check_blocks(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), n.alias("first"), n.alias("last"), F.lit(5).alias("lines")))


@query("""with p as (select source as book, n_chars % 50 as printed, max(doc_id) as page from documents group by 1, 2), s as (select source as book, doc_id as page, arg_min(lang || doc_id, (lang <> 'de', lang || doc_id)) as section from documents group by 1, 2),
r as (select doc_id as reference, source as book, doc_id % 50 as printed from documents)
select reference, r.book, r.printed, p.page, s.section from r left join p on p.book = r.book and p.printed = r.printed left join s on s.book = p.book and s.page = p.page""")
def trn09_folios(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents").withColumn("book", F.col("source"))
    pages = doc.select("book", (F.col("n_chars") % 50).alias("printed"), F.col("doc_id").alias("page"))
    sections = doc.select("book", F.col("doc_id").alias("page"), F.concat("lang", "doc_id").alias("section"), F.when(F.col("lang") == "de", "recipe").otherwise("passage").alias("kind"))
    return V.resolve_folios(doc.select(F.col("doc_id").alias("reference"), "book", (F.col("doc_id") % 50).alias("printed")), pages, sections)


@query("""with a as (select event_id // 3 as page, case event_type when 'click' then null when 'view' then 'empty response' when 'error' then 'refused' when 'signup' then 'empty response' else 'timeout' end as error from events),
n as (select page, count(*) as n, count(*) filter (error is null) as good, bool_and(error = 'empty response') as empty, bool_or(error = 'refused') as refused from a group by page)
select page, case when good > 0 then 'transcribed' when coalesce(refused, false) then 'refused' when coalesce(empty, false) and n >= 3 then 'blank' when n >= 3 then 'failed' else 'pending' end as status from n""")
def trn12_status(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    error = F.when(kind.isin("view", "signup"), "empty response").when(kind == "error", "refused").when(kind == "purchase", "timeout")
    return V.page_status(table(spark, d, "events").select(F.floor(F.col("event_id") / 3).alias("page"), error.alias("error")), 3)


@query("""with a as (select user_id, event_id as id, row_number() over (partition by user_id order by event_id) as k from events where event_type = 'view'), b as (select user_id, event_id as id, row_number() over (partition by user_id order by event_id) as k from events where event_type = 'click')
select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.k, b.k) as k, a.id as left_id, b.id as right_id from a full join b on a.user_id = b.user_id and a.k = b.k""")
def trn13_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("id", F.col("event_id"))
    return V.pair_by_order(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "user_id", "event_id")


@query("""with b as (select s_suppkey // 8 as page, s_suppkey as box, (s_suppkey % 6) * 8 as l, (s_suppkey % 6) * 8 + 10 as r, (s_suppkey % 4) * 0.02 as t, (s_suppkey % 4) * 0.02 + 0.03 as b from supplier),
p as (select l_orderkey * 10 + l_linenumber as line, l_suppkey // 8 as page, l_quantity as x, l_discount as y from lineitem),
h as (select line, count(*) as n, min(box) as box from p join b on p.page = b.page and x >= l and x < r and y >= t::double and y < b::double group by line)
select p.line, case when n = 1 then box end as box, case when n is null then 'unassigned' when n > 1 then 'ambiguous' else 'assigned' end as state from p left join h on h.line = p.line""".replace(" b from supplier", " bottom from supplier").replace("y < b::double", "y < bottom::double"))
def trn16_assign(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    d4 = lambda c: F.expr(c).cast("decimal(6,2)").cast("double")
    boxes = table(spark, d, "supplier").select(
        F.floor(k / 8).alias("page"), k.alias("box"), (k % 6 * 8).alias("l"), (k % 6 * 8 + 10).alias("r"), d4("s_suppkey % 4 * 0.02").alias("t"), d4("s_suppkey % 4 * 0.02 + 0.03").alias("b")
    )
    points = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.floor(F.col("l_suppkey") / 8).alias("page"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    return V.assign_lines(points, boxes)


@query(r"""with l as (select doc_id, lines, unnest(generate_series(1, len(lines))) as line from (select doc_id, string_split(text, chr(10)) as lines from documents)),
w as (select doc_id, line, words, unnest(generate_series(1, len(words))) as pos from (select doc_id, line, string_split(lines[line], ' ') as words from l)),
c as (select doc_id as page, line, pos, words[pos] as word, (doc_id * 7 + line * 3 + pos) % 100 as confidence from w),
n as (select page, line, string_agg(word, ' ' order by pos) as t, sum(confidence * length(word)) as c, sum(length(word)) as n from c group by 1, 2),
p as (select page, string_agg(t, chr(10) order by line) as text, round(sum(c) / sum(n), 6) as mean_confidence from n group by 1)
select page, text, mean_confidence, concat_ws(',', case when mean_confidence < 49 then 'low confidence' end, case when length(text) < 200 then 'short' end, case when regexp_matches(text, '\d') then 'numbers' end) as reasons from p""")
def trn18_triage(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    words = lines.select("doc_id", (F.col("line") + 1).alias("line"), F.posexplode(F.split("t", " ")).alias("pos", "word")).withColumn("pos", F.col("pos") + 1)
    words = words.withColumn("confidence", (F.col("doc_id") * 7 + F.col("line") * 3 + F.col("pos")) % 100).withColumnRenamed("doc_id", "page")
    return V.ocr_triage(words, 49.0)


@query(r"""with t as (select conv_id as "group", text || ' ' || (turn % 2) || ' cups V2 x' as text from conversations),
n as (select "group", array_to_string(list_sort(regexp_extract_all(' ' || text, '[^\p{L}\p{N}_](\d+(?:[./]\d+)*)', 1)), ' ') as numbers, len(regexp_extract_all(' ' || text, '[^\p{L}\p{N}_](?:[VY][2348]|Sg)\s')) as odd from t)
select "group", count(distinct numbers) > 1 as disagreement, sum(odd) as suspicious from n group by 1""")
def trn19_candidates(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("text", F.lit(" "), F.col("turn") % 2, F.lit(" cups V2 x"))
    return V.triage_candidates(table(spark, d, "conversations").select(F.col("conv_id").alias("group"), text.alias("text")))


@query("""with l as (select conv_id, arg_max(text, turn) as new, count(*) as n from conversations where turn > 0 group by 1)
select c.conv_id as target, coalesce(new, text) as value, coalesce(n, 0) as revisions from conversations c left join l using (conv_id) where turn = 0""")
def rev01_overlay(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumnsRenamed({"conv_id": "target", "text": "value", "turn": "seq"})
    return V.review_overlay(c.where("seq = 0").select("target", "value"), c.where("seq > 0"))


@query("""select doc_id, case when doc_id % 3 > 0 then left(text, 3) || '[new]' || substring(text, 9) else text end as result, doc_id % 3 = 0 as refused from documents""")
def rev02_edit(spark: SparkSession, d: str) -> DataFrame:
    expected = F.when(F.col("doc_id") % 3 == 0, F.lit("other")).otherwise(F.substring("text", 4, 5))
    rows = table(spark, d, "documents").select("doc_id", "text", F.lit(3).alias("start"), F.lit(8).alias("end"), expected.alias("expected"), F.lit("[new]").alias("replacement"))
    return V.edit_occurrence(rows).select("doc_id", "result", "refused")


@query("""with v as (select l_orderkey as document, l_linenumber * 100000 + l_partkey as target, case when l_returnflag = 'R' then 'unresolved' else 'read' end as state, l_quantity as confidence, l_tax > 0.07 as numeric from lineitem),
r as (select *, concat_ws(',', case when state = 'unresolved' then 'unresolved' end, case when confidence < 10 then 'confidence' end, case when numeric then 'numeric' end) as reasons from v)
select document, target, reasons, row_number() over (partition by document order by state <> 'unresolved', confidence nulls first, target) as pos from r where reasons <> ''""")
def rev03_queue(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("document"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("target"), F.when(F.col("l_returnflag") == "R", "unresolved").otherwise("read").alias("state"),
        F.col("l_quantity").alias("confidence"), (F.col("l_tax") > 0.07).alias("numeric"),
    )
    return V.review_queue(rows, 10)


@query("""with m as (select doc_id as line, source as selection from documents), v as (select doc_id as line, lang || (doc_id % 4) as selection, doc_id as seq from documents where doc_id % 5 = 0),
l as (select line, arg_max(selection, seq) as to from v group by 1)
select coalesce(l.to, selection) as selection, string_agg(m.line::varchar, ',' order by m.line) as lines, count(*) as n from m left join l on l.line = m.line group by 1""".replace(" as to ", ' as "to" ').replace("l.to", 'l."to"'))
def rev04_members(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents").withColumn("line", F.col("doc_id"))
    moves = doc.where("doc_id % 5 = 0").select("line", F.concat("lang", F.col("doc_id") % 4).alias("selection"), F.col("doc_id").alias("seq"))
    return V.effective_members(doc.select("line", F.col("source").alias("selection")), moves)


@query("""with d as (select event_id as id, event_id as seq, user_id as scope, event_type = 'error' as revokes, (event_id * 7) % 5000 as named from events),
l as (select scope, max(seq) as until from d where revokes group by 1)
select id from d join l using (scope) where not revokes and seq < until union select named from d where revokes""")
def rev06_revoked(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    action = F.when(F.col("event_type") == "error", "revoke").otherwise("approve")
    return V.revoked(table(spark, d, "events").select(k.alias("id"), k.alias("seq"), F.col("user_id").alias("scope"), action.alias("action"), F.array((k * 7) % 5000).alias("affected")))


@query("""with recursive e as (select p_partkey - 1 as src, p_partkey as dst from part where p_size > 20 union select p_partkey, p_partkey // 2 from part where p_size = 7),
c(id) as (select p_partkey from part where p_size = 50 union select dst from c join e on src = c.id) select distinct id from c""")
def rev07_dependents(spark: SparkSession, d: str) -> DataFrame:
    """Revoked are the parts of the largest size; of two neighbouring parts the second depends on the first if it is larger than 20."""
    shared_folder(spark)
    part = table(spark, d, "part")
    edges = part.where("p_size > 20").select((F.col("p_partkey") - 1).alias("src"), F.col("p_partkey").alias("dst"))
    edges = edges.union(part.select("p_partkey", (F.col("p_partkey") / 2).cast("long")).where("p_size = 7"))
    return G.closure(part.where("p_size = 50").select(F.col("p_partkey").alias("id")), edges.toDF("src", "dst"))


@query("""with recursive d as (select event_id as id, user_id as scope, event_type as digest, case when event_type = 'view' then 'reject' else 'approve' end as action, event_id % 9 as candidate from events),
seed as (select d.id from d, (select l_suppkey % 200 as scope, 'error' as digest, l_linenumber as own from lineitem group by all) t where d.scope = t.scope and action = 'approve' and (d.digest = t.digest or d.candidate = t.own)),
b as (select event_id + 1 as id, event_id as decision from events where event_id % 5 > 0), c(id) as (select id from seed union select b.id from c join b on b.decision = c.id)
select user_id as source, epoch_us(ts) // 86400000000 as page from events where event_id in (select id from c) and event_type <> 'view' group by all""")
def rev07_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of decisions that withdrawals hit: events are decisions on their user's scope, of five each depends on the one before; their days are pages."""
    shared_folder(spark)
    e, k = table(spark, d, "events"), F.col("event_id")
    decisions = e.select(k.alias("id"), F.when(F.col("event_type") == "view", "reject").otherwise("approve").alias("action"), F.col("user_id").alias("scope"), F.col("event_type").alias("scope_digest"), (k % 9).alias("candidate"))
    target = table(spark, d, "lineitem").select((F.col("l_suppkey") % 200).alias("scope"), F.lit("error").alias("scope_digest"), F.col("l_linenumber").cast("long").alias("candidate")).distinct()
    bindings = e.where(k % 5 > 0).select((k + 1).alias("id"), k.alias("decision"))
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400)
    evidence = e.where("event_type <> 'view'").select(k.alias("id"), F.col("user_id").alias("source"), day.alias("page"))
    return G.affected_pages(G.dependents(decisions, bindings, target), evidence)


@query("""with s as (select doc_id as key, source, unnest([doc_id % 50, doc_id % 61]) as page from documents), w as (select doc_id, 'src' || (doc_id % 20) as source, doc_id % 50 as page from labels where toxic = 1),
r as (select l.doc_id as key, 'withdrawn' as reason from labels l where quality = 0 union select s.key, 'page' from s join w on w.source = s.source and w.page = s.page),
g as (select key, string_agg(distinct reason, ',' order by reason) as reasons from r group by 1)
select d.doc_id as key, case when reasons is not null then 'suppressed' when lang = 'fr' then 'superseded' else 'eligible' end as state, coalesce(reasons, '') as reasons from documents d left join g on g.key = d.doc_id""")
def rev09_eligibility(spark: SparkSession, d: str) -> DataFrame:
    doc, labels = table(spark, d, "documents"), table(spark, d, "labels")
    k = F.col("doc_id")
    sections = doc.select(k.alias("key"), "source", k.alias("decision"), F.array_distinct(F.array(k % 50, k % 61)).alias("pages"), (F.col("lang") == "fr").alias("superseded"))
    none = F.lit(None)
    gone = labels.where("quality = 0").select(k.alias("decision"), none.cast("string").alias("source"), none.cast("long").alias("page"), F.lit("withdrawn").alias("reason"))
    paged = labels.where("toxic = 1").select(none.cast("long").alias("decision"), F.concat(F.lit("src"), k % 20).alias("source"), (k % 50).alias("page"), F.lit("page").alias("reason"))
    return V.section_eligibility(sections, gone.union(paged))


@query("""select distinct d.doc_id as key from documents d join labels l on 'src' || (l.doc_id % 20) = d.source and l.toxic = 1 and (l.doc_id % 50 = d.doc_id % 50 or l.doc_id % 50 = d.doc_id % 61)""")
def rev10_supersede(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    sections = table(spark, d, "documents").select(k.alias("key"), "source", F.array(k % 50, k % 61).alias("pages"))
    return V.supersede(sections, table(spark, d, "labels").where("toxic = 1").select(F.concat(F.lit("src"), k % 20).alias("source"), (k % 50).alias("page")))


@query("""with r as (select doc_id as key, text, md5(text) as digest from documents), e as (select doc_id as key, case when doc_id % 4 = 0 then 'stale' else md5(text) end as digest, case when toxic = 1 then 'nontext' when quality = 0 then 'correct' else 'accept' end as decision from labels join documents using (doc_id))
select r.key, case when decision = 'correct' then 'corrected ' || r.key when decision = 'nontext' then '' else text end as text, coalesce(decision, 'pending') as state from r left join e on e.key = r.key and e.digest = r.digest""")
def rev11_ocr(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    k = F.col("doc_id")
    decision = F.when(F.col("toxic") == 1, "nontext").when(F.col("quality") == 0, "correct").otherwise("accept")
    decisions = table(spark, d, "labels").join(doc, "doc_id").select(k.alias("key"), F.when(k % 4 == 0, "stale").otherwise(F.md5("text")).alias("digest"), decision.alias("decision"), F.concat(F.lit("corrected "), k).alias("correction"))
    return V.effective_ocr(doc.select(k.alias("key"), "text", F.md5("text").alias("digest")), decisions)


@query("""with s as (select doc_id as key, text, n_chars > 500 as searchable from documents), x as (select doc_id as key from documents where doc_id % 9 > 0)
select 'decision without section' as rule, doc_id + 50 as key from labels where doc_id + 50 not in (select key from s) union all select 'searched but not searchable', key from x where key not in (select key from s where searchable)
union all select 'searchable but not searched', key from s where searchable and key not in (select key from x) union all select 'blank', key from s where searchable and trim(text) = ''""")
def rev12_gate(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents").withColumn("key", F.col("doc_id"))
    decisions = table(spark, d, "labels").select((F.col("doc_id") + 50).alias("key"))
    return V.publish_gate(doc.select("key", "text", (F.col("n_chars") > 500).alias("searchable")), decisions, doc.where("doc_id % 9 > 0").select("key"))


@query(r"""with n as (select doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as body from documents), b as (select item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as phrase from benchmark)
select item_id, doc_id from b join n on contains(body, phrase) and regexp_matches(' ' || replace(body, phrase, chr(1)) || ' ', '[^\p{L}\p{N}_/]' || chr(1) || '[^\p{L}\p{N}_/]')""")
def eva01_present(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark text, whole, in every document."""
    return V.present(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark").select("item_id", F.col("text").alias("phrase")))


@query("""with q as (select user_id as query, 'c' || (user_id % 4) as category, 's' || (user_id % 3) as split, [user_id % 7, user_id % 5] as relevant from events group by user_id),
h as (select user_id as query, (props::json->>'$.k')::int % 20 as unit, min(event_id) as pos from events group by 1, 2), u as (select *, row_number() over (partition by query order by pos, unit) as rank from h),
w as (select distinct query, unnest(relevant) as unit from q), f as (select query, min(rank) as rank from u join w using (query, unit) where rank <= 10 group by 1), r as (select q.*, rank from q left join f using (query))
select category, split, count(rank) as hits, count(*) as total, round(count(rank) / count(*), 6) as recall_at_10, round(sum(coalesce(1.0::double / rank, 0)) / count(*), 6) as mrr, grouping(category) * 2 + grouping(split) as level
from r group by grouping sets ((category), (split), ())""")
def eva02_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    u = F.col("user_id")
    queries = e.select(u.alias("query")).distinct().select("query", F.concat(F.lit("c"), F.col("query") % 4).alias("category"), F.concat(F.lit("s"), F.col("query") % 3).alias("split"), F.array_distinct(F.array(F.col("query") % 7, F.col("query") % 5)).alias("relevant"))
    hits = e.select(u.alias("query"), (F.get_json_object("props", "$.k").cast("long") % 20).alias("unit"), F.col("event_id").alias("pos"))
    return V.retrieval_metrics(queries, hits)


@query("""with i as (select source as book, doc_id % 3 > 0 as before, n_chars % 4 > 0 as after from documents)
select book, count(*) as items, count(*) filter (before) as before, count(*) filter (after) as after, count(*) filter (not before and after) as fixed, count(*) filter (before and not after) as broke, grouping(book)::int as total from i group by rollup (book)""")
def eva04_items(spark: SparkSession, d: str) -> DataFrame:
    return V.score_items(table(spark, d, "documents").select(F.col("source").alias("book"), (F.col("doc_id") % 3 > 0).alias("before"), (F.col("n_chars") % 4 > 0).alias("after")))


FORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[\x{{2010}}-\x{{2015}}]', '-', 'g'), '-\s+', '-', 'g'), '\s+', ' ', 'g'))"
#: Items are the first line of each document and, parted by a bar, its first two words and its first line's last one; corrected texts lack what comes before their first line end, on every fourth page.
ITEMS = f"""p as (select source as book, doc_id as page, text, string_split(text, chr(10))[1] as line, case when doc_id % 4 = 0 then substr(text, instr(text, chr(10)) + 1) else text end as after from documents where text is not null and source is not null),
i as (select book, page, 1 as item, 'amount' as field, line as t from p union all select book, page, 2, 'heading', split_part(line, ' ', 1) || ' | ' || string_split(line, ' ')[-1] from p),
m as (select i.*, p.text, p.after, page % 11 <> 3 as there from i join p using (book, page)),
f as (select *, {FORM.format("replace(text, chr(9), ' | ')")} as fb, {FORM.format("replace(after, chr(9), ' | ')")} as fa, list_transform(string_split(t, ' | '), lambda c: {FORM.format("c")}) as cells,
  list_transform(string_split(replace(text, chr(9), ' | '), chr(10)), lambda x: {FORM.format("x")}) as lb, list_transform(string_split(replace(after, chr(9), ' | '), chr(10)), lambda x: {FORM.format("x")}) as la from m),
s as (select book, page, item, field, field = 'amount' as quantity, not there as missing,
  there and if(len(cells) > 1, len(list_filter(lb, lambda x: len(list_filter(cells, lambda c: not contains(x, c))) = 0)) > 0, contains(fb, {FORM.format("t")})) as before,
  there and if(len(cells) > 1, len(list_filter(la, lambda x: len(list_filter(cells, lambda c: not contains(x, c))) = 0)) > 0, contains(fa, {FORM.format("t")})) as after from f)"""


def _matched(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null and source is not null").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), "text")
    after = F.when(F.col("page") % 4 == 0, F.expr("substr(text, instr(text, '\\n') + 1)")).otherwise(F.col("text"))
    pages = docs.where("page % 11 <> 3").select("book", "page", F.col("text").alias("before"), after.alias("after"))
    line = F.substring_index("text", "\n", 1)
    two = F.struct(F.lit(2).alias("item"), F.lit("heading").alias("field"), F.concat(F.substring_index(line, " ", 1), F.lit(" | "), F.substring_index(line, " ", -1)).alias("text"))
    items = docs.select("book", "page", F.explode(F.array(F.struct(F.lit(1).alias("item"), F.lit("amount").alias("field"), line.alias("text")), two)).alias("x")).select("book", "page", "x.*", F.lit(False).alias("ambiguous"))
    return V.match_items(pages, items)


@query(f"""with {ITEMS} select book, count(distinct (book, page)) as pages, count(distinct (book, page)) filter (missing) as missing, count(*) as items, count(*) filter (before) as before, count(*) filter (after) as after,
count(*) filter (quantity) as quantities, count(*) filter (quantity and before) as quantities_before, count(*) filter (quantity and after) as quantities_after,
count(*) filter (not before and after) as fixed, count(*) filter (before and not after) as broke, grouping(book)::int as total from s group by rollup (book)""")
def eva04_scores(spark: SparkSession, d: str) -> DataFrame:
    return V.item_scores(_matched(spark, d))


@query(f"with {ITEMS} select book, page, item, field, case when after then 'fixed' when before then 'broke' else 'miss' end as change from s where not after or not before")
def eva04_transitions(spark: SparkSession, d: str) -> DataFrame:
    return V.transitions(_matched(spark, d))


PRICES = "(values ('A', 0.25, 0.025, 2.0), ('N', 0.5, 0.05, 4.0), ('R', 1.0, 0.1, 8.0))"


@query(f"""with p as (select * from {PRICES} t(model, f, c, o)), r as (select l.*, f, c, o, row_number() over (partition by l_returnflag order by l_tax * l_quantity, l_orderkey, l_linenumber) - 1 as k, count(*) over (partition by l_returnflag) as n from lineitem l join p on model = l_returnflag)
select l_returnflag as model, count(*) as calls, count(*) filter (l_discount = 0) as failed, round(sum(l_quantity * f::double + l_linenumber * c::double + l_partkey * o::double), 4) as cost, round(median(l_tax * l_quantity), 6) as median_s,
max(l_tax * l_quantity) filter (k = floor(n * 0.9)) as p90_s from r group by 1""")
def eva07_costs(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.sql(f"select col1 as model, cast(col2 as double) as fresh_price, cast(col3 as double) as cached_price, cast(col4 as double) as output_price from {PRICES}")
    calls = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("model"), F.struct("l_orderkey", "l_linenumber").alias("call"), (F.col("l_tax") * F.col("l_quantity")).alias("seconds"), (F.col("l_discount") == 0).alias("failed"),
        F.col("l_quantity").alias("fresh"), F.col("l_linenumber").alias("cached"), F.col("l_partkey").alias("output"),
    )
    return V.cost_summary(calls, prices)


@query("""with a as (select event_type as metric, round(avg(value), 6) as value from events where event_id % 2 = 0 group by 1), b as (select event_type as metric, round(avg(value), 6) as value from events where event_type <> 'view' group by 1)
select coalesce(a.metric, b.metric) as metric, a.value as run, b.value as baseline, round(a.value - b.value, 6) as change from a full join b on a.metric = b.metric""")
def eva08_compare(spark: SparkSession, d: str) -> DataFrame:
    means = lambda rows: rows.groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))
    e = table(spark, d, "events")
    return V.compare_runs(means(e.where("event_id % 2 = 0")), means(e.where("event_type <> 'view'")))


@query("""select user_id as "case", case when event_id % 2 = 0 then 'base' else 'new' end as side, count(*) as attempts, count(*) filter (value >= 5) as successes, round(median(value) filter (value >= 5), 6) as median_ms, min(value) filter (value >= 5) as min_ms, max(value) filter (value >= 5) as max_ms,
count(distinct case when value < 90 then user_id % 5 end) = 1 and count(case when value < 90 then 1 end) = count(*) as identical, count(*) filter (value >= 5) >= 20 as complete from events group by 1, 2""")
def eva09_ab(spark: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("event_id") % 2 == 0, "base").otherwise("new")
    rows = table(spark, d, "events").select(F.col("user_id").alias("case"), side.alias("side"), (F.col("value") < 5).alias("failed"), F.col("value").alias("ms"), F.when(F.col("value") < 90, F.col("user_id") % 5).alias("digest"))
    return V.ab_summary(rows, 20)


@query(r"""with p as (select source as book, len(regexp_extract_all(text, '[\p{L}\p{N}]')) as alnum, len(regexp_extract_all(text, chr(65533))) as broken from documents)
select book, count(*) as pages, count(*) filter (alnum >= 400) as with_text, sum(alnum) as alnum, sum(broken) as broken, concat_ws(',', floor(count(*) * 0.25 + 0.5)::bigint, floor(count(*) * 0.5 + 0.5)::bigint, floor(count(*) * 0.75 + 0.5)::bigint) as samples from p group by 1""")
def eva11_coverage(spark: SparkSession, d: str) -> DataFrame:
    return V.coverage_survey(table(spark, d, "documents").select(F.col("source").alias("book"), "text"), 400)
