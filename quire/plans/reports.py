"""Sources, reports, corrections and publications over orders, lines, events and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.operators import reports as R
from quire.sources import library as L

from .registry import query, table

JOIN = lambda c: F.array_join(c, ",")
ID = "sha256(concat_ws(chr(31), {}))"


@query("""with a as (select p_partkey as book_id, array_to_string(list(l_suppkey::varchar order by l_orderkey, l_linenumber, l_suppkey::varchar), ',') as authors from lineitem join part on p_partkey = l_partkey group by 1)
select p_partkey as book_id, p_name as title, coalesce(authors, '') as authors, p_brand || ',' || p_type as tags from part left join a on book_id = p_partkey""")
def src01_catalog(spark: SparkSession, d: str) -> DataFrame:
    part, line = table(spark, d, "part"), table(spark, d, "lineitem")
    authors = line.select(F.col("l_partkey").alias("book_id"), F.struct("l_orderkey", "l_linenumber").alias("ord"), F.col("l_suppkey").cast("string").alias("name"))
    tags = part.select(F.col("p_partkey").alias("book_id"), F.posexplode(F.array("p_brand", "p_type")).alias("ord", "name"))
    rows = L.read_catalog(part.select(F.col("p_partkey").alias("book_id"), F.col("p_name").alias("title")), authors, tags)
    return rows.withColumns({"authors": JOIN("authors"), "tags": JOIN("tags")})


FORMATS = """with f as (select user_id * 10 + event_id % 7 as book_id, case event_type when 'click' then 'EPUB' when 'view' then 'PDF' when 'error' then 'DJVU' else 'MOBI' end as format, event_id::varchar as name from events),
c as (select book_id, count(*) filter (format = 'EPUB') as epubs, count(*) as n, min(name) filter (format = 'EPUB') as epub_name, min(format) as only_format, min(name) as only_name from f group by book_id)"""


@query(f"""{FORMATS} select book_id, case when epubs = 1 then 'EPUB' when epubs = 0 and n = 1 and only_format in ('PDF', 'DJVU') then only_format end as format,
case when epubs = 1 then epub_name when epubs = 0 and n = 1 and only_format in ('PDF', 'DJVU') then only_name end as name,
case when epubs = 1 or (epubs = 0 and n = 1 and only_format in ('PDF', 'DJVU')) then 'selected' else 'rejected' end as status from c""")
def src02_formats(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    name = F.when(kind == "click", "EPUB").when(kind == "view", "PDF").when(kind == "error", "DJVU").otherwise("MOBI")
    rows = table(spark, d, "events").select((F.col("user_id") * 10 + F.col("event_id") % 7).alias("book_id"), name.alias("format"), F.col("event_id").cast("string").alias("name"))
    return L.select_format(rows)


@query(r"select doc_id as page, 'Page ' || doc_id as title, text, length(regexp_replace(text, '[^\p{L}\p{N}_]', '', 'g')) < 400 as needs_ocr from documents")
def src05_pages(spark: SparkSession, d: str) -> DataFrame:
    return L.page_units(table(spark, d, "documents").select(F.col("doc_id").alias("page"), "text"), 400)


@query("""with o as (select 'events' as kind, user_id::varchar as source, value >= 1 as sound from events union all select 'documents', source, n_chars > 100 from documents)
select kind, count(*) filter (sound) as accepted, count(*) filter (not sound) as rejected, count(distinct source) as sources from o group by kind""")
def src09_observations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("title"), F.col("ts").cast("timestamp").alias("at"), "value")
    t = table(spark, d, "documents").select("source", F.col("doc_id").cast("string").alias("title"), F.lit(None).cast("timestamp").alias("at"), "n_chars")
    return L.read_observations({"events": (e, F.col("value") >= 1, F.lit("seen")), "documents": (t, F.col("n_chars") > 100, F.lit("held"))})[1]


@query("""select source || '/' || doc_id as path, sha256(text) as sha256, strlen(text) as size, case when source like 'src1%' then case when source like 'src10%' then 'index' else 'asset' end else 'other' end as role from documents""")
def snk02_inventory(spark: SparkSession, d: str) -> DataFrame:
    objects = table(spark, d, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    return L.inventory(objects, {"src1": "asset", "src10": "index"})


@query("""select o_custkey, sha256(string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', chr(10) order by o_orderkey) || chr(10)) as digest, count(*) as n from orders group by o_custkey""")
def snk03_digest(spark: SparkSession, d: str) -> DataFrame:
    return L.dump_digest(table(spark, d, "orders"), "o_custkey", "o_orderkey", ["o_orderstatus", "o_orderkey"])


SQ = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
CLAIMS = f"""raw as (select doc_id, source, doc_id // 4 as page, case when doc_id % 2 = 0 then 'text' else 'amount' end as kind,
  {SQ.format("case when doc_id % 5 = 0 then 'no such words' when doc_id % 7 = 0 then '' else substring(text, 5, 30) end")} as quoted, {SQ.format("case when doc_id % 11 = 0 then substring(text, 5, 30) else 'better' end")} as proposed from documents),
texts as (select source, doc_id // 4 as page, {SQ.format('text')} as body from documents),
ids as (select *, sha256(concat_ws(chr(31), source, page::varchar, kind, quoted, proposed)) as report_id from raw),
seen as (select i.doc_id, i.source, i.page, i.kind, i.quoted, i.proposed, i.report_id, coalesce(bool_or(contains(body, quoted)), false) as seen from ids i left join texts t on t.source = i.source and t.page = i.page group by all)"""


@query(f"""with {CLAIMS} select doc_id, source, page, kind, quoted, proposed, report_id,
case when quoted = '' then 'no quote' when length(quoted) > 25 then 'too long' when quoted = proposed then 'no change' when not seen then 'quote not found' end as reason from seen""")
def rep01_intake(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    page = F.floor(F.col("doc_id") / 4).alias("page")
    cut = F.substring("text", 5, 30)
    raw = doc.select(
        "doc_id", "source", page, F.when(F.col("doc_id") % 2 == 0, "text").otherwise("amount").alias("kind"),
        F.when(F.col("doc_id") % 5 == 0, "no such words").when(F.col("doc_id") % 7 == 0, "").otherwise(cut).alias("quoted"),
        F.when(F.col("doc_id") % 11 == 0, cut).otherwise("better").alias("proposed"),
    )
    return R.intake_reports(raw, doc.select("source", page, "text"), most=25)


@query("""with b as (select l_orderkey * 1000000 + l_partkey as k, l_linenumber as n, (l_suppkey % 90) / 90.0 as x, (l_partkey % 95) / 90.0 as y, l_quantity / 100 as w from lineitem),
r as (select *, case when not (x >= 0 and x < x + w and x + w <= 1 and y >= 0 and y < y + w and y + w <= 1) then 'no box' when x + w - x < 0.02 or y + w - y < 0.02 then 'box too small' end as reason from b where n > 1)
select reason, count(*) as n from r group by reason union all select 'none', count(*) from b where n = 1""")
def rep01_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as boxes by their reason; the first of an order has none."""
    x, y, w = (F.col("l_suppkey") % 90) / F.lit(90.0), (F.col("l_partkey") % 95) / F.lit(90.0), F.col("l_quantity") / 100
    rows = table(spark, d, "lineitem").select(F.when(F.col("l_linenumber") > 1, F.array(x, y, x + w, y + w)).alias("region"))
    reason = F.when(F.col("region").isNull(), "none").otherwise(R.box_reason(F.col("region")))
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("select user_id as report_id, event_id as seq, value from (select *, row_number() over (partition by user_id order by ts, event_id) as k from events) where k = 1")
def rep02_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("report_id"), F.col("event_id").alias("seq"), F.col("ts").alias("created_at"), "value")
    return R.dedupe_reports(rows).select("report_id", "seq", "value")


@query("select event_type, event_id as id, row_number() over (partition by event_type, date_trunc('hour', ts) order by ts, event_id) <= 3 as admitted from events")
def rep03_clock(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_type", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    return R.clock_limit(rows, "event_type", 3).select("event_type", "id", "admitted")


@query()
def rep03_rolling(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    return R.rolling_limit(rows, "user_id", most=2, seconds=86400)


@query("""with s as (select user_id as submission, event_id as seq, ts, event_type as fingerprint from events),
f as (select *, first_value(fingerprint) over (partition by submission order by ts, seq) as first, row_number() over (partition by submission order by ts, seq) as k from s)
select submission, seq, case when k = 1 then 'accepted' when fingerprint = first then 'repeated' else 'conflict' end as status, sha256(concat_ws(chr(31), submission::varchar, first)) as receipt from f""")
def rep04_receipts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("submission"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.col("event_type").alias("fingerprint"))
    return R.receipts(rows).select("submission", "seq", "status", "receipt")


BALLOTS = "select event_id // 3 as report, case when event_type in ('click', 'view') then 'proposed' when event_type = 'purchase' then 'current' end as vote, value > 60 as refused from events"
DECIDED = f"""n as (select report, count(*) filter (vote = 'proposed') as proposed, count(*) filter (vote = 'current') as "current", coalesce(bool_or(refused), false) as refused from ({BALLOTS}) group by report),
decided as (select report, proposed, "current", case when refused then 'owner' when proposed >= 2 then 'correction' when "current" >= 2 then 'rejected' else 'owner' end as outcome from n)"""


def _decided(spark: SparkSession, d: str) -> DataFrame:
    vote = F.when(F.col("event_type").isin("click", "view"), "proposed").when(F.col("event_type") == "purchase", "current")
    return R.decide(table(spark, d, "events").select(F.floor(F.col("event_id") / 3).alias("report"), vote.alias("vote"), (F.col("value") > 60).alias("refused")))


@query(f"with {DECIDED} select * from decided")
def rep06_decide(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d)


@query("select o_orderkey as report_id, o_totalprice from orders where o_orderkey not in (select l_orderkey from lineitem) order by o_orderdate, o_orderkey limit 50")
def rep07_pending(spark: SparkSession, d: str) -> DataFrame:
    reports = table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_orderdate").alias("created_at"), "o_totalprice")
    return R.pending(reports, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id")), 50).select("report_id", "o_totalprice")


@query("""select o_orderkey as id, o_custkey, o_orderpriority from (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as k from orders where o_orderstatus = 'F') where k = 1""")
def rep08_ledger(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("o_orderstatus") == "F", "correction").otherwise("rejected")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", "o_orderpriority", F.col("o_orderdate").alias("decided_at"), outcome.alias("outcome"))
    return R.build_ledger(rows, ["o_custkey", "o_orderpriority"]).select("id", "o_custkey", "o_orderpriority")


@query(f"""with {DECIDED}, items as (select report as item, 'report' as origin from decided where outcome = 'owner' union select o_orderkey, 'correction' from orders where o_orderstatus = 'P'),
old as (select report as item, 'report' as origin from decided where report % 2 = 0)
select item, origin, not exists (select 1 from old where old.item = items.item and old.origin = items.origin) as added from items""")
def rep09_queue(spark: SparkSession, d: str) -> DataFrame:
    decided = _decided(spark, d)
    before = decided.where("report % 2 = 0").select(F.col("report").alias("item"), F.lit("report").alias("origin"))
    return R.owner_queue(decided, table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id")), before)


@query("""with l as (select o_orderkey % 12000 as id, o_custkey, o_orderkey as seq, o_orderdate as decided_at, o_orderstatus as from_text, left(o_orderpriority, 1) as to_text from orders),
r as (select *, count(*) over (partition by id) as n, count(*) over (partition by o_custkey, decided_at) as m, lag(id) over w is not null and (lag(decided_at) over w, lag(id) over w) > (decided_at, id) as wrong from l window w as (partition by o_custkey order by seq))
select id, 'id repeats' as rule from r where n > 1 union all select id, 'key repeats' from r where m > 1 union all select id, 'no change' from r where from_text = to_text union all select id, 'order' from r where wrong""")
def cor02_ledger(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(
        (F.col("o_orderkey") % 12000).alias("id"), F.col("o_custkey").alias("part"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("decided_at"),
        F.col("o_orderstatus").alias("from_text"), F.substring("o_orderpriority", 1, 1).alias("to_text"),
    )
    return R.check_ledger(rows, ["part", "decided_at"], "part")


@query("""with s as (select source, doc_id, list_distinct([doc_id % 97, doc_id % 89]) as pages from documents where doc_id % 3 = 0), c as (select distinct source, unnest(pages) as page from s),
p as (select source, doc_id % 100 as page, doc_id from documents)
select p.source, p.page, doc_id, c.page is null as searchable from p left join c on c.source = p.source and c.page = p.page""")
def cor04_units(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    sections = doc.where("doc_id % 3 = 0").select("source", F.array_distinct(F.array(F.col("doc_id") % 97, F.col("doc_id") % 89)).alias("pages"))
    return R.searchable_pages(doc.select("source", (F.col("doc_id") % 100).alias("page"), "doc_id"), sections)


@query("""with o as (select source, case when n_chars < 800 then 'applied' when n_chars < 3000 then 'stale' when lang = 'de' then 'ambiguous' end as outcome from documents)
select source, count(*) as units, count(*) filter (outcome = 'applied') as applied, count(*) filter (outcome = 'stale') as stale, count(*) filter (outcome = 'ambiguous') as ambiguous, grouping(source)::int as total from o group by rollup (source)""")
def cor06_report(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("n_chars") < 800, "applied").when(F.col("n_chars") < 3000, "stale").when(F.col("lang") == "de", "ambiguous")
    return R.build_report(table(spark, d, "documents").select("source", outcome.alias("outcome")))


@query("""with a as (select o_custkey as source, string_agg(o_orderkey::varchar, ',' order by o_orderkey) as digest from orders where o_orderstatus <> 'P' group by 1), b as (select o_custkey as source, string_agg(o_orderkey::varchar, ',' order by o_orderkey) as digest from orders where o_orderstatus <> 'P' and (o_custkey % 5 > 0 or o_orderkey % 7 > 0) and o_custkey % 11 > 0 group by 1),
r as (select coalesce(a.source, b.source) as source, case when b.source is null then 'added' when a.source is null then 'removed' when a.digest <> b.digest then 'changed' end as change from a full join b on a.source = b.source)
select * from r where change is not null""")
def cor07_changed(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").where("o_orderstatus <> 'P'").withColumnRenamed("o_custkey", "source")
    digest = lambda df: L.dump_digest(df, "source", "o_orderkey", ["o_orderkey"]).drop("n")
    return R.changed_sources(digest(rows), digest(rows.where("(source % 5 > 0 or o_orderkey % 7 > 0) and source % 11 > 0")))


@query("""select doc_id, 'stored' as side from documents where doc_id % 10 = 0 union all select doc_id, 'expected' from documents where doc_id % 10 = 0 and doc_id % 20 > 0""")
def cor08_diff(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents").select("doc_id", "text")
    edited = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    return R.diff_index(doc, doc.where("doc_id % 20 > 0").select("doc_id", edited.alias("text")), "doc_id", "text")


@query()
def cor03_apply(spark: SparkSession, d: str) -> DataFrame:
    """Every line of each document is corrected in turn; an id is the line's number."""
    doc = table(spark, d, "documents")
    rows = doc.select(F.col("doc_id").alias("unit"), F.posexplode(F.split("text", "\n")).alias("k", "from_text"))
    ledger = rows.select("unit", F.col("k").cast("long").alias("decided_at"), F.col("k").cast("long").alias("id"), "from_text", F.upper("from_text").alias("to_text"))
    return R.apply_in_order(doc.select(F.col("doc_id").alias("unit"), "text"), ledger)


INV = "select l_orderkey // 100 as publication, 'p' || (l_partkey % 50) as path, sha256((l_partkey % 40)::varchar) as sha256, case when l_quantity > 45 then 2 else 1 end as size, case when l_linenumber = 7 then 'index' else 'asset' end as role from lineitem"


def _inventory(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.floor(F.col("l_orderkey") / 100).alias("publication"), F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("path"), F.sha2((F.col("l_partkey") % 40).cast("string"), 256).alias("sha256"),
        F.when(F.col("l_quantity") > 45, 2).otherwise(1).alias("size"), F.when(F.col("l_linenumber") == 7, "index").otherwise("asset").alias("role"),
    )


@query(f"""with i as ({INV}) select publication, 'path repeats' as rule, path as key from i group by publication, path having count(*) > 1
union all select publication, 'two sizes', sha256 from i group by publication, sha256 having count(distinct size) > 1
union all select publication, 'index', (count(*) filter (role = 'index'))::varchar from i group by publication having count(*) filter (role = 'index') <> 1""")
def pub01_manifest(spark: SparkSession, d: str) -> DataFrame:
    return R.check_manifest(_inventory(spark, d))


@query("""with w as (select sha256(text) as sha256, min(strlen(text)) as wanted from documents where doc_id % 9 > 0 group by 1),
t as (select sha256(text) as sha256, sha256(case when doc_id % 8 = 0 then text || '.' else text end) as real, strlen(case when doc_id % 8 = 0 then text || '.' else text end) as held
  from (select *, row_number() over (partition by text order by doc_id) as k from documents) where k = 1 and doc_id % 10 > 0),
r as (select coalesce(w.sha256, t.sha256) as sha256, case when real is null then 'missing' when wanted is null then 'extra' when real <> t.sha256 or held <> wanted then 'changed' end as state from w full join t on t.sha256 = w.sha256)
select * from r where state is not null""")
def pub02_verify(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    doc = table(spark, d, "documents").withColumn("name", F.sha2("text", 256))
    wanted = doc.where("doc_id % 9 > 0").select(F.col("name").alias("sha256"), F.length(F.col("text").cast("binary")).alias("size"))
    one = doc.withColumn("k", F.row_number().over(W.partitionBy("text").orderBy("doc_id"))).where("k = 1 and doc_id % 10 > 0")
    content = F.when(F.col("doc_id") % 8 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).cast("binary")
    return R.verify(wanted, one.select("name", content.alias("content")))


@query("""with p as (select o_orderkey as publication, o_orderkey as seq, case when o_orderstatus = 'F' then 'success' when o_orderkey % 100 = 0 then 'pending' else 'failed' end as status from orders),
r as (select *, row_number() over (partition by status order by seq desc) as k from p), kept as (select publication from r where status = 'pending' or (status = 'success' and k <= 3))
select distinct l_partkey as sha256 from lineitem where l_partkey not in (select l_partkey from lineitem join kept on publication = l_orderkey)""")
def pub03_retention(spark: SparkSession, d: str) -> DataFrame:
    """Objects that no kept publication refers to."""
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderkey") % 100 == 0, "pending").otherwise("failed")
    publications = table(spark, d, "orders").select(F.col("o_orderkey").alias("publication"), F.col("o_orderkey").alias("seq"), status.alias("status"))
    inventory = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("publication"), F.col("l_partkey").alias("sha256"))
    return R.retention_plan(publications, inventory, inventory)[1]


@query("""with o as (select source, doc_id as section, md5(text) as locator from documents), n as (select source, doc_id + 1 as section, md5(text) as locator from documents where doc_id % 6 > 0),
uo as (select source, locator, min(section) as section from o group by all having count(*) = 1), un as (select source, locator, min(section) as target from n group by all having count(*) = 1)
select o.section as place, target, case when target is null then 'unavailable' else 'moved' end as state from o left join uo on uo.source = o.source and uo.section = o.section left join un on un.source = o.source and un.locator = uo.locator""")
def pub04_migrate(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents").select("source", F.col("doc_id").alias("section"), F.md5("text").alias("locator"))
    new = doc.where("section % 6 > 0").withColumn("section", F.col("section") + 1)
    return R.migrate_locations(doc.select("source", "section", F.col("section").alias("place")), doc, new)


@query("select source, count(*) as sections, sum(length(text)) as chars, count(*) filter (length(text) < 200) as short, count(*) filter (trim(text) = '') as empty from documents group by source")
def pub06_stats(spark: SparkSession, d: str) -> DataFrame:
    return R.build_stats(table(spark, d, "documents"))


@query("select user_id, event_id as id, event_type as status from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as last from events) where event_type is distinct from last")
def pub07_changes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("status"))
    return R.status_changes(rows, "user_id").drop("at")
