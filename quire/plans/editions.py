"""Edition queries: sources as editions, documents as sections and pages, orders and lines as entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.operators import editions as E
from quire.streaming.usage import stream_dedupe

from .registry import query, shared_folder, table
from .usage import _run, _stream



@query("""with s as (select source, doc_id as section, 'd' || (doc_id % 9) as document, doc_id::varchar as anchor, case when doc_id % 2 = 0 then 'Section ' || doc_id else 'Own ' || doc_id end as title from documents),
t as (select source, n_chars as ord, lang || doc_id as title, doc_id as section from documents where doc_id % 3 = 0)
select s.source, s.section, case when s.title like 'Section %' then coalesce(t.title, s.title) else s.title end as title from s left join t on t.source = s.source and t.section = s.section""")
def doc09_toc(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    place = [F.concat(F.lit("d"), F.col("doc_id") % 9).alias("document"), F.col("doc_id").cast("string").alias("anchor")]
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Section "), F.col("doc_id"))).otherwise(F.concat(F.lit("Own "), F.col("doc_id")))
    sections = doc.select("source", F.col("doc_id").alias("section"), *place, title.alias("title"))
    toc = doc.where("doc_id % 3 = 0").select("source", F.col("n_chars").alias("ord"), F.concat("lang", "doc_id").alias("title"), *place)
    return E.attach_toc(toc, sections)[1].select("source", "section", "title")


@query("""with i as (select l_orderkey % 50 as source, l_orderkey as document, l_partkey % 5 as image, l_linenumber as ord, case when l_returnflag = 'A' then 'fig ' || l_linenumber else '' end as fig, case when l_returnflag = 'R' then null else 'alt ' || l_linenumber end as alt from lineitem),
o as (select source, document, image, min(ord) as ord, arg_min(coalesce(nullif(fig, ''), nullif(alt, ''), ''), (ord, coalesce(nullif(fig, ''), nullif(alt, ''), ''))) as caption from i group by 1, 2, 3),
g as (select source, document, string_agg(image::varchar, ',' order by ord, image) as images, arg_min(caption, (ord, image)) as caption from o group by 1, 2)
select o_orderkey % 50 as source, o_orderkey as section, coalesce(images, '') as images, coalesce(caption, '') as caption from orders left join g on g.document = o_orderkey""")
def doc10_images(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    images = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 50).alias("source"), F.col("l_orderkey").alias("document"), (F.col("l_partkey") % 5).alias("image"), F.struct("l_linenumber", "l_partkey").alias("ord"),
        F.when(flag == "A", F.concat(F.lit("fig "), "l_linenumber")).otherwise("").alias("figcaption"), F.when(flag != "R", F.concat(F.lit("alt "), "l_linenumber")).alias("alt"),
    )
    key = F.col("o_orderkey")
    images = images.withColumn("ord", F.col("ord.l_linenumber"))
    return E.attach_images(images, table(spark, d, "orders").select((key % 50).alias("source"), key.alias("document"), key.alias("section")))


@query("""with r as (select distinct 'link' as kind, page_id::varchar as key, url as detail from pages where length(url) % 2 = 0 union select 'parser', page_id::varchar, unnest(['long ' || length(html), 'lang']) from pages)
select sha256(concat_ws(chr(31), kind, key, detail)) as id, kind, key, detail from r""")
def doc13_issues(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages").withColumn("key", F.col("page_id"))
    links = pages.select("key", F.col("url").alias("href"), F.when(F.length("url") % 2 == 0, "unresolved").otherwise("external").alias("state"))
    return E.issues(links, pages.select("key", F.array(F.concat(F.lit("long "), F.length("html")), F.lit("lang")).alias("diagnostics")))


@query("""with occ as (select o_custkey as edition, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey)::int as ordinal, o_orderkey // 2 as document, 100 as size from orders),
once as (select * from occ qualify count(*) over (partition by edition, document) = 1),
nav as (select o_custkey as edition, o_orderkey as entry, o_orderkey // 2 as document, o_orderkey % 90 as place from orders where o_orderkey % 3 = 0),
st as (select n.edition, entry, ordinal as fo, place as fp, lead(ordinal) over w as no, lead(place) over w as np from nav n join once using (edition, document) window w as (partition by n.edition order by ordinal, place, entry)),
r as (select st.edition, entry, document, case when ordinal = fo then fp else 0 end as first, case when ordinal = no then np - 1 else size - 1 end as last from st join occ using (edition) where ordinal >= fo and (no is null or ordinal < no or (ordinal = no and 0 < np)))
select * from r where last >= first""")
def doc20_extents(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    orders = table(spark, d, "orders")
    key = F.col("o_orderkey")
    rank = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    half = F.floor(key / 2)
    occurrences = orders.select(F.col("o_custkey").alias("edition"), rank.alias("ordinal"), half.alias("document"), F.lit(100).alias("size"))
    navigation = orders.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("edition"), key.alias("entry"), half.alias("document"), (key % 90).alias("place"))
    return E.chapter_extents(navigation, occurrences)


@query("""with b as (select l_orderkey as recipe, (l_linenumber * 100000 + l_partkey) * 10000 + l_suppkey as pos, case l_returnflag when 'A' then 'part' when 'N' then 'ingredient' else 'instruction' end as role from lineitem),
c as (select *, last_value(case when role = 'part' then pos end ignore nulls) over (partition by recipe order by pos rows unbounded preceding) as part from b)
select recipe, pos, role as kind, row_number() over (partition by recipe, role order by pos) as ordinal, part from c where role <> 'part'""")
def rec06_annotate(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("l_returnflag") == "A", "part").when(F.col("l_returnflag") == "N", "ingredient").otherwise("instruction")
    return E.annotate(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("recipe"), ((F.col("l_linenumber") * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("pos"), role.alias("role")))


@query("""with i as (select o_custkey as doc, o_orderkey as first, o_orderkey + 40 as last, o_orderkey % 4 = 0 as old from orders)
select doc, first, last from i f where not old and not exists (select 1 from i e where e.old and e.doc = f.doc and f.first <= e.last and e.first <= f.last)""")
def rec06_uncovered(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), key.alias("first"), (key + 40).alias("last"))
    return E.without_covered(rows.where("first % 4 > 0"), rows.where("first % 4 = 0"))


@query("""with w as (select l_orderkey % 300 as page, l_quantity as "left", l_linenumber * 10.0::double as top, l_partkey::varchar as word from lineitem),
c as (select s_suppkey % 300 as page, s_suppkey as cell, (s_suppkey % 4) * 12.0 as x0, (s_suppkey % 4) * 12.0 + 15 as x1, 0.0 as y0, 45.0 as y1 from supplier)
select w.page, cell, string_agg(word, ' ' order by top, "left", word) as text from w join c using (page) where "left" + 2 >= x0 and "left" + 2 < x1 and top + 4 >= y0 and top + 4 < y1 group by 1, 2""")
def eva06_cells(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 300).alias("page"), F.col("l_quantity").alias("left"), (F.col("l_linenumber") * 10.0).alias("top"), F.lit(4.0).alias("width"), F.lit(8.0).alias("height"), F.col("l_partkey").cast("string").alias("word")
    )
    x = F.col("s_suppkey") % 4 * 12.0
    cells = table(spark, d, "supplier").select((F.col("s_suppkey") % 300).alias("page"), F.col("s_suppkey").alias("cell"), x.alias("x0"), (x + 15).alias("x1"), F.lit(0.0).alias("y0"), F.lit(45.0).alias("y1"))
    return E.cell_text(words, cells)


@query(r"""with b as (select doc_id, lang as kind, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) as body, trim(regexp_replace(lower(case when doc_id % 4 = 0 then 'something else altogether' when doc_id % 4 = 1 then text || ' and more' else text end), '\s+', ' ', 'g')) as phrase from documents)
select kind, count(*) as parts, count(*) filter (contains(body, phrase)) as exact, count(*) filter (contains(body, array_to_string(string_split(phrase, ' ')[1:3], ' '))) as anchored from b group by kind""")
def eva10_reading(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    expected = F.when(F.col("doc_id") % 4 == 0, "something else altogether").when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit(" and more"))).otherwise(F.col("text"))
    return E.reading_summary(doc.select(F.col("doc_id").alias("key"), F.col("lang").alias("kind"), expected.alias("expected")), doc.select(F.col("doc_id").alias("key"), "text"))


@query("""select o_orderkey as cell from orders join (select l_orderkey, string_agg(l_returnflag, ' ' order by l_linenumber, l_partkey) as t from lineitem group by 1) on l_orderkey = o_orderkey where t <> 'N N'""")
def rev05_consistency(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    name = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", name.alias("n")))), lambda x: x["n"])
    cells = line.groupBy(F.col("l_orderkey").alias("cell")).agg(ids.alias("line_ids")).withColumn("text", F.lit("N N"))
    cells = cells.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("cell")), "cell")
    return E.consistency(cells, line.select(name.alias("line"), F.col("l_returnflag").alias("text")))


@query("""with c as (select conv_id, string_agg(text, chr(10) order by turn) as t, string_agg(distinct role, ',' order by role) as p from conversations group by 1)
select conv_id as selection, case when conv_id % 3 = 0 then t else '' end as text, length(p) as pages from c""")
def rev13_sections(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("line", F.concat_ws(":", "conv_id", "turn"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"])
    selections = c.groupBy(F.col("conv_id").alias("selection")).agg(lines.alias("line_ids"))
    rows = E.approved_sections(selections, c.select("line", "text", F.col("role").alias("page")), selections.where("selection % 3 = 0"))
    return rows.withColumn("pages", F.length("pages"))


@query("""with recursive last as (select user_id as scope, arg_max(event_type, event_id) as action, arg_max(event_id % 3, event_id) as digest from events group by 1),
own as (select p_partkey as scope, case when l.scope is null then 'undecided' when action = 'error' then 'revoked' when digest <> p_partkey % 3 then 'changed' else 'approved' end as state from part left join last l on l.scope = p_partkey),
uses as (select p_partkey as scope, p_partkey + 1 as needs from part where p_size > 30 union select p_partkey, p_partkey - 1 from part where p_size % 7 = 0),
reach(a, b) as (select scope, needs from uses union select a, needs from reach join uses on scope = b),
b(scope) as (select scope from own where state <> 'approved' union select a from reach where a = b union select needs from uses where needs not in (select scope from own) union select uses.scope from b join uses on needs = b.scope)
select own.scope, case when state = 'approved' and own.scope in (select scope from b) then 'support' else state end as state from own""")
def rev08_eligibility(spark: SparkSession, d: str) -> DataFrame:
    """Larger parts need the next one, some the one before: chains, cycles and needs that don't exist."""
    shared_folder(spark)
    part = table(spark, d, "part")
    scopes = part.select(F.col("p_partkey").alias("scope"), (F.col("p_partkey") % 3).alias("digest"))
    action = F.when(F.col("event_type") == "error", "revoke").otherwise("approve")
    decisions = table(spark, d, "events").select(F.col("user_id").alias("scope"), action.alias("action"), (F.col("event_id") % 3).alias("digest"), F.col("event_id").alias("seq"))
    uses = part.where("p_size > 30").select("p_partkey", F.col("p_partkey") + 1).union(part.where("p_size % 7 = 0").select("p_partkey", F.col("p_partkey") - 1))
    return E.eligibility(scopes, decisions, uses.toDF("scope", "needs"))


@query("""with p as (select l_orderkey as source, l_linenumber as page from lineitem), w as (select source, max(page) as hi, min(page) as lo, count(distinct page) as n, count(*) as r from p group by 1),
s as (select l_partkey as section, l_orderkey as source, unnest([1, l_linenumber]) as page from lineitem), k as (select o_orderkey as source, o_orderkey % 7 as wanted from orders)
select 'pages' as rule, source::varchar as key from w where lo <> 1 or hi <> n or n <> r
union all select distinct 'section page', section::varchar from s where not exists (select 1 from p where p.source = s.source and p.page = s.page)
union all select 'count', coalesce(w.source, k.source)::varchar from w full join k on w.source = k.source where r is distinct from wanted""")
def trn14_candidate(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    pages = line.select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("page"))
    sections = line.select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("section"), F.array(F.lit(1), F.col("l_linenumber")).alias("pages"))
    return E.validate_candidate(pages, sections, table(spark, d, "orders").select(F.col("o_orderkey").alias("source"), (F.col("o_orderkey") % 7).alias("wanted")))


@query("select distinct event_id % 700 as id from events")
def use02_stream(spark: SparkSession, d: str) -> DataFrame:
    """Ids that repeat within the watermark come out once."""
    stream = _stream(spark, d, [(F.col("event_id") % 700).alias("id"), F.col("ts").cast("timestamp").alias("at")])
    return _run(stream_dedupe(stream, "id", "60 days"), "append").select("id")


@query("""with h as (select l_orderkey as section, max(case when l_returnflag = 'A' then l_linenumber end) as i, min(case when l_returnflag = 'N' then l_linenumber end) as m from lineitem group by 1)
select section from h join orders on o_orderkey = section and o_orderstatus <> 'P' where i < m""")
def rec05_explicit(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("l_returnflag") == "A", "ingredient").when(F.col("l_returnflag") == "N", "instruction")
    blocks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("section"), F.col("l_linenumber").alias("pos"), role.alias("role"))
    return E.explicit_recipes(table(spark, d, "orders").select(F.col("o_orderkey").alias("section"), (F.col("o_orderstatus") != "P").alias("in_toc")), blocks)


@query("""with l as (select l_orderkey * 1000000 + l_linenumber * 10000 + l_partkey as link, any_value(l_orderkey) as source_recipe, min(l_returnflag) as source_role, any_value(l_partkey % 5) as s, any_value(l_orderkey % 400) as doc, any_value(l_partkey % 1000) as place from lineitem group by 1),
r as (select o_orderkey % 400 as doc, o_orderkey as recipe, o_custkey % 900 as first, o_custkey % 900 + o_orderkey % 60 as last from orders),
h as (select link, arg_min(recipe, (last - first, recipe)) as target_recipe from l join r using (doc) where place >= first and place <= last group by 1)
select link, source_recipe, source_role, target_recipe, case s when 0 then 'external' when 1 then 'unresolved_document' when 2 then 'unresolved_anchor' else case when target_recipe = source_recipe then 'same_recipe' when target_recipe is not null then 'bounded_recipe' else 'source_target_requires_review' end end as resolution
from l left join h using (link)""")
def rec10_references(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 10000 + F.col("l_partkey")
    s = F.col("l_partkey") % 5
    state = F.when(s == 0, "external").when(s == 1, "no document").when(s == 2, "no anchor").otherwise("resolved")
    rows = table(spark, d, "lineitem").select(key.alias("link"), F.col("l_orderkey").alias("source_recipe"), F.col("l_returnflag").alias("source_role"), state.alias("state"), (F.col("l_orderkey") % 400).alias("doc"), (F.col("l_partkey") % 1000).alias("place"))
    links = rows.groupBy("link", "source_recipe", "state", "doc", "place").agg(F.min("source_role").alias("source_role"))
    first = F.col("o_custkey") % 900
    ranges = table(spark, d, "orders").select((F.col("o_orderkey") % 400).alias("doc"), F.col("o_orderkey").alias("recipe"), first.alias("first"), (first + F.col("o_orderkey") % 60).alias("last"))
    return E.catalog_references(links, ranges)


@query("""with b as (select o_orderkey as key, unnest([1, 2]) as block, unnest([1, 4]) as first, unnest([3, 7]) as last from orders), o as (select key, block, unnest(generate_series(first, last)) as old from b),
l as (select distinct l_orderkey as key, l_linenumber as old, l_linenumber + case when l_partkey % 7 = 0 then 1 else 0 end as new from lineitem),
h as (select key, block, min(new) as first, max(new) as last, count(distinct new) as n from o join l using (key, old) group by 1, 2)
select key, block, first, last, last - first + 1 <> n as refused from h""")
def trn06_remap(spark: SparkSession, d: str) -> DataFrame:
    block = F.explode(F.array(F.struct(F.lit(1).alias("block"), F.lit(1).alias("first"), F.lit(3).alias("last")), F.struct(F.lit(2).alias("block"), F.lit(4).alias("first"), F.lit(7).alias("last"))))
    labels = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), block.alias("b")).select("key", "b.*")
    n = F.col("l_linenumber")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), n.alias("old"), (n + F.when(F.col("l_partkey") % 7 == 0, 1).otherwise(0)).alias("new")).distinct()
    return E.remap_labels(labels, lines)


@query("""select doc_id as page, 0 as crop, split_part(text, chr(10), 1) as line, case when doc_id % 4 = 0 then 'tied' when doc_id % 3 * 2 <= 3 then 'rejected' when doc_id % 7 = 0 and not list_contains(string_split('~' || text, chr(10)), split_part(text, chr(10), 1)) then 'unmatched' else 'reviewed' end as reason from documents""")
def trn10_review(spark: SparkSession, d: str) -> DataFrame:
    doc, k = table(spark, d, "documents"), F.col("doc_id")
    first = F.substring_index("text", "\n", 1)
    votes = doc.select(k.alias("page"), F.lit(0).alias("crop"), first.alias("line"), (k % 3).alias("support"), F.lit(3).alias("voters"), (k % 4 == 0).alias("tie"))
    return E.quantity_review(votes, doc.select(k.alias("page"), F.when(k % 7 == 0, F.concat(F.lit("~"), "text")).otherwise(F.col("text")).alias("text")))


@query()
def doc19_units(spark: SparkSession, d: str) -> DataFrame:
    from quire.functions.html import capture_nodes

    tag = F.col("tag")
    block = F.coalesce(tag.isin("p", "li", "td", "h1", "h2", "h3"), F.lit(False))
    return E.search_units(capture_nodes(table(spark, d, "pages")), block, F.coalesce(tag.isin("h1", "h2", "h3"), F.lit(False)))
