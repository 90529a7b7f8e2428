"""Structure queries: lines of `documents` as blocks, `pages` as HTML documents, orders and lines as ordered records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions.html import capture_nodes
from quire.operators import model as M, structure as D

from .registry import query, table

SQUASH = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
SECTIONS = f"""
blocks as (select doc_id as doc, i - 1 as i, parts[i] as text from (select doc_id, parts, unnest(generate_series(1, len(parts))) as i from (select doc_id, string_split(text, chr(10)) as parts from documents))),
marked as (select *, length(text) < 60 as head, row_number() over (partition by doc order by i) as k from blocks),
grouped as (select *, sum(case when head and k > 1 then 1 else 0 end) over (partition by doc order by i rows unbounded preceding) as section, {SQUASH.format('text')} as line from marked),
sections as (select doc, section, coalesce(arg_min(line, i) filter (head), 'Section ' || (doc % 7 + 1) || '.' || (section + 1)) as title, coalesce(string_agg(line, chr(10) order by i) filter (line <> ''), '') as text from grouped group by doc, section)"""


def _sections(spark: SparkSession, d: str) -> DataFrame:
    """Short lines are headings; the spine ordinal is doc_id % 7."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return D.split_sections(D.blocks_of(docs), F.length("text") < 60, F.col("doc") % 7)


@query(f"with {SECTIONS} select doc, section::bigint as section, title, text from sections")
def doc04_sections(spark: SparkSession, d: str) -> DataFrame:
    return _sections(spark, d)


@query(f"""with {SECTIONS} select doc, section::bigint as section, coalesce(sum(length(text) + 1) over (partition by doc order by section rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from sections""")
def doc05_offsets(spark: SparkSession, d: str) -> DataFrame:
    return D.text_offsets(_sections(spark, d)).select("doc", "section", "offset")


@query("select conv_id as edition, turn as ordinal, role as document, row_number() over (partition by conv_id, role order by turn) = 1 as first from conversations")
def doc06_reading_order(spark: SparkSession, d: str) -> DataFrame:
    spine = table(spark, d, "conversations").select(F.col("conv_id").alias("edition"), F.col("turn").alias("ordinal"), F.col("role").alias("document"))
    return D.reading_order(spine)


HREFS = """links as (select page_id, k, hrefs[k] as href from (select page_id, hrefs, unnest(generate_series(1, len(hrefs))) as k from (select page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) as hrefs from pages)))"""


@query(f"""with {HREFS},
split as (select page_id, k, href, case when contains(href, '#') then regexp_extract(href, '[^#]*$') else '' end as fragment, split_part(href, '#', 1) as path,
  regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') as external from links),
placed as (select *, case when external then null when path = '' then 'docs/p' || page_id when path like '/%' then trim(path, '/') else 'docs/' || path end as target from split),
known as (select distinct target, length(target) % 3 = 0 as anchored from placed where target is not null and length(target) % 2 = 0)
select page_id, k, href, p.target, fragment, case when external then 'external' when n.target is null then 'unresolved' when fragment = '' then 'resolved_resource' when n.anchored and fragment = 'top' then 'resolved_node' else 'unresolved' end as state
from placed p left join known n on n.target = p.target""")
def doc07_links(spark: SparkSession, d: str) -> DataFrame:
    """Targets of even length are documents; those of a length that 3 divides have an anchor "top"."""
    found = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("k", "href"))
    links = found.select("page_id", (F.col("k") + 1).alias("k"), "href", F.concat(F.lit("docs/p"), "page_id").alias("base"))
    nothing = spark.createDataFrame([], "document string, anchor string")
    paths = D.resolve_links(links, nothing.select("document"), nothing).select(F.col("target").alias("document")).dropna().distinct()
    documents = paths.where(F.length("document") % 2 == 0)
    anchors = documents.where(F.length("document") % 3 == 0).withColumn("anchor", F.lit("top"))
    return D.resolve_links(links, documents, anchors).select("page_id", "k", "href", "target", "fragment", "state")


@query()
def doc01_nodes(spark: SparkSession, d: str) -> DataFrame:
    return capture_nodes(table(spark, d, "pages"))


@query()
def doc12_stats(spark: SparkSession, d: str) -> DataFrame:
    return D.structure_stats(capture_nodes(table(spark, d, "pages")))


@query()
def doc14_in_list(spark: SparkSession, d: str) -> DataFrame:
    nodes = D.mark_inside(capture_nodes(table(spark, d, "pages")), F.col("tag").isin("ul", "ol", "table"))
    return nodes.select("doc", "preorder", "inside")


@query()
def doc17_outer_blocks(spark: SparkSession, d: str) -> DataFrame:
    block = F.coalesce(F.col("tag").isin("p", "li", "td", "pre", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6"), F.lit(False))
    return D.outer_blocks(capture_nodes(table(spark, d, "pages")), block).select("doc", "preorder", "subtree_end", "tag")


@query()
def doc11_context(spark: SparkSession, d: str) -> DataFrame:
    nodes = capture_nodes(table(spark, d, "pages"))
    return D.last_boundary(nodes, F.coalesce(F.col("tag").isin("h1", "h2", "h3"), F.lit(False)), F.col("id")).select("doc", "preorder", "context")


@query("""with n as (select doc_id as key, text, greatest(ceil(length(text) / 1800.0), 1)::int as n from documents), r as (select key, text, unnest(generate_series(0, n - 1)) as chunk from n)
select key, chunk::int as chunk, sha256(key || ':' || chunk) as id, substring(text, (chunk * 1800 + 1)::int, 1800) as text from r""")
def doc18_chunks(spark: SparkSession, d: str) -> DataFrame:
    return D.chunks(table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"), 1800)


@query("""with r as (select doc_id as key, text, unnest(generate_series(0, greatest(length(text) - 1, 0), 4000)) as "offset" from documents)
select key, "offset"::int as "offset", substring(text, ("offset" + 1)::int, 4000) as "window", case when "offset" + 4000 < length(text) then "offset" + 4000 end as next_offset from r""")
def doc22_windows(spark: SparkSession, d: str) -> DataFrame:
    return D.reading_windows(table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"))


@query("""select o_custkey, o_orderkey, lag(o_orderkey) over w as previous, lead(o_orderkey) over w as next, floor((row_number() over w - 1) / 30) * 30 as contents_offset
from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def doc24_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return D.neighbours(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey")


@query("""with r as (select conv_id, turn, unnest([turn - 1, turn + 1, turn + 100]) as target, unnest([0, 1, 2]) as ord from conversations)
select conv_id as source, r.turn as section, 'turn ' || target as label, target, floor((row_number() over (partition by conv_id, r.turn order by ord) - 1) / 20) as page
from r where exists (select 1 from conversations c where c.conv_id = r.conv_id and c.turn = r.target)""")
def doc25_related(spark: SparkSession, d: str) -> DataFrame:
    ref = lambda t: F.struct(F.concat(F.lit("turn "), t).alias("label"), t.alias("target"))
    turn = F.col("turn")
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("source"), turn.alias("section"), F.array(ref(turn - 1), ref(turn + 1), ref(turn + 100)).alias("references"))
    return D.related_targets(rows)


@query("""with e as (select o_orderkey as edition, o_orderstatus as sha from orders), old as (select l_orderkey as edition, l_orderkey * 10 + l_linenumber as id, l_quantity as v from lineitem where l_linenumber <= 3),
inc as (select l_orderkey as edition, case when l_returnflag = 'A' then 'F' else 'O' end as sha, l_orderkey * 10 + l_linenumber as id, l_quantity + 1 as v from lineitem where l_linenumber >= 3)
select edition, id, v from old union all select edition, id, v from inc join e using (edition, sha) where id not in (select id from old)""")
def doc26_merge(spark: SparkSession, d: str) -> DataFrame:
    editions = table(spark, d, "orders").select(F.col("o_orderkey").alias("edition"), F.col("o_orderstatus").alias("sha"))
    lines = table(spark, d, "lineitem").withColumn("edition", F.col("l_orderkey")).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    old = lines.where("l_linenumber <= 3").select("edition", "id", F.col("l_quantity").alias("v"))
    sha = F.when(F.col("l_returnflag") == "A", "F").otherwise("O")
    incoming = lines.where("l_linenumber >= 3").select("edition", sha.alias("sha"), "id", (F.col("l_quantity") + 1).alias("v"))
    return D.merge_interpretations(old, incoming, editions)[0]


@query("""with o as (select l_orderkey as edition, count(*) as occurrences, count(distinct l_partkey) as documents from lineitem group by 1),
k as (select edition, string_agg(kind || '=' || n, ',' order by kind) as kinds, sum(n) as entities from (select l_orderkey as edition, l_returnflag as kind, count(*) as n from lineitem group by 1, 2) group by 1)
select o_orderkey as edition, coalesce(occurrences, 0) as occurrences, coalesce(documents, 0) as documents, coalesce(kinds, '') as kinds, coalesce(entities, 0) as entities
from orders left join o on edition = o_orderkey left join k using (edition)""")
def doc28_books(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return D.describe_books(
        table(spark, d, "orders").select(F.col("o_orderkey").alias("edition")),
        lines.select(F.col("l_orderkey").alias("edition"), F.col("l_partkey").alias("document")),
        lines.select(F.col("l_orderkey").alias("edition"), F.col("l_returnflag").alias("kind")),
    )


@query("""select 'part' as rule, (l_orderkey || '.' || l_linenumber)::varchar as key from lineitem where l_partkey not in (select p_partkey from part where p_size < 25)
union all select 'order', (l_orderkey || '.' || l_linenumber)::varchar from lineitem where l_orderkey not in (select o_orderkey from orders)
union all select 'lines', l_orderkey::varchar from (select l_orderkey, min(l_linenumber) as lo, max(l_linenumber) as hi, count(distinct l_linenumber) as n, count(*) as r from lineitem group by 1) where lo <> 1 or hi - lo + 1 <> n or n <> r""")
def doc21_validate(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").withColumn("line", F.concat_ws(".", "l_orderkey", "l_linenumber"))
    return (
        D.missing_references(lines, "line", "l_partkey", table(spark, d, "part").where("p_size < 25"), "p_partkey", "part")
        .unionByName(D.missing_references(lines, "line", "l_orderkey", table(spark, d, "orders"), "o_orderkey", "order"))
        .unionByName(D.gaps(lines, "l_orderkey", "l_linenumber", "lines"))
    )


def _spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lines of documents as text nodes, each after a block, some after an image; a span of two parts in each document, and one reversed."""
    lines = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    kinds = F.array(F.struct(F.lit("p").alias("tag"), F.lit(None).cast("string").alias("text")), F.struct(F.when(F.col("i") % 7 == 3, "img").otherwise("span").alias("tag"), F.lit(None).cast("string").alias("text")), F.struct(F.lit(None).cast("string").alias("tag"), F.col("line").alias("text")))
    nodes = lines.select("doc", "i", F.posexplode(kinds).alias("k", "n")).select("doc", (F.col("i") * 3 + F.col("k")).alias("preorder"), "n.tag", "n.text")
    nodes = nodes.withColumn("id", F.concat_ws(":", "doc", "preorder"))
    ends = lines.groupBy("doc").agg(F.max("i").alias("last"), F.max_by(F.length("line"), "i").alias("end_len"), F.min_by(F.length("line"), "i").alias("len"))
    node = lambda i: F.concat_ws(":", "doc", i * 3 + 2)
    first, last, middle = F.lit(0), F.col("last"), F.floor(F.col("last") / 2)
    part = lambda span, n, a, x, b, y: F.struct(F.concat(F.lit(span), F.col("doc")).alias("span"), F.lit(n).alias("part"), node(a).alias("start_node"), x.cast("int").alias("start_offset"), node(b).alias("end_node"), y.cast("int").alias("end_offset"))
    zero = F.lit(0)
    parts = ends.select(F.explode(F.array(part("a", 0, first, F.floor(F.col("len") / 3), last, F.col("end_len")), part("a", 1, middle, zero, last, F.floor(F.col("end_len") / 2)), part("r", 0, last, F.col("end_len"), first, zero))).alias("x")).select("x.*")
    return parts, nodes


SPANS = r"""l as (select doc_id as doc, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i, unnest(string_split(text, chr(10))) as line from documents where text is not null),
p as (select *, chr(10) || case when i % 7 = 3 then ' [uninterpreted image] ' else '' end as before from l),
o as (select *, coalesce(sum(length(before) + length(line)) over (partition by doc order by i rows between unbounded preceding and 1 preceding), 0) + length(before) as place from p),
b as (select doc, string_agg(before || line, '' order by i) as body, max(i) as last, arg_max(length(line), i) as end_len, arg_min(length(line), i) as len, arg_max(place, i) as end_place, arg_min(place, i) as first_place from o group by doc),
m as (select b.*, o.place as middle from b join o on o.doc = b.doc and o.i = b.last // 2)"""


@query(rf"""with {SPANS}
select 'a' || doc as span, md5(regexp_replace(substring(body, (first_place + len // 3 + 1)::bigint, (end_place + end_len - first_place - len // 3)::bigint) || chr(10) || substring(body, (middle + 1)::bigint, (end_place + end_len // 2 - middle)::bigint), '^\s+|\s+$', '', 'g')) as text_md5 from m""")
def doc16_spans(spark: SparkSession, d: str) -> DataFrame:
    parts, nodes = _spans(spark, d)
    bounds, _ = D.span_bounds(parts.where(~F.startswith("span", F.lit("r"))), nodes)
    return D.span_text(bounds, nodes, D.separators(F.col("tag"))).select("span", F.md5("text").alias("text_md5"))


@query(f"with {SPANS} select 'r' || doc as span, 'reversed' as reason from m where last > 0 or end_len > 0")
def doc15_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Spans that end before they start."""
    parts, nodes = _spans(spark, d)
    return D.span_bounds(parts, nodes)[1].select("span", "reason")


@query("""with l as (select l_orderkey as doc, concat_ws('.', l_orderkey, l_linenumber, l_partkey) as id, l_linenumber as pre, 'o' || l_orderkey as parent from lineitem),
k as (select doc, list(id order by pre, id) as kids, count(*) as fin from l group by 1), o as (select o_orderkey as doc, 'o' || o_orderkey as id, coalesce(kids, []) as kids, coalesce(fin, 0) as fin from orders left join k on doc = o_orderkey),
n as (select doc, id, 0 as pre, null as parent from o union all select * from l), m as (select l.*, o.kids, o.fin, lag(pre) over (partition by l.doc order by pre, l.id) as last from l join o on o.id = l.parent)
select 'places' as rule, doc::varchar as key from n group by doc having min(pre) <> 0 or max(pre) <> count(*) - 1 or count(distinct pre) <> count(*)
union select 'roots', doc::varchar from n group by doc having count(*) filter (parent is null) <> 1
union select 'node twice', id from n group by id having count(*) > 1
union select 'parent', id from l where parent not in (select id from o)
union select 'outside its parent', id from m where pre <= 0 or pre > fin
union select 'siblings', id from m where pre <> coalesce(last, 0) + 1
union select 'parent names another', id from m where kids[pre] is distinct from id
union select 'child names another', 'o' || doc || ':' || c.id from (select doc, unnest(kids) as id, generate_subscripts(kids, 1) as pre from k) c where not exists (select 1 from l where l.doc = c.doc and l.id = c.id and l.pre = c.pre)""")
def doc21_trees(spark: SparkSession, d: str) -> DataFrame:
    """Orders as roots of their lines; a line's number is its place. Numbers move to their order; names are made there."""
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # names are longer than numbers, and what a task sorts should fit its memory
    held = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"), "l_partkey").repartition(parts, "doc")
    name = lambda n, part: F.concat_ws(".", "doc", n, part).alias("id")
    n = F.col("n")
    lines = held.select("doc", name(n, F.col("l_partkey")), n.alias("preorder"), n.alias("subtree_end"), F.concat(F.lit("o"), "doc").alias("parent"), (n - 1).alias("ordinal"), F.lit("text").alias("kind"), F.array().cast("array<string>").alias("children"))
    kids = held.groupBy("doc").agg(F.collect_list(F.struct("n", "l_partkey")).alias("held"))
    named = F.transform("held", lambda x: F.struct(x["n"].alias("n"), name(x["n"], x["l_partkey"])))
    kids = kids.select("doc", F.transform(F.array_sort(named), lambda x: x["id"]).alias("children"))
    roots = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc")).repartition(parts, "doc").join(kids, "doc", "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))
    roots = roots.select("doc", F.concat(F.lit("o"), "doc").alias("id"), F.lit(0).alias("preorder"), F.size("children").alias("subtree_end"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("int").alias("ordinal"), F.lit("element").alias("kind"), "children")
    return M.check_trees(lines.unionByName(roots))
