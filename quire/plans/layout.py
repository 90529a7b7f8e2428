"""Layout queries: pages as captured HTML, lines of documents as blocks with types, documents as scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions.html import capture_nodes, navigation
from quire.operators import boundaries as B, layout as L, structure as D

from .registry import query, shared_folder, table

#: Text of HTML; as browsers read it, a name's semicolon may be absent, as where a heading was cut.
PLAIN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '<[^>]*>', '', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#x27;?', '''', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))"""
SPACED = "replace(t, '<br>', ' ')"
#: The pages' bodies are a nav of items, a loose text, a heading, paragraphs and a loose footer; a paragraph with an open bold holds all that follow.
BODY = r"""b as (select page_id, regexp_extract(html, '<nav>(.*?)</nav>', 1, 's') as nav, regexp_extract(html, '<div class="ad">(.*?)</div>', 1, 's') as ad, regexp_extract(html, '<h1>(.*?)</h1>', 1, 's') as head,
  regexp_extract(html, '</h1>(.*?)</article>', 1, 's') as rest, regexp_extract(html, '<footer>(.*?)</footer>', 1, 's') as foot from pages),
c as (select *, case when contains(rest, '<p><b>') then split_part(rest, '<p><b>', 1) else rest end as ps, case when contains(rest, '<p><b>') then [substr(rest, strpos(rest, '<p><b>'))] else [] end as bold from b),
d as (select page_id, e.tag as tag, e.t as t, place from (select page_id, unnest(parts) as e, generate_subscripts(parts, 1) as place from (select page_id, list_concat(list_transform(regexp_extract_all(nav, '<li>(.*?)</li>', 1, 's'), lambda x: {'tag': 'li', 't': x}), [{'tag': 'text', 't': ad}, {'tag': 'h1', 't': head}],
  list_transform(regexp_extract_all(ps, '<p>(.*?)</p>', 1, 's'), lambda x: {'tag': 'p', 't': x}), list_transform(bold, lambda x: {'tag': 'p', 't': x}), [{'tag': 'text', 't': foot}]) as parts from c)))"""


@query(rf"""with {BODY}, e as (select page_id as doc, tag, {PLAIN.format('t')} as text, place as o from d),
f as (select * from e where tag <> 'text' or text <> '') select doc, row_number() over (partition by doc order by o) - 1 as i, tag, text from f""")
def doc03_leaves(spark: SparkSession, d: str) -> DataFrame:
    return L.leaf_blocks(capture_nodes(table(spark, d, "pages"))).select("doc", "i", "tag", "text")


@query(rf"""with l as (select page_id, hrefs[k] as href, labels[k] as label, k from (select page_id, hrefs, labels, unnest(generate_series(1, len(hrefs))) as k from
  (select page_id, regexp_extract_all(nav, 'href="([^"]*)"', 1) as hrefs, regexp_extract_all(nav, '<a[^>]*>(.*?)</a>', 1) as labels from (select page_id, regexp_extract(html, '<nav>(.*?)</nav>', 1, 's') as nav from pages)))),
p as (select *, trim(href, '/') as target from l), known as (select distinct target from p where length(target) % 2 = 0)
select page_id as doc, k - 1 as ordinal, case page_id % 3 when 0 then 'toc' when 1 then 'landmark' else 'other' end as kind, {PLAIN.format('label')} as label, p.target, case when n.target is null then 'unresolved' else 'resolved_resource' end as state
from p left join known n on n.target = p.target""")
def doc08_navigation(spark: SparkSession, d: str) -> DataFrame:
    """Every third page's list is a table of contents, the next one's landmarks; targets of even length are documents."""
    k = F.col("page_id") % 3
    nav = F.when(k == 0, '<nav epub:type="toc">').when(k == 1, '<nav epub:type="landmarks">').otherwise("<nav>")
    entries = navigation(table(spark, d, "pages").select("page_id", F.replace("html", F.lit("<nav>"), nav).alias("html"))).withColumn("base", F.concat(F.lit("docs/p"), F.col("doc").cast("string")))
    nothing = spark.createDataFrame([], "document string, anchor string")
    paths = D.resolve_links(entries, nothing.select("document"), nothing).select(F.col("target").alias("document")).dropna().distinct()
    return D.resolve_links(entries, paths.where(F.length("document") % 2 == 0), nothing).select("doc", "ordinal", "kind", "label", "target", "state")


@query(rf"""with {BODY}, e as (select page_id as doc, place as o, tag, {PLAIN.format(SPACED)} as text from d),
f as (select * from e where tag <> 'text' and text <> '') select doc, row_number() over (partition by doc order by o) as k, tag,
case tag when 'li' then 'authored-inline-ingredient' when 'h1' then 'authored-inline-title,name' else '' end as classes, text from f""")
def rec02_profile(spark: SparkSession, d: str) -> DataFrame:
    """Links in items and a span that holds a whole heading tell roles; a bold start of a paragraph tells none. A book is ten pages."""
    html = F.replace(F.replace("html", F.lit('<a href='), F.lit('<a class="part" href=')), F.lit("<b>"), F.lit('<b class="part">'))
    html = F.regexp_replace(html, r"(?s)<h1>(.*?)</h1>", '<h1 class="name"><span class="big">$1</span></h1>')
    # A bold start that is never closed would cover its paragraph, so it gets a first word outside.
    html = F.replace(html, F.lit('<p><b class="part">'), F.lit('<p><i></i><b class="none">'))
    book = F.floor(F.col("doc") / 10)
    nodes = capture_nodes(table(spark, d, "pages").select("page_id", html.alias("html"))).withColumn("book", book)
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("class")) for r, c in (("title", "name"), ("title_inline", "big"), ("ingredient_inline", "part"))]))
    profiles = table(spark, d, "pages").select(F.floor(F.col("page_id") / 10).alias("book")).distinct().select("book", rules.alias("r")).select("book", "r.*")
    blocks = L.profile_blocks(nodes, profiles)
    k = F.row_number().over(D.W.partitionBy("doc").orderBy("pos"))
    return blocks.select("doc", k.alias("k"), "tag", F.array_join("classes", ",").alias("classes"), "text")


LINES = "l as (select doc_id as doc, unnest(parts) as raw, unnest(generate_series(0, len(parts) - 1)) as pos, doc_id % 3 as m from (select doc_id, string_split(text, chr(10)) as parts from documents))"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))


@query(rf"""with {LINES}, t as (select doc, pos, length(raw) % 7 as k, case length(raw) % 7 when 0 then 'Serves 4' when 1 then 'TO SERVE' when 2 then 'FOR THE SAUCE' when 3 then 'Heat ' || raw else '- ' || lower(raw) end as text, length(raw) % 5 as s from l),
u as (select *, case when s = 0 then 'title' when s = 1 then null when k = 0 then 'yield' when s = 2 then null when k in (1, 2) then case when lead(k) over w = 0 then 'title' else 'component' end else 'text' end as kind,
  case when s = 0 then 'none' when s = 1 then null when k = 0 then 'ingredient' when s = 2 then null when k = 1 then 'instruction' when k = 2 then 'ingredient' when k = 3 then 'verb' end as ev from t window w as (partition by doc order by pos)),
v as (select *, sum(case when ev in ('none', 'ingredient', 'instruction') then 1 else 0 end) over (partition by doc order by pos) as part from u),
x as (select *, coalesce(max(case when ev in ('none', 'ingredient', 'instruction') then ev end) over (partition by doc, part), 'none') as st, count(*) filter (ev = 'verb') over (partition by doc, part order by pos) > 0 as verb from v)
select doc, pos, case when kind <> 'text' then kind when kind is null or st = 'none' then null when verb then 'instruction' else st end as role from x""")
def rec11_svg(spark: SparkSession, d: str) -> DataFrame:
    """A line's length gives its type and, but for plain lines, its words."""
    n = F.length("raw")
    k, s = n % 7, n % 5
    text = F.when(k == 0, "Serves 4").when(k == 1, "TO SERVE").when(k == 2, "FOR THE SAUCE").when(k == 3, F.concat(F.lit("Heat "), "raw")).otherwise(F.concat(F.lit("- "), F.lower("raw")))
    style = F.when(s == 0, "font-family: Sagan; font-size: 18.5px").when(s == 1, "font-family: Akkurat; font-size:7px").when(s == 2, "font-family: Other; font-size: 9px").otherwise("font-size: 8px; font-family:Akkurat")
    return L.svg_roles(_lines(spark, d).select("doc", "pos", style.alias("style"), text.alias("text"))).select("doc", "pos", "role")


@query(rf"""with {LINES}, t as (select *, m < 2 and min(case when pos > 0 and length(raw) % 4 = 0 then pos end) over (partition by doc) is not null as counts, min(case when pos > 0 and length(raw) % 4 = 0 then pos end) over (partition by doc) as yield from l)
select doc, pos, case when not counts then null when pos = 0 then 'title' when pos = yield then 'ingredient-list' when pos > yield then 'instruction' end as role,
case when pos = 0 then case when m < 2 then case when counts then 'BEANS & RICE' else 'BEANS & RICE Some note. ' || raw end else 'Beans. ' || raw end when length(raw) % 4 = 0 then 'MAKES 2 ' || raw else '- ' || raw end as text from t""")
def rec11_fragments(spark: SparkSession, d: str) -> DataFrame:
    """Two of three documents start with capitals; lines of a length that 4 divides state the yield."""
    first = F.when(F.col("doc") % 3 < 2, "BEANS & RICE Some note. ").otherwise("Beans. ")
    lead = F.when(F.col("pos") == 0, first).when(F.length("raw") % 4 == 0, "MAKES 2 ").otherwise("- ")
    return L.fragment_roles(_lines(spark, d).select("doc", "pos", F.concat(lead, "raw").alias("text"))).select("doc", "pos", "role", "text")


ROLE = "case when length(raw) < 60 or pos = 0 and doc % 4 = 0 then 'title' when length(raw) % 6 in (0, 1) then 'ingredient' when length(raw) % 6 = 2 then 'method' when length(raw) % 19 = 0 then 'stop' when length(raw) % 6 = 3 then 'note' end"


@query(rf"""with {LINES}, a as (select doc // 20 as book, doc as document, pos as i, doc * 100000 + pos as pos, case when pos % 3 = 0 then 'td' else 'p' end as tag, {ROLE} as role, doc * 100000 + pos + length(raw) % 2 as reach, length(raw)::varchar as text from l where doc % 11 <> 5),
s as (select *, role is not distinct from 'title' as title, lead(document) over w as nd, lead(i) over w as ni, role is not distinct from 'title' and not (coalesce(lag(role) over w = 'title', false) and lag(document) over w = document) as start from a window w as (partition by book order by pos)),
r as (select * from (select *, sum(start::int) over (partition by book order by pos) as recipe from s) where recipe > 0),
h as (select *, bool_and(title) over (partition by book, recipe order by pos) as head from r),
u as (select * from (select *, bool_or(coalesce(role = 'stop', false) and not head) over (partition by book, recipe order by pos) as stopped from h) where not stopped),
e as (select *, max(pos) filter (role in ('ingredient', 'method') and not head) over (partition by book, recipe) as core from u),
g as (select *, max(document) filter (pos = core) over (partition by book, recipe) as cd, max(reach) filter (pos = core) over (partition by book, recipe) as cr from e),
k as (select *, not coalesce(bool_or(pos > core and not (document = cd and (pos <= cr or coalesce(role = 'note', false) or tag = 'td'))) over (partition by book, recipe order by pos), false) as kept from g),
z as (select book, recipe, string_agg(text, ' ' order by pos) filter (head) as title, min(pos) as first, max(pos) filter (kept) as last, count(*) filter (kept) as blocks, count(*) filter (kept and role = 'ingredient') as ingredients, count(*) filter (kept and role = 'method') as methods,
  min(document) as low, greatest(max(document) filter (kept), case when arg_max(coalesce(ni, -1), pos) filter (kept) = 0 then arg_max(coalesce(nd, -1), pos) filter (kept) - 1 end) as high, count(distinct document) filter (kept) as filled from k group by all),
y as (select *, ingredients > 0 and methods > 0 as good from z)
select book, recipe, title, first, case when good then last end as last, blocks, ingredients, methods, case when good then high - low + 1 end as n_parts, case when good then high - low + 1 - filled end as n_whole, case when good then 'candidate' else 'rejected' end as status from y""")
def rec04_ranges(spark: SparkSession, d: str) -> DataFrame:
    """A book is twenty documents, of which every eleventh has no text."""
    doc, pos, n = F.col("doc"), F.col("pos"), F.length("raw")
    role = F.when((n < 60) | ((pos == 0) & (doc % 4 == 0)), "title").when((n % 6).isin(0, 1), "ingredient").when(n % 6 == 2, "method").when(n % 19 == 0, "stop").when(n % 6 == 3, "note")
    at = doc * 100000 + pos
    blocks = _lines(spark, d).where(doc % 11 != 5).select(
        F.floor(doc / 20).alias("book"), doc.alias("document"), pos.alias("i"), at.alias("pos"), (at + n % 2).alias("reach"), F.when(pos % 3 == 0, "td").otherwise("p").alias("tag"), role.alias("role"), n.cast("string").alias("text")
    )
    rows = L.catalog_ranges(blocks)
    whole = F.size(F.filter("parts", lambda p: p["whole"]))
    return rows.select("book", "recipe", "title", "first", "last", "blocks", "ingredients", "methods", F.when(F.col("parts").isNotNull(), F.size("parts")).alias("n_parts"), F.when(F.col("parts").isNotNull(), whole).alias("n_whole"), "status")


def _scan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents as pages, eight of an edition. By the remainder of 4: a recipe, its steps overleaf, prose under a heading, a menu."""
    shared_folder(spark)
    docs = table(spark, d, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("parts"))
    size = F.concat(F.transform("parts", lambda x: F.lit("")), F.array(*[F.lit("")] * 4))
    lengths = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.size(size).alias("before"))
    rows = docs.join(lengths, "doc_id", "left").select("doc_id", "before", F.posexplode(F.concat(F.array(*[F.lit("a")] * 4), "parts")).alias("i", "raw"))
    k, i, page = F.col("doc_id") % 4, F.col("i"), F.col("doc_id")
    # Every other edition's steps overleaf start anew, so they don't go on.
    anew = F.col("before").isNull() | (F.floor(page / 8) % 2 == 1)
    step = F.when(k == 1, i + F.when(anew, 1).otherwise(F.col("before") - 2)).otherwise(i - 2)
    text = (
        F.when((k == 1) | ((k == 0) & (i > 2)), F.concat(step.cast("string"), F.lit(". Stir "), "raw"))
        .when(i == 0, "A name")
        .when(k == 0, F.concat(F.lit("2 cups "), "raw"))
        .otherwise(F.concat(F.lit("- "), "raw"))
    )
    line = page * 100000 + i
    edition = F.floor(page / 8)
    kind = F.when((i == 0) & (k != 1), F.when(k == 3, "menu").otherwise("title")).otherwise("text")
    rows = rows.select(edition.alias("edition"), page.alias("page"), line.alias("line"), line.alias("rank"), F.lit(10).alias("x0"), (i * 10 + 20).alias("y0"), F.lit(80).alias("x1"), (i * 10 + 28).alias("y1"), F.lit(100).alias("width"), F.lit(1000).alias("height"), text.alias("text"), kind.alias("kind"))
    none = F.array().cast("array<long>")
    blocks = rows.select("edition", F.col("line").alias("block"), "kind", F.lit(None).cast("string").alias("marker"), F.array("line").alias("line_ids"), none.alias("children"))
    return rows.drop("kind"), blocks


PAGES = """p as (select doc_id as page, doc_id // 8 as edition, doc_id % 4 as k, len(string_split(coalesce(text, ''), chr(10))) + 4 as n from documents),
q as (select p.*, p.k = 1 and o.page is not null and p.edition % 2 = 0 as joined from p left join p o on o.page = p.page - 1)"""


@query(f"""with {PAGES}, s as (select edition, page, k, n + coalesce((select max(o.n) from q o where o.page = q.page + 1 and o.joined), 0) as n from q where not joined)
select edition, row_number() over (partition by edition order by page) as selection, case k when 0 then 'recipe' when 3 then 'passage' else 'unclassified' end as kind, case when k in (0, 3) then 'candidate' else 'unresolved' end as state, page * 100000 as first_line, n as n_lines from s""")
def trn17_selections(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = B.propose_boundaries(*_scan(spark, d))
    return rows.select("edition", "selection", "kind", "state", F.get("line_ids", F.lit(0)).alias("first_line"), F.size("line_ids").alias("n_lines"))


@query(f"with {PAGES} select edition, page - 1 as from_page, page as to_page, n as n_lines from q where joined")
def trn17_links(spark: SparkSession, d: str) -> DataFrame:
    _, links = B.propose_boundaries(*_scan(spark, d))
    return links.select("edition", "from_page", "to_page", F.size("line_ids").alias("n_lines"))
