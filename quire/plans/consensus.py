"""Consensus queries: three noisy readings of each document, users as owners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.operators import consensus as C, evidence as E, readings as R, sections as S

from .registry import query, shared_folder, table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """A page is a document, read by the first reader."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("page"), "text", F.lit("r1").alias("reader"))


def _readings(spark: SparkSession, d: str) -> DataFrame:
    """Three readings of each page, in all lines with a digit: the second adds one to a number on even pages, the third with it on every fourth; all differ on pages that 5 divides."""
    pages = _pages(spark, d).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3))))
    page, k = F.col("page"), F.col("k")
    more = F.when(page % 5 == 0, k.cast("string")).when(((page % 2 == 0) & (k == 2)) | ((page % 4 == 0) & (k == 3)), "1").otherwise("")
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, F.lit(r"\A([^0-9]*[0-9]+)"), F.concat(F.lit("$1"), more)))
    return pages.select("page", F.lit(0).cast("long").alias("crop"), F.concat(F.lit("r"), k).alias("reader"), F.when(F.col("text").rlike("[0-9]"), F.array_join(lines, "\n")).otherwise(F.col("text")).alias("text"))


#: Lines with a digit and a letter as the first and second reader have them, with the reading that wins by position.
LINES = r"""l as (select doc_id as page, unnest(string_split(text, chr(10))) as line, unnest(generate_series(1, len(string_split(text, chr(10))))) as pos from documents),
w as (select page, pos, line, regexp_replace(line, '^([^0-9]*[0-9]+)', case when page % 5 = 0 or page % 4 = 0 then '\11' else '\1' end) as won, regexp_matches(line, '[0-9]') and regexp_matches(strip_accents(lower(line)), '[a-z]') as counts from l)"""
CLEAN = r"""regexp_replace(replace(trim(regexp_replace(trim(won), '^`+|`+$', '', 'g')), chr(9), ' | '), '^\s*[-•]\s+', '')"""


@query(rf"""with {LINES}, c as (select page, {CLEAN} as line from w where counts)
select page, 0 as crop, case when contains(line, '|') then regexp_replace(regexp_replace(line, '\s*\|\s*', ' | ', 'g'), '^[ |]+|[ |]+$', '', 'g') else line end as line,
case when page % 5 = 0 then 1 when page % 2 = 0 then 2 else 3 end as support, 3 as voters, page % 5 = 0 as tie from c""")
def trn03_votes(spark: SparkSession, d: str) -> DataFrame:
    return R.vote_lines(_readings(spark, d)).select("page", "crop", "line", "support", "voters", "tie")


def _patched(spark: SparkSession, d: str, reviewed: bool) -> DataFrame:
    shared_folder(spark)
    # Votes are few beside the text that they come from, and a patch asks for them several times.
    return R.patch_pages(_pages(spark, d), R.vote_lines(_readings(spark, d)).checkpoint(), reviewed)


PATCHED = rf"""with {LINES}, n as (select page, pos, counts and page % 4 = 0 and page % 5 > 0 as change, line, won from w)
select page, string_agg(case when change then won else line end, chr(10) order by pos) as text, count(*) filter (change) as changes"""


@query(PATCHED + " from n group by page")
def trn04_patch(spark: SparkSession, d: str) -> DataFrame:
    return _patched(spark, d, False).select("page", "text", "changes")


@query(PATCHED + r", count(*) filter (trim(line) <> '') as origins from n group by page")
def trn05_patch(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed patches, with the number of lines that have an origin."""
    return _patched(spark, d, True).select("page", "text", "changes", F.size("origins").alias("origins"))


@query()
def trn02_regions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_partkey") % 10 / 12.0
    t = F.col("l_suppkey") % 8 / 10.0
    boxes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("reader"), k.alias("l"), t.alias("t"), (k + 0.3).alias("r"), (t + 0.2).alias("b"))
    return C.cluster_regions(boxes)


@query()
def trn08_sections(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    return C.assemble_sections(doc.select(F.col("source").alias("book"), F.col("doc_id").alias("page"), F.substring_index("text", "\n", 1).alias("title")))


def _sections(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as pages of their source: a block for each line, the first titled by itself; the last of three is a footer, a fifth goes on."""
    docs = table(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), "lang", "text")
    lines = docs.select("book", "page", "lang", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    part = F.when((F.col("n") > 0) & (F.col("n") % 3 == 2), "footer").otherwise("text")
    kind = F.when(F.col("lang") == "de", "chapter").otherwise("passage")
    blocks = lines.select("book", "page", "n", F.when(F.col("n") == 0, F.col("line")).alias("title"), kind.alias("kind"), part.alias("part"), ((F.col("page") % 5 == 0) & (F.col("n") == 0) | (F.col("n") > 0)).alias("continues"), F.col("line").alias("text"))
    return S.assemble(docs.select("book", "page"), blocks)


@query()
def trn08_parts(spark: SparkSession, d: str) -> DataFrame:
    """The sections' order depends on all that came before, which SQL can't express; tests/test_sections.py has a plain scan."""
    return _sections(spark, d)[1].select("book", "section", "page", "n", "part", F.md5("text").alias("text_md5"))


@query()
def trn08_page_sections(spark: SparkSession, d: str) -> DataFrame:
    return _sections(spark, d)[2]


@query("""select doc_id as page, n_chars % 50 as printed, case when doc_id % 3 = 0 then source else '' end as sections, case when doc_id % 4 = 0 then lang else '' end as open from documents""")
def trn11_ledger(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents").withColumn("page", F.col("doc_id"))
    named = lambda rows, c: rows.select("page", F.col(c).alias("id"))
    return C.page_ledger(doc.select("page", (F.col("n_chars") % 50).alias("printed")), named(doc.where("doc_id % 3 = 0"), "source"), named(doc.where("doc_id % 4 = 0"), "lang"))


@query("""with g as (select l_orderkey as t, unnest(generate_series(l_linenumber, l_linenumber + l_partkey % 2)) as r, l_suppkey % 3 as c from lineitem)
select 'cells overlap' as rule, t || ':' || r || ':' || c as key from g group by t, r, c having count(*) > 1
union all select 'line owned twice', l_partkey::varchar from lineitem group by l_partkey having count(*) > 1
union all select 'two parents', l_suppkey::varchar from lineitem group by l_suppkey having count(distinct l_linenumber) > 1""")
def trn15_layout(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    column = F.col("l_suppkey") % 3
    cells = line.select(
        F.col("l_orderkey").alias("table"), F.col("l_linenumber").alias("row_start"), (F.col("l_linenumber") + F.col("l_partkey") % 2 + 1).cast("int").alias("row_end"), column.cast("int").alias("column_start"), (column + 1).cast("int").alias("column_end")
    )
    return C.validate_layout(cells, line.select(F.col("l_partkey").alias("line")), line.select(F.col("l_suppkey").alias("block"), F.col("l_linenumber").alias("parent")))


#: Order lines as lines and blocks of their order's page: boxes on a render of 100 by 100, doubled and moved by the page; blocks lead to the next one or back.
EVIDENCE = """l as (select l_orderkey as page, l_orderkey * 10 + l_linenumber as line, l_linenumber as n, l_partkey % 95 as x, l_suppkey % 97 as y, l_quantity % 10 as w, l_discount * 15 as confidence,
  l_partkey, l_suppkey, case when l_linenumber = 4 then l_orderkey * 10 + 5 else l_orderkey * 10 + l_linenumber end as named,
  case when l_linenumber % 2 = 1 then l_orderkey * 10 + l_linenumber + 1 when l_linenumber = 2 and l_orderkey % 5 = 0 then l_orderkey * 10 + 1 end as child from lineitem)"""


def _evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """pages, lines and blocks of EVIDENCE."""
    order, n, rows = F.col("l_orderkey"), F.col("l_linenumber"), table(spark, d, "lineitem")
    x, y, w = (F.col("l_partkey") % 95).cast("double"), (F.col("l_suppkey") % 97).cast("double"), F.col("l_quantity") % 10
    point = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    size = lambda v: F.struct(F.lit(v).alias("w"), F.lit(v).alias("h"))
    key = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"))
    turn = F.when(F.col("page") % 50 == 7, 0.0).otherwise(2.0)
    maps = F.struct(turn.alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(2.0).alias("d"), (F.col("page") % 3).cast("double").alias("e"), F.lit(0.0).alias("f"))
    pages = key.select("page", size(100.0).alias("render"), size(200.0).alias("source"), maps.alias("map"))
    line = order * 10 + n
    lines = rows.select(order.alias("page"), line.alias("line"), F.array(point(x, y), point(x + w, y), point(x + w, y + 5), point(x, y + 5)).alias("polygon"), (F.col("l_discount") * 15).alias("confidence"))
    child = F.when(n % 2 == 1, line + 1).when((n == 2) & (order % 5 == 0), line - 1)
    blocks = rows.select(order.alias("page"), line.alias("block"), F.array(F.when(n == 4, line + 1).otherwise(line)).alias("line_ids"), F.array_compact(F.array(child)).alias("children"))
    return pages, lines, blocks


@query(f"""with {EVIDENCE}, p as (select l.*, page % 3 as e, if(page % 50 = 7, 0, 2) as a from l)
select 'flat map' as rule, o_orderkey::varchar as key from orders where o_orderkey % 50 = 7
union select 'outside the render', line::varchar from p where x + w > 100 or y + 5 > 100
union select 'outside the source', line::varchar from p where greatest(a * x, a * (x + w)) + e > 200.000001 or 2 * (y + 5) > 200.000001
union select 'no area', line::varchar from p where w = 0 union select 'confidence', line::varchar from p where confidence > 1""")
def trn15_geometry(spark: SparkSession, d: str) -> DataFrame:
    pages, lines, _ = _evidence(spark, d)
    return E.geometry(pages, lines)


@query(f"""with recursive {EVIDENCE}, held as (select page, line from l), kids as (select page, line as parent, child from l where child is not null),
up as (select child as block, min(parent) as parent from kids group by 1), chain(block, above) as (select block, parent from up union select chain.block, up.parent from chain join up on up.block = chain.above)
select 'line in no block' as rule, line::varchar as key from l where line not in (select named from l)
union select 'line twice', line::varchar from l group by line having count(*) > 1 union select 'block twice', line::varchar from l group by line having count(*) > 1
union select distinct 'block names another line', line || ':' || named from l where named not in (select line from l)
union select distinct 'block names another child', parent || ':' || child from kids where child not in (select line from l)
union select 'two parents', child::varchar from kids group by child having count(*) > 1
union select distinct 'cycle', block::varchar from chain where block = above""")
def trn15_ownership(spark: SparkSession, d: str) -> DataFrame:
    shared_folder(spark)
    _, lines, blocks = _evidence(spark, d)
    return E.ownership(lines, blocks)


@query(f"""with {EVIDENCE}, c as (select page as t, line, named, n - 1 as r0, n + l_partkey % 2 as r1, l_suppkey % 3 as c0 from l), g as (select t, unnest(generate_series(r0, r1 - 1)) as r, c0 from c where r1 <= 5)
select 'outside the grid' as rule, t || ':' || line as key from c where r1 > 5 union select 'cells overlap', t || ':' || r || ':' || c0 from g group by t, r, c0 having count(*) > 1
union select 'cell twice', line::varchar from c group by line having count(*) > 1 union select 'cell line twice', line::varchar from c group by line having count(*) > 1
union select 'cell line outside the block', line || ':' || line from c where line <> t * 10 + 1
union select 'table of no block', o_orderkey::varchar from orders where o_orderkey * 10 + 1 not in (select line from l)""")
def trn15_grids(spark: SparkSession, d: str) -> DataFrame:
    _, _, blocks = _evidence(spark, d)
    key, rows = F.col("o_orderkey"), table(spark, d, "lineitem")
    tables = table(spark, d, "orders").select(key.alias("table"), key.alias("page"), (key * 10 + 1).alias("block"), F.lit(5).alias("rows"), F.lit(3).alias("columns"))
    n, column, line = F.col("l_linenumber"), (F.col("l_suppkey") % 3).cast("int"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    cells = rows.select(F.col("l_orderkey").alias("table"), line.alias("cell"), (n - 1).alias("row_start"), (n + F.col("l_partkey") % 2).cast("int").alias("row_end"), column.alias("column_start"), (column + 1).alias("column_end"), F.array(line).alias("line_ids"))
    return E.grids(tables, cells, blocks)


TOKENS = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')"
PLACES = "list_filter(generate_series(1, len(hay) - len({0}) + 1), lambda i: len({0}) > 0 and hay[i] = {0}[1] and hay[i:i + len({0}) - 1] = {0})"


@query(rf"""with l as (select doc_id as page, unnest(string_split(text, chr(10))) as t, unnest(generate_series(1, len(string_split(text, chr(10))))) - 1 as line from documents),
n as (select *, regexp_extract(t, '^([^0-9]*)([0-9]+)(.*)$', ['a', 'b', 'c'], 's') as x from l where regexp_matches(t, '[0-9]')),
r as (select page, line, 'r' || k as reader, case when page % 5 = 0 then x.a || x.b || '0' || k || x.c when page % 2 = 0 then x.a || x.b || '1' || x.c else t end as reading, t as current, x.a || x.b || '1' || x.c as proposed from n, generate_series(1, 3) s(k)),
h as (select page, line, reader, {TOKENS.format("reading")} as hay, {TOKENS.format("current")} as cur, {TOKENS.format("proposed")} as new from r),
c as (select *, len(new) >= len(cur) as newer, if(len(new) >= len(cur), new, cur) as one, if(len(new) >= len(cur), cur, new) as two from h),
p as (select *, {PLACES.format("one")} as spots, {PLACES.format("two")} as other from c)
select page, line, reader, case when len(spots) > 0 then if(len(list_filter(other, lambda j: len(list_filter(spots, lambda i: i <= j and j < i + len(one))) = 0)) > 0, 'none', if(newer, 'proposed', 'current'))
  when len(other) > 0 then if(newer, 'current', 'proposed') else 'none' end as vote from p""")
def rep05_ballots(spark: SparkSession, d: str) -> DataFrame:
    """Every line with a number, as three readers have it: corrected on even pages, differing on pages that 5 divides."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("line", "text")).where(F.col("text").rlike("[0-9]"))
    part = lambda i: F.regexp_extract("text", r"(?s)\A([^0-9]*)([0-9]+)(.*)\z", i)
    with_number = lambda n: F.concat(part(1), part(2), n, part(3))
    page, k = F.col("page"), F.col("k").cast("string")
    reading = F.when(page % 5 == 0, with_number(F.concat(F.lit("0"), k))).when(page % 2 == 0, with_number(F.lit("1"))).otherwise(F.col("text"))
    claims = lines.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3)))).select("page", "line", F.concat(F.lit("r"), k).alias("reader"), reading.alias("reading"), F.col("text").alias("current"), with_number(F.lit("1")).alias("proposed"))
    return C.ballots(claims).select("page", "line", "reader", "vote")


@query()
def rep10_recovery(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("l_partkey") % 10 / 10.0, F.col("l_suppkey") % 10 / 10.0
    rows = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("attempt"), (F.col("l_orderkey") % 7).alias("source"), F.floor(F.col("l_orderkey") / 7).alias("page"), x.alias("l"), y.alias("t"), (x + 0.2).alias("r"), (y + 0.2).alias("b")
    )
    return C.recovery_status(rows)


@query()
def use16_personal(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_type") == "error", "remove").otherwise("save")
    return C.fold_personal(e.select(F.col("user_id").alias("owner"), F.col("event_id").alias("seq"), (F.col("event_id") % 900).alias("op"), kind.alias("kind"), (k % 30).alias("place")), 20)


@query()
def doc23_budget(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    return C.budget_pages(doc.select(F.floor(F.col("doc_id") / 5).alias("selection"), F.col("doc_id").alias("node"), "text"), 2000, 3)


@query("""select doc_id as key, case when doc_id % 2 = 0 then '[unresolved 1: amount]' || case when contains(text, chr(10)) then substring(text, strpos(text, chr(10))) else '' end else text || chr(10) || '[unresolved 1: amount]' end as text from documents""")
def cor01_markers(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    fragment = F.when(F.col("doc_id") % 2 == 0, F.substring_index("text", "\n", 1)).otherwise("no such line at all")
    return C.mark_unresolved(doc.select(F.col("doc_id").alias("key"), "text"), doc.select(F.col("doc_id").alias("key"), F.lit(1).alias("id"), F.lit("amount").alias("code"), fragment.alias("fragment")))


@query("""select source as book, doc_id as page, text || chr(10) || lead(text) over (partition by source order by doc_id) as text from documents qualify lead(text) over (partition by source order by doc_id) is not null""")
def eva03_windows(spark: SparkSession, d: str) -> DataFrame:
    return C.adjacent_windows(table(spark, d, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), "text"))
