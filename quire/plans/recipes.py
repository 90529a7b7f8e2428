"""Recipe queries: lines of documents as blocks, orders as recipes, parts as targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.operators import graphs as G, recipes as R

from .registry import query, shared_folder, table

ROLES = """case when length(text) < 60 then 'title' when n % 5 in (1, 2) then 'ingredient' when n % 5 = 3 then 'instruction' when n % 17 = 0 then 'stop' end"""
BLOCKS = f"""raw as (select doc_id, source, lines[i] as text, i, length(lines[i]) as n from (select doc_id, source, lines, unnest(generate_series(1, len(lines))) as i from (select doc_id, source, string_split(text, chr(10)) as lines from documents))),
blocks as (select source as book, doc_id as document, doc_id * 100000 + i - 1 as pos, text, {ROLES} as role from raw)"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    n = F.length("text")
    role = F.when(n < 60, "title").when((n % 5).isin(1, 2), "ingredient").when(n % 5 == 3, "instruction").when(n % 17 == 0, "stop")
    return rows.select(F.col("source").alias("book"), F.col("doc_id").alias("document"), (F.col("doc_id") * 100000 + F.col("i")).alias("pos"), "text", role.alias("role"))


@query(f"""with {BLOCKS},
s as (select *, coalesce(role = 'title', false) and not coalesce(lag(role = 'title') over w and lag(document) over w = document, false) as start from blocks window w as (partition by book order by pos)),
r as (select * from (select *, sum(start::int) over (partition by book order by pos rows unbounded preceding) as recipe from s) where recipe > 0),
h as (select *, sum(case when role = 'title' and document = fd then 0 else 1 end) over (partition by book, recipe order by pos rows unbounded preceding) = 0 as heading from (select *, first_value(document) over (partition by book, recipe order by pos) as fd from r)),
u as (select * from (select *, sum(case when role = 'stop' and not heading then 1 else 0 end) over (partition by book, recipe order by pos rows unbounded preceding) as stopped from h) where stopped = 0),
a as (select *, min(pos) filter (role = 'ingredient') over (partition by book, recipe) as ing from u),
b as (select *, max(pos) filter (role = 'instruction' and pos > ing) over (partition by book, recipe) as method, max(pos) filter (role = 'ingredient') over (partition by book, recipe) as last_ing from a),
c as (select *, greatest(method, last_ing) as core from b),
e as (select *, max(document) filter (pos = core) over (partition by book, recipe) as cd from c),
f as (select *, pos <= core or max(case when pos > core and document <> cd then 1 else 0 end) over (partition by book, recipe order by pos rows unbounded preceding) = 0 as kept from e),
g as (select book, recipe, string_agg(text, ' ' order by pos) filter (heading) as title, min(pos) as first, max(pos) filter (kept) as last, count(*) as blocks, sum(length(text)) as chars, max(method) as method from f group by all)
select book, recipe::bigint as recipe, title, first, case when method is not null and blocks <= 500 and chars <= 150000 then last end as last, blocks, case when method is not null and blocks <= 500 and chars <= 150000 then 'kept' else 'rejected' end as status from g""")
def rec03_windows(spark: SparkSession, d: str) -> DataFrame:
    return R.recipe_windows(_blocks(spark, d))


@query("""with l as (select l_orderkey * 10 + l_linenumber as line, l_quantity::bigint as q, (l_discount * 100)::bigint as h, l_partkey % 4 as k from lineitem),
a as (select line, k, case k when 0 then q when 1 then q * 2 + 1 when 2 then q * 100 + 25 else null end as num, case k when 0 then 1 when 1 then 2 when 2 then 100 end as den from l)
select line, (num // gcd(num, den))::bigint as num, (den // gcd(num, den))::bigint as den, case k when 0 then 'cups' when 1 then 'tbsp' when 2 then null end as unit, case when k < 3 then 'beans' end as name, case when k = 0 then 'rinsed' end as preparation from a""")
def rec07_ingredients(spark: SparkSession, d: str) -> DataFrame:
    """Lines are spelled out as "3 cups beans, rinsed", "3½ tbsp beans", "3.25 beans" and "3 to 4 cups beans"."""
    q = F.col("l_quantity").cast("long").cast("string")
    k = F.col("l_partkey") % 4
    text = F.when(k == 0, F.concat(q, F.lit(" cups beans, rinsed"))).when(k == 1, F.concat(q, F.lit("½ tbsp beans"))).when(k == 2, F.concat(q, F.lit(".25 beans"))).otherwise(F.concat(q, F.lit(" to 4 cups beans")))
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), text.alias("text"))
    return R.parse_ingredients(rows, "text").drop("text")


@query("""with r as (select o_custkey as doc, o_orderkey as recipe, o_orderkey * 10 as first, o_orderkey * 10 + 30 + o_orderkey % 4000 as last from orders where o_orderkey % 3 = 0),
l as (select l_orderkey * 10 + l_linenumber as link, o_custkey as doc, (l_orderkey // 3) * 3 as source_recipe, l_orderkey * 10 + (l_partkey % 500) * 10 as target from lineitem join orders on o_orderkey = l_orderkey),
h as (select l.*, r.recipe, r.last from l asof left join r on l.doc = r.doc and l.target >= r.first),
o as (select link, doc, source_recipe, case when last >= target then recipe end as target_recipe from h)
select * from o where target_recipe is null or target_recipe <> source_recipe""")
def rec09_uses(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    key = F.col("o_orderkey")
    ranges = orders.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("doc"), key.alias("recipe"), (key * 10).alias("first"), (key * 10 + 30 + key % 4000).alias("last"))
    line = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == key)
    links = line.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("link"), F.col("o_custkey").alias("doc"), (F.floor(F.col("l_orderkey") / 3) * 3).alias("source_recipe"),
        (F.col("l_orderkey") * 10 + (F.col("l_partkey") % 500) * 10).alias("target"),
    )
    return R.authored_uses(links, ranges)


@query("""with c as (select l_orderkey as edition, count(*) filter (l_returnflag = 'A') as "A", count(*) filter (l_returnflag = 'N') as "N", count(*) filter (l_returnflag = 'R') as "R" from lineitem group by 1)
select o_orderkey as edition, coalesce("A", 0) as "A", coalesce("N", 0) as "N", coalesce("R", 0) as "R", case when greatest(coalesce("A", 0), coalesce("N", 0), coalesce("R", 0)) > 0 then 'interpreted' else 'native text only' end as note from orders left join c on edition = o_orderkey""")
def rec12_report(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("edition"), F.col("l_returnflag").alias("kind"))
    return R.interpretation_report(entities, table(spark, d, "orders").select(F.col("o_orderkey").alias("edition")), ["A", "N", "R"])


#: Large parts use the next one, smaller ones the one before the last; sizes divisible by 7 are unclassified, by 5 of a part only, by 11 without a target.
WORK = """with recursive u as (select p_partkey * 10 + 1 as use, p_partkey as src, p_partkey + 1 as dst, p_size as s, length(p_name) as size from part where p_size > 20
  union all select p_partkey * 10 + 2, p_partkey, p_partkey - 2, p_size, length(p_name) from part where p_size < 25),
uses as (select use, src, if(s % 11 = 0, null, dst) as dst, if(s % 7 = 0, null, true) as required, s % 5 > 0 as whole, size from u),
leads as (select distinct src, dst from uses where required and whole and dst is not null),
walk(root, node, level) as (select distinct src, src, 1 from uses union select w.root, l.dst, w.level + 1 from walk w join leads l on l.src = w.node where w.level < 6),
near as (select root, node, min(level) as level from walk group by all),
reach(root, node, step) as (select distinct dst, dst, 0 from leads union select r.root, l.dst, r.step + 1 from reach r join leads l on l.src = r.node where r.step < 4),
cyclic as (select distinct src, dst from leads l where exists (select 1 from reach r where r.root = l.dst and r.node = l.src)),
listed as (select root, use, src, dst, level as depth, row_number() over w as n, sum(size) over w as upto, required is null or dst is null or not whole as unresolved, coalesce(required and whole and dst is not null, false) as leads
  from near join uses on src = node where level <= 5 window w as (partition by root order by level, src, use)),
kept as (select *, n <= 12 and upto <= 400 as fits from listed)"""


def _work(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    shared_folder(spark)
    k, s = F.col("p_partkey"), F.col("p_size")
    part = table(spark, d, "part")
    use = lambda n, dst: [(k * 10 + n).alias("use"), k.alias("src"), F.when(s % 11 != 0, dst).alias("dst"), F.when(s % 7 != 0, F.lit(True)).alias("required"), (s % 5 > 0).alias("whole"), F.length("p_name").alias("size")]
    uses = part.where("p_size > 20").select(*use(1, k + 1)).union(part.where("p_size < 25").select(*use(2, k - 2)))
    return G.supporting_work(uses, uses.select(F.col("src").alias("root")).distinct(), depth=4, limit=12, most_bytes=400)


@query(f"""{WORK} select root, use, kept.src, kept.dst, depth, n, unresolved, leads and c.src is not null as cycle from kept left join cyclic c on c.src = kept.src and c.dst = kept.dst where fits""")
def rec13_closure(spark: SparkSession, d: str) -> DataFrame:
    """Every part is a root."""
    return _work(spark, d)[0]


@query(f"""{WORK}, deep as (select distinct root from near where level = 6),
sums as (select root, count(*) filter (fits) as n_uses, count(*) filter (fits and unresolved) as n_unresolved, bool_or(not fits) as over from kept group by root)
select root, n_uses, n_unresolved, over or root in (select root from deep) as truncated from sums""")
def rec13_summary(spark: SparkSession, d: str) -> DataFrame:
    return _work(spark, d)[1]


@query("select l_orderkey as recipe, l_partkey as id, l_returnflag as kind, floor((row_number() over (partition by l_orderkey order by l_returnflag, l_linenumber, l_partkey) - 1) / 3) as page from lineitem")
def rec14_related(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("recipe"), F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("ordinal"))
    return R.related_records(rows, 3)


@query("""select o_orderkey as recipe, o_orderpriority as title, count(l_partkey) as n_parts, count(distinct l_suppkey) as n_sources, coalesce(string_agg(l_partkey::varchar, ',' order by l_linenumber, l_partkey), '') as parts
from orders left join lineitem on l_orderkey = o_orderkey group by 1, 2""")
def rec15_packages(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("recipe"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("text"), F.col("l_suppkey").alias("target"))
    rows = R.recipe_packages(table(spark, d, "orders").select(F.col("o_orderkey").alias("recipe"), F.col("o_orderpriority").alias("title")), parts)
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return rows.select("recipe", "title", size("parts").alias("n_parts"), size("sources").alias("n_sources"), F.coalesce(F.array_join(F.transform("parts", lambda p: p["text"].cast("string")), ","), F.lit("")).alias("parts"))


@query("""with p as (select l_orderkey, l_returnflag as subject, list_sort(list(distinct l_suppkey % 5)) as p from lineitem group by 1, 2)
select subject, array_to_string(p, '+') as participants, count(*) as n from p where len(p) >= 2 group by 1, 2""")
def rec17_pairings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("assertion"), F.col("l_returnflag").alias("subject"), (F.col("l_suppkey") % 5).alias("participant"))
    return R.pairings(rows)


@query("""with p as (select p_brand as class, min(case when p_size < 20 then 'ingredient' else 'title' end) as role, min(p_size) as rank from part group by 1),
b as (select p_partkey as block, unnest([p_brand, p_type]) as class from part)
select p_partkey as block, arg_min(role, rank) as role from part left join b on block = p_partkey left join p using (class) group by 1""")
def rec01_classify(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    profiles = part.groupBy(F.col("p_brand").alias("class")).agg(F.min(F.when(F.col("p_size") < 20, "ingredient").otherwise("title")).alias("role"), F.min("p_size").alias("rank")).withColumn("book", F.lit(1))
    blocks = part.select(F.lit(1).alias("book"), F.col("p_partkey").alias("block"), F.array("p_brand", "p_type").alias("classes"))
    return R.classify_blocks(blocks, profiles).select("block", "role")
