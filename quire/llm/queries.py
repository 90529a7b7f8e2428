"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import attribution, bpe, classifier, conversations, embeddings, minhash, mixing, periodic, quality_rules, reputation, substring, tokenfile, warc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, by_space=True)


#: 24 bands: a pair at 0.85 shares none with probability 8e-7.
NEAR = minhash.NearDedup(shingle=3, percent=85, bands=24)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), NEAR)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), by_space=True)


def op4_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, by_space=True)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


#: The rules of the URL filter.
URL_RULES = (
    reputation.Rule("allow", "org", "/"),
    reputation.Rule("block", "example.org", "/es/"),
    reputation.Rule("block", "example.org", "/en/1"),
    reputation.Rule("allow", "com", "/fr/"),
    reputation.Rule("block", "com", "/de/"),
)


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's document is the number in its path, not its own id."""
    rules = reputation.Reputation(rules=URL_RULES)
    document = F.regexp_extract("path", "/([0-9]+)", 1).try_cast("long")
    rows = reputation.host_reputation(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"), rules, page_doc=document)
    return rows.withColumns({"rate": F.round("rate", 9), "bound": F.round("bound", 9)})


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_duplicates(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.find_runs(periodic.planted(_table(spark, sf_dir, "documents"))))


def op12_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_pages(_table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damaged(rows), everyone=rows)


QUERIES = (
    op1_byte_bpe,
    op2_minhash_near_dedup,
    op3_token_files,
    op4_cube_mixing,
    op5_grid_order_join,
    op6_quality_classifier,
    op7_section_tokens,
    op8_quality_rules,
    op9_host_reputation,
    op10_substring_dedup,
    op11_periodic_runs,
    op12_warc_normaliser,
    op13_conversation_repair,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
#: Smallest id that each id reaches over links(a, b), both directions there.
REACH = """reach(id, r) as (select a, a from links union select reach.id, links.b from reach join links on links.a = reach.r),
top as (select id, min(r) as component_id from reach group by id)"""

SUFFIXES = ", ".join(f"'{x}'" for x in reputation.Reputation().suffixes)


def digamma_sql(x: str) -> str:
    y = f"({x} + 6)"
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} * {y}) + 1 / (120 * power({y}, 4)) - 1 / (252 * power({y}, 6)) - ({' + '.join(f'1 / ({x} + {k}.0)' for k in range(6))}))"


def trigamma_sql(x: str) -> str:
    y = f"({x} + 6)"
    terms = " + ".join(f"1 / (({x} + {k}.0) * ({x} + {k}.0))" for k in range(6))
    return f"(1 / {y} + 1 / (2 * {y} * {y}) + 1 / (6 * power({y}, 3)) - 1 / (30 * power({y}, 5)) + 1 / (42 * power({y}, 7)) + {terms})"


LETTERS_32 = " || ".join(f"substr('{warc.BASE32}', (v[{k}] >> {s} & 31) + 1, 1)" for k in range(1, 9) for s in (15, 10, 5, 0))

SQL = {
    "op12_warc_normaliser": f"""with p as (select page_id, coalesce(html, '') as h from pages), d as (select *, sha1(h) as s, max(page_id) over (partition by h) as top, count(*) over (partition by h) as n from p),
x as (select *, n > 1 and top is not null and page_id is distinct from top as again, [('0x' || substr(s, 5 * k + 1, 5))::bigint for k in generate_series(0, 7)] as v from d)
select page_id, strlen(h)::bigint as payload_bytes, {LETTERS_32} as payload_digest, if(again, 'revisit', 'response') as record_type, if(again, top, null) as refers_to from x""",
    "op2_minhash_near_dedup": f"""with recursive d as (select doc_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
g as (select doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' '))) end) as g from d),
n as (select doc_id, count(*) as n from g group by doc_id),
same as (select x.doc_id as a, y.doc_id as b, count(*) as k from g x join g y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
links as (select a, b from same join n as na on na.doc_id = a join n as nb on nb.doc_id = b where 100 * k >= 85 * (na.n + nb.n - k)),
{REACH}
select doc_id, coalesce(n.n, 0) as n_shingles, coalesce(component_id, doc_id) as component_id, coalesce(component_id, doc_id) = doc_id as kept from documents left join n using (doc_id) left join top on top.id = doc_id""",
    "op5_grid_order_join": f"""with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), u as (select vec_id, e, sqrt(list_dot_product(e, e)) as n from v),
links as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id where list_dot_product(a.e, b.e) >= 0.9 * a.n * b.n),
c as (select a as id, count(*) as n from links group by 1),
{REACH}
select vec_id, coalesce(n, 0) as n_links, coalesce(component_id, vec_id) as component_id, coalesce(component_id, vec_id) = vec_id as kept from embeddings left join c on c.id = vec_id left join top on top.id = vec_id""",
    "op9_host_reputation": f"""with r as (select page_id, case when strpos(url, '://') > 0 then substring(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
rules as (select * from (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) t(verdict, h, q)),
fit as (select page_id, arg_max(h || q, length(h || q)) as rule, arg_max(verdict, length(h || q)) as by_rule from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, q) group by 1),
marks as (select doc_id as doc, coalesce(toxic = 1 or quality = 0, false)::int as bad from labels),
named as (select host, try_cast(regexp_extract(path, '/([0-9]+)', 1) as bigint) as doc, string_split(host, '.') as h, case when array_to_string(h[-2:], '.') in ({SUFFIXES}) then 2 else 1 end as k from p),
hosts as (select host, array_to_string(any_value(h)[-any_value(k) - 1:], '.') as domain, array_to_string(any_value(h)[-any_value(k):], '.') as suffix, count(m.bad) as n, coalesce(sum(m.bad), 0) as bad from named left join marks m using (doc) group by 1),
domains as (select domain, suffix, sum(n) as n, sum(bad) as bad from hosts group by 1, 2), tops as (select suffix, sum(n) as n, sum(bad) as bad from domains group by 1),
root as (select (sum(bad) + 1.0) / (sum(n) + 5.0) as m from tops),
j1 as (select tops.*, m from tops, root),
s1 as (select sum(case when n > 0 then n * power(bad / n - m, 2) else 0 end) as e, count(*) filter (n > 0) as k, sum(n) as t, any_value(m) as m0 from j1),
t1 as (select case when (e - k * m0 * (1 - m0)) > 0 then m0 * (1 - m0) / ((e - k * m0 * (1 - m0)) / greatest(t - k, 1)) - 1 else 40 end as s from s1),
p1 as (select suffix, (s * m + bad) / (s + n) as m from (select j1.*, least(greatest(s, 2), 40) as s from j1, t1)),
j2 as (select domains.*, m from domains join p1 using (suffix)),
s2 as (select suffix, sum(case when n > 0 then n * power(bad / n - m, 2) else 0 end) as e, count(*) filter (n > 0) as k, sum(n) as t, any_value(m) as m0 from j2 group by 1),
t2 as (select suffix, case when (e - k * m0 * (1 - m0)) > 0 then m0 * (1 - m0) / ((e - k * m0 * (1 - m0)) / greatest(t - k, 1)) - 1 else 40 end as s from s2),
p2 as (select domain, (s * m + bad) / (s + n) as m from (select j2.*, least(greatest(s, 2), 40) as s from j2 join t2 using (suffix))),
j3 as (select hosts.*, m from hosts join p2 using (domain)),
s3 as (select domain, sum(case when n > 0 then n * power(bad / n - m, 2) else 0 end) as e, count(*) filter (n > 0) as k, sum(n) as t, any_value(m) as m0 from j3 group by 1),
t3 as (select domain, case when (e - k * m0 * (1 - m0)) > 0 then m0 * (1 - m0) / ((e - k * m0 * (1 - m0)) / greatest(t - k, 1)) - 1 else 40 end as s from s3),
p3 as (select host, s * m + bad as a, s * (1 - m) + n - bad as b from (select j3.*, least(greatest(s, 2), 40) as s from j3 join t3 using (domain))),
sc as (select host, a / (a + b) as rate, 1 / (1 + exp({digamma_sql("b")} - {digamma_sql("a")} + 1.0 * sqrt({trigamma_sql("a")} + {trigamma_sql("b")}))) as bound from p3)
select p.page_id, p.host, p.path, rule, coalesce(by_rule, case when bound > (select m from root) then 'block' else 'allow' end) as verdict, round(rate, 9) as rate, round(bound, 9) as bound
from p left join fit using (page_id) left join sc on sc.host = p.host""",
    "op10_substring_dedup": f"""with d as (select doc_id, {WORDS.format("text")} as w from documents),
s as (select doc_id, w, unnest(generate_series(1, len(w) - 49)) as i from d where len(w) >= 50), x as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from s),
m as (select h, min(doc_id) as lo from x group by h), g as (select doc_id, i from x join m using (h) where lo < doc_id),
gone as (select doc_id, list(distinct p) as p from (select doc_id, unnest(generate_series(i, i + 49)) as p from g) group by 1),
k as (select doc_id, w, coalesce(p, []) as p from d left join gone using (doc_id)),
o as (select doc_id, pos, w[pos] as word from (select doc_id, w, unnest(generate_series(1, len(w))) as pos from d where len(w) > 0)),
dead as (select doc_id, unnest(p) as pos from gone),
kept as (select doc_id, string_agg(word, ' ' order by pos) as t from o anti join dead using (doc_id, pos) group by 1)
select k.doc_id, len(k.w) as n_words, len(k.p) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from k left join kept on kept.doc_id = k.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return SQL
