"""Usage queries over `events`: event type as operation, user as source, props.k as target."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.operators import reports as P, usage as U
from quire.sources.library import read_publication, read_reports, write_publication
from quire.streaming import heartbeats as H, usage as S

from .registry import query, shared_folder, table

NOW = "timestamp '2024-01-31 00:00:00'"


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls: click is a search over two users' sources, view reads a section, the others get a page or a book."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    operation = F.when(kind == "click", "search").when(kind == "view", "read_section").when(kind == "purchase", "get_page").when(kind == "signup", "get_book").otherwise("ping")
    user = F.concat(F.lit("s"), F.col("user_id"))
    sources = F.array(user, F.concat(F.lit("s"), F.col("user_id") + k.cast("int") % 2), F.lit("bad token!"))
    return table(spark, d, "events").select(
        F.concat(F.lit("c"), F.col("event_id")).alias("call"), F.col("ts").cast("timestamp").alias("at"), operation.alias("operation"), (F.col("value") < 2).alias("failed"),
        (F.col("value") > 50).alias("withheld"), F.concat(F.lit("pub"), F.col("event_id") % 3).alias("publication"), sources.alias("sources"), user.alias("source"),
        F.lit(None).cast("string").alias("book"), k.alias("target"), (k.cast("int") % 5 == 0).alias("continuation"), (k.cast("int") % 7 == 0).alias("zoom"),
        (F.col("value") * 10 - 50).alias("duration_ms"),
    )


EVENTS = """
raw as (select event_id, ts as "at", case event_type when 'click' then 'search' when 'view' then 'read_section' when 'purchase' then 'get_page' when 'signup' then 'get_book' else 'ping' end as operation,
  value, user_id, (props::json->>'$.k')::int as k from events),
called as (select *, operation = 'search' and value >= 2 as searched from raw where operation <> 'ping'),
hits as (select *, case when searched then list_sort(list_distinct(['s' || user_id, 's' || (user_id + k % 2), null]), 'asc', 'nulls last') else ['s' || user_id] end as list0 from called),
hits2 as (select *, case when searched then list_concat(list0, [null]) else list0 end as list from hits),
ev as (select 'c' || event_id || ':' || (i - 1) as id, "at", operation,
  case when value < 2 then 'error' when operation = 'read_section' and value > 50 then 'withheld' else 'success' end as outcome,
  'pub' || (event_id % 3) as publication, list[i] as source, null::varchar as book, case when not searched then k::varchar end as target,
  k % 5 = 0 as continuation, k % 7 = 0 as zoom, least(greatest(value * 10 - 50, 0), 3600000) as duration_ms
  from (select *, unnest(generate_series(1, len(list))) as i from hits2)),
metrics as (select *, operation || case when zoom then '_zoom' else '' end || ':' || outcome as metric,
  row_number() over (partition by regexp_replace(id, ':[^:]*$', '') order by id) = 1 as is_first from ev)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    return U.normalize_events(_calls(spark, d))


@query(f"with {EVENTS} select id, \"at\"::varchar as \"at\", operation, outcome, publication, source, book, target, continuation, zoom, round(duration_ms, 6) as duration_ms from ev")
def use01_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).withColumn("at", F.col("at").cast("string")).withColumn("duration_ms", F.round("duration_ms", 6))


@query("select id, collector, value from (select event_id % 700 as id, user_id as collector, value, row_number() over (partition by event_id % 700 order by user_id, ts, event_id) as k from events) where k = 1")
def use02_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select((F.col("event_id") % 700).alias("id"), F.col("user_id").alias("collector"), F.col("ts").cast("timestamp").alias("at"), "event_id", "value")
    return U.dedupe_events(rows, "id", ("collector", "at", "event_id")).select("id", "collector", "value")


@query(f"with {EVENTS} select publication, operation, count(*) as n from ev where \"at\" <= {NOW} and \"at\" >= {NOW} - interval 7 days and publication = 'pub1' group by all")
def use03_window(spark: SparkSession, d: str) -> DataFrame:
    return U.window_filter(_events(spark, d), F.expr(NOW), 7, "pub1").groupBy("publication", "operation").agg(F.count("*").alias("n"))


@query(f"""with {EVENTS} select metric, count(*) as n from metrics where is_first group by metric
union all select 'search_appearances', count(*) from metrics where operation = 'search' and source is not null
union all select 'continuation_calls', count(*) from metrics where is_first and continuation""")
def use04_totals(spark: SparkSession, d: str) -> DataFrame:
    return U.usage_totals(_events(spark, d))


@query(f"with {EVENTS} select coalesce(source, 'unattributed') as edition, metric, count(*) as n from metrics where operation <> 'search' or source is not null group by all")
def use05_editions(spark: SparkSession, d: str) -> DataFrame:
    return U.usage_by_edition(_events(spark, d))


@query(f"with {EVENTS} select strftime(\"at\", '%Y-%m-%d') as day, count(*) as n from metrics where is_first group by all")
def use05_daily(spark: SparkSession, d: str) -> DataFrame:
    return U.daily_activity(_events(spark, d))


@query(f"""with {EVENTS} select (select count(*) from (select distinct publication, source, operation, target from ev where target is not null and outcome = 'success')) as unique_content_scopes,
count(distinct publication) as publications from ev""")
def use05_scopes(spark: SparkSession, d: str) -> DataFrame:
    return U.unique_scopes(_events(spark, d))


def _stream(spark: SparkSession, d: str, columns: list[Column]) -> DataFrame:
    """`events` as a file stream."""
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).select(*columns)


def _run(stream: DataFrame, mode: str) -> DataFrame:
    spark = stream.sparkSession
    return S.available_now(stream, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", mode)


@query("select strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by all")
def use06_stream_daily(spark: SparkSession, d: str) -> DataFrame:
    out = _run(S.stream_daily(_stream(spark, d, [F.col("ts").cast("timestamp").alias("at")])), "complete")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


LOG = """select event_id, case when event_type = 'error' then 'other' else 'reader_request' end as event, event_type as route,
case when value < 30 then 200 else 500 end as status, value as ms from events"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Events as log lines, every other one wrapped in a message."""
    e = table(spark, d, "events")
    event = F.when(F.col("event_type") == "error", "other").otherwise("reader_request")
    plain = F.to_json(F.struct(event.alias("event"), F.col("event_type").alias("route"), F.when(F.col("value") < 30, 200).otherwise(500).alias("status"), F.col("value").alias("ms")))
    wrapped = F.to_json(F.struct(plain.alias("message")))
    line = F.when(F.col("event_id") % 2 == 0, plain).when(F.col("event_id") % 101 == 0, F.lit("{broken")).otherwise(wrapped)
    return U.read_request_log(e.select("event_id", line.alias("line")))


@query(f"select event_id, route, status, ms from ({LOG}) where event = 'reader_request' and not (event_id % 2 = 1 and event_id % 101 = 0)")
def src07_request_log(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d).select("event_id", "route", "status", "ms")


@query(f"""select route, count(*) as requests, count(*) filter (status = 200) as successes, count(distinct status) as statuses, count(*) filter (status = 200) as n,
round(median(ms) filter (status = 200), 6) as median_ms, min(ms) filter (status = 200) as min_ms, max(ms) filter (status = 200) as max_ms
from ({LOG}) where event = 'reader_request' and not (event_id % 2 = 1 and event_id % 101 = 0) and route in ('click', 'view', 'purchase') group by route""")
def use07_requests(spark: SparkSession, d: str) -> DataFrame:
    return U.request_summary(_log(spark, d), ["click", "view", "purchase"])


@query("""select event_type as route, case when value < 10 then 'lookup' else 'read' end as stage, count(*) as n, round(median(value), 6) as median_ms, min(value) as min_ms, max(value) as max_ms,
sum((props::json->>'$.k')::int) as items from events group by all""")
def use07_stages(spark: SparkSession, d: str) -> DataFrame:
    stage = F.when(F.col("value") < 10, "lookup").otherwise("read")
    value = F.struct(F.col("value").alias("ms"), F.get_json_object("props", "$.k").cast("int").alias("n"))
    log = table(spark, d, "events").select(F.col("event_type").alias("route"), F.lit(200).alias("status"), F.create_map(stage, value).alias("stages"))
    return U.stage_summary(log)


@query("""select collector, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as retained_from, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as last_observed_at, count(*) as n
from (select ts, case when user_id % 2 = 0 then 'a' else 'b' end as collector from events) group by collector""")
def src08_collectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("ts", "at")
    one = e.where("coalesce(user_id % 2 = 0, false)").withColumn("collector", F.lit("a"))
    two = e.where("not coalesce(user_id % 2 = 0, false)").drop("props").withColumn("collector", F.lit("b"))
    status = U.union_collectors([one, two])[1]
    return status.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("retained_from", "last_observed_at")})


BOARD = """
records as (select user_id as edition, case when value < 20 then 'included' when value < 80 then 'held' end as membership from events where event_type in ('signup', 'purchase')),
members as (select edition, count(distinct membership) as m, min(membership) as membership, count(*) as aliases from records group by edition),
facts as (select user_id as edition, event_type as dimension, case when value < 5 then 'failed' else 'ok' end as state, ts, event_id from events where event_type in ('view', 'click')),
ranked as (select *, row_number() over (partition by edition, dimension order by ts desc, state desc) as k, lead(state) over (partition by edition, dimension order by ts desc, state desc) as previous from facts),
latest as (select edition, max(case when dimension = 'view' then state end) as view, max(case when dimension = 'click' then state end) as click, count(*) filter (previous <> state) as changed from ranked where k = 1 group by edition),
board as (select m.edition, case when m > 1 then 'conflict' else membership end as membership, aliases, view, click, coalesce(changed, 0) as changed,
  m > 1 or coalesce(view = 'failed', false) or coalesce(click = 'failed', false) as attention from members m left join latest using (edition))"""


def _board(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    membership = F.when(F.col("value") < 20, "included").when(F.col("value") < 80, "held")
    records = e.where(F.col("event_type").isin("signup", "purchase")).select(F.col("user_id").alias("edition"), membership.alias("membership"))
    facts = e.where(F.col("event_type").isin("view", "click")).select(
        F.col("user_id").alias("edition"), F.col("event_type").alias("dimension"), F.when(F.col("value") < 5, "failed").otherwise("ok").alias("state"), F.col("ts").cast("timestamp").alias("at")
    )
    return U.status_board(records, facts, ["view", "click"])


@query(f"with {BOARD} select * from board")
def use10_board(spark: SparkSession, d: str) -> DataFrame:
    return _board(spark, d)


OBSERVED = "select event_id as id, user_id as source, user_id % 2 = 0 as remote, ts, event_type as status from events"


@query(f"""with o as ({OBSERVED}), l as (select source, remote, max(ts) as last_at, arg_max(status, (ts, id)) as status from o group by all),
a as (select *, epoch_us(timestamp '2024-01-30 23:00:00') - epoch_us(last_at) as age from l)
select source, remote, status, age <= case when remote then 600000000 else 60000000 end as "current", age > 120000000 as overdue from a""")
def use11_freshness(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    rows = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("source"), (F.col("user_id") % 2 == 0).alias("remote"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("status"))
    return U.freshness(rows, F.expr("timestamp '2024-01-30 23:00:00'"))


#: Episodes of users by the gaps between their events, before the time that the stream's watermark reaches.
BEATS = """with w as (select epoch_us(max(ts)) // 1000 - 3600000 as until from events), e as (select distinct user_id as source, epoch_us(ts) // 1000 as ms from events, w where ts is not null and user_id is not null and epoch_us(ts) // 1000 < until),
g as (select source, ms, lag(ms) over (partition by source order by ms) as before, lead(ms) over (partition by source order by ms) as after from e),
b as (select source, ms, 'observed' as activity from g where before is null or ms - before > 120000 union all select source, ms + 120000, 'overdue' from g, w where coalesce(after - ms > 120000, ms + 120000 < until))
select source, ms, activity from b"""


def _beats(spark: SparkSession, d: str) -> list[Column]:
    return [F.col("user_id").alias("source"), F.col("ts").cast("timestamp").alias("at")]


@query(BEATS)
def use11_heartbeats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(*_beats(spark, d))
    last = e.agg(F.date_trunc("millisecond", F.max("at") - F.expr("interval 1 hour")).alias("until")).first()["until"]
    return H.heartbeats(e, F.lit(last)).select("source", F.unix_millis("at").alias("ms"), "activity")


@query(BEATS)
def use11_stream_heartbeats(spark: SparkSession, d: str) -> DataFrame:
    """use11_heartbeats on a stream, by timers."""
    with H.with_timers(spark):
        out = _run(H.stream_heartbeats(_stream(spark, d, _beats(spark, d))), "append")
    return out.select("source", F.unix_millis("at").alias("ms"), "activity")


REPORTS = """select sha256(concat_ws(chr(31), source, doc_id::varchar, 'wording', left(text, instr(text || chr(10), chr(10)) - 1), lang)) as report_id, doc_id as page from documents where text is not null and source is not null and lang is not null and doc_id % 3 > 0"""


def _reports(spark: SparkSession, d: str) -> tuple[str, Column]:
    """JSON reports on the first line of each document, those of every third with a wrong id, in a new folder; and what a report's id has to be."""
    content = P.claim_id(*[F.col(c) for c in ("source", "page", "kind", "quoted", "proposed")])
    docs = table(spark, d, "documents").where("text is not null and source is not null and lang is not null")
    rows = docs.select("source", F.col("doc_id").alias("page"), F.lit("wording").alias("kind"), F.substring_index("text", "\n", 1).alias("quoted"), F.col("lang").alias("proposed"), F.timestamp_seconds(F.col("doc_id")).alias("created_at"))
    path = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"
    rows.withColumn("report_id", F.when(F.col("page") % 3 == 0, "wrong").otherwise(content)).write.json(path)
    return path, content


@query(REPORTS)
def src06_reports(spark: SparkSession, d: str) -> DataFrame:
    return read_reports(spark, *_reports(spark, d)).select("report_id", "page")


@query(REPORTS)
def src06_stream_reports(spark: SparkSession, d: str) -> DataFrame:
    return _run(H.stream_reports(spark, *_reports(spark, d)), "append").select("report_id", "page")


@query(f"""with {BOARD} select count(*) filter (membership = 'included') as included, count(*) filter (membership = 'held') as held, count(*) filter (membership = 'conflict') as conflict,
count(*) filter (membership is null) as undecided, count(*) filter (attention) as attention, sum(aliases) as queue from board""")
def use12_summary(spark: SparkSession, d: str) -> DataFrame:
    return U.board_summary(_board(spark, d), F.lit(False))


@query("""with o as (select user_id as owner, max(value)::int % 3 as generation from events group by 1),
s as (select event_id as session, user_id as owner, (props::json->>'$.k')::int % 3 as generation, ts - interval 20 days as started, ts as seen, event_type = 'error' as ended from events),
b as (select session, owner, seen, case when ended then 'ended' when o.generation is null or o.generation <> s.generation then 'superseded'
  when timestamp '2024-01-31 00:00:00' >= seen + interval 7 days then 'idle' when timestamp '2024-01-31 00:00:00' >= started + interval 30 days then 'expired' else 'live' end as base
  from s left join o using (owner)),
r as (select *, row_number() over (partition by owner, base order by seen desc, session desc) as k from b)
select session, owner, case when base = 'live' and k > 2 then 'capped' else base end as status from r""")
def use14_sessions(spark: SparkSession, d: str) -> DataFrame:
    """An owner's generation is the largest value, halves to the even number, modulo 3."""
    e = table(spark, d, "events")
    owners = e.groupBy(F.col("user_id").alias("owner")).agg((F.rint(F.max("value")).cast("int") % 3).alias("generation"))
    k = F.get_json_object("props", "$.k").cast("int")
    rows = e.select(
        F.col("event_id").alias("session"), F.col("user_id").alias("owner"), (k % 3).alias("generation"), (F.col("ts") - F.expr("interval 20 days")).alias("started"),
        F.col("ts").alias("seen"), (F.col("event_type") == "error").alias("ended"),
    )
    return U.session_status(rows, owners, F.expr(NOW), cap=2)


SESSIONS = """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as n from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as started, strftime(max(ts) + interval 6 hours, '%Y-%m-%d %H:%M:%S.%f') as ends, count(*) as n from s group by user_id, s.n"""


def _session_text(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("started", "ends")})


@query(SESSIONS)
def use15_sessionize(spark: SparkSession, d: str) -> DataFrame:
    return _session_text(U.sessionize(table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at")), "user_id", "6 hours"))


@query(SESSIONS)
def use15_stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    stream = S.stream_sessions(_stream(spark, d, [F.col("ts").cast("timestamp").alias("at"), F.col("user_id")]), "user_id", "6 hours")
    return _session_text(_run(stream, "complete"))


@query("""with h as (select user_id, event_id, sha256(concat_ws(chr(31), '', event_type)) as id, case when event_id % 4 = 0 then null else lag(sha256(concat_ws(chr(31), '', event_type))) over (partition by user_id order by event_id) end as predecessor,
lag(sha256(concat_ws(chr(31), '', event_type))) over (partition by user_id order by event_id) as last, event_type from events)
select user_id, event_id, 'predecessor' as rule from h where predecessor is distinct from last
union all select user_id, event_id, 'digest' from h where id <> sha256(concat_ws(chr(31), coalesce(predecessor, ''), event_type))""")
def use17_chain(spark: SparkSession, d: str) -> DataFrame:
    """Ids are digests as of a first entry, and every fourth entry forgets its predecessor."""
    from pyspark.sql import Window as W

    e = table(spark, d, "events").withColumn("id", F.sha2(F.concat_ws("\x1f", F.lit(""), "event_type"), 256))
    last = F.lag("id").over(W.partitionBy("user_id").orderBy("event_id"))
    log = e.withColumn("predecessor", F.when(F.col("event_id") % 4 != 0, last)).withColumn("content", F.col("event_type"))
    return U.check_chain(log, "user_id", "event_id")


@query("""select doc_id, source, md5(text) as text_md5 from documents where lang = 'en' and text is not null and source in ('src1', 'src2')""")
def snk01_search_rows(spark: SparkSession, d: str) -> DataFrame:
    """Two sources' search rows of a publication of the documents; English texts are searchable."""
    docs = table(spark, d, "documents")
    search = docs.select("doc_id", "source", F.md5("text").alias("text_md5"), ((F.col("lang") == "en") & F.col("text").isNotNull()).alias("searchable"))
    path = f"{shared_folder(spark)}/publication-{uuid.uuid4().hex}"
    write_publication({"sections": docs.select("doc_id", "source", "text"), "search": search}, path)
    return read_publication(spark, path, "search", ["src1", "src2"]).drop("searchable")
