"""Usage and operations analytics over event logs, batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Operations that are recorded, and the form of a token.
OPERATIONS = ("search", "read_section", "get_page", "get_image", "inspect_image", "get_artifact", "list_images", "get_book")
TOKEN = r"\A[A-Za-z0-9_.:/-]{1,200}\z"
RETENTION_DAYS = 90


def token(value: Column) -> Column:
    return F.when(value.rlike(TOKEN), value)


def normalize_events(calls: DataFrame) -> DataFrame:
    """Event rows from calls(call, at, operation, failed, withheld, publication, sources array, source, book, target, continuation, zoom, duration_ms).

    A search gives a row for each distinct returned source; other operations one row.
    """
    searched = (F.col("operation") == "search") & ~F.col("failed")
    outcome = (
        F.when(F.col("failed"), F.lit("error")).when((F.col("operation") == "read_section") & F.col("withheld"), F.lit("withheld")).otherwise(F.lit("success"))
    )
    found = F.array_sort(F.array_distinct(F.transform("sources", token)))
    found = F.when(F.coalesce(F.size(found), F.lit(0)) > 0, found).otherwise(F.array(F.lit(None).cast("string")))
    targets = F.when(searched, found).otherwise(F.array(token(F.col("source"))))
    rows = calls.where(F.col("operation").isin(*OPERATIONS)).withColumn("outcome", outcome).select("*", F.posexplode(targets).alias("k", "hit"))
    return rows.select(
        F.concat_ws(":", "call", "k").alias("id"),
        "at",
        "operation",
        "outcome",
        token(F.col("publication")).alias("publication"),
        F.col("hit").alias("source"),
        F.when(~searched, token(F.col("book"))).alias("book"),
        F.when(~searched, token(F.col("target"))).alias("target"),
        "continuation",
        "zoom",
        F.least(F.greatest(F.col("duration_ms"), F.lit(0.0)), F.lit(3600000.0)).alias("duration_ms"),
    )


def dedupe_events(events: DataFrame, key: str = "id", order: tuple[str, ...] = ("collector", "at")) -> DataFrame:
    """One row per id: the first in the order of collectors."""
    first = W.partitionBy(key).orderBy(*order)
    return events.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")


def window_filter(events: DataFrame, now: Column, days: int | None, publication: str | None = None) -> DataFrame:
    """Events of the last days, at most the retention; None: all that are retained."""
    kept = min(days or RETENTION_DAYS, RETENTION_DAYS)
    out = events.where((F.col("at") <= now) & (F.col("at") >= now - F.expr(f"interval {kept} days")))
    return out.where(F.col("publication") == publication) if publication else out


def _metric() -> Column:
    return F.concat(F.col("operation"), F.when(F.col("zoom"), F.lit("_zoom")).otherwise(F.lit("")), F.lit(":"), F.col("outcome"))


def invocation(event_id: Column) -> Column:
    return F.regexp_replace(event_id, r":[^:]*\z", "")


def first_calls(events: DataFrame) -> DataFrame:
    """Adds metric and first: whether a row is the first of its invocation, by id."""
    order = W.partitionBy("__call").orderBy("id")
    rows = events.withColumn("__call", invocation(F.col("id"))).withColumn("metric", _metric())
    return rows.withColumn("first", F.row_number().over(order) == 1).drop("__call")


def usage_totals(events: DataFrame) -> DataFrame:
    """metric, n: calls by operation and outcome, search appearances, continuation calls."""
    rows = first_calls(events)
    names = F.array_compact(
        F.array(
            F.when(F.col("first"), F.col("metric")),
            F.when((F.col("operation") == "search") & F.col("source").isNotNull(), F.lit("search_appearances")),
            F.when(F.col("first") & F.col("continuation"), F.lit("continuation_calls")),
        )
    )
    return rows.select(F.explode(names).alias("metric")).groupBy("metric").agg(F.count("*").alias("n"))


def usage_by_edition(events: DataFrame) -> DataFrame:
    rows = events.withColumn("metric", _metric()).where("operation <> 'search' or source is not null")
    return rows.groupBy(F.coalesce("source", F.lit("unattributed")).alias("edition"), "metric").agg(F.count("*").alias("n"))


def daily_activity(events: DataFrame) -> DataFrame:
    return first_calls(events).where("first").groupBy(F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def unique_scopes(events: DataFrame) -> DataFrame:
    """Distinct contents that were read with success, and publications seen."""
    scope = F.when(F.col("target").isNotNull() & (F.col("outcome") == "success"), F.struct(*[F.coalesce(c, F.lit("")) for c in ("publication", "source", "operation", "target")]))
    return events.agg(F.countDistinct(scope).alias("unique_content_scopes"), F.countDistinct("publication").alias("publications"))


def union_collectors(frames: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(events, collectors): the union of collectors' events and a status row for each collector."""
    every = frames[0]
    for df in frames[1:]:
        every = every.unionByName(df, allowMissingColumns=True)
    status = every.groupBy("collector").agg(F.min("at").alias("retained_from"), F.max("at").alias("last_observed_at"), F.count("*").alias("n"))
    return every, status


def read_request_log(lines: DataFrame, event: str = "reader_request") -> DataFrame:
    """Rows of an NDJSON log, plain or wrapped in {"message": "<json>"}; others are dropped."""
    schema = "event string, request string, route string, method string, status int, ms double, k int, message string"
    outer = F.from_json("line", schema)
    inner = F.from_json(outer["message"], schema)
    rows = lines.withColumn("r", F.when(inner["event"].isNotNull(), inner).otherwise(outer))
    return rows.where(F.col("r.event") == event).select(*[c for c in lines.columns if c != "line"], "r.request", "r.route", "r.method", "r.status", "r.ms", "r.k")


def request_summary(log: DataFrame, routes: list[str]) -> DataFrame:
    """route: requests, successes, wall times of successes (finite and not negative)."""
    sound = log.where(F.col("route").isin(*routes) & F.col("status").between(100, 599))
    ms = F.when((F.col("status") == 200) & ~F.isnan("ms") & (F.col("ms") >= 0) & (F.col("ms") < F.lit(float("inf"))), F.col("ms"))
    return sound.groupBy("route").agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("status") == 200).alias("successes"),
        F.countDistinct("status").alias("statuses"),
        F.count(ms).alias("n"),
        F.round(F.median(ms), 6).alias("median_ms"),
        F.min(ms).alias("min_ms"),
        F.max(ms).alias("max_ms"),
    )


def stage_summary(log: DataFrame) -> DataFrame:
    """route, stage: of successes, how often a stage was observed and its times; log.stages maps a stage to (ms, n)."""
    rows = log.where("status = 200").select("route", F.explode("stages").alias("stage", "v"))
    return rows.groupBy("route", "stage").agg(
        F.count("*").alias("n"), F.round(F.median("v.ms"), 6).alias("median_ms"), F.min("v.ms").alias("min_ms"), F.max("v.ms").alias("max_ms"), F.sum("v.n").alias("items")
    )


def status_board(records: DataFrame, facts: DataFrame, dimensions: list[str]) -> DataFrame:
    """A row per edition: its membership or "conflict", aliases, the state of each dimension, and whether it needs attention.

    The state of a dimension is that of its latest fact; an older different one is the previous state.
    """
    members = records.groupBy("edition").agg(F.collect_set("membership").alias("m"), F.count("*").alias("aliases"))
    order = W.partitionBy("edition", "dimension").orderBy(F.desc("at"), F.desc("state"))
    latest = facts.withColumn("k", F.row_number().over(order)).withColumn("previous", F.lead("state").over(order)).where("k = 1")
    states = latest.groupBy("edition").pivot("dimension", dimensions).agg(F.first("state"))
    changed = latest.groupBy("edition").agg(F.count_if(F.col("previous") != F.col("state")).alias("changed"))
    board = members.join(states, "edition", "left").join(changed, "edition", "left")
    membership = F.when(F.size("m") > 1, F.lit("conflict")).otherwise(F.col("m")[0])
    failing = [F.coalesce(F.col(d) == "failed", F.lit(False)) for d in dimensions]
    attention = F.size("m") > 1
    for flag in failing:
        attention = attention | flag
    return board.select("edition", membership.alias("membership"), "aliases", *dimensions, F.coalesce("changed", F.lit(0).cast("long")).alias("changed"), attention.alias("attention"))


def freshness(observations: DataFrame, now: Column) -> DataFrame:
    """Last observation of each source: current within 60 s (local) or 600 s (remote), overdue after 120 s without a heartbeat."""
    last = observations.groupBy("source", "remote").agg(F.max("at").alias("last_at"), F.max_by("status", F.struct("at", "id")).alias("status"))
    age = F.unix_micros(now) - F.unix_micros("last_at")
    limit = F.when(F.col("remote"), F.lit(600_000_000)).otherwise(F.lit(60_000_000))
    return last.select("source", "remote", "status", (age <= limit).alias("current"), (age > 120_000_000).alias("overdue"))


def board_summary(board: DataFrame, stale: Column) -> DataFrame:
    return board.agg(
        F.count_if(F.col("membership") == "included").alias("included"),
        F.count_if(F.col("membership") == "held").alias("held"),
        F.count_if(F.col("membership") == "conflict").alias("conflict"),
        F.count_if(F.col("membership").isNull()).alias("undecided"),
        F.count_if("attention").alias("attention"),
        F.when(~F.coalesce(F.bool_or(stale), F.lit(False)), F.sum("aliases")).alias("queue"),
    )


def session_status(sessions: DataFrame, owners: DataFrame, now: Column, cap: int = 100) -> DataFrame:
    """status of sessions(session, owner, generation, started, seen, ended) against owners(owner, generation); the newest `cap` live ones of an owner stay."""
    joined = sessions.join(owners.select("owner", F.col("generation").alias("current")), "owner", "left")
    base = (
        F.when(F.col("ended"), F.lit("ended"))
        .when(F.col("current").isNull() | (F.col("current") != F.col("generation")), F.lit("superseded"))
        .when(now >= F.col("seen") + F.expr("interval 7 days"), F.lit("idle"))
        .when(now >= F.col("started") + F.expr("interval 30 days"), F.lit("expired"))
        .otherwise(F.lit("live"))
    )
    order = W.partitionBy("owner", "base").orderBy(F.desc("seen"), F.desc("session"))
    ranked = joined.withColumn("base", base).withColumn("k", F.row_number().over(order))
    status = F.when((F.col("base") == "live") & (F.col("k") > cap), F.lit("capped")).otherwise(F.col("base"))
    return ranked.select("session", "owner", status.alias("status"))


def sessionize(events: DataFrame, key: str, gap: str = "7 days") -> DataFrame:
    """Activity sessions: events of a key no further apart than the gap."""
    grouped = events.groupBy(key, F.session_window("at", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ends"), "n")


def check_chain(log: DataFrame, by: str, order: str) -> DataFrame:
    """Violations of a chained history (id, predecessor, content): a broken link, or an id that isn't the content's digest."""
    last = F.lag("id").over(W.partitionBy(by).orderBy(order))
    broken = F.array_compact(
        F.array(
            F.when(~F.col("predecessor").eqNullSafe(last), F.lit("predecessor")),
            F.when(F.col("id") != F.sha2(F.concat_ws("\x1f", F.coalesce("predecessor", F.lit("")), "content"), 256), F.lit("digest")),
        )
    )
    return log.withColumn("rule", broken).select(by, order, F.explode("rule").alias("rule"))
