"""Reports, decisions, corrections ledger, publications."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions.islands import with_islands
from quire.functions.text import squash


def claim_id(*fields: Column) -> Column:
    """A content id: the digest of the fields with a separator and a mark for null."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(f.cast("string"), F.lit("\x00")) for f in fields]), 256)


#: Fixed value: the least side of a box, as a part of the page.
LEAST_SIDE = 0.02


def box_reason(region: Column) -> Column:
    """Why a box (left, top, right, bottom, as parts of the page) is refused; null for a sound one and for none."""
    side = lambda i: F.get(region, F.lit(i))
    along = lambda a, b: (side(a) >= 0) & (side(a) < side(b)) & (side(b) <= 1)
    sound = F.coalesce((F.size(region) == 4) & along(0, 2) & along(1, 3), F.lit(False))
    small = (side(2) - side(0) < LEAST_SIDE) | (side(3) - side(1) < LEAST_SIDE)
    return F.when(region.isNull(), None).when(~sound, "no box").when(small, "box too small")


def intake_reports(raw: DataFrame, sections: DataFrame, most: int = 500) -> DataFrame:
    """Adds report_id and reason (null: accepted) to reports(source, page, kind, quoted, proposed) and, if they have one, region.

    A quote has to occur in a text of its source and page; keys join first. A region is a box on the page, to
    four places a part of the claim; a report without one claims the whole page.
    """
    rows = raw.withColumns({c: squash(F.coalesce(c, F.lit(""))) for c in ("quoted", "proposed")})
    claim = [F.col(c) for c in ("source", "page", "kind", "quoted", "proposed")]
    if "region" in raw.columns:
        claim.append(F.array_join(F.transform("region", lambda v: F.format_number(v, 4)), ","))
    rows = rows.withColumn("report_id", claim_id(*claim))
    texts = sections.select("source", "page", squash(F.col("text")).alias("body"))
    found = rows.join(texts, ["source", "page"], "left").groupBy(*rows.columns).agg(F.coalesce(F.bool_or(F.contains("body", F.col("quoted"))), F.lit(False)).alias("seen"))
    reason = (
        F.when(F.col("quoted") == "", "no quote").when(F.length("quoted") > most, "too long").when(F.col("quoted") == F.col("proposed"), "no change").when(~F.col("seen"), "quote not found")
    )
    if "region" in raw.columns:
        reason = F.coalesce(box_reason(F.col("region")), reason)
    return found.withColumn("reason", reason).drop("seen")


def dedupe_reports(reports: DataFrame) -> DataFrame:
    order = W.partitionBy("report_id").orderBy("created_at", "seq")
    return reports.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def clock_limit(events: DataFrame, key: str, most: int = 60) -> DataFrame:
    """Adds admitted: the first `most` of a key in each clock hour."""
    order = W.partitionBy(key, F.date_trunc("hour", "at")).orderBy("at", "id")
    return events.withColumn("admitted", F.row_number().over(order) <= most)


def rolling_limit(events: DataFrame, key: str, most: int = 60, seconds: int = 3600) -> DataFrame:
    """Adds admitted: at most `most` admitted ones in any hour; a refused one doesn't count.

    An admission depends on earlier ones, so rows are scanned in order; but a
    gap of the limit's span empties the state, so each island between such
    gaps is scanned apart, a batch at a time. Rows without a time count nothing.
    """
    span = seconds * 1_000_000
    rows = with_islands(events.select(F.col(key), F.col("id"), F.col("at"), F.unix_micros("at").alias("us")), key, "us", max(span, 1))
    rows = rows.repartition(F.col(key), F.col("island")).sortWithinPartitions(key, "island", "us", "id").select(key, "island", "us", "id", "at")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, deque()
        for batch in batches:
            out = []
            for *island, us in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if island != here:
                    here = island
                    held.clear()
                if us is None:
                    out.append(most > 0)
                    continue
                while held and us - held[0] >= span:
                    held.popleft()
                out.append(len(held) < most)
                if out[-1]:
                    held.append(us)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(4), pa.array(out, pa.bool_())], names=[key, "id", "at", "admitted"])

    return rows.mapInArrow(scan, f"{key} long, id long, at timestamp, admitted boolean")


def receipts(submissions: DataFrame) -> DataFrame:
    """Adds receipt and status: a submission id keeps its first fingerprint; another one conflicts."""
    first = F.first("fingerprint").over(W.partitionBy("submission").orderBy("at", "seq"))
    rows = submissions.withColumn("first", first)
    rank = F.row_number().over(W.partitionBy("submission").orderBy("at", "seq"))
    status = F.when(rank == 1, "accepted").when(F.col("fingerprint") == F.col("first"), "repeated").otherwise("conflict")
    return rows.withColumn("status", status).withColumn("receipt", claim_id(F.col("submission"), F.col("first"))).drop("first")


def decide(ballots: DataFrame) -> DataFrame:
    """report, outcome from ballots(report, vote, refused): two of three votes decide; a refusal goes to the owner."""
    n = ballots.groupBy("report").agg(
        F.count_if(F.col("vote") == "proposed").alias("proposed"), F.count_if(F.col("vote") == "current").alias("current"), F.coalesce(F.bool_or("refused"), F.lit(False)).alias("refused")
    )
    outcome = F.when(F.col("refused"), "owner").when(F.col("proposed") >= 2, "correction").when(F.col("current") >= 2, "rejected").otherwise("owner")
    return n.select("report", "proposed", "current", outcome.alias("outcome"))


def pending(reports: DataFrame, decisions: DataFrame, n: int) -> DataFrame:
    """Reports without a decision, oldest first."""
    return reports.join(decisions.select("report_id"), "report_id", "left_anti").orderBy("created_at", "report_id").limit(n)


def build_ledger(decisions: DataFrame, key: list[str]) -> DataFrame:
    """Accepted decisions as ledger rows: each correction key keeps its first."""
    order = W.partitionBy(*key).orderBy("decided_at", "id")
    rows = decisions.where("outcome = 'correction'").withColumn("__k", F.row_number().over(order))
    return rows.where("__k = 1").drop("__k")


def check_ledger(ledger: DataFrame, key: list[str], part: str) -> DataFrame:
    """id, rule: ids and keys that repeat, texts that don't change, rows of a part out of the order of decision."""
    place = W.partitionBy(part).orderBy("seq")
    before = F.lag(F.struct("decided_at", "id")).over(place)
    rules = F.array_compact(
        F.array(
            F.when(F.count("*").over(W.partitionBy("id")) > 1, F.lit("id repeats")),
            F.when(F.count("*").over(W.partitionBy(*key)) > 1, F.lit("key repeats")),
            F.when(F.col("from_text") == F.col("to_text"), F.lit("no change")),
            F.when(before > F.struct("decided_at", "id"), F.lit("order")),
        )
    )
    return ledger.withColumn("rules", rules).select("id", F.explode("rules").alias("rule"))


def owner_queue(decisions: DataFrame, ambiguous: DataFrame, before: DataFrame) -> DataFrame:
    """item, origin, added: unsettled reports and ambiguous corrections; added since the queue before."""
    items = decisions.where("outcome = 'owner'").select(F.col("report").alias("item"), F.lit("report").alias("origin"))
    items = items.unionByName(ambiguous.select(F.col("id").alias("item"), F.lit("correction").alias("origin"))).distinct()
    return items.join(before.select("item", "origin", F.lit(True).alias("old")), ["item", "origin"], "left").select("item", "origin", F.col("old").isNull().alias("added"))


def changed_sources(ledger: DataFrame, published: DataFrame) -> DataFrame:
    """source, change from digests (source, digest): added, removed or changed."""
    rows = ledger.withColumnRenamed("digest", "now").join(published.withColumnRenamed("digest", "then"), "source", "full")
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("then"), "changed")
    return rows.select("source", change.alias("change")).where("change is not null")


def diff_index(stored: DataFrame, expected: DataFrame, key: str, text: str) -> DataFrame:
    """key, side: rows that only one has; digests of texts are compared, not texts."""
    row = lambda df: df.select(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("h"))
    one, two = row(stored), row(expected)
    return one.exceptAll(two).select(key, F.lit("stored").alias("side")).unionByName(two.exceptAll(one).select(key, F.lit("expected").alias("side")))


def build_report(outcomes: DataFrame) -> DataFrame:
    """Per source and in total: units, and corrections applied, stale and ambiguous."""
    return outcomes.rollup("source").agg(
        F.count("*").alias("units"),
        F.count_if(F.col("outcome") == "applied").alias("applied"),
        F.count_if(F.col("outcome") == "stale").alias("stale"),
        F.count_if(F.col("outcome") == "ambiguous").alias("ambiguous"),
        F.grouping("source").cast("int").alias("total"),
    )


def searchable_pages(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds searchable: a page is, unless a section covers it."""
    covered = sections.select("source", F.explode("pages").alias("page")).distinct().withColumn("covered", F.lit(True))
    return pages.join(covered, ["source", "page"], "left").withColumn("searchable", F.col("covered").isNull()).drop("covered")


# --- publications --------------------------------------------------------------


def check_manifest(inventory: DataFrame) -> DataFrame:
    """publication, rule, key: paths that repeat, hashes with two sizes, hashes of another form, not exactly one index."""
    path = inventory.groupBy("publication", "path").count().where("count > 1").select("publication", F.lit("path repeats").alias("rule"), F.col("path").alias("key"))
    size = inventory.groupBy("publication", "sha256").agg(F.countDistinct("size").alias("n")).where("n > 1").select("publication", F.lit("two sizes").alias("rule"), F.col("sha256").alias("key"))
    form = inventory.where(~F.col("sha256").rlike(r"\A[0-9a-f]{64}\z")).select("publication", F.lit("hash form").alias("rule"), F.col("path").alias("key"))
    index = inventory.groupBy("publication").agg(F.count_if(F.col("role") == "index").alias("n")).where("n <> 1").select("publication", F.lit("index").alias("rule"), F.col("n").cast("string").alias("key"))
    return path.unionByName(size).unionByName(form).unionByName(index)


def verify(inventory: DataFrame, objects: DataFrame) -> DataFrame:
    """sha256, state of each distinct object of an inventory: missing, changed or extra; sound ones are left out."""
    wanted = inventory.groupBy("sha256").agg(F.min("size").alias("wanted"))
    there = objects.select(F.col("name").alias("sha256"), F.sha2("content", 256).alias("real"), F.length("content").alias("held"))
    rows = wanted.join(there, "sha256", "full")
    state = F.when(F.col("real").isNull(), "missing").when(F.col("wanted").isNull(), "extra").when((F.col("real") != F.col("sha256")) | (F.col("held") != F.col("wanted")), "changed")
    return rows.select("sha256", state.alias("state")).where("state is not null")


def retention_plan(publications: DataFrame, inventory: DataFrame, objects: DataFrame, keep: int = 3) -> tuple[DataFrame, DataFrame]:
    """(publications to remove, objects to remove): the newest successes and what is pending stay, and what they refer to."""
    order = W.partitionBy("status").orderBy(F.desc("seq"))
    ranked = publications.withColumn("k", F.row_number().over(order))
    kept = (F.col("status") == "pending") | ((F.col("status") == "success") & (F.col("k") <= keep))
    needed = inventory.join(ranked.where(kept).select("publication"), "publication", "left_semi").select("sha256").distinct()
    return ranked.where(~kept).select("publication"), objects.select("sha256").distinct().join(needed, "sha256", "left_anti")


def migrate_locations(places: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """place, target, state: a saved section moves if its locator is unique and unchanged in its source."""
    unique = lambda df, name: df.withColumn("n", F.count("*").over(W.partitionBy("source", "locator"))).where("n = 1").select("source", "locator", F.col("section").alias(name))
    rows = places.join(unique(old, "section"), ["source", "section"], "left").join(unique(new, "target"), ["source", "locator"], "left")
    return rows.select("place", "target", F.when(F.col("target").isNull(), "unavailable").otherwise("moved").alias("state"))


def status_changes(polls: DataFrame, key: str) -> DataFrame:
    """Polls whose status differs from the one before."""
    w = W.partitionBy(key).orderBy("at", "id")
    return polls.withColumn("__last", F.lag("status").over(w)).where(~F.col("status").eqNullSafe(F.col("__last"))).drop("__last")


def build_stats(sections: DataFrame) -> DataFrame:
    return sections.groupBy("source").agg(
        F.count("*").alias("sections"), F.sum(F.length("text")).alias("chars"), F.count_if(F.length("text") < 200).alias("short"), F.count_if(F.trim("text") == "").alias("empty")
    )


def apply_in_order(texts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Fold corrections(unit, decided_at, id, from_text, to_text) over texts(unit, text), in decision order.

    Per correction: applied if its text occurs once, stale if it doesn't,
    ambiguous if it does more than once. A unit's ledger is folded alone.
    """
    held = ledger.groupBy(F.col("unit").alias("of")).agg(F.collect_list(F.struct("decided_at", "id", "from_text", "to_text")).alias("ledger"))
    rows = texts.select("unit", "text").join(held, F.col("unit").eqNullSafe(F.col("of")), "left").drop("of")
    schema = "unit long, id long, outcome string, text string"
    form = to_arrow_schema(T.StructType.fromDDL(schema))

    def fold(unit: int, text: str | None, corrections: list[dict]) -> list[tuple]:
        out = []
        for row in sorted(corrections, key=lambda x: [(v is None, v) for v in (x["decided_at"], x["id"])]):
            n = text.count(row["from_text"]) if text and row["from_text"] else 0
            if n == 1:
                text = text.replace(row["from_text"], row["to_text"])
            out.append((unit, row["id"], {0: "stale", 1: "applied"}.get(n, "ambiguous"), None))
        return [*out, (unit, None, "text", text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A slice at a time, so that its texts are few in memory.
            for at in range(0, batch.num_rows, 500):
                units = zip(*(c.to_pylist() for c in batch.slice(at, 500).columns))
                out = [x for unit, text, corrections in units for x in fold(unit, text, corrections or [])]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(form)], schema=form)

    return rows.mapInArrow(run, schema)

