"""Transcription checks, review overlays, approvals and eligibility."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from quire.functions.text import nfkc, phrase_form

# --- transcription ---------------------------------------------------------------


def clean_line(text: Column) -> Column:
    """A line without a bullet; tabs become cell bars."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*[•*·-]\s+", ""), r"\t+", " | "))


def wording_key(text: Column) -> Column:
    """Letters only, lower case."""
    return F.lower(F.regexp_replace(text, r"(?U)[^\p{L}]", ""))


def quantities(text: Column) -> Column:
    """Quantity tokens in order."""
    return F.regexp_extract_all(text, F.lit(r"(\d+(?:[./]\d+)?)"), 1)


def check_blocks(labels: DataFrame) -> DataFrame:
    """key, rule: blocks (key, first, last) that don't cover lines 1..lines once and in order."""
    w = W.partitionBy("key").orderBy("first", "last")
    follows = labels.withColumn("before", F.coalesce(F.lag("last").over(w), F.lit(0))).where(F.col("first") != F.col("before") + 1).select("key", F.lit("gap or overlap").alias("rule"))
    ends = labels.groupBy("key").agg(F.max("last").alias("last"), F.max("lines").alias("lines")).where("last <> lines").select("key", F.lit("end").alias("rule"))
    return follows.unionByName(ends)


def resolve_folios(references: DataFrame, pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Adds page and section to references(book, printed): the last page of a folio, then its recipe section, else its first."""
    last = pages.groupBy("book", "printed").agg(F.max("page").alias("page"))
    best = sections.groupBy("book", "page").agg(F.min_by("section", F.struct(F.col("kind") != "recipe", "section")).alias("section"))
    return references.join(last, ["book", "printed"], "left").join(best, ["book", "page"], "left")


def page_status(attempts: DataFrame, rounds: int) -> DataFrame:
    """page, status: transcribed once a text came; blank after `rounds` attempts that all came empty; else failed or pending."""
    n = attempts.groupBy("page").agg(F.count("*").alias("n"), F.count_if(F.col("error").isNull()).alias("good"), F.every(F.col("error") == "empty response").alias("empty"), F.bool_or(F.col("error") == "refused").alias("refused"))
    status = (
        F.when(F.col("good") > 0, "transcribed")
        .when(F.coalesce("refused", F.lit(False)), "refused")
        .when(F.coalesce("empty", F.lit(False)) & (F.col("n") >= rounds), "blank")
        .when(F.col("n") >= rounds, "failed")
        .otherwise("pending")
    )
    return n.select("page", status.alias("status"))


def pair_by_order(left: DataFrame, right: DataFrame, by: str, order: str) -> DataFrame:
    """by, k, left_id, right_id: the k-th of a group on one side with the k-th on the other; a null marks a mismatch."""
    ranked = lambda df, name: df.select(by, F.col("id").alias(name), F.row_number().over(W.partitionBy(by).orderBy(order)).alias("k"))
    return ranked(left, "left_id").join(ranked(right, "right_id"), [by, "k"], "full")


def assign_lines(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """line, box, state: points (page, line, x, y) in boxes (page, box, l, t, r, b); two boxes make a line ambiguous, none leaves it unassigned."""
    inside = (F.col("x") >= F.col("l")) & (F.col("x") < F.col("r")) & (F.col("y") >= F.col("t")) & (F.col("y") < F.col("b"))
    hits = points.join(boxes, "page").where(inside).groupBy("line").agg(F.count("*").alias("n"), F.min("box").alias("box"))
    rows = points.select("line").join(hits, "line", "left")
    state = F.when(F.col("n").isNull(), "unassigned").when(F.col("n") > 1, "ambiguous").otherwise("assigned")
    return rows.select("line", F.when(F.col("n") == 1, F.col("box")).alias("box"), state.alias("state"))


def _word_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of words at neighbouring places of a line, from words(page, line, pos, word, confidence): page, line, empty, pos, n, text, c, known, size.

    A null word (empty) and a word with a space are runs of their own, so a text of n words has n - 1 spaces.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        page = pc.dictionary_encode(batch.column("page"), null_encoding="encode").indices.to_numpy()
        line, pos, word = batch.column("line").to_numpy(), batch.column("pos").to_numpy(), batch.column("word")
        empty = pc.is_null(word).to_numpy(zero_copy_only=False)
        alone = empty | pc.match_substring(word, " ").fill_null(False).to_numpy(zero_copy_only=False)
        new = np.ones(batch.num_rows, bool)
        new[1:] = (page[1:] != page[:-1]) | (line[1:] != line[:-1]) | (pos[1:] != pos[:-1] + 1) | alone[1:] | alone[:-1]
        first = np.flatnonzero(new)
        size = pc.utf8_length(word).fill_null(0).cast(pa.int64())
        weight = pc.multiply(batch.column("confidence"), size.cast(batch.schema.field("confidence").type))
        known = pc.is_valid(weight).to_numpy(zero_copy_only=False) & ~empty
        c = np.where(known, weight.fill_null(0).to_numpy(), 0)
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(first, batch.num_rows), pa.int32()), word.fill_null("")), " ")
        yield pa.RecordBatch.from_arrays(
            [batch.column("page").take(pa.array(first)), pa.array(line[first]), pa.array(empty[first]), pa.array(pos[first]), pa.array(np.diff(np.append(first, batch.num_rows))), texts,
             pa.array(np.add.reduceat(c, first)), pa.array(np.add.reduceat(known.astype(np.int64), first)), pa.array(np.add.reduceat(size.to_numpy(), first))],
            names=["page", "line", "empty", "pos", "n", "text", "c", "known", "size"],
        )


def _page_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page, text, c, known, size from runs in order; the last page of a batch waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in (b for b in batches if b.num_rows):
        pages = batch.column("page")
        if held and pages[0] == held[-1].column("page")[-1] == pages[-1]:
            held.append(batch)
            continue
        codes = pc.dictionary_encode(pages, null_encoding="encode").indices.to_numpy()
        last = int(np.flatnonzero(codes == codes[-1])[0])
        held.append(batch.slice(0, last))
        if sum(b.num_rows for b in held):
            yield _joined(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
        held = [batch.slice(last)]
    if held:
        yield _joined(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _joined(runs: pa.RecordBatch) -> pa.RecordBatch:
    """The texts of whole pages. Where runs overlap, words are put in order one by one."""
    codes = pc.dictionary_encode(runs.column("page"), null_encoding="encode").indices.to_numpy()
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    sums = [np.add.reduceat(runs.column(c).to_numpy(), first) for c in ("c", "known", "size")]
    page, line, pos, n = codes, runs.column("line").to_numpy(), runs.column("pos").to_numpy(), runs.column("n").to_numpy()
    empty, text = runs.column("empty").to_numpy(zero_copy_only=False), runs.column("text")
    if ((page[1:] == page[:-1]) & (line[1:] == line[:-1]) & (empty[1:] == empty[:-1]) & (pos[1:] < pos[:-1] + n[:-1])).any():
        words = [w for t, k in zip(text.to_pylist(), n) for w in ([t] if k == 1 else t.split(" "))]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(pos, n)
        rows = pa.table([pa.array(np.repeat(page, n)), pa.array(np.repeat(line, n)), pa.array(np.repeat(empty, n)), pa.array(place), pa.array(words, pa.string())], names=["page", "line", "empty", "pos", "text"])
        rows = rows.sort_by([(c, "ascending") for c in rows.column_names]).combine_chunks()
        page, line, empty = (rows.column(c).to_numpy() for c in ("page", "line", "empty"))
        text = rows.column("text").combine_chunks()
    new = np.append(True, page[1:] != page[:-1])
    between = np.where(new, 0, np.where(np.append(True, line[1:] != line[:-1]), 1, np.where(empty, 0, 2)))
    pieces = pc.binary_join_element_wise(pa.array(["", "\n", " "]).take(pa.array(between)), text, "")
    cuts = pa.array(np.append(np.flatnonzero(new), len(page)), pa.int32())
    return pa.RecordBatch.from_arrays([runs.column("page").take(pa.array(first)), pc.binary_join(pa.ListArray.from_arrays(cuts, pieces), ""), *map(pa.array, sums)], names=["page", "text", "c", "known", "size"])


def ocr_triage(words: DataFrame, least: float = 60.0) -> DataFrame:
    """page, text, mean_confidence weighted by length, reasons, from words(page, line, pos, word, confidence).

    Words that lie together in their batch go to their page as one text, so rows that move are lines rather than
    words. A task sorts them, on disk if need be, and holds one batch and one page. Null words come last in their line;
    the mean confidence of a page without a character is not a number, without any word that has one it is null.
    """
    place = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-(2**47))).alias(c)
    whole = isinstance(words.schema["confidence"].dataType, T.IntegralType)
    number = "long" if whole else "double"
    rows = words.select("page", place("line"), place("pos"), "word", F.col("confidence").cast(number))
    kind = words.schema["page"].dataType.simpleString()
    runs = rows.mapInArrow(_word_runs, f"page {kind}, line long, empty boolean, pos long, n long, text string, c {number}, known long, size long")
    runs = runs.repartition("page").sortWithinPartitions("page", "line", "empty", "pos")
    texts = runs.mapInArrow(_page_texts, f"page {kind}, text string, c {number}, known long, size long")
    mean = F.when(F.col("known") > 0, F.when(F.col("size") == 0, F.lit(float("nan"))).otherwise(F.try_divide("c", "size")))
    pages = texts.select("page", "text", F.round(mean, 6).alias("mean_confidence"))
    reasons = F.array_compact(F.array(F.when(F.col("mean_confidence") < least, F.lit("low confidence")), F.when(F.length("text") < 200, F.lit("short")), F.when(F.col("text").rlike(r"\d"), F.lit("numbers"))))
    return pages.withColumn("reasons", F.array_join(reasons, ","))


def triage_candidates(texts: DataFrame) -> DataFrame:
    """group, disagreement, suspicious: whether the readings' numbers differ as multisets, and how many odd quantity forms there are."""
    numbers = F.array_join(F.array_sort(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}_])(\d+(?:[./]\d+)*)(?![\d/])"), 1)), " ")
    odd = F.regexp_count("text", F.lit(r"(?<![\p{L}\p{N}_])(?:[VY][2348]|Sg)(?=\s)"))
    return texts.groupBy("group").agg((F.countDistinct(numbers) > 1).alias("disagreement"), F.sum(odd).cast("long").alias("suspicious"))


# --- review ------------------------------------------------------------------------


def review_overlay(originals: DataFrame, revisions: DataFrame) -> DataFrame:
    """target, value, revised: the value of the last revision, the original without one."""
    last = revisions.groupBy("target").agg(F.max_by("value", "seq").alias("new"), F.count("*").alias("n"))
    rows = originals.join(last, "target", "left")
    return rows.select("target", F.coalesce("new", "value").alias("value"), F.coalesce("n", F.lit(0)).alias("revisions"))


def edit_occurrence(rows: DataFrame) -> DataFrame:
    """Adds result and refused: `replacement` goes into [start, end) if that holds `expected`."""
    held = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    good = F.coalesce(held == F.col("expected"), F.lit(False))
    edited = F.concat(F.substring("text", F.lit(1), F.col("start")), F.col("replacement"), F.substring("text", F.col("end") + 1, F.lit(1 << 30)))
    return rows.withColumn("result", F.when(good, edited).otherwise(F.col("text"))).withColumn("refused", ~good)


def review_queue(view: DataFrame, least: float) -> DataFrame:
    """target, reasons, pos: what needs a look: unresolved first, then by confidence, then in order."""
    reasons = F.array_compact(F.array(F.when(F.col("state") == "unresolved", F.lit("unresolved")), F.when(F.col("confidence") < least, F.lit("confidence")), F.when(F.col("numeric"), F.lit("numeric"))))
    rows = view.withColumn("reasons", reasons).where(F.size("reasons") > 0)
    order = W.partitionBy("document").orderBy(F.col("state") != "unresolved", F.col("confidence").asc_nulls_first(), "target")
    return rows.select("document", "target", F.array_join("reasons", ",").alias("reasons"), F.row_number().over(order).alias("pos"))


def effective_members(members: DataFrame, moves: DataFrame) -> DataFrame:
    """selection, lines: a reviewed line belongs where it was moved to, the others where they were."""
    last = moves.groupBy("line").agg(F.max_by("selection", "seq").alias("to"))
    rows = members.join(last, "line", "left").select("line", F.coalesce("to", "selection").alias("selection"))
    return rows.groupBy("selection").agg(F.array_join(F.array_sort(F.collect_list("line")), ",").alias("lines"), F.count("*").alias("n"))


def revoked(decisions: DataFrame) -> DataFrame:
    """Decisions that a later one of their scope revokes, or that one names."""
    events = decisions.where("action = 'revoke'")
    last = events.groupBy("scope").agg(F.max("seq").alias("until"))
    prior = decisions.where("action = 'approve'").join(last, "scope").where("seq < until").select("id")
    return prior.union(events.select(F.explode("affected").alias("id"))).distinct()


def section_eligibility(sections: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """key, state, reasons: a section is suppressed by a withdrawal of its decision or of one of its pages."""
    by_decision = sections.join(withdrawals.select("decision", "reason").dropna(subset=["decision"]), "decision").select("key", "reason")
    paged = sections.select("key", "source", F.explode("pages").alias("page"))
    by_page = paged.join(withdrawals.select("source", "page", "reason").dropna(subset=["page"]), ["source", "page"]).select("key", "reason")
    reasons = by_decision.union(by_page).groupBy("key").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    rows = sections.join(reasons, "key", "left")
    state = F.when(F.col("reasons").isNotNull(), "suppressed").when(F.col("superseded"), "superseded").otherwise("eligible")
    return rows.select("key", state.alias("state"), F.coalesce(F.array_join("reasons", ","), F.lit("")).alias("reasons"))


def supersede(sections: DataFrame, changed: DataFrame) -> DataFrame:
    """Sections that overlap a page whose reviewed text changed."""
    return sections.select("key", "source", F.explode("pages").alias("page")).join(changed, ["source", "page"], "left_semi").select("key").distinct()


def effective_ocr(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """key, text, state: a decision counts only for the exact result that it saw."""
    rows = results.join(decisions, ["key", "digest"], "left")
    state = F.when(F.col("decision").isNull(), "pending").otherwise(F.col("decision"))
    text = F.when(state == "correct", F.col("correction")).when(state == "nontext", F.lit("")).otherwise(F.col("text"))
    return rows.select("key", text.alias("text"), state.alias("state"))


def publish_gate(sections: DataFrame, decisions: DataFrame, searched: DataFrame) -> DataFrame:
    """rule, key of what stops a publication."""
    lost = decisions.join(sections.select("key"), "key", "left_anti").select(F.lit("decision without section").alias("rule"), "key")
    hidden = searched.join(sections.where("searchable").select("key"), "key", "left_anti").select(F.lit("searched but not searchable").alias("rule"), "key")
    unseen = sections.where("searchable").join(searched.select("key"), "key", "left_anti").select(F.lit("searchable but not searched").alias("rule"), "key")
    blank = sections.where("searchable and trim(text) = ''").select(F.lit("blank").alias("rule"), "key")
    return lost.unionByName(hidden).unionByName(unseen).unionByName(blank)


# --- evaluation ----------------------------------------------------------------------


def present(texts: DataFrame, phrases: DataFrame, n: int = 5) -> DataFrame:
    """item_id, doc_id: phrases (item_id, phrase) that stand in texts (doc_id, text) between word boundaries, numbers and fractions safe.

    A phrase's first n words, or all of a shorter one, meet the same run of
    words in the texts; what meets is compared whole. An empty phrase is nowhere.
    """
    wanted = phrases.select("item_id", phrase_form(F.col("phrase")).alias("phrase")).where("phrase <> ''")
    wanted = wanted.withColumn("words", _phrase_words("phrase")).withColumn("n", F.least(F.size("words"), F.lit(n))).where("n > 0")
    wanted = wanted.select("item_id", "phrase", "n", F.xxhash64(F.slice("words", 1, F.col("n"))).alias("run"))
    bodies = texts.select("doc_id", phrase_form(F.col("text")).alias("body"))
    words = bodies.select("doc_id", _phrase_words("body").alias("words"))
    runs = None
    for size in sorted(r["n"] for r in wanted.select("n").distinct().collect()):  # 1 to n
        found = F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.xxhash64(F.slice("words", i, size)))  # noqa: B023
        one = words.where(F.size("words") >= size).select("doc_id", F.lit(size).alias("n"), F.explode(F.array_distinct(found)).alias("run"))
        runs = one if runs is None else runs.unionByName(one)
    if runs is None:
        return wanted.select("item_id", F.lit(None).cast("long").alias("doc_id")).limit(0)
    pairs = runs.join(wanted, ["n", "run"]).select("item_id", "doc_id", "phrase").distinct()
    inside = F.concat(F.lit(r"(?<![\p{L}\p{N}_/])\Q"), F.col("phrase"), F.lit(r"\E(?![\p{L}\p{N}_/])"))
    return pairs.join(bodies, "doc_id").where(F.regexp_like("body", inside)).select("item_id", "doc_id")


def _phrase_words(column: str) -> Column:
    return F.regexp_extract_all(F.col(column), F.lit(r"([\p{L}\p{N}_/]+)"), 1)


def retrieval_metrics(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """hits, total, recall_at_10 and mean reciprocal rank by category, by split and overall.

    hits(query, unit, pos) ranks units; queries(query, category, split, relevant array).
    """
    order = W.partitionBy("query").orderBy("pos", "unit")
    units = hits.groupBy("query", "unit").agg(F.min("pos").alias("pos")).withColumn("rank", F.row_number().over(order)).where("rank <= 10")
    wanted = queries.select("query", F.explode("relevant").alias("unit"))
    first = units.join(wanted, ["query", "unit"]).groupBy("query").agg(F.min("rank").alias("rank"))
    rows = queries.where(F.size("relevant") > 0).join(first, "query", "left")
    sets = rows.groupingSets([["category"], ["split"], []], "category", "split")
    return sets.agg(
        F.count("rank").alias("hits"),
        F.count("*").alias("total"),
        F.round(F.count("rank") / F.count("*"), 6).alias("recall_at_10"),
        F.round(F.sum(F.coalesce(1 / F.col("rank"), F.lit(0.0))) / F.count("*"), 6).alias("mrr"),
        F.grouping_id("category", "split").alias("level"),
    )


def scored_form(text: Column) -> Column:
    """The form in which items are compared: compatible characters, lower case, one dash, one space, no space after a dash."""
    plain = F.regexp_replace(F.lower(nfkc(F.coalesce(text, F.lit("")))), "[\u2010-\u2015]", "-")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)-\s+", "-"), r"(?U)\s+", " "))


def match_items(pages: DataFrame, items: DataFrame, excluded: tuple[str, ...] = ("continuation", "ownership"), amounts: tuple[str, ...] = ("ingredient_line", "amount")) -> DataFrame:
    """book, page, item, field, quantity, before, after, missing: whether each item of the reference is in the page's text as read and as corrected.

    pages(book, page, before, after), items(book, page, item, field, text, ambiguous). An item of several cells, parted by
    bars, is found on a line that holds all of them; any other in the text as a whole. Items that are
    ambiguous or of an excluded field are left out. A page that isn't there has no text: its items
    count, and are wrong. A null text is empty, and an empty item is in every page that is there.

    Items meet their page by an equi-join; a page's forms are made once, before it.
    """
    tabs = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\t"), F.lit(" | "))
    forms = lambda c: [scored_form(tabs(F.col(c))).alias(f"{c}_all"), F.transform(F.split(tabs(F.col(c)), "\r\n|\r|\n"), lambda x: x).alias(f"{c}_raw")]
    read = pages.select("book", "page", F.lit(True).alias("there"), *forms("before"), *forms("after"))
    # Lines are brought to their form as rows: the form has a Python step, which arrays can't take.
    lines = read.select("book", "page", F.posexplode(F.arrays_zip(F.col("before_raw").alias("b"), F.col("after_raw").alias("a"))).alias("i", "x"))
    lines = lines.select("book", "page", scored_form(F.col("x.b")).alias("b"), scored_form(F.col("x.a")).alias("a")).groupBy("book", "page").agg(F.collect_set("b").alias("before_lines"), F.collect_set("a").alias("after_lines"))
    read = read.drop("before_raw", "after_raw").join(lines, ["book", "page"], "left")
    wanted = items.where(~F.coalesce("ambiguous", F.lit(False)) & ~F.coalesce(F.col("field").isin(*excluded), F.lit(False)))
    wanted = wanted.withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"\Acolumn headers: ", ""))
    wanted = wanted.select("book", "page", "item", "field", scored_form(F.col("text")).alias("form"), F.split("text", r" \| ").alias("cells"))
    cells = wanted.where(F.size("cells") > 1).select("book", "page", "item", F.explode("cells").alias("cell")).select("book", "page", "item", scored_form(F.col("cell")).alias("cell"))
    cells = cells.groupBy("book", "page", "item").agg(F.collect_set("cell").alias("cells"))
    wanted = wanted.drop("cells").join(cells, ["book", "page", "item"], "left").join(read, ["book", "page"], "left")
    there = F.coalesce("there", F.lit(False))

    def found(side: str) -> Column:
        on_line = F.exists(f"{side}_lines", lambda line: F.forall("cells", lambda c: F.contains(line, c)))
        return there & F.coalesce(F.when(F.col("cells").isNotNull(), on_line).otherwise(F.contains(f"{side}_all", F.col("form"))), F.lit(False))

    return wanted.select("book", "page", "item", "field", F.coalesce(F.col("field").isin(*amounts), F.lit(False)).alias("quantity"), found("before").alias("before"), found("after").alias("after"), (~there).alias("missing"))


def item_scores(matched: DataFrame) -> DataFrame:
    """Per book and in total: pages, missing pages, items right before and after, the same of quantities, fixed and broken ones."""
    right = lambda c, when=F.lit(True): F.count_if(F.col(c) & when)
    q = F.col("quantity")
    return matched.rollup("book").agg(
        F.countDistinct("book", "page").alias("pages"),
        F.countDistinct(F.when(F.col("missing"), F.struct("book", "page"))).alias("missing"),
        F.count("*").alias("items"), right("before").alias("before"), right("after").alias("after"),
        F.count_if(q).alias("quantities"), right("before", q).alias("quantities_before"), right("after", q).alias("quantities_after"),
        F.count_if(~F.col("before") & F.col("after")).alias("fixed"), F.count_if(F.col("before") & ~F.col("after")).alias("broke"),
        F.grouping("book").cast("int").alias("total"),
    )


def transitions(matched: DataFrame) -> DataFrame:
    """book, page, item, field, change: items that a correction fixed or broke, and those that are still wrong."""
    change = F.when(F.col("after") & ~F.col("before"), "fixed").when(F.col("before") & ~F.col("after"), "broke").when(~F.col("after"), "miss")
    return matched.withColumn("change", change).where("change is not null").select("book", "page", "item", "field", "change")


def score_items(items: DataFrame) -> DataFrame:
    """Per book and in total: items right before and after, fixed and broken ones, from items(book, item, before, after)."""
    return items.rollup("book").agg(
        F.count("*").alias("items"),
        F.count_if("before").alias("before"),
        F.count_if("after").alias("after"),
        F.count_if(~F.col("before") & F.col("after")).alias("fixed"),
        F.count_if(F.col("before") & ~F.col("after")).alias("broke"),
        F.grouping("book").cast("int").alias("total"),
    )


def cost_summary(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """model: calls, failed ones, list cost, median and p90 of the seconds; p90 is the element at 0.9 n, counted from 0."""
    cost = F.col("fresh") * F.col("fresh_price") + F.col("cached") * F.col("cached_price") + F.col("output") * F.col("output_price")
    # A model may have very many calls: they are counted by their seconds first, and only values and counts are put in order.
    rows = calls.join(F.broadcast(prices), "model").withColumn("cost", cost).groupBy("model", "seconds")  # a row per model
    rows = rows.agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"), F.sum("cost").alias("cost"))
    model = W.partitionBy("model")
    rows = rows.withColumns({"upto": F.sum("n").over(model.orderBy("seconds")), "all": F.sum("n").over(model), "without": F.sum(F.when(F.col("seconds").isNull(), F.col("n")).otherwise(0)).over(model)})
    element = lambda at: F.max(F.when((at >= F.col("upto") - F.col("n")) & (at < F.col("upto")), F.col("seconds")))
    timed = F.col("all") - F.col("without")
    median = element(F.col("without") + F.floor((timed - 1) / 2)) * 0.5 + element(F.col("without") + F.floor(timed / 2)) * 0.5
    return rows.groupBy("model").agg(
        F.sum("n").alias("calls"),
        F.sum("failed").alias("failed"),
        F.round(F.sum("cost"), 4).alias("cost"),
        F.round(median, 6).alias("median_s"),
        element(F.floor(F.col("all") * 0.9)).alias("p90_s"),
    )


def compare_runs(run: DataFrame, baseline: DataFrame) -> DataFrame:
    """metric, run, baseline, change of two frames of (metric, value)."""
    rows = run.withColumnRenamed("value", "run").join(baseline.withColumnRenamed("value", "baseline"), "metric", "full")
    return rows.withColumn("change", F.round(F.col("run") - F.col("baseline"), 6))


def ab_summary(samples: DataFrame, rounds: int) -> DataFrame:
    """case, side: attempts, successes, times, whether results are identical and the cell is complete."""
    good = ~F.col("failed")
    ms = F.when(good, F.col("ms"))
    return samples.groupBy("case", "side").agg(
        F.count("*").alias("attempts"),
        F.count_if(good).alias("successes"),
        F.round(F.median(ms), 6).alias("median_ms"),
        F.min(ms).alias("min_ms"),
        F.max(ms).alias("max_ms"),
        ((F.countDistinct("digest") == 1) & (F.count("digest") == F.count("*"))).alias("identical"),
        (F.count_if(good) >= rounds).alias("complete"),
    )


def coverage_survey(pages: DataFrame, least: int = 40) -> DataFrame:
    """book: pages, pages with text, letters and digits, replacement characters, and sample pages at 25, 50 and 75 percent."""
    n = F.regexp_count("text", F.lit(r"[\p{L}\p{N}]"))
    rows = pages.withColumn("alnum", n).withColumn("broken", F.regexp_count("text", F.lit("�")))
    by_book = rows.groupBy("book").agg(
        F.count("*").alias("pages"), F.count_if(F.col("alnum") >= least).alias("with_text"), F.sum("alnum").alias("alnum"), F.sum("broken").alias("broken")
    )
    samples = F.array_join(F.transform(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), lambda f: F.floor(F.col("pages") * f + 0.5).cast("string")), ",")
    return by_book.withColumn("samples", samples)
