"""Document structure: sections, offsets, windows, neighbours, links, interval tests, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions.text import squash


def blocks_of(docs: DataFrame) -> DataFrame:
    """doc, i, text from (doc, text): the lines of a plain document as blocks."""
    return docs.select("doc", F.posexplode(F.split("text", "\n")).alias("i", "text"))


def split_sections(blocks: DataFrame, heading: Column, spine: Column) -> DataFrame:
    """doc, section, title, text from blocks(doc, i, text).

    A heading opens a section if the current one holds anything; the title is
    the first heading, else "Section spine.section"; blank lines don't count.
    """
    order = W.partitionBy("doc").orderBy("i")
    marked = blocks.withColumn("head", heading).withColumn("spine", spine)
    marked = marked.withColumn("section", F.sum(F.when(F.col("head") & (F.row_number().over(order) > 1), 1).otherwise(0)).over(order))
    line = squash(F.col("text"))
    parts = F.array_sort(F.collect_list(F.when(line != "", F.struct("i", line.alias("t")))))
    first = F.min(F.when(F.col("head"), F.struct("i", line.alias("t"))))
    grouped = marked.groupBy("doc", "section").agg(parts.alias("parts"), first.alias("first"), F.first("spine").alias("spine"))
    fallback = F.concat(F.lit("Section "), F.col("spine") + 1, F.lit("."), F.col("section") + 1)
    return grouped.select(
        "doc", "section", F.coalesce(F.col("first.t"), fallback).alias("title"), F.array_join(F.transform("parts", lambda p: p["t"]), "\n").alias("text")
    )


def text_offsets(sections: DataFrame) -> DataFrame:
    """Adds offset: where a section's text starts in its document, with a line end between sections."""
    before = W.partitionBy("doc").orderBy("section").rowsBetween(W.unboundedPreceding, -1)
    return sections.withColumn("offset", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("long"))


def reading_order(spine: DataFrame) -> DataFrame:
    """Adds first: whether an occurrence (edition, ordinal, document) is its document's first."""
    order = W.partitionBy("edition", "document").orderBy("ordinal")
    return spine.withColumn("first", F.row_number().over(order) == 1)


def chunks(texts: DataFrame, size: int = 18_000) -> DataFrame:
    """key, chunk, id, text: pieces of at most size characters with ids that depend on key and number."""
    count = F.greatest(F.ceil(F.length("text") / size).cast("int"), F.lit(1))
    rows = texts.select("key", "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    piece = F.substring("text", F.col("chunk") * size + 1, F.lit(size))
    return rows.select("key", "chunk", F.sha2(F.concat_ws(":", F.col("key").cast("string"), F.col("chunk").cast("string")), 256).alias("id"), piece.alias("text"))


def reading_windows(sections: DataFrame, size: int = 4000) -> DataFrame:
    """key, offset, text, next_offset of each window; the last has none."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(size))
    rows = sections.select("key", "text", F.explode(starts).alias("offset"))
    end = F.col("offset") + size
    return rows.select("key", "offset", F.substring("text", F.col("offset") + 1, F.lit(size)).alias("window"), F.when(end < F.length("text"), end).alias("next_offset"))


def neighbours(rows: DataFrame, by: str, order: list, key: str, page: int = 30) -> DataFrame:
    """Previous and next key in the order, and the start of the contents page."""
    w = W.partitionBy(by).orderBy(*order)
    rank = F.row_number().over(w) - 1
    return rows.select(by, key, F.lag(key).over(w).alias("previous"), F.lead(key).over(w).alias("next"), (F.floor(rank / page) * page).alias("contents_offset"))


def related_targets(sections: DataFrame, page: int = 20) -> DataFrame:
    """source, section, label, target, page from references array<struct<label,target>>: targets that exist in the same source."""
    refs = sections.select("source", "section", F.posexplode("references").alias("ord", "r"))
    known = sections.select("source", F.col("section").alias("target"))
    found = refs.select("source", "section", "ord", F.col("r.label").alias("label"), F.col("r.target").alias("target")).join(known, ["source", "target"], "left_semi")
    rank = F.row_number().over(W.partitionBy("source", "section").orderBy("ord")) - 1
    return found.select("source", "section", "label", "target", F.floor(rank / page).alias("page"))


def merge_interpretations(existing: DataFrame, incoming: DataFrame, editions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, refused): rows of editions whose source hash differs are refused; an id that is there stays as it is."""
    same = ["edition", "sha"]
    accepted = incoming.join(editions.select(*same), same, "left_semi")
    refused = incoming.join(editions.select(*same), same, "left_anti")
    fresh = accepted.join(existing.select("id"), "id", "left_anti")
    return existing.unionByName(fresh.select(*existing.columns)), refused


def describe_books(editions: DataFrame, occurrences: DataFrame, entities: DataFrame) -> DataFrame:
    """Counts per edition: occurrences, distinct documents, and entities by kind as "kind=n" in order."""
    order = occurrences.groupBy("edition").agg(F.count("*").alias("occurrences"), F.countDistinct("document").alias("documents"))
    kinds = entities.groupBy("edition", "kind").agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda k: F.concat_ws("=", k["kind"], k["n"])), ",")
    by_kind = kinds.groupBy("edition").agg(text.alias("kinds"), F.sum("n").alias("entities"))
    return editions.join(order, "edition", "left").join(by_kind, "edition", "left").select(
        "edition", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("kinds", F.lit("")).alias("kinds"), F.coalesce("entities", F.lit(0)).alias("entities")
    )


def normalize_path(path: Column) -> Column:
    """A path without "." and "x/.." parts, whatever their depth below the root."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda held, p: F.when(p != "..", F.concat(held, F.array(p))).otherwise(F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))),
    )
    return F.array_join(folded, "/")


def resolve_links(links: DataFrame, documents: DataFrame, anchors: DataFrame) -> DataFrame:
    """Adds target, fragment and state to links(base, href).

    external: has a scheme; resolved_node: document and anchor are there;
    resolved_resource: the document, without a fragment; else unresolved.
    """
    fragment = F.when(F.contains("href", F.lit("#")), F.url_decode(F.substring_index("href", "#", -1))).otherwise(F.lit(""))
    path = F.substring_index("href", "#", 1)
    folder = F.regexp_replace("base", r"[^/]*\z", "")
    target = F.when(path == "", F.col("base")).when(F.startswith(path, F.lit("/")), normalize_path(path)).otherwise(normalize_path(F.concat(folder, path)))
    external = F.col("href").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    rows = links.withColumn("fragment", fragment).withColumn("target", F.when(~external, target))
    rows = rows.join(documents.select(F.col("document").alias("target"), F.lit(True).alias("there")).distinct(), "target", "left")
    rows = rows.join(anchors.select(F.col("document").alias("target"), F.col("anchor").alias("fragment"), F.lit(True).alias("node")).distinct(), ["target", "fragment"], "left")
    state = (
        F.when(external, "external")
        .when(F.col("there").isNull(), "unresolved")
        .when(F.col("fragment") == "", "resolved_resource")
        .when(F.col("node").isNull(), "unresolved")
        .otherwise("resolved_node")
    )
    return rows.withColumn("state", state).drop("there", "node")


# --- nested intervals ------------------------------------------------------------


def mark_inside(nodes: DataFrame, container: Column) -> DataFrame:
    """Adds inside: whether an earlier container's interval covers the node. Intervals nest, so a running maximum decides."""
    before = W.partitionBy("doc").orderBy("preorder").rowsBetween(W.unboundedPreceding, -1)
    reach = F.max(F.when(container, F.col("subtree_end"))).over(before)
    return nodes.withColumn("inside", F.coalesce(reach >= F.col("preorder"), F.lit(False)))


def outer_blocks(nodes: DataFrame, block: Column) -> DataFrame:
    """Blocks that no earlier block covers."""
    return mark_inside(nodes, block).where(block & ~F.col("inside")).drop("inside")


def last_boundary(elements: DataFrame, boundary: Column, value: Column) -> DataFrame:
    """Adds context: the value at the last boundary before an element, as of its place."""
    upto = W.partitionBy("doc").orderBy("preorder").rowsBetween(W.unboundedPreceding, -1)
    return elements.withColumn("context", F.last(F.when(boundary, F.struct(value.alias("v"))), ignorenulls=True).over(upto)["v"])


def span_bounds(parts: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bounds, violations) of span parts (span, part, start_node, start_offset, end_node, end_offset)."""
    at = lambda side: nodes.select(
        F.col("id").alias(f"{side}_node"), F.col("doc").alias(f"{side}_doc"), F.col("preorder").alias(f"{side}_pre"), F.length("text").alias(f"{side}_len")
    )
    rows = parts.join(at("start"), "start_node", "left").join(at("end"), "end_node", "left")
    reason = (
        F.when(F.col("start_doc").isNull() | F.col("end_doc").isNull(), "missing node")
        .when(F.col("start_doc") != F.col("end_doc"), "two documents")
        .when(F.struct("start_pre", "start_offset") > F.struct("end_pre", "end_offset"), "reversed")
        .when((F.col("start_offset") < 0) | (F.col("start_offset") > F.col("start_len")) | (F.col("end_offset") > F.col("end_len")), "offset")
    )
    rows = rows.withColumn("reason", reason)
    bounds = rows.where("reason is null").select("span", "part", F.col("start_doc").alias("doc"), "start_pre", "start_offset", "end_pre", "end_offset")
    return bounds, rows.where("reason is not null").select("span", "part", "reason")


def separators(tag: Column) -> Column:
    """What an element stands for between texts: a line end for a block or a line break, a mark for an image, else nothing."""
    blocks = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "li", "br", "caption", "figcaption", "div", "section", "article")
    return F.when(tag.isin("img", "image"), " [uninterpreted image] ").when(tag.isin(*blocks), "\n").otherwise("")


def span_text(bounds: DataFrame, nodes: DataFrame, separator: Column | None = None, size: int = 4096) -> DataFrame:
    """span, text: what lies between the bounds of each part, in order and cut at both ends, with separators for elements; parts are joined by a line end, the whole is trimmed.

    A document's nodes are laid end to end, as places in one long text that is only kept in pieces
    of `size` characters; a part is a stretch of places. It meets its pieces by their numbers, so
    its cost is that of its text, wherever it lies, and no join compares places.
    Parts without text are empty; a span whose bounds are not in nodes has no row.
    """
    own = nodes.select("doc", "preorder", F.coalesce("text", F.lit("") if separator is None else F.coalesce(separator, F.lit(""))).alias("piece"))
    run = W.partitionBy("doc").orderBy("preorder").rowsBetween(W.unboundedPreceding, -1)
    placed = own.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(run), F.lit(0)))
    last = F.col("at") + F.length("piece") - 1
    cut = placed.where("piece <> ''").select("doc", "at", "piece", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor(last / size))).alias("k"))
    low = F.greatest(F.col("k") * size - F.col("at"), F.lit(0))
    cut = cut.select("doc", "k", F.col("at") + low, F.substring("piece", (low + 1).cast("int"), (F.least((F.col("k") + 1) * size - F.col("at"), F.length("piece")) - low).cast("int")).alias("t")).toDF("doc", "k", "at", "t")
    pieces = cut.groupBy("doc", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "t"))), lambda x: x["t"]), "").alias("body"))
    place = lambda side: placed.select("doc", F.col("preorder").alias(f"{side}_pre"), F.col("at").alias(f"{side}_at"))
    ends = bounds.join(place("start"), ["doc", "start_pre"]).join(place("end"), ["doc", "end_pre"])
    ends = ends.select("span", "part", "doc", (F.col("start_at") + F.col("start_offset")).alias("lo"), (F.col("end_at") + F.col("end_offset")).alias("hi"))
    stretch = F.when(F.col("hi") > F.col("lo"), F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))).otherwise(F.array(F.lit(-1).cast("long")))
    held = ends.withColumn("k", F.explode(stretch)).join(pieces, ["doc", "k"], "left")
    low = F.greatest(F.col("lo") - F.col("k") * size, F.lit(0))
    high = F.least(F.col("hi") - F.col("k") * size, F.lit(size))
    piece = F.coalesce(F.substring("body", (low + 1).cast("int"), (high - low).cast("int")), F.lit(""))
    by_part = held.groupBy("span", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", piece.alias("t")))), lambda x: x["t"]), "").alias("t"))
    whole = by_part.groupBy("span").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "t"))), lambda x: x["t"]), "\n").alias("text"))
    return whole.select("span", F.regexp_replace("text", r"(?U)\A\s+|\s+\z", "").alias("text"))


def structure_stats(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("doc").agg(
        F.count("*").alias("nodes"),
        F.count_if(F.col("kind") == "text").alias("text_nodes"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("characters"),
        F.count_if(F.col("tag") == "img").alias("images"),
        F.count_if(F.col("tag") == "table").alias("tables"),
        F.count_if(F.col("tag").isin("td", "th")).alias("cells"),
        F.count_if(F.col("tag").isin("ul", "ol")).alias("lists"),
        F.count_if((F.col("tag") == "a") & F.col("href").isNotNull()).alias("links"),
    )


# --- rules -----------------------------------------------------------------------


def missing_references(rows: DataFrame, key: str, reference: str, target: DataFrame, target_key: str, rule: str) -> DataFrame:
    """rule, key: rows whose reference isn't there."""
    known = target.select(F.col(target_key).alias(reference)).distinct()
    return rows.where(F.col(reference).isNotNull()).join(known, reference, "left_anti").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def gaps(rows: DataFrame, by: str, order: str, rule: str) -> DataFrame:
    """rule, key: groups whose ordinals don't run from the first on without a gap."""
    whole = rows.groupBy(by).agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.countDistinct(order).alias("n"), F.count("*").alias("rows"))
    wrong = whole.where((F.col("lo") != 1) | (F.col("hi") - F.col("lo") + 1 != F.col("n")) | (F.col("n") != F.col("rows")))
    return wrong.select(F.lit(rule).alias("rule"), F.col(by).cast("string").alias("key"))


def roundtrip(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """doc: documents whose text nodes, joined in order, don't have the stored digest."""
    parts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("preorder", "text"))))
    joined = nodes.groupBy("doc").agg(F.sha2(F.array_join(F.transform(parts, lambda p: p["text"]), ""), 256).alias("found"))
    return documents.join(joined, "doc", "left").where(~F.col("found").eqNullSafe(F.col("body_sha256"))).select("doc")
