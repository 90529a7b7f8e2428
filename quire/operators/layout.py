"""Blocks from captured HTML nodes: leaf blocks, profile blocks, roles from typography, catalog ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions.text import squash

#: Elements that are a block as a whole, and those that a profile always takes.
LEAVES = "h1 h2 h3 h4 h5 h6 p li figcaption td pre".split()
PROFILED = "p li h1 h2 h3 h4 h5 h6 blockquote".split()
#: The typography and the words that tell roles.
YIELD = r"^(?:Serves|Makes)\b"
LATE_PARTS = ("TO FINISH", "TO ASSEMBLE", "TO SERVE")
VERBS = r"^(?:Preheat|Heat|Bring|Combine|Whisk|Place|In (?:a|the)|Mix|Add|Put|Peel|Pour|Cut|Transfer|Prepare|To (?:make|finish|assemble))\b"
CAPITALS = r"^([A-Z][A-Z0-9 ’‘&–—,:()/-]{3,})(?=\s+[A-Z][a-z])"


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _owned(nodes: DataFrame, block: Column, keys: list[str]) -> DataFrame:
    """Adds owner, the preorder of the outermost block that holds a node (itself included); null outside blocks."""
    order = W.partitionBy(*keys).orderBy("preorder")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    reach = F.max(F.when(block, F.col("subtree_end"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = nodes.withColumn("__outer", block & ~_true(reach >= F.col("preorder")))
    rows = rows.withColumn("__at", F.last(F.when(F.col("__outer"), F.struct("preorder", "subtree_end")), ignorenulls=True).over(upto))
    return rows.withColumn("owner", F.when(F.col("__at.subtree_end") >= F.col("preorder"), F.col("__at.preorder"))).drop("__at", "__outer")


def _joined(text: Column) -> Column:
    """The texts of a group in document order, squashed; nothing is ''."""
    parts = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("preorder", text.alias("t")))))
    return squash(F.array_join(F.transform(parts, lambda p: p["t"]), ""))


def leaf_blocks(nodes: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """doc, i, tag, class, id, text: the leaf blocks of captured documents in reading order.

    A block is an outermost heading, paragraph, item, caption, cell or pre, with
    all its text; text outside blocks is a block "text" unless it is blank.
    Scripts and styles don't count; where a document has a body, only its first
    one does. An element whose id is in targets(doc, anchor) gives a block
    "anchor" before its own, unless it lies inside a block. Empty elements are
    blocks with the text ''.
    """
    order = W.partitionBy("doc").orderBy("preorder")
    hidden = _true(F.col("tag").isin("script", "style"))
    reach = F.max(F.when(hidden, F.col("subtree_end"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    body = F.min(F.when(F.col("tag") == "body", F.struct("preorder", "subtree_end"))).over(W.partitionBy("doc"))
    rows = nodes.withColumn("__hidden", _true(reach >= F.col("preorder"))).withColumn("__body", body)
    rows = rows.where(~F.col("__hidden") & F.coalesce(F.col("preorder").between(F.col("__body.preorder"), F.col("__body.subtree_end")), F.lit(True)))
    rows = _owned(rows, _true(F.col("tag").isin(*LEAVES)), ["doc"])
    loose = F.col("owner").isNull() & (F.col("kind") == "text") & (squash(F.col("text")) != "")
    unit = F.coalesce("owner", F.when(loose, F.col("preorder")))
    own = F.col("preorder") == F.col("unit")
    grouped = rows.withColumn("unit", unit).where("unit is not null").groupBy("doc", "unit").agg(
        F.coalesce(F.max(F.when(own, F.col("tag"))), F.lit("text")).alias("tag"),
        F.max(F.when(own, F.col("class"))).alias("class"),
        F.max(F.when(own, F.col("anchor"))).alias("id"),
        _joined(F.col("text")).alias("text"),
    )
    out = grouped.withColumn("__rank", F.lit(1))
    if targets is not None:
        free = rows.where("anchor is not null and (owner is null or owner = preorder)").join(targets.select("doc", "anchor").distinct(), ["doc", "anchor"], "left_semi")
        marks = free.select("doc", F.col("preorder").alias("unit"), F.lit("anchor").alias("tag"), F.lit(None).cast("string").alias("class"), F.col("anchor").alias("id"), F.lit("").alias("text"), F.lit(0).alias("__rank"))
        out = out.unionByName(marks)
    at = W.partitionBy("doc").orderBy("unit", "__rank")
    return out.select("doc", (F.row_number().over(at) - 1).alias("i"), "tag", "class", "id", "text")


def profile_blocks(nodes: DataFrame, profiles: DataFrame) -> DataFrame:
    """book, doc, pos, end, tag, classes, text: the outer text blocks of nodes(book, doc, ...) under the profile of their book.

    profiles(book, rule, class): the rules "title_inline" and
    "ingredient_inline" name classes of spans, all others select. A div is a
    block if a selector names it, a table row if "ingredient" names "table-r",
    an svg text under the rule "svg_text". A row carries the classes of all it
    holds. A span's rule counts only where such spans hold the whole text of
    the block. Books without a profile have the plain blocks; blank blocks go.
    """
    rule = lambda *names: F.collect_set(F.when(F.col("rule").isin(*names), F.col("class")))
    held = profiles.groupBy("book").agg(
        F.collect_set(F.when(~F.col("rule").isin("title_inline", "ingredient_inline", "svg_text"), F.col("class"))).alias("chosen"),
        rule("title_inline").alias("title_inline"),
        rule("ingredient_inline").alias("ingredient_inline"),
        F.bool_or((F.col("rule") == "ingredient") & (F.col("class") == "table-r")).alias("by_row"),
        F.bool_or(F.col("rule") == "svg_text").alias("by_svg"),
    )
    classes = F.filter(F.split(F.coalesce("class", F.lit("")), r"\s+"), lambda c: c != "")
    rows = nodes.join(held, "book", "left").withColumn("classes", classes)
    tag = F.col("tag")
    block = tag.isin(*PROFILED) | ((tag == "div") & F.arrays_overlap("classes", "chosen")) | ((tag == "tr") & F.col("by_row")) | ((tag == "text") & F.col("by_svg"))
    rows = _owned(rows, _true((F.col("kind") == "element") & block), ["book", "doc"]).where("owner is not null")
    inside = W.partitionBy("book", "doc", "owner").orderBy("preorder").rowsBetween(W.unboundedPreceding, 0)
    below = F.col("preorder") > F.col("owner")
    covered = lambda c: _true(F.max(F.when(below & F.arrays_overlap("classes", c), F.col("subtree_end"))).over(inside) >= F.col("preorder"))
    rows = rows.withColumns({"__title": covered("title_inline"), "__ingredient": covered("ingredient_inline")})
    own = F.col("preorder") == F.col("owner")
    grouped = rows.groupBy("book", "doc", F.col("owner").alias("pos")).agg(
        F.max(F.when(own, F.col("subtree_end"))).alias("end"),
        F.max(F.when(own, tag)).alias("tag"),
        F.max(F.when(own, F.col("classes"))).alias("own"),
        F.flatten(F.collect_set("classes")).alias("all"),
        _joined(F.when(F.col("kind") == "text", F.col("text")).when(tag.isin("br", "td", "th"), "\n")).alias("text"),
        _joined(F.when(F.col("__title"), F.col("text"))).alias("title_text"),
        _joined(F.when(F.col("__ingredient"), F.col("text"))).alias("ingredient_text"),
    )
    whole = lambda c, name: F.when(F.col(c) == F.col("text"), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.when(F.col("tag") == "tr", F.col("all")).otherwise(F.col("own")), whole("title_text", "authored-inline-title"), whole("ingredient_text", "authored-inline-ingredient"))
    return grouped.where("text <> ''").select("book", "doc", "pos", "end", "tag", F.array_sort(F.array_distinct(every)).alias("classes"), "text")


def svg_roles(blocks: DataFrame, title_font: str = "Sagan", text_font: str = "Akkurat") -> DataFrame:
    """Adds role to blocks(doc, pos, style, text) of a page drawn as text: title, yield, component, ingredient, instruction or null.

    Titles and yields are told by type and words, a line of capitals is a
    component, or a title if a yield follows. Other lines of the text font are
    ingredients until a line starts with a verb of the kitchen, then
    instructions; a title ends both.
    """
    order = W.partitionBy("doc").orderBy("pos")
    size = F.coalesce(F.regexp_extract("style", r"font-size:\s*([\d.]+)", 1).try_cast("double"), F.lit(0.0))
    big, plain = size >= 7.5, F.contains(F.coalesce("style", F.lit("")), F.lit(text_font))
    text = F.col("text")
    heading = F.contains(F.coalesce("style", F.lit("")), F.lit(title_font)) & (size >= 15) & (size < 35)
    capitals = big & plain & text.rlike("[A-Z]{3}") & (text == F.upper(text))
    kind = (
        F.when(heading, "title")
        .when(big & text.rlike(YIELD), "yield")
        .when(capitals & _true(F.lead("text").over(order).rlike(YIELD)), "capital title")
        .when(capitals, "component")
        .when(big & plain & text.rlike(VERBS), "verb")
        .when(big & plain, "line")
    )
    rows = blocks.withColumn("__kind", kind)
    opens = F.when(F.col("__kind") == "title", "none").when(F.col("__kind").isin("yield", "capital title", "component"), F.when(text.isin(*LATE_PARTS), "instruction").otherwise("ingredient"))
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__opens", opens).withColumns({"__state": F.last("__opens", ignorenulls=True).over(upto), "__part": F.count("__opens").over(upto)})
    started = F.max(F.col("__kind") == "verb").over(W.partitionBy("doc", "__part").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    state = F.when(F.col("__state") != "none", F.when(_true(started), "instruction").otherwise(F.col("__state")))
    role = F.when(F.col("__kind").isin("title", "yield", "component"), F.col("__kind")).when(F.col("__kind") == "capital title", "title").when(F.col("__kind").isin("verb", "line"), state)
    return rows.withColumn("role", role).select(*blocks.columns, "role")


def fragment_roles(blocks: DataFrame) -> DataFrame:
    """Adds role to blocks(doc, pos, text) of pages in whole paragraphs: title, ingredient-list, instruction or null.

    A page counts if its first block starts with a run of capitals before its
    headnote, and a later block states the yield; the title's text is cut to
    the run. What follows the yield is instruction.
    """
    order = W.partitionBy("doc").orderBy("pos")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = blocks.withColumn("__k", F.row_number().over(order))
    rows = rows.withColumn("__yield", F.min(F.when(F.col("text").rlike(r"^(?:MAKES|SERVES)\b"), F.col("__k"))).over(whole))
    # The run is read once, on the first block, so no text is carried along the page.
    rows = rows.withColumn("__title", F.when(F.col("__k") == 1, F.trim(F.regexp_extract("text", CAPITALS, 1))))
    rows = rows.withColumn("__counts", F.max(F.col("__title") != "").over(whole) & (F.col("__yield") > 1))
    at, list_at = F.col("__k"), F.col("__yield")
    role = F.when(_true(F.col("__counts")), F.when(at == 1, "title").when(at == list_at, "ingredient-list").when(at > list_at, "instruction"))
    return rows.withColumn("role", role).withColumn("text", F.when(F.col("role") == "title", F.col("__title")).otherwise(F.col("text"))).select(*blocks.columns, "role")


def catalog_ranges(blocks: DataFrame) -> DataFrame:
    """book, recipe, title, first, last, blocks, ingredients, methods, parts, status of blocks(book, document, i, pos, reach, tag, role, text).

    As `recipe_windows`, with a stricter end: after the last ingredient or
    method only what lies inside it (pos up to its reach), notes and cells of
    its document stay. document is an ordinal, i the place in it. parts are
    the documents of a range: the first has a start, the last an end, those
    without a block are whole; a document without blocks before the next one
    belongs to the range. A range without both an ingredient and a method is
    rejected. Texts other than titles aren't carried.
    """
    order = W.partitionBy("book").orderBy("pos")
    slim = blocks.select("book", "document", "i", "pos", "reach", "tag", _true(F.col("role") == "title").alias("title"), F.coalesce("role", F.lit("")).alias("role"), F.when(F.col("role") == "title", F.col("text")).alias("text"))
    joined = _true(F.lag("title").over(order) & (F.lag("document").over(order) == F.col("document")))
    rows = slim.withColumns({"__start": F.when(F.col("title") & ~joined, 1).otherwise(0), "__next": F.struct(F.lead("document").over(order).alias("document"), F.lead("i").over(order).alias("i"))})
    rows = rows.withColumn("recipe", F.sum("__start").over(order)).where("recipe > 0")
    inner = W.partitionBy("book", "recipe").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("book", "recipe")
    rows = rows.withColumn("__head", F.min("title").over(inner))
    rows = rows.withColumn("__stopped", F.max((F.col("role") == "stop") & ~F.col("__head")).over(inner)).where("not __stopped")
    content = F.col("role").isin("ingredient", "method") & ~F.col("__head")
    rows = rows.withColumn("__end", F.max(F.when(content, F.struct("pos", "document", "reach"))).over(whole))
    after = F.col("pos") > F.col("__end.pos")
    belongs = (F.col("document") == F.col("__end.document")) & ((F.col("pos") <= F.col("__end.reach")) | (F.col("role") == "note") | _true(F.col("tag").isin("td", "th")))
    rows = rows.withColumn("__kept", ~_true(F.max(after & ~belongs).over(inner)))
    kept = lambda c: F.when(F.col("__kept"), c)
    heads = F.array_sort(F.collect_list(F.when(F.col("__head"), F.struct("pos", "text"))))
    out = rows.groupBy("book", "recipe").agg(
        F.array_join(F.transform(heads, lambda p: p["text"]), " ").alias("title"),
        F.min("pos").alias("first"),
        F.max(kept(F.struct("pos", "document", "__next"))).alias("tail"),
        F.count_if(F.col("__kept")).alias("blocks"),
        F.count_if(F.col("__kept") & (F.col("role") == "ingredient")).alias("ingredients"),
        F.count_if(F.col("__kept") & (F.col("role") == "method")).alias("methods"),
        F.min("document").alias("low"),
        F.collect_set(kept(F.col("document"))).alias("filled"),
    )
    high = F.greatest(F.col("tail.document"), F.when(F.col("tail.__next.i") == 0, F.col("tail.__next.document") - 1))
    parts = F.transform(
        F.sequence("low", high),
        lambda d: F.struct(
            d.alias("document"),
            F.when(d == F.col("low"), F.col("first")).alias("start"),
            F.when((d == high) & F.array_contains("filled", d), F.col("tail.pos")).alias("end"),
            (~F.array_contains("filled", d)).alias("whole"),
        ),
    )
    good = (F.col("ingredients") > 0) & (F.col("methods") > 0)
    return out.select("book", "recipe", "title", "first", F.when(good, F.col("tail.pos")).alias("last"), "blocks", "ingredients", "methods", F.when(good, parts).alias("parts"), F.when(good, "candidate").otherwise("rejected").alias("status"))
