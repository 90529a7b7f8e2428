"""Recipe interpretation: windows, ingredient lines, uses, packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Units of measure, and the glyphs that an amount may hold.
UNITS = (
    "g gram grams kg kilogram kilograms ml milliliter milliliters l liter liters oz ounce ounces lb pound pounds cup cups tbsp tablespoon tablespoons "
    "tsp teaspoon teaspoons quart quarts pint pints dash dashes quantity recipe portion portions"
).split()
GLYPHS = {"¼": (1, 4), "½": (1, 2), "¾": (3, 4), "⅓": (1, 3), "⅔": (2, 3), "⅛": (1, 8), "⅜": (3, 8), "⅝": (5, 8), "⅞": (7, 8)}


def classify_blocks(blocks: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds role: the first profile rule (book, role, rank, class) that names one of a block's classes.

    The rules grow with the number of books, so Spark decides by their size whether to broadcast them.
    """
    rules = profiles.select("book", "role", "rank", F.col("class").alias("c"))
    hits = blocks.select("book", "block", F.explode("classes").alias("c")).join(rules, ["book", "c"])
    return blocks.join(hits.groupBy("book", "block").agg(F.min_by("role", "rank").alias("role")), ["book", "block"], "left")


def recipe_windows(blocks: DataFrame, most_blocks: int = 500, most_chars: int = 150_000) -> DataFrame:
    """book, recipe, title, first, last, blocks, status of candidate recipes in blocks(book, pos, document, role, text).

    Adjacent titles of a document are one start. A window ends before the
    next start or at the first stop. It is kept if an ingredient and then an
    instruction occur and it isn't oversized; its end is the rest of the last
    one's document inside the window.
    """
    order = W.partitionBy("book").orderBy("pos")
    title = F.coalesce(F.col("role") == "title", F.lit(False))
    after = F.coalesce(F.lag(title).over(order) & (F.lag("document").over(order) == F.col("document")), F.lit(False))
    rows = blocks.withColumn("start", title & ~after).withColumn("recipe", F.sum(F.when(F.col("start"), 1).otherwise(0)).over(order)).where("recipe > 0")
    inner = W.partitionBy("book", "recipe").orderBy("pos")
    upto = inner.rowsBetween(W.unboundedPreceding, 0)
    # The title run: titles of the first document without a gap.
    rows = rows.withColumn("k", F.row_number().over(inner))
    broken = F.sum(F.when((F.col("role") == "title") & (F.col("document") == F.first("document").over(inner)), 0).otherwise(1)).over(upto)
    rows = rows.withColumn("heading", broken == 0)
    rows = rows.withColumn("stopped", F.sum(F.when((F.col("role") == "stop") & ~F.col("heading"), 1).otherwise(0)).over(upto)).where("stopped = 0")
    whole = W.partitionBy("book", "recipe")
    rows = rows.withColumn("ingredient", F.min(F.when(F.col("role") == "ingredient", F.col("pos"))).over(whole))
    method = (F.col("role") == "instruction") & (F.col("pos") > F.col("ingredient"))
    rows = rows.withColumn("method", F.max(F.when(method, F.col("pos"))).over(whole))
    rows = rows.withColumn("core", F.greatest(F.col("method"), F.max(F.when(F.col("role") == "ingredient", F.col("pos"))).over(whole)))
    rows = rows.withColumn("core_document", F.max(F.when(F.col("pos") == F.col("core"), F.col("document"))).over(whole))
    # Blocks after the core stay as long as the document does.
    left = F.max(F.when((F.col("pos") > F.col("core")) & (F.col("document") != F.col("core_document")), 1).otherwise(0)).over(upto)
    rows = rows.withColumn("kept", (F.col("pos") <= F.col("core")) | (left == 0))
    parts = F.array_sort(F.collect_list(F.when(F.col("heading"), F.struct("pos", "text"))))
    out = rows.groupBy("book", "recipe").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("title"),
        F.min("pos").alias("first"),
        F.max(F.when(F.col("kept"), F.col("pos"))).alias("end"),
        F.count("*").alias("blocks"),
        F.sum(F.length("text")).alias("chars"),
        F.max("method").alias("method"),
    )
    good = F.col("method").isNotNull() & (F.col("blocks") <= most_blocks) & (F.col("chars") <= most_chars)
    return out.select("book", "recipe", "title", "first", F.when(good, F.col("end")).alias("last"), "blocks", F.when(good, "kept").otherwise("rejected").alias("status"))


def parse_ingredients(lines: DataFrame, line: str) -> DataFrame:
    """Adds num, den, unit, name, preparation of an ingredient line; all null where the amount is compound or missing.

    Every step is a column that later ones refer to, so no pattern is matched twice.
    """
    glyphs = "".join(GLYPHS)
    number = rf"(?s)^(\d+(?:\.\d+)?(?:\s+\d+/\d+)?|\d+/\d+|[{glyphs}]|\d+[{glyphs}])\s+(.*)$"
    plain = F.regexp_extract(line, number, 1)
    for glyph, (a, b) in GLYPHS.items():
        plain = F.replace(plain, F.lit(glyph), F.lit(f" {a}/{b}"))
    rows = lines.withColumn("__rest", F.regexp_extract(line, number, 2)).withColumn("__amount", F.trim(plain))
    whole = F.regexp_extract("__amount", r"^(\d+)(?![\d/])", 1).try_cast("long")
    rows = rows.withColumns(
        {
            "__whole": F.coalesce(whole, F.lit(0)),
            "__decimals": F.regexp_extract("__amount", r"^\d+\.(\d+)", 1),
            "__top": F.regexp_extract("__amount", r"(\d+)/(\d+)$", 1).try_cast("long"),
            "__bottom": F.regexp_extract("__amount", r"(\d+)/(\d+)$", 2).try_cast("long"),
            "__first": F.regexp_extract("__rest", r"^(\S+)", 1),
        }
    )
    unit = F.lower(F.regexp_replace("__first", r"\.+$", "")).isin(*UNITS)
    rows = rows.withColumns({"__scale": F.pow(F.lit(10), F.length("__decimals")).cast("long"), "__unit": unit})
    base = F.col("__whole") * F.col("__scale") + F.coalesce(F.col("__decimals").try_cast("long"), F.lit(0))
    rows = rows.withColumns(
        {
            "__num": F.when(F.col("__bottom").isNull(), base).otherwise(base * F.col("__bottom") + F.col("__top") * F.col("__scale")),
            "__den": F.col("__scale") * F.coalesce("__bottom", F.lit(1)),
            "__after": F.when(F.col("__unit"), F.regexp_replace("__rest", r"^\S+\s*", "")).otherwise(F.col("__rest")),
        }
    )
    euclid = F.aggregate(  # more steps than two numbers of this size need
        F.sequence(F.lit(1), F.lit(24)),
        F.struct(F.col("__num").alias("a"), F.col("__den").alias("b")),
        lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.nullif(s["b"], F.lit(0))).alias("b"))),
        lambda s: F.greatest(s["a"], F.lit(1)),
    )
    after = F.col("__after")
    compound = (F.trim(after) == "") | after.rlike(rf"(?i)^(?:[\d{glyphs}(/|×–-]|(?:plus|to|or)\b)") | after.rlike(r"\([^)]*\d")
    rows = rows.withColumns({"__divisor": euclid, "__sound": (F.col("__amount") != "") & ~compound & (F.col("__den") != 0)})
    prep = F.trim(F.when(F.contains(after, F.lit(",")), F.substring(after, F.instr(after, ",") + 1, F.lit(1 << 20))))
    held = lambda c: F.when(F.col("__sound"), c)
    return rows.select(
        *lines.columns,
        held((F.col("__num") / F.col("__divisor")).cast("long")).alias("num"),
        held((F.col("__den") / F.col("__divisor")).cast("long")).alias("den"),
        held(F.when(F.col("__unit"), F.col("__first"))).alias("unit"),
        held(F.trim(F.substring_index(after, ",", 1))).alias("name"),
        held(F.when(prep != "", prep)).alias("preparation"),
    )


def authored_uses(links: DataFrame, ranges: DataFrame) -> DataFrame:
    """Adds target_recipe to links(doc, source_recipe, target): the last range that starts at or before the target, if it reaches it.

    An as-of join by union and carry, so there is no range join; links to a recipe's own range are dropped.
    """
    events = ranges.select("doc", F.col("first").alias("at"), F.lit(0).alias("o"), F.struct("recipe", "last").alias("r"), F.lit(None).cast("long").alias("source_recipe"), F.lit(None).cast("long").alias("link"))
    events = events.unionByName(links.select("doc", F.col("target").alias("at"), F.lit(1).alias("o"), F.lit(None).cast(ranges.select(F.struct("recipe", "last").alias("r")).schema["r"].dataType).alias("r"), "source_recipe", "link"))
    order = W.partitionBy("doc").orderBy("at", "o").rowsBetween(W.unboundedPreceding, 0)
    found = events.withColumn("hit", F.last("r", ignorenulls=True).over(order)).where("o = 1")
    target = F.when(F.col("hit.last") >= F.col("at"), F.col("hit.recipe"))
    rows = found.select("link", "doc", "source_recipe", target.alias("target_recipe"))
    return rows.where("target_recipe is null or target_recipe <> source_recipe")


def interpretation_report(entities: DataFrame, editions: DataFrame, kinds: list[str]) -> DataFrame:
    counts = entities.groupBy("edition").pivot("kind", kinds).agg(F.count(F.lit(1)))
    rows = editions.join(counts, "edition", "left")
    note = F.when(F.greatest(*[F.coalesce(k, F.lit(0)) for k in kinds]) > 0, "interpreted").otherwise("native text only")
    return rows.select("edition", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds], note.alias("note"))


def related_records(entities: DataFrame, page: int = 16) -> DataFrame:
    order = W.partitionBy("recipe").orderBy("kind", "ordinal", "id")
    return entities.withColumn("page", F.floor((F.row_number().over(order) - 1) / page)).select("recipe", "id", "kind", "page")


def recipe_packages(recipes: DataFrame, parts: DataFrame) -> DataFrame:
    """A nested row per recipe: parts in order, and linked sources once each."""
    grouped = parts.groupBy("recipe").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("parts"), F.array_sort(F.collect_set("target")).alias("sources"))
    return recipes.join(grouped, "recipe", "left")


def pairings(entities: DataFrame) -> DataFrame:
    """subject, participants, n of assertions(assertion, subject, participant) with two participants or more."""
    sets = entities.groupBy("assertion", "subject").agg(F.array_sort(F.collect_set("participant")).alias("p")).where(F.size("p") >= 2)
    return sets.groupBy("subject", F.array_join("p", "+").alias("participants")).agg(F.count("*").alias("n"))
