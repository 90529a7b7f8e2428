"""Rules of a book model: trees of nodes, typed references, states of fields, editions. One row for each thing that breaks a rule.

A tree is checked by counts of a document and windows over a parent and its
children: if a first child follows its parent and each sibling the one before
it, intervals nest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from quire.operators.evidence import _all, _broken

#: States of a field that have a value.
VALUED = ("candidate", "supported")
TREE_RULES = ["places", "roots", "node twice", "interval", "parent", "parent is no element", "outside its parent", "siblings", "parent names another", "child names another"]


def check_trees(nodes: DataFrame) -> DataFrame:
    """rule, key over nodes(doc, id, preorder, subtree_end, parent, ordinal, kind, children).

    A document's places run from 0 without a gap, it has one root, and no id is there twice. An
    element's interval lies in its document and in its parent's, a text is its own; a parent is an
    element of the document that names the child at its ordinal, and names no others. Null
    places break the rules that need them, and so do all children of a parent that is there twice
    break that of siblings.

    Nodes move once, to their document; the rules are windows there, over a document, over a parent with its
    children, and over the places of a parent's children. Then a row for each key moves, with its rules as bits and
    the number of nodes that have it as their id.
    """
    bit = lambda when, rule: F.when(F.coalesce(when, F.lit(True)), F.lit(1 << TREE_RULES.index(rule))).otherwise(F.lit(0))
    doc, places, none = W.partitionBy("doc"), W.partitionBy("doc").orderBy("preorder"), F.lit(None)
    rows = nodes.withColumns({"k": F.row_number().over(places), "again": F.lag("preorder").over(places) == F.col("preorder")})
    rows = rows.withColumns({"n": F.count("*").over(doc), "lo": F.min("preorder").over(doc), "hi": F.max("preorder").over(doc), "own": F.count("preorder").over(doc), "twice": F.count_if("again").over(doc), "roots": F.count_if(F.col("parent").isNull()).over(doc)})
    end = F.when(F.col("kind") == "text", F.col("subtree_end") == F.col("preorder")).otherwise((F.col("preorder") <= F.col("subtree_end")) & (F.col("subtree_end") < F.col("n")))
    uneven = (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("own") - F.col("twice") != F.col("n"))
    # What a document breaks is noted with its first row. Then a row for each node, each child that it names and each child that it is.
    by_doc = F.when(F.col("k") == 1, bit(uneven, "places") + bit(F.col("roots") != 1, "roots")).otherwise(F.lit(0))
    by_node = F.when(F.col("doc").isNotNull(), bit(~end, "interval")).otherwise(F.lit(0))
    entry = lambda t, parent, ordinal, name, whole=F.lit(0), own=F.lit(0): F.struct(
        F.lit(t).alias("t"), parent.cast("string").alias("parent"), ordinal.cast("long").alias("ordinal"), name.cast("string").alias("id"), whole.alias("by_doc"), own.alias("rules")
    )
    node = F.array(entry(0, F.col("id"), none, none, by_doc, by_node))
    named = F.transform(F.coalesce("children", F.array()), lambda c, i: entry(1, F.col("id"), i, c))
    child = F.filter(F.array(entry(2, F.col("parent"), F.col("ordinal"), F.col("id"))), lambda x: x["parent"].isNotNull())
    rows = rows.select("doc", "preorder", "subtree_end", "kind", F.explode(F.concat(node, named, child)).alias("x")).select("doc", "x.*", *[F.when(F.col("x.t") != 1, F.col(c)).alias(c) for c in ("preorder", "subtree_end", "kind")])
    family = W.partitionBy("doc", "parent").orderBy("t", "preorder", "id")
    upto = family.rowsBetween(W.unboundedPreceding, 0)
    up = lambda c: F.when(F.col("t") == 0, F.col(c))
    rows = rows.withColumns({
        "ups": F.count_if(F.col("t") == 0).over(upto), "elements": F.count_if((F.col("t") == 0) & (F.col("kind") == "element")).over(upto),
        "pres": F.count(up("preorder")).over(upto), "up_pre": F.max(up("preorder")).over(upto), "ends": F.count(up("subtree_end")).over(upto), "up_end": F.min(up("subtree_end")).over(upto),
        "last": F.when(F.lag("t").over(family) == 2, F.lag("subtree_end").over(family)),
    })
    place = W.partitionBy("doc", "parent", "ordinal", "id")
    rows = rows.withColumns({"names": F.count_if(F.col("t") == 1).over(place), "children": F.count_if(F.col("t") == 2).over(place)})
    outside = (F.col("pres") < F.col("ups")) | (F.col("ends") < F.col("ups")) | (F.col("preorder") <= F.col("up_pre")) | (F.col("subtree_end") > F.col("up_end"))
    follows = (F.col("ups") == 1) & (F.col("preorder") == F.coalesce("last", "up_pre") + 1)
    met = bit(F.col("elements") < F.col("ups"), "parent is no element") + bit(outside, "outside its parent") + bit(~follows, "siblings") + bit(F.col("names") < F.col("ups"), "parent names another")
    met = F.when(F.col("doc").isNotNull() & (F.col("ups") > 0), met).otherwise(bit(F.lit(True), "parent"))
    unmet = bit((F.col("children") == 0) | F.col("doc").isNull() | F.col("parent").isNull() | F.col("id").isNull(), "child names another")
    key = lambda *c: F.concat_ws(":", *[F.col(x).cast("string") for x in c])
    said = lambda key, rules, count=F.lit(0), nulls=F.lit(0): F.struct(key.alias("key"), rules.alias("rules"), count.alias("count"), nulls.alias("nulls"))
    nulls = F.col("parent").isNull().cast("int")
    says = F.when(F.col("t") == 0, F.array(said(key("parent"), F.col("rules"), 1 - nulls, nulls), said(key("doc"), F.col("by_doc")))).when(F.col("t") == 1, F.array(said(key("parent", "id"), unmet))).otherwise(F.array(said(key("id"), met)))
    says = rows.select(F.explode(says).alias("x")).select("x.*").where("rules > 0 or count > 0 or nulls > 0")
    by_key = says.groupBy("key").agg(F.bit_or("rules").alias("rules"), F.sum("count").alias("count"), F.sum("nulls").alias("nulls"))
    rules = F.col("rules").bitwiseOR(bit((F.col("count") > 1) | (F.col("nulls") > 1), "node twice"))
    broken = F.filter(F.array(*[F.lit(r) for r in TREE_RULES]), lambda r, i: F.getbit(rules, i) == 1)
    return by_key.where(rules > 0).select(F.explode(broken).alias("rule"), "key")


def check_references(references: DataFrame, entities: DataFrame) -> DataFrame:
    """rule, key: references(reference, edition, target, kind) to nothing, to another edition or to another kind of entities(id, edition, kind). A null target is no reference."""
    met = references.where("target is not null").join(entities.select(F.col("id").alias("target"), F.col("edition").alias("there"), F.col("kind").alias("is_kind")), "target", "left")
    there = met.where("there is not null")
    parts = [
        _broken(met, F.col("there").isNull(), "no target", "reference"),
        _broken(there, F.col("there") != F.col("edition"), "target in another edition", "reference"),
        _broken(there, F.col("is_kind") != F.col("kind"), "target of another kind", "reference"),
    ]
    return _all(parts)


def check_fields(fields: DataFrame) -> DataFrame:
    """rule, key over fields(field, state, value, evidence, reason): only a candidate or supported field has a value, it has evidence, and any other has a reason."""
    valued = F.coalesce(F.col("state").isin(*VALUED), F.lit(False))
    parts = [
        _broken(fields, F.col("value").isNotNull() != valued, "value and state", "field"),
        _broken(fields.where(valued), F.coalesce(F.size("evidence"), F.lit(0)) == 0, "no evidence", "field"),
        _broken(fields.where(~valued), F.coalesce(F.trim("reason"), F.lit("")) == "", "no reason", "field"),
    ]
    return _all(parts)


def check_editions(model: DataFrame, published: DataFrame) -> DataFrame:
    """rule, key: editions(edition, source) of the model that the publication lacks, that the model lacks, or whose source differs."""
    both = model.select("edition", F.col("source").alias("ours")).join(published.select("edition", F.col("source").alias("theirs"), F.lit(True).alias("out")), "edition", "full")
    known, out = F.col("ours").isNotNull(), F.coalesce("out", F.lit(False))
    return _all([_broken(both, known & ~out, "not published", "edition"), _broken(both, out & ~known, "not in the model", "edition"), _broken(both.where(known & out), ~F.col("ours").eqNullSafe(F.col("theirs")), "another source", "edition")])
