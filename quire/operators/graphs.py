"""Closures over links: what is reached from a seed, and bounded work from many roots.

Every round is written to the checkpoint folder, so plans stay short and a
lost executor costs no earlier round. Only counts come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def closure(seed: DataFrame, edges: DataFrame) -> DataFrame:
    """id: the seed(id) and all that is reached from it over edges(src, dst), in rounds that grow with the logarithm of the longest chain.

    After a round that holds everything nearer than n steps, links of exactly n steps
    give everything nearer than 2 n. Such links are made from links of half the
    length while they are no more than four times the edges, as in long chains;
    where they would multiply, distances are short, and rounds go on by the longest that there are.
    Cycles, repeated edges and edges to unknown ids do no harm; null ids reach nothing.
    """
    found = seed.where("id is not null").select("id").distinct().checkpoint()
    links = edges.where("src is not null and dst is not null").select("src", "dst").distinct().checkpoint()
    most = 4 * links.count()
    last, growing = found, True  # what the links start from
    while True:
        new = last.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(found, "id", "left_anti").checkpoint()
        if new.isEmpty():
            return found
        found = found.union(new).checkpoint()
        if growing:
            longer = links.alias("a").join(links.select(F.col("src").alias("mid"), F.col("dst").alias("end")), F.col("dst") == F.col("mid")).select("src", F.col("end").alias("dst")).distinct()
            if longer.limit(most + 1).count() <= most:
                links, last = longer.checkpoint(), found
                continue
            growing = False
        last = new


def dependents(decisions: DataFrame, bindings: DataFrame, target: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """id: approvals that a withdrawal of target(scope, scope_digest, candidate) hits, and all decisions that depend on them.

    Hit are approvals and portion reviews of the scope that are bound to the
    same digest or candidate, or to one of the candidates with the same selection.
    decisions: id, action, scope, scope_digest, candidate. bindings: id depends on decision.
    """
    approvals = decisions.where(F.col("action").isin("approve", "review_portion"))
    scoped = approvals.join(target.select("scope", F.col("scope_digest").alias("digest"), F.col("candidate").alias("own")), "scope")
    hit = scoped.where((F.col("scope_digest") == F.col("digest")) | (F.col("candidate") == F.col("own"))).select("id")
    if candidates is not None:
        alike = target.select("scope").distinct().join(candidates.select("scope", "candidate"), "scope")
        hit = hit.union(approvals.join(alike, ["scope", "candidate"], "left_semi").select("id"))
    return closure(hit, bindings.select(F.col("decision").alias("src"), F.col("id").alias("dst")))


def affected_pages(affected: DataFrame, evidence: DataFrame) -> DataFrame:
    """source, page: the pages that affected decisions rest on, by evidence(id, source, page)."""
    return evidence.join(affected, "id", "left_semi").select("source", "page").distinct()


def on_cycle(links: DataFrame, depth: int) -> DataFrame:
    """src, dst: links on a cycle of at most depth + 1 links.

    A link is on one if its end reaches its start. Nodes that nothing leads to or from are on none;
    they are taken off layer by layer first.
    """
    left = links.select("src", "dst").distinct().checkpoint()
    n = left.count()
    for _ in range(depth):
        inner = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        inner = inner.select("src", "dst").checkpoint()
        m = inner.count()
        left = inner
        if m in (0, n):
            break
        n = m
    loops = left.where("src = dst")
    reach = left.select(F.col("dst").alias("root")).distinct().withColumn("node", F.col("root")).checkpoint()
    new, closing = reach, loops
    for _ in range(depth):
        step = new.join(left, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct().join(reach, ["root", "node"], "left_anti").checkpoint()
        if step.isEmpty():
            break
        reach, new = reach.union(step).checkpoint(), step
    closing = loops.union(left.join(reach, (F.col("dst") == F.col("root")) & (F.col("src") == F.col("node"))).select("src", "dst"))
    return closing.distinct()


def supporting_work(uses: DataFrame, roots: DataFrame, depth: int = 4, limit: int = 30, most_bytes: int = 24_000) -> tuple[DataFrame, DataFrame]:
    """(work, summary): the uses that each root needs, breadth first, within a budget.

    uses: use, src, dst, required (null: unclassified), whole (null: no scope), size (bytes).
    work: root, use, src, dst, depth, n (its number in the root's work), unresolved, cycle.
    summary: root, n_uses, n_unresolved, truncated.

    All uses of a reached recipe are listed by recipe and use, level by level, the first `limit` of a root
    and while their sizes stay within `most_bytes`. A required use of the whole of a known
    recipe leads on, to recipes that the root hasn't met; one without class, scope or target, or
    required of a part, is unresolved. A use is on a cycle if what it leads to
    needs it again within `depth` steps. truncated: the budget left uses out, or the depth did.

    A level holds each (root, recipe) once, so its size is bounded by roots and budget, not by the number of paths.
    """
    uses = uses.select("use", "src", "dst", "required", "whole", F.coalesce("size", F.lit(0)).alias("size")).checkpoint()
    leads = F.coalesce(F.col("required") & F.col("whole") & F.col("dst").isNotNull(), F.lit(False))
    open_ = F.col("required").isNull() | F.col("dst").isNull() | F.col("whole").isNull() | (F.col("required") & ~F.coalesce("whole", F.lit(False)))
    cycles = on_cycle(uses.where(leads).select("src", "dst"), depth)
    roots = roots.where("root is not null").select("root").distinct().checkpoint()
    spent = roots.withColumns({"n": F.lit(0).cast("long"), "bytes": F.lit(0).cast("long"), "over": F.lit(False)})
    met = new = roots.withColumn("node", F.col("root"))
    found = None
    for level in range(1, depth + 2):
        order = W.partitionBy("root").orderBy("src", "use")
        # One more than the budget shows that something was left out.
        step = new.join(spent.where("not over"), "root").join(uses, F.col("node") == F.col("src"))
        step = step.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit + 1).withColumn("at", F.col("bytes") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
        step = step.withColumn("fits", (F.col("n") + F.col("k") <= limit) & (F.col("at") <= most_bytes)).checkpoint()
        listed = step.where("fits").select("root", "use", "src", "dst", F.lit(level).alias("depth"), (F.col("n") + F.col("k")).alias("n"), leads.alias("leads"), F.coalesce(open_, F.lit(True)).alias("unresolved"))
        found = listed if found is None else found.unionByName(listed)
        tally = step.groupBy("root").agg(F.count_if("fits").alias("more"), F.max(F.when(F.col("fits"), F.col("at"))).alias("upto"), F.bool_or(~F.col("fits")).alias("stop"))
        spent = spent.join(tally, "root", "left").select("root", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce("upto", "bytes").alias("bytes"), (F.col("over") | F.coalesce("stop", F.lit(False))).alias("over")).checkpoint()
        new = listed.where("leads").select("root", F.col("dst").alias("node")).distinct().join(met, ["root", "node"], "left_anti").checkpoint()
        if new.isEmpty():
            break
        if level == depth + 1:  # the depth leaves out what these need
            spent = spent.join(new.select("root").distinct().withColumn("deep", F.lit(True)), "root", "left").withColumn("over", F.col("over") | F.coalesce("deep", F.lit(False))).drop("deep").checkpoint()
            break
        met = met.union(new).checkpoint()
    marked = found.join(cycles.withColumn("cycle", F.lit(True)), ["src", "dst"], "left").withColumn("cycle", F.coalesce("cycle", F.lit(False)) & F.col("leads"))
    work = marked.select("root", "use", "src", "dst", "depth", "n", "unresolved", "cycle")
    summary = spent.join(found.groupBy("root").agg(F.count_if("unresolved").alias("n_unresolved")), "root", "left")
    return work, summary.select("root", F.col("n").alias("n_uses"), F.coalesce("n_unresolved", F.lit(0)).alias("n_unresolved"), F.col("over").alias("truncated"))
