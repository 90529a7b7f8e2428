"""Quality rules: fixed rules, then robust multivariate outliers by language and source.

Every document gives a vector of transformed statistics. For each
(language, source) group the minimum-covariance-determinant estimate is
found: from three deterministic starts (medians with fixed scales, Winsorised
and spatial-sign covariances), steps take the closest part of the group, its
mean and covariance, and again, until no determinant falls any more; the
least determinant of all starts wins. The consistency factor of the core and
a chi-square quantile make squared Mahalanobis distances a verdict. Columns
and SQL functions only.

Two things keep small and discrete groups sound, alike at every size. The
covariance is drawn to a diagonal one of pooled robust scales as if `prior`
documents of those scales belonged to the group (a minimum regularised
covariance determinant), and no conditional deviation goes below a statistic's
resolution: many statistics are constant in the core of a group.

The subset of a step is cut at a bin of a fixed logarithmic histogram of the
distances, so a group of any size needs a bounded number of counts, and the
same rows give the same subset however they are partitioned.

Defined results: a null text has no words (so it fails the base rules); a
null language or source is a group of its own; a group without a document
that passes the base rules has null distances; rows that repeat an id are
judged each on its own text; a null id keeps its row; texts of any length are
read whole. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import erf, exp, pi, sqrt

from pyspark.sql import Column, DataFrame, Observation, Window as W, functions as F

from .common import SPACE, Scratch, hot_keys, salted_join


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    #: Most percent of words in repeated 3-word windows.
    repeat_percent: int = 50
    #: Part of a group that the estimate is taken from.
    core: float = 0.75
    #: Documents of the pooled scales that each group has beside its own.
    prior: float = 30.0
    #: A document of a normal group is rejected with this probability.
    tail: float = 1e-6
    #: Steps go on while a log-determinant falls by more than this.
    settled: float = 1e-2


#: The statistics and their resolutions: smaller deviations mean nothing in a text.
FEATURES = {"f1": 0.3, "f2": 0.03, "f3": 0.09, "f4": 0.06, "f5": 0.06}
NAMES = list(FEATURES)
ROOTS = [f"l_{a}_{b}" for i, a in enumerate(NAMES) for b in NAMES[: i + 1]]
STATE = [*[f"m_{a}" for a in NAMES], *ROOTS, "logdet"]


def chi_square(x: float, freedom: int) -> float:
    """Distribution function for an odd number of degrees of freedom."""
    term, total = sqrt(2 * x / pi) * exp(-x / 2), erf(sqrt(x / 2))
    for k in range(1, freedom, 2):
        total -= term
        term *= x / (k + 2)
    return total


def chi_square_quantile(part: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < part else (low, middle)
    return high


def consistency(core: float, freedom: int) -> float:
    """What makes the covariance of the closest part of a normal group that of the whole."""
    return core / chi_square(chi_square_quantile(core, freedom), freedom + 2)


def statistics(docs: DataFrame, text: Column, keep: dict[str, Column]) -> DataFrame:
    """keep's columns and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    names = list(keep)
    base = docs.select(*[c.alias(n) for n, c in keep.items()], F.coalesce(text, F.lit("")).alias("body"))
    words = base.select(
        *names,
        F.filter(F.split("body", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("body", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.regexp_count("body", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    counted = words.select(
        *names,
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))).alias("marks"),
    )
    windows = counted.withColumn("marks", F.slice("marks", 1, F.greatest(F.col("n_words") - 2, F.lit(0)).cast("int")))
    # Windows by hash, then position; only texts that repeat one need the order.
    ordered = windows.withColumn(
        "marks",
        F.when(F.size(F.array_distinct("marks")) < F.size("marks"), F.sort_array(F.transform("marks", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    )
    again = ordered.withColumn(
        "marks",
        F.sort_array(
            F.array_compact(
                F.transform(
                    "marks",
                    lambda m, k: F.when((F.get("marks", k - 1)["h"].eqNullSafe(m["h"])) | (F.get("marks", k + 1)["h"].eqNullSafe(m["h"])), m["i"]),
                )
            )
        ),
    )
    new_words = F.zip_with("marks", F.slice("marks", 2, F.greatest(F.size("marks"), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    covered = F.aggregate(new_words, F.lit(0).cast("long"), lambda s, x: s + x)
    return again.select(*names, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _features() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(1.0 + F.col("n_words")).alias("f1"),
        F.log((F.col("word_chars") + 1) / n).alias("f2"),
        F.sqrt(F.col("n_symbols") / n).alias("f3"),
        (F.col("n_repeat_words") / n).alias("f4"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("f5"),
    ]


def _roots(rows: DataFrame, keep: list[str], floors: dict[str, float]) -> DataFrame:
    """Lower triangular roots and log-determinants of the matrices in columns c_a_b; no pivot is below a statistic's floor."""
    for i, a in enumerate(NAMES):
        for j, b in enumerate(NAMES[: i + 1]):
            value = F.col(f"c_{a}_{b}")
            for k in NAMES[:j]:
                value = value - F.col(f"l_{a}_{k}") * F.col(f"l_{b}_{k}")
            rows = rows.withColumn(f"l_{a}_{b}", F.sqrt(F.greatest(value, F.lit(floors[a] ** 2))) if i == j else value / F.col(f"l_{b}_{b}"))
    logdet = 2 * sum((F.log(F.col(f"l_{a}_{a}")) for a in NAMES[1:]), F.log(F.col("l_f1_f1")))
    return rows.withColumn("logdet", logdet).select(*keep, *STATE)


def _covariances(columns: dict[str, Column]) -> list[Column]:
    return [F.covar_pop(columns[a], columns[b]).alias(f"c_{a}_{b}") for i, a in enumerate(NAMES) for b in NAMES[: i + 1]]


def _drawn(rows: DataFrame, used: Column, factor: float, p: QualityRules) -> DataFrame:
    """Covariances of `used` documents together with those of p.prior documents of scale one."""
    weight = F.lit(p.prior) / (used + p.prior)
    for i, a in enumerate(NAMES):
        for b in NAMES[: i + 1]:
            rows = rows.withColumn(f"c_{a}_{b}", (1 - weight) * factor * F.col(f"c_{a}_{b}") + (weight if a == b else F.lit(0.0)))
    return rows


def _distance(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Squared Mahalanobis distance d2 from the columns STATE on the same row."""
    solved = []
    for i, a in enumerate(NAMES):
        value = F.col(a) - F.col(f"m_{a}")
        for b, y in zip(NAMES[:i], solved):
            value = value - F.col(f"l_{a}_{b}") * F.col(y)
        solved.append(f"y_{a}")
        rows = rows.withColumn(f"y_{a}", value / F.col(f"l_{a}_{a}"))
    return rows.select(*keep, sum((F.col(y) * F.col(y) for y in solved[1:]), F.col(solved[0]) * F.col(solved[0])).alias("d2"))


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(d2 + 1e-6) * 64).cast("int")


MOMENTS = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[: i + 1]]


def _core(scored: DataFrame, by: list[str], part: float) -> DataFrame:
    """used, means m_a and covariances c_a_b of the closest part of each group: up to the smallest bin at or below which that part lies.

    Counts, sums and products are taken by bin, so one pass gives the cut and the moments below it.
    """
    sums = [F.sum(a).alias(f"s_{a}") for a in NAMES] + [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in MOMENTS]
    bins = scored.groupBy(*by, _bin(F.col("d2")).alias("bin")).agg(F.count("*").alias("n"), *sums)
    below, whole = W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*by)
    held = bins.withColumns({"under": F.coalesce(F.sum("n").over(below), F.lit(0)), "all": F.sum("n").over(whole)}).where(F.col("under") < F.col("all") * part)
    total = held.groupBy(*by).agg(F.sum("n").alias("used"), *[F.sum(c).alias(c) for c in bins.columns if c[:2] in ("s_", "p_")])
    mean = lambda a: F.col(f"s_{a}") / F.col("used")
    return total.select(*by, "used", *[mean(a).alias(f"m_{a}") for a in NAMES], *[(F.col(f"p_{a}_{b}") / F.col("used") - mean(a) * mean(b)).alias(f"c_{a}_{b}") for a, b in MOMENTS])


def _starts(z: DataFrame, floors: dict[str, float], p: QualityRules) -> DataFrame:
    """grp, start and STATE: medians with scales of one, Winsorised and spatial-sign covariances; z has medians of zero."""
    length = F.sqrt(sum((F.col(a) * F.col(a) for a in NAMES[1:]), F.col("f1") * F.col("f1")))
    signs = {a: F.when(length > 0, F.col(a) / length).otherwise(0.0) for a in NAMES}
    zeros = {a: F.lit(0.0) for a in NAMES}
    held = F.count("*").alias("used")
    kinds = [zeros, {a: F.tanh(F.col(a)) for a in NAMES}, signs]
    found = [z.groupBy("grp").agg(held, *_covariances(k)).select("*", F.lit(i).alias("start")) for i, k in enumerate(kinds)]
    drawn = _drawn(found[0].unionByName(found[1]).unionByName(found[2]), F.col("used"), 1.0, p)
    for a in NAMES:
        drawn = drawn.withColumn(f"m_{a}", F.lit(0.0))
    return _roots(drawn, ["grp", "start"], floors)


def _robust(z: DataFrame, hot: DataFrame | None, floors: dict[str, float], p: QualityRules, scratch: Scratch) -> DataFrame:
    """grp and STATE of the least determinant that the steps from all starts find."""
    by, factor = ["grp", "start"], consistency(p.core, len(NAMES))
    packed = lambda rows: rows.groupBy("grp").agg(F.collect_list(F.struct("start", *STATE)).alias("states"))  # three of a group
    state = scratch.settle(_starts(z, floors, p).withColumn("best", F.lit(None).cast(f"struct<{', '.join(f'{c}: double' for c in STATE)}>")))
    while True:
        scored = salted_join(z, packed(state), ["grp"], hot, ["f1", "f2"]).select("grp", *NAMES, F.explode("states").alias("s")).select("grp", *NAMES, "s.*")
        scored = _distance(scored, [*by, *NAMES])
        found = _roots(_drawn(_core(scored, by, p.core), F.col("used"), factor, p), by, floors)
        moved = found.join(state.select(*by, "best"), by)
        falls = F.coalesce(F.col("best.logdet") - F.col("logdet"), F.lit(1.0))
        best = F.when(F.col("best").isNull() | (falls > 0), F.struct(*STATE)).otherwise(F.col("best"))
        seen = Observation()
        after = scratch.settle(moved.observe(seen, F.max(falls).alias("fell")).select(*by, *STATE, best.alias("best")))
        scratch.drop(state)
        state = after
        if (seen.get["fell"] or 0) <= p.settled:
            return state.groupBy("grp").agg(F.min_by("best", F.struct("best.logdet", "start")).alias("s")).select("grp", "s.*")


def quality_rules(
    docs: DataFrame,
    params: QualityRules = QualityRules(),
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, distance, base_failed, kept."""
    p = params
    scratch = Scratch(docs.sparkSession, "quality")
    group = F.concat_ws("", F.coalesce(F.concat(F.lit("="), F.col(lang_col)), F.lit("")), F.lit("\x1f"), F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")))
    found = statistics(docs, F.col(text_col), {"doc_id": F.col(id_col), "grp": group})
    failed = (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.repeat_percent * F.col("n_words"))
    rows = scratch.settle(found.select("*", failed.alias("base_failed"), *_features()))

    # Documents that fail the base rules have their verdict; they don't shape the estimates.
    usable = rows.where("not base_failed").select("grp", *NAMES)
    hot = hot_keys(rows, ["grp"])
    middles = scratch.settle(usable.groupBy("grp").agg(*[F.percentile_approx(a, 0.5, 1000).alias(f"c_{a}") for a in NAMES]))
    moved = lambda x: salted_join(x, middles, ["grp"], hot, ["f1", "f2"], "left")
    around = moved(usable).agg(*[F.percentile_approx(F.abs(F.col(a) - F.col(f"c_{a}")), 0.5, 1000).alias(a) for a in NAMES]).first()
    scale = {a: max(1.4826 * (around[a] or 0), FEATURES[a]) for a in NAMES}
    centred = [((F.col(a) - F.col(f"c_{a}")) / scale[a]).alias(a) for a in NAMES]
    z = scratch.settle(moved(usable).select("grp", *centred))
    states = scratch.settle(_robust(z, hot, {a: FEATURES[a] / scale[a] for a in NAMES}, p, scratch))

    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = moved(rows).select(*columns, "base_failed", "grp", *centred)
    scored = _distance(salted_join(judged, states, ["grp"], hot, ["f1", "f2"], "left"), [*columns, "base_failed"])
    scratch.drop(z)
    fits = F.coalesce(F.col("d2") <= chi_square_quantile(1 - p.tail, len(NAMES)), F.lit(False))
    return scored.select(*columns, F.col("d2").alias("distance"), "base_failed", (~F.col("base_failed") & fits).alias("kept"))
