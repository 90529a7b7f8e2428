"""Empirical-Bayes host reputation for URL filters.

A page with a label is a trial, bad if it is toxic or of low quality. Counts
are summed per host, registered domain and suffix. Each level's bad rate gets
a beta prior from the level above: its mean is the parent's posterior mean,
its strength comes from the spread of the rates under that parent (method of
moments), held between two bounds. A host is blocked if the lower posterior
bound of its bad rate is over `lift` times the rate of all pages: what counts
is being worse than the rest, as the share of bad pages differs between
crawls. Explicit rules on host and path come first. Columns and SQL functions
only; tables of hosts stay distributed, hot hosts and domains are salted.

The bound is a quantile of the beta posterior by its logit, whose mean and
variance are differences and sums of digamma and trigamma functions.

`page_doc` gives the document of a page whose labels count; by default that
of the page's own id. The registered domain is the last label before the
suffix with it; the suffix is the last label, or the last two where the last
two are in `suffixes`, which takes such entries of a public suffix list.
Hosts of one label are their own domain.

Defined results: a null url, or one without "://", has an empty host and path,
fits no rule and is judged as the host "" is; a page without a label counts
nothing; a host without labelled pages has its parent's posterior; several
labels of one page count once each; a null page id keeps its row. An empty
table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, hot_keys, salted_join


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Reputation:
    rules: Sequence[Rule] = ()
    #: Suffixes of two labels, beside every single label.
    suffixes: Sequence[str] = ("co.uk", "org.uk", "com.au", "co.jp")
    #: Standard deviations of the bound below the mean of the posterior's logit; times the rate of all pages that it must pass.
    z: float = 1.0
    lift: float = 1.0
    least_strength: float = 2.0
    most_strength: float = 40.0
    #: Prior of the root: pseudo-counts of bad and good pages.
    root: tuple[float, float] = field(default=(1.0, 4.0))


def with_parts(pages: DataFrame, url_col: str) -> DataFrame:
    """Adds host and path."""
    rest = F.when(F.instr(url_col, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise(F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract("__rest", r"\A([^/?#]*)", 1), upper, lower)
    path = F.regexp_extract("__rest", r"(?s)\A[^/?#]*([^?#]*)", 1)
    return pages.withColumn("__rest", rest).withColumn("host", host).withColumn("path", path).drop("__rest")


def ruled(p: Reputation) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(p.rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == rule.host) | F.endswith("host", F.lit("." + rule.host))) & F.startswith("path", F.lit(rule.path))
        name, verdict = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def _with_parents(hosts: DataFrame, p: Reputation) -> DataFrame:
    two = F.substring_index("host", ".", -2)
    suffix = F.when(two.isin(*p.suffixes), two).otherwise(F.substring_index("host", ".", -1))
    above = F.size(F.split(suffix, r"\.")) + 1
    labels = F.split("host", r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - above + 1, F.lit(1)), above), ".")
    return hosts.withColumn("suffix", suffix).withColumn("domain", domain)


def _posterior(rows: DataFrame, key: str, parent: str | None, prior: DataFrame | None, p: Reputation) -> DataFrame:
    """key, a, b: the beta posterior of each key from bad and n, shrunk to its parent's mean.

    The strength of the prior under a parent is m (1 - m) / v - 1 with the
    rates' variance v between the parent's keys less what sampling explains.
    """
    if prior is None:
        return rows.select(key, (F.col("bad") + p.root[0]).alias("a"), (F.col("n") - F.col("bad") + p.root[1]).alias("b"))
    means = prior.select(F.col(prior.columns[0]).alias(parent), (F.col("a") / (F.col("a") + F.col("b"))).alias("m"))
    hot = hot_keys(rows, [parent])
    joined = salted_join(rows, means, [parent], hot, [key])
    some = F.col("n") > 0
    error = F.sum(F.when(some, F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), 2)).otherwise(0.0))
    keys, trials = F.sum(F.when(some, 1.0).otherwise(0.0)), F.sum(F.col("n").cast("double"))
    spread = joined.groupBy(parent).agg(error.alias("e"), keys.alias("k"), trials.alias("t"), F.first("m").alias("m0"))
    variance = (F.col("e") - F.col("k") * F.col("m0") * (1 - F.col("m0"))) / F.greatest(F.col("t") - F.col("k"), F.lit(1.0))
    strength = F.when(variance > 0, F.col("m0") * (1 - F.col("m0")) / variance - 1).otherwise(F.lit(p.most_strength))
    spread = spread.select(parent, F.least(F.greatest(strength, F.lit(p.least_strength)), F.lit(p.most_strength)).alias("s"))
    full = salted_join(joined, spread, [parent], hot, [key])
    return full.select(key, (F.col("s") * F.col("m") + F.col("bad")).alias("a"), (F.col("s") * (1 - F.col("m")) + F.col("n") - F.col("bad")).alias("b"))


def digamma(x: Column) -> Column:
    y = x + 6
    return F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * F.pow(y, 4)) - 1 / (252 * F.pow(y, 6)) - sum((1 / (x + k) for k in range(1, 6)), 1 / x)


def trigamma(x: Column) -> Column:
    y = x + 6
    return 1 / y + 1 / (2 * y * y) + 1 / (6 * F.pow(y, 3)) - 1 / (30 * F.pow(y, 5)) + 1 / (42 * F.pow(y, 7)) + sum((1 / ((x + k) * (x + k)) for k in range(1, 6)), 1 / (x * x))


def lower_bound(a: Column, b: Column, z: float) -> Column:
    """About the quantile of the beta distribution that lies z deviations below the middle."""
    return 1 / (1 + F.exp(digamma(b) - digamma(a) + z * F.sqrt(trigamma(a) + trigamma(b))))


def host_reputation(
    pages: DataFrame,
    labels: DataFrame,
    params: Reputation = Reputation(),
    id_col: str = "page_id",
    url_col: str = "url",
    label_id: str = "doc_id",
    page_doc: Column | None = None,
    bad: str = "toxic = 1 or quality = 0",
) -> DataFrame:
    """page_id, host, path, rule, verdict, rate, bound: a row per page."""
    p = params
    scratch = Scratch(pages.sparkSession, "reputation")
    rows = with_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), "url").drop("url")
    marks = labels.select(F.col(label_id).alias("doc"), F.coalesce(F.expr(bad), F.lit(False)).cast("long").alias("bad"))
    # Every host once, with the outcomes of its pages.
    trials = rows.select((F.col("page_id") if page_doc is None else page_doc).alias("doc"), "host").join(marks, "doc").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = rows.groupBy("host").agg(F.count("*").alias("pages")).select("host").join(trials, "host", "left").na.fill(0, ["n", "bad"])
    hosts = scratch.settle(_with_parents(hosts, p))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    root = tops.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).select(F.lit(0).alias("root"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"))
    post = scratch.settle(_posterior(root, "root", None, None, p))
    a, b = post.select("a", "b").first()
    post = scratch.settle(_posterior(tops.withColumn("root", F.lit(0)), "suffix", "root", post, p))
    post = scratch.settle(_posterior(domains, "domain", "suffix", post, p))
    post = scratch.settle(_posterior(hosts.select("host", "domain", "n", "bad"), "host", "domain", post, p))
    scores = post.select("host", (F.col("a") / (F.col("a") + F.col("b"))).alias("rate"), lower_bound(F.col("a"), F.col("b"), p.z).alias("bound"))
    name, verdict = ruled(p)
    own = F.when(F.col("bound") > p.lift * (a / (a + b)), F.lit("block")).otherwise(F.lit("allow"))
    return (
        salted_join(rows.withColumn("rule", name).withColumn("by_rule", verdict), scores, ["host"], hot_keys(rows, ["host"]), ["page_id"], "left")
        .select("page_id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), "rate", "bound")
    )
