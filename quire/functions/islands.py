"""Ordered work on keys of any size: islands between gaps, and running values by chunks.

No step brings the rows of one key together. Windows are over a chunk of a
key, or over one row for each chunk of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Buckets of a gap's width in a chunk.
CHUNK = 4096


def meet(left: DataFrame, right: DataFrame, names: list[str], how: str = "left") -> DataFrame:
    """left with the other columns of right, by names that may be null."""
    other = right.withColumnsRenamed({n: f"__{n}" for n in names})
    on = F.lit(True)
    for name in names:
        on = on & F.col(name).eqNullSafe(F.col(f"__{name}"))
    return left.join(other, on, how).drop(*[f"__{n}" for n in names])


def before(rows: DataFrame, by: list[str], chunk: str, order: list, values: dict[str, Column], fold) -> DataFrame:
    """Adds fold (F.sum, F.max) of each value over a key's rows up to each row; chunk mustn't fall in the order."""
    rows = rows.withColumns({f"__v{name}": value for name, value in values.items()})
    whole = rows.groupBy(*by, chunk).agg(*[fold(f"__v{name}").alias(f"__c{name}") for name in values])
    earlier = W.partitionBy(*by).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    carried = whole.select(*by, chunk, *[fold(f"__c{name}").over(earlier).alias(f"__c{name}") for name in values])
    here = W.partitionBy(*by, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    joined = meet(rows.withColumns({f"__h{name}": fold(f"__v{name}").over(here) for name in values}), carried, [*by, chunk])
    both = lambda h, c: F.coalesce(h, F.lit(0)) + F.coalesce(c, F.lit(0)) if fold is F.sum else F.greatest(h, c)  # noqa: E731  greatest passes over nulls
    out = joined.withColumns({name: both(F.col(f"__h{name}"), F.col(f"__c{name}")) for name in values})
    return out.drop(*[f"__{k}{name}" for k in "vhc" for name in values])


def with_islands(rows: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """Adds island: the `at` (a long) of the first row after which no two neighbours of the key are `gap` or more apart.

    Rows of one bucket of that width are less than a gap apart, so only a
    bucket's first row can start an island, and only the bucket before it decides.
    """
    bucket = lambda c: F.expr(f"(`{c}` - pmod(`{c}`, {gap}L)) div {gap}L")
    placed = rows.withColumn("__bucket", bucket(at))
    ends = placed.groupBy(key, "__bucket").agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    last = ends.select(key, (F.col("__bucket") + 1).alias("__bucket"), F.col("hi").alias("last"))
    found = meet(ends, last, [key, "__bucket"])
    start = F.when(F.col("last").isNull() | (F.col("lo") - F.col("last") >= gap), F.col("lo"))
    found = found.withColumn("__chunk", F.floor(F.col("__bucket") / CHUNK))
    found = before(found, [key], "__chunk", ["__bucket"], {"island": start}, F.max)
    return meet(placed, found.select(key, "__bucket", "island"), [key, "__bucket"]).drop("__bucket")
