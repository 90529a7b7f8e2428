"""Small ordered folds: Spark groups in the JVM, Python sees batches of groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def per_group(rows: DataFrame, keys: list[str], columns: list[str], fold: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """keys and what fold makes of each group's tuples, whose order isn't defined. A group has to be small."""
    packed = rows.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("rows"))
    form = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for *key, items in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                out += [(*key, *x) for x in fold([tuple(i.values()) for i in items])]
            columns = zip(*out) if out else [()] * len(form)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, form)], schema=form)

    return packed.mapInArrow(run, schema)
