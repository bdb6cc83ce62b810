"""Groups that need their rows in order and together, many small ones at a time.

A grouped map starts anew for each group; where groups are small, that is most of the work. Here a partition is sorted by
its groups and read as one stream, and a group's rows are held only while it is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def fold_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Callable[[list[tuple]], Iterable[tuple]], schema: T.StructType) -> DataFrame:
    """What ``fold`` makes of each group's rows, which are tuples of the columns of ``df`` in the order of ``order``. Null
    keys are groups of their own; an empty table gives an empty table."""
    places = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(target)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

        key, group, out = None, [], []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (now := tuple(row[i] for i in places)) != key:
                    out += fold(group) if group else []
                    key, group = now, []
                group.append(row)
            yield made(out)
            out = []
        yield made([*fold(group)] if group else [])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
