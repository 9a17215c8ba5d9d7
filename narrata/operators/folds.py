"""Folds over the ordered rows of a key that hold a batch of rows at a time, however many the key has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def folded(rows: DataFrame, key: str, order: list[str], values: list[str], made: str, start: tuple, step: Callable) -> DataFrame:
    """key and the columns made: what step gives for a key's rows one after the other.

    step(state, *values) returns the next state and a tuple of made, or None for no row; each key begins with start. Rows are
    dealt by key and sorted in their task, so a key's rows meet one task but are never gathered there. Rows of a null key are
    a key of their own; ties in order come in any order.
    """
    rows = rows.select(key, *dict.fromkeys([*order, *values]))
    schema = StructType([rows.schema[key], *_parse_datatype_string(made).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        current, state = none, start
        for batch in batches:
            out = []
            for k, *row in zip(*(batch.column(c).to_pylist() for c in (key, *values)), strict=True):
                if current is none or k != current:
                    current, state = k, start
                state, one = step(state, *row)
                if one is not None:
                    out.append((k, *one))
            columns = list(zip(*out, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
