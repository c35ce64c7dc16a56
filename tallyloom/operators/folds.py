"""Recurrences: rows whose value depends on what the row before them came to."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def folded(rows: DataFrame, key: str, order: list[str], begin: Callable[[dict], Any], step: Callable[[Any, dict], tuple[Any, dict | None]], schema: str) -> DataFrame:
    """The rows that step makes of each key's rows in order; step takes and returns the state, begin makes it of the first row.

    Keys are dealt to tasks and sorted there; rows stream through a task once, whatever a key's number of them, and only
    the state is carried from row to row. Time is linear in the rows. The columns of order should tell all rows apart."""
    made_of = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, at, state = False, None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not seen or row[key] != at:
                    seen, at, state = True, row[key], begin(row)
                state, made = step(state, row)
                if made is not None:
                    out.append(made)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=made_of)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
