"""Filters that keep whole rows: every column as it came, judged by one of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def keep_rows(docs: DataFrame, column: str, judge: Callable[[list], list[bool]]) -> DataFrame:
    """The rows of ``docs`` whose value of ``column`` passes ``judge`` (values of a batch in, a mark for each out).

    Rows keep all their columns and types, repeats stay repeats, and no row is moved: there is no shuffle and no join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(judge(b.column(b.schema.get_field_index(column)).to_pylist()), type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
