"""Small helpers for Arrow-batched stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from brightloom.session import cut_lineage


def per_row(df: DataFrame, columns: list[str], schema: str, row: Callable[..., tuple]) -> DataFrame:
    """One output row for each input row; `row` gets the values of `columns`, `schema` names what it returns."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [row(*values) for values in zip(*(column.to_pylist() for column in batch.columns))]
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*found)))) if found else {name: [] for name in names})

    return df.select(*columns).mapInArrow(run, schema)


def stored(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from the written table."""
    return cut_lineage(df)
