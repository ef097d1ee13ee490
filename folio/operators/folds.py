"""Folds over a key's rows in their order, with a state of a few numbers: for what depends on all that came before and is
neither a window's sum nor an island.

Rows are sorted, by Spark and on disk where they are many, and the state goes from batch to batch; no key's rows are ever
together in memory. A key is one task's work, as the order demands."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame


def ordered_fold(rows: DataFrame, by: list[str], order: list[str], given: list[str], start: Callable[[], object], step: Callable[..., tuple[object, tuple]], made: str) -> DataFrame:
    """rows with the columns `made` (DDL): step(state, *values of `given`) gives the next state and a row's new values; start()
    is a key's first state. Rows alike in order come in any order among themselves."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(made)
    kinds = [to_arrow_type(f.dataType) for f in added.fields]
    names = [f.name for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in by), strict=True)
            values = zip(*(batch.column(c).to_pylist() for c in given), strict=True)
            out = []
            for own, args in zip(keys, values, strict=True):
                if key is None or own != key:
                    key, state = own, start()
                state, row = step(state, *args)
                out.append(row)
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*batch.schema.names, *names])

    schema = StructType([*rows.schema.fields, *added.fields])
    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
