"""Order-dependent folds over small groups.

The rows of a group come sorted, in Arrow batches; several groups share a task, and a group
may span batches. Groups have to be small: callers cut large keys first (see ``scan``).
"""

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def schema_of(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def fold_groups(df: DataFrame, keys: list[str], order: list[str],
                fold: Callable[[list[dict]], Iterable[tuple]], ddl: str,
                together: bool = False) -> DataFrame:
    """``fold(rows of one group) → result tuples`` for every group, as a DataFrame of ``ddl``.

    ``together``: the rows of a group lie in one task already, as after ``scan.near_strips``.
    """
    schema = to_arrow_schema(schema_of(ddl))

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(col, type=field.type) for col, field in zip(columns, schema)],
            schema=schema)

    def run(batches):
        group, current = [], None
        for batch in batches:
            names = batch.schema.names
            columns = [column.to_pylist() for column in batch.columns]
            marks = zip(*(columns[names.index(k)] for k in keys))
            done = []
            for key, values in zip(marks, zip(*columns)):
                if key != current:
                    if group:
                        done.extend(fold(group))
                    group, current = [], key
                group.append(dict(zip(names, values)))
            if done:
                yield to_batch(done)
        if group:
            rest = list(fold(group))
            if rest:
                yield to_batch(rest)

    placed = df if together else df.repartition(*keys)
    return placed.sortWithinPartitions(*keys, *order).mapInArrow(run, schema_of(ddl))


def fold_stream(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object],
                step: Callable[[object, dict], tuple[object, tuple]], ddl: str) -> DataFrame:
    """One result per row from a state that starts anew with each key; memory stays constant.

    ``step(state, row) → (state, result tuple)``.
    """
    schema = to_arrow_schema(schema_of(ddl))

    def run(batches):
        state, current = None, None
        for batch in batches:
            names = batch.schema.names
            out = []
            for values in zip(*(column.to_pylist() for column in batch.columns)):
                row = dict(zip(names, values))
                key = tuple(row[k] for k in keys)
                if key != current:
                    state, current = start(), key
                state, result = step(state, row)
                out.append(result)
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(col, type=field.type) for col, field in zip(columns, schema)],
                    schema=schema)

    return (df.repartition(*keys).sortWithinPartitions(*keys, *order)
            .mapInArrow(run, schema_of(ddl)))
