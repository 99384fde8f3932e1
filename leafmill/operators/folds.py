"""Folds along each key's rows in order, with a state that doesn't grow.

Rows are dealt by key and sorted within the partitions, and each partition is walked once, batch by batch: a key's rows follow
each other, so only the state of the key at hand is held, however many rows it has.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from leafmill.sources.shared import in_batches


def folded(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[..., tuple[object, tuple]], schema: str) -> DataFrame:
    """A result for each row of a key in order: step(state, value, value ...), with the row's values in the order of its columns,
    gives the next state and the row's result (in the schema's order)."""
    names = rows.columns
    place = names.index(key)
    out_schema = rows.sparkSession.createDataFrame([], schema).schema
    fields = [f.name for f in out_schema]

    def walk(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(out_schema)
        at, state = object(), None
        for batch in batches:
            found = []
            for values in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if values[place] != at:
                    at, state = values[place], start()
                state, result = step(state, *values)
                found.append(result)
            columns = list(zip(*found, strict=True)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds.field(n).type) for n, c in zip(fields, columns, strict=True)], fields)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(walk, out_schema)


def annotated(rows: DataFrame, keys: list[str], order: list, reads: list[str], start: Callable[[], object], step: Callable[..., tuple[object, tuple]], adds: str, parts: int | None = None) -> DataFrame:
    """Rows with further columns (`adds`) from a walk along each key's rows in order: step(state, value ...) gets the values of
    the columns in `reads` and gives the next state and the row's new values. Only those and the keys become Python's; a key with
    few rows costs no more than its rows do. `parts`: into how many partitions the keys are dealt, else the session's number."""
    dealt = rows.repartition(parts, *keys) if parts else rows.repartition(*keys)
    kinds = rows.sparkSession.createDataFrame([], adds).schema
    out_schema = StructType([*rows.schema.fields, *kinds.fields])

    def walk(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(kinds)
        at, state = None, None
        for batch in batches:
            columns, found = [as_list(batch.column(n)) for n in reads], []
            starts = key_starts(batch, keys)
            for a, z in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                key = key_at(batch, keys, a)
                if key != at:
                    at, state = key, start()
                for values in zip(*(c[a:z] for c in columns), strict=True):
                    state, result = step(state, *values)
                    found.append(result)
            yield widened(batch, found, fields)

    return in_batches(dealt.sortWithinPartitions(*keys, *order), walk, out_schema)


def by_key(rows: DataFrame, keys: list[str], order: list, reads: list[str], each: Callable[..., list[tuple]], adds: str, parts: int | None = None, together: bool = False) -> DataFrame:
    """Rows with further columns (`adds`) that each(list, list ...) makes of the columns in `reads` of all rows of a key, in order.
    It is for keys whose rows are few, as a page's are: one key's numbers are Python's at a time. `together`: a key's rows are in
    one partition as they come, so they aren't dealt again."""
    kinds = rows.sparkSession.createDataFrame([], adds).schema
    out_schema = StructType([*rows.schema.fields, *kinds.fields])

    def walk(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(kinds)
        held, at = [], None

        def made(batch):
            columns, found = [as_list(batch.column(n)) for n in reads], []
            starts = key_starts(batch, keys)
            for a, z in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                found.extend(each(*(c[a:z] for c in columns)))
            return widened(batch, found, fields)

        for batch in batches:
            if not batch.num_rows:
                continue
            if held and key_at(batch, keys, 0) != at:
                yield made(pa.concat_batches(held))
                held = []
            # the last key may go on in the next batch
            last = key_starts(batch, keys)[-1]
            if last:
                yield made(pa.concat_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
            at = key_at(batch, keys, batch.num_rows - 1)
        if held:
            yield made(pa.concat_batches(held))

    dealt = rows if together else rows.repartition(parts, *keys) if parts else rows.repartition(*keys)
    return in_batches(dealt.sortWithinPartitions(*keys, *order), walk, out_schema)


def as_list(column: pa.Array) -> list:
    """A column's values; numbers without nulls by way of numpy, which is faster."""
    fast = column.null_count == 0 and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type))
    return column.to_numpy().tolist() if fast else column.to_pylist()


def key_at(batch: pa.RecordBatch, keys: list[str], row: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in keys)


def key_starts(batch: pa.RecordBatch, keys: list[str]) -> list[int]:
    """At which rows of a sorted batch another key begins, the first row among them; a null is a value like others."""
    if not batch.num_rows:
        return []
    changed = np.zeros(batch.num_rows, dtype=bool)
    changed[0] = True
    for k in keys:
        column = batch.column(k)
        before, after = column.slice(0, batch.num_rows - 1), column.slice(1)
        differ = pc.fill_null(pc.not_equal(before, after), False).to_numpy(zero_copy_only=False)
        changed[1:] |= differ | (pc.is_null(before).to_numpy(zero_copy_only=False) != pc.is_null(after).to_numpy(zero_copy_only=False))
    return np.flatnonzero(changed).tolist()


def widened(batch: pa.RecordBatch, found: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [()] * len(fields)
    new = [pa.array(c, f.type) for f, c in zip(fields, columns, strict=True)]
    return pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *fields.names])
