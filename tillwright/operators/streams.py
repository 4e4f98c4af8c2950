"""Kernels over one receipt at a time, fed from one sorted stream per partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def isolated(run: Callable[[object, list[tuple]], list[tuple]], width: int, with_errors: bool = False) -> Callable[[object, list[tuple]], list[tuple]]:
    """``run`` that doesn't raise: a receipt that fails gives no rows or, where ``with_errors``, one of ``width``
    columns with its id alone, and the error."""

    def safe(key, rows: list[tuple]) -> list[tuple]:
        try:
            return [(*r, None) if with_errors else r for r in run(key, rows)]
        except Exception as e:  # whatever one receipt's data breaks
            return [(key, *[None] * (width - 1), f"{type(e).__name__}: {e}")] if with_errors else []

    return safe


def values(column: pa.Array) -> list:
    """A column as Python values: numbers by way of numpy, and texts made once for each that differs, where none is null."""
    if not column.null_count and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type) or pa.types.is_boolean(column.type)):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not column.null_count and pa.types.is_string(column.type):
        coded = column.dictionary_encode()
        return list(map(coded.dictionary.to_pylist().__getitem__, coded.indices.to_numpy().tolist()))
    return column.to_pylist()


def by_receipt(rows: DataFrame, columns: tuple[str, ...], order: str, run: Callable[[object, list[tuple]], list[tuple]], fields: list[tuple[str, str]], dealt: bool = False) -> DataFrame:
    """``run(receipt_id, rows)`` for each receipt's rows (the other columns), sorted by ``order``; its tuples are
    rows of ``fields`` (name, type). Rows are dealt by receipt once, unless they are ``dealt`` so already; a receipt is
    in memory at a time."""
    arrow = pa.schema([(name, KINDS[kind]) for name, kind in fields])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def packed() -> pa.RecordBatch:
            arrays = [pa.array(c, f.type) for c, f in zip(zip(*out), arrow)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for b in batches:
            receipts, *rest = (values(b.column(i)) for i in range(len(columns)))
            rows, at = list(zip(*rest)), 0
            for i, receipt in enumerate(receipts):
                if receipt != key:
                    held += rows[at:i]
                    if held:
                        out += run(key, held)
                    key, held, at = receipt, [], i
            held += rows[at:]
            if len(out) > 5000:
                yield packed()
        if held:
            out += run(key, held)
        if out:
            yield packed()

    whole = rows.select(*columns) if dealt else rows.select(*columns).repartition("receipt_id")
    return whole.sortWithinPartitions("receipt_id", order).mapInArrow(stream, ", ".join(f"{name} {kind}" for name, kind in fields))
