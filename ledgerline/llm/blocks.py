"""Vectors in blocks: rows packed into binary rows, so that pairs of blocks travel as two rows; and streams in slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: A block as a row: its key, the number of vectors and of dimensions, ids, values, their type and an index of them.
BLOCK = "block long, n int, dims int, ids binary, data binary, kind string, index binary"
SCHEMA = pa.schema(
    [("block", pa.int64()), ("n", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()), ("data", pa.binary()), ("kind", pa.string()), ("index", pa.binary())]
)
#: Types that a block's values may be sent as, smallest first.
KINDS = ("<i2", "<f4", "<f8")

#: Rows of whole groups that are worked on at once.
SLICE = 1 << 16


def usable(vector: str, nonzero: bool) -> Column:
    """Whether a vector has components, all present and finite, and if asked one that is not zero."""
    v = F.col(vector).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad)
    return F.coalesce(ok & F.exists(v, lambda x: x != 0) if nonzero else ok, F.lit(False))


def smallest(values: np.ndarray) -> tuple[bytes, str]:
    """The values in the smallest type that holds them exactly, and which that is."""
    for kind in KINDS:
        with np.errstate(invalid="ignore", over="ignore"):
            held = values.astype(kind)
        if (held == values).all():
            return np.ascontiguousarray(held).tobytes(), kind
    raise ValueError("values are not finite")


def pack(vectors: DataFrame, key: str, change: Callable[[np.ndarray], np.ndarray] | None = None, index: Callable[[np.ndarray], bytes] | None = None) -> DataFrame:
    """``vectors`` (id long, v array<double>, and a key) to one BLOCK row per block.

    ``index`` makes of the values what later tasks would otherwise build once per pair.  The caller's blocks are of bounded size; all vectors of one have one length.
    """

    def one(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        column = table.column("v").combine_chunks()
        values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order]
        values = change(values) if change else values
        made = index(values) if index else None
        data, kind = smallest(values)
        row = [[table.column("block")[0].as_py()], [len(ids)], [values.shape[1]], [ids[order].tobytes()], [data], [kind], [made]]
        return pa.Table.from_arrays([pa.array(x, t.type) for x, t in zip(row, SCHEMA)], schema=SCHEMA)

    return vectors.select("id", "v", F.col(key).cast("long").alias("block")).groupBy("block").applyInArrow(one, BLOCK)


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids and values (as doubles) of a BLOCK row."""
    return np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["data"], dtype=row["kind"]).reshape(row["n"], -1).astype(np.float64)


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str], group: int) -> Iterator[list[np.ndarray]]:
    """Columns of a stream that is sorted by its first ``group`` columns, in slices of whole groups: ``SLICE`` rows, or one group if it has more."""
    held: list[list[np.ndarray]] = []
    rows = 0

    def together() -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*held)]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names])
        rows += batch.num_rows
        if rows >= SLICE:
            columns = together()
            changes = np.zeros(rows - 1, dtype=bool)
            for c in columns[:group]:
                changes |= c[1:] != c[:-1]
            cut = np.flatnonzero(changes)
            if len(cut):
                at = int(cut[-1]) + 1
                yield [c[:at] for c in columns]
                columns = [c[at:] for c in columns]
            held, rows = [columns], len(columns[0])
    if rows:
        yield together()
