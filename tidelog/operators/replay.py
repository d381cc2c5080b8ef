"""Current state of tables from a feed of inserts, updates and deletes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators.skew import OrderPlan, plan_order

INSERT, UPDATE, DELETE = 1, 2, 3


def _differs(c: pa.Array) -> np.ndarray:
    """Where a column's value is not that of the row before (from the second row on); null equals null."""
    x, y = c.slice(0, len(c) - 1), c.slice(1)
    try:
        differs = pc.not_equal(x, y)
    except pa.ArrowNotImplementedError:  # nested types
        return np.fromiter((v != w for v, w in zip(x.to_pylist(), y.to_pylist())), bool, len(x))
    if pa.types.is_floating(c.type):  # as Spark has it, NaN equals NaN
        differs = pc.and_(differs, pc.invert(pc.and_(pc.is_nan(x), pc.is_nan(y))))
    return pc.or_(pc.fill_null(differs, False), pc.xor(x.is_null(), y.is_null())).to_numpy(zero_copy_only=False)


def _merged(images: pa.Array, since: np.ndarray, last: np.ndarray) -> pa.Array:
    """Image of each state: that of its last row if this row resets (or is the only one), else the columns of all rows from since on, later ones first."""
    found = images.take(pa.array(last))
    several = np.flatnonzero(since < last)
    if not len(several):
        return found
    put: list[list] = []
    for first, end in zip(since[several].tolist(), last[several].tolist()):
        image: dict = {}
        for new in images.slice(first, end - first + 1).to_pylist():
            image.update(new or ())
        put.append(list(image.items()))
    at = np.arange(len(found))
    at[several] = len(found) + np.arange(len(several))
    return pa.concat_arrays([found, pa.array(put, images.type)]).take(pa.array(at))


def _states(rows: pa.RecordBatch, n_keys: int, n_order: int) -> pa.RecordBatch:
    """State machine over rows (key..., order..., op, full[, image]) sorted by key and order: one row a key, its state after its last row.

    A state has the form of a change that leads to it, whatever was before: DELETE if the row is gone, INSERT if what came before the key's
    first row no longer matters, else UPDATE. So it can stand before a key's further rows, and states of a key's ranges can be put together in
    the same way. A row whose order is not above the last applied one is skipped.
    """
    n = rows.num_rows
    starts, applied = np.ones(n, bool), np.ones(n, bool)
    starts[1:] = np.logical_or.reduce([_differs(c) for c in rows.columns[:n_keys]])
    applied[1:] = np.logical_or.reduce([starts[1:], *(_differs(c) for c in rows.columns[n_keys : n_keys + n_order])])
    if not applied.all():
        rows, starts = rows.filter(pa.array(applied)), starts[applied]
        n = rows.num_rows
    ops, full = (c.to_numpy(zero_copy_only=False) for c in rows.columns[n_keys + n_order : n_keys + n_order + 2])
    first = np.flatnonzero(starts)
    last = np.append(first[1:], n) - 1
    reset = np.maximum.accumulate(np.where((ops != UPDATE) | full, np.arange(n), -1))[last]  # the last row that resets; before first: none
    state = np.where(ops[last] == DELETE, DELETE, np.where(reset >= first, INSERT, UPDATE))
    out = [c.take(pa.array(last)) for c in rows.columns[: n_keys + n_order]]
    out += [pa.array(state, rows.schema.field(n_keys + n_order).type), pa.array(np.zeros(len(last), bool))]
    out += [_merged(c, np.maximum(reset, first), last) for c in rows.columns[n_keys + n_order + 2 :]]
    return pa.RecordBatch.from_arrays(out, schema=rows.schema)


def _machine(n_keys: int, n_order: int):
    """The state machine over a partition's batches. A batch's last state is carried over, as its key may go on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            states = _states(rows, n_keys, n_order)
            held = states.slice(states.num_rows - 1)
            yield states.slice(0, states.num_rows - 1)
        if held is not None:
            yield held

    return run


def replay(changes: DataFrame, keys: list[str], order: list[str], op: str, image: str | None, hint: Column, full: Column | None = None, plan: OrderPlan | None = None) -> DataFrame:
    """Rows that exist after all changes, with the place of the change that last set each, and their image.

    Method: rows are spread by key (a heavy key by ranges of its order as well, see OrderPlan), sorted by order within
    partitions, and run through a state machine that resets on INSERT, DELETE and full updates, merges the columns of
    partial updates, and skips what is not after the last applied change. Ranges of one key are then composed, one
    piece a range, by the same machine. State is one row at a time beside Spark's batch, so a key of any length needs no more memory.

    changes: keys (any types), order (comparable, ascending; must not be null), op (1 INSERT, 2 UPDATE, 3 DELETE; other
    and null codes are ignored), image (map; null is the empty image; without one, images neither travel nor come out). hint: a double
    that never decreases in order. full: whether an update replaces the row; default: never. Result: keys, order, image. Null keys are keys of
    their own; an UPDATE without INSERT before makes a row of the columns it has; empty input gives no rows; extra
    columns are dropped, so their names cannot clash. Rows of equal order count once (INSERT before UPDATE before DELETE, then the
    first as Spark sorts them).
    """
    ops = changes.filter(F.col(op).isin(INSERT, UPDATE, DELETE))
    plan = plan or plan_order(ops, keys, hint)
    full = F.coalesce(full, F.lit(False)) if full is not None else F.lit(False)
    lean = ops.select(*keys, plan.shard(hint).cast("int").alias("_shard"), *order, F.col(op).cast("int").alias("_op"), full.alias("_full"), *([F.when(F.col(op) != DELETE, F.col(image)).alias("_image")] if image else []))
    by = [*keys, "_shard"]
    pieces = lean.repartition(*by).sortWithinPartitions(*by, *order, "_op").mapInArrow(_machine(len(by), len(order)), lean.schema)
    if any(plan.cuts):  # a shard's piece is final unless its key's slot was cut; the composing step has one piece a range
        pieces = pieces.repartition(*keys).sortWithinPartitions(*by).mapInArrow(_machine(len(keys), 1 + len(order)), lean.schema)
    found = pieces.filter(F.col("_op") != DELETE)
    if not image:
        return found.select(*keys, *order)
    kind = lean.schema["_image"].dataType
    empty = F.map_from_arrays(F.array().cast(T.ArrayType(kind.keyType)), F.array().cast(T.ArrayType(kind.valueType)))
    return found.select(*keys, *order, F.coalesce("_image", empty).alias(image))
