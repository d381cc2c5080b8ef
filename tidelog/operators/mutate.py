"""From row events to mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.keys import image_values, pk_text
from tidelog.model import DELETE, EVENT_TYPES, INSERT, ROW_EVENTS, UPDATE


def zip_row(values: Column, names: Column) -> Column:
    """Map of names to values by place, cut to the shorter list. Null if either is null."""
    n = F.least(F.size(values), F.size(names))
    return F.when(values.isNotNull() & names.isNotNull(), F.map_from_arrays(F.slice(names, F.lit(1), n), F.slice(values, F.lit(1), n)))


def pk_changed(before: Column, after: Column, pk_names: Column, by_column: bool = False) -> Column:
    """Whether an update changes the primary key: its text, or with by_column any of its values. False without primary key."""
    a, b = image_values(before, pk_names), image_values(after, pk_names)
    if by_column:
        return (F.size(pk_names) > 0) & F.exists(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda x: x)
    return F.coalesce(~pk_text(a).eqNullSafe(pk_text(b)) & (F.size(pk_names) > 0), F.lit(False))


def mapped(event_type: str = "event_type") -> Column:
    """Whether an event's kind makes mutations; false for the other kinds of a log, an error for kinds that are none."""
    kind = F.col(event_type)
    unknown = F.raise_error(F.concat(F.lit("no mapper for events of kind "), F.coalesce(kind, F.lit("null")))).cast("boolean")
    return F.when(kind.isin(*ROW_EVENTS), True).when(kind.isin(*EVENT_TYPES), False).otherwise(unknown)


def explode_mutations(events: DataFrame, names: str = "column_names", pk_names: str = "pk_names", by_column: bool = False) -> DataFrame:
    """One row a mutation of WRITE, UPDATE and DELETE events: op, event_row_position, op_seq, entity, previous_entity.

    An update that changes the primary key becomes a DELETE of the old and an INSERT of the new image with the same row
    position; op_seq (0, 1) keeps their order. Other known events give nothing, nor does one without rows; an event of a kind that
    no mapper knows is an error (filters.known_type() takes them out beforehand).
    """
    rows = events.filter(mapped()).select("*", F.posexplode("rows").alias("event_row_position", "_row"))
    imaged = rows.withColumns({"_before": zip_row(F.col("_row.before"), F.col(names)), "_after": zip_row(F.col("_row.after"), F.col(names))})
    none = F.lit(None).cast("map<string,string>")

    def one(op: int, seq: int, entity: Column, previous: Column) -> Column:
        return F.struct(F.lit(op).alias("op"), F.lit(seq).alias("op_seq"), entity.alias("entity"), previous.alias("previous_entity"))

    split = F.array(one(DELETE, 0, F.col("_before"), none), one(INSERT, 1, F.col("_after"), none))
    made = (
        F.when(F.col("event_type") == "WRITE", F.array(one(INSERT, 1, F.col("_after"), none)))
        .when(F.col("event_type") == "DELETE", F.array(one(DELETE, 0, F.col("_before"), none)))
        .when(pk_changed(F.col("_before"), F.col("_after"), F.col(pk_names), by_column), split)
        .otherwise(F.array(one(UPDATE, 1, F.col("_after"), F.col("_before"))))
    )
    return imaged.withColumn("_m", F.explode(made)).select(*events.columns, "event_row_position", "_m.op", "_m.op_seq", "_m.entity", "_m.previous_entity")


def changed_columns(entity: Column, previous: Column, op: Column) -> Column:
    """Sorted names of the columns that a mutation changes: all for inserts and deletes; for updates those that one image
    lacks and those whose values differ (null equals null)."""
    every = F.array_union(F.map_keys(previous), F.map_keys(entity))
    differs = lambda k: (F.map_contains_key(previous, k) != F.map_contains_key(entity, k)) | ~F.try_element_at(previous, k).eqNullSafe(F.try_element_at(entity, k))
    return F.array_sort(F.when((op == UPDATE) & previous.isNotNull() & entity.isNotNull(), F.filter(every, differs)).otherwise(F.map_keys(F.coalesce(entity, previous))))


def wire_value(value: Column) -> Column:
    """Bytes of a value on the wire: its UTF-8 text; a missing value is null."""
    return F.encode(value, "UTF-8")


# Type codes of columns that hold whole numbers.
WHOLE_NUMBERS = (1, 2, 3, 8, 9, 13, 247, 248)


def typed_bytes(value: Column, code: Column) -> Column:
    """Bytes of a value by its column's type code: whole numbers as 8 bytes, highest first; all others as their UTF-8 text. Null stays null.

    A text that is no whole number in such a column is an error, as is its way back for other lengths.
    """
    number = F.unhex(F.lpad(F.hex(value.cast("bigint")), 16, "0"))
    return F.when(code.isin(*WHOLE_NUMBERS), number).otherwise(F.encode(value, "UTF-8"))


def typed_value(data: Column, code: Column) -> Column:
    """The value's text, from typed_bytes()."""
    return F.when(code.isin(*WHOLE_NUMBERS), F.conv(F.hex(data), 16, -10)).otherwise(F.decode(data, "UTF-8"))


def wire_image(image: Column) -> Column:
    return F.transform_values(image, lambda _, v: wire_value(v))


def unwire_image(image: Column) -> Column:
    return F.transform_values(image, lambda _, v: F.decode(v, "UTF-8"))


def join_two(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two inputs combined where either may be missing."""
    return left.join(right, keys, "full_outer")


def join_three(a: DataFrame, b: DataFrame, c: DataFrame, keys: list[str]) -> DataFrame:
    return join_two(join_two(a, b, keys), c, keys)
