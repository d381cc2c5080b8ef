"""Data model: schemas of the log, mutations and schema history; the column type codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INSERT, UPDATE, DELETE, INVALID = 1, 2, 3, 4
MUTATION_TYPES = {INSERT: "INSERT", UPDATE: "UPDATE", DELETE: "DELETE", INVALID: "INVALID"}
EVENT_TYPES = ("TABLE_MAP", "WRITE", "UPDATE", "DELETE", "XID", "QUERY", "START", "GTID")
ROW_EVENTS = ("WRITE", "UPDATE", "DELETE")

BINLOG_EVENTS = """source_id string, event_type string, table_id bigint, server_id bigint, timestamp_ms bigint, file_name string, position bigint,
next_position bigint, gtid_set string, server_uuid string, file_no bigint, offset bigint, database string, table_name string, column_types array<int>,
sql string, xid bigint, gtid string, rows array<struct<before:array<string>,after:array<string>>>"""

#: A log position, as start and end of transactions.
TRANSACTION = "struct<timestamp_ms:bigint,offset:bigint,position:string,gtid:string>"

# Type codes of log columns, their names and the Spark types that hold their values.
TYPE_CODES = {
    0: ("DECIMAL", "decimal"), 1: ("TINY", "tinyint"), 2: ("SHORT", "smallint"), 3: ("LONG", "int"), 4: ("FLOAT", "float"), 5: ("DOUBLE", "double"),
    6: ("NULL", "string"), 7: ("TIMESTAMP", "timestamp"), 8: ("LONGLONG", "bigint"), 9: ("INT24", "int"), 10: ("DATE", "date"),
    11: ("TIME", "interval day to second"), 12: ("DATETIME", "timestamp_ntz"), 13: ("YEAR", "int"), 14: ("NEWDATE", "date"), 15: ("VARCHAR", "string"),
    16: ("BIT", "binary"), 17: ("TIMESTAMP_V2", "timestamp"), 18: ("DATETIME_V2", "timestamp_ntz"), 19: ("TIME_V2", "interval day to second"),
    246: ("NEWDECIMAL", "decimal"), 247: ("ENUM", "int"), 248: ("SET", "bigint"), 249: ("TINY_BLOB", "binary"), 250: ("MEDIUM_BLOB", "binary"),
    251: ("LONG_BLOB", "binary"), 252: ("BLOB", "binary"), 253: ("VAR_STRING", "string"), 254: ("STRING", "string"), 255: ("GEOMETRY", "binary"),
}
UNKNOWN = (-1, "UNKNOWN", "string")
_WIDER = {"tinyint": "smallint", "smallint": "int", "int": "bigint", "bigint": "decimal(20,0)"}


def type_name(code: Column | str) -> Column:
    """Name of a type code; a signed byte counts as its unsigned value; unknown codes and nulls are UNKNOWN."""
    c = (F.col(code) if isinstance(code, str) else code).cast("int").bitwiseAND(F.lit(0xFF))
    table = F.create_map(*[x for k, (name, _) in TYPE_CODES.items() for x in (F.lit(k), F.lit(name))])
    return F.coalesce(F.try_element_at(table, c), F.lit(UNKNOWN[1]))


def mutation_type(code: Column | str) -> Column:
    """A mutation's type code; unknown codes and nulls are INVALID."""
    c = F.col(code) if isinstance(code, str) else code
    return F.when(c.isin(*MUTATION_TYPES), c.cast("int")).otherwise(INVALID)


def spark_type(code: int, raw_type: str = "") -> T.DataType:
    """Spark type for a column: widened one step if unsigned, decimals by their raw type (text beyond 38 digits)."""
    import re

    kind = TYPE_CODES.get(code & 0xFF, UNKNOWN[1:])[1]
    if kind == "decimal":
        found = re.search(r"\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", raw_type)
        precision, scale = (int(found[1]), int(found[2] or 0)) if found else (10, 0)
        return T.DecimalType(precision, scale) if precision <= 38 else T.StringType()
    if "unsigned" in raw_type.lower():
        kind = _WIDER.get(kind, kind)
    return T.DayTimeIntervalType() if kind.startswith("interval") else T._parse_datatype_string(kind)
