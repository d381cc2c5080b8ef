"""Log events as a batch table, and a deterministic log made from an events table for tests and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import gtid
from tidelog.functions.positions import log_file_name, offset_of
from tidelog.model import BINLOG_EVENTS

#: Shape of the made log: events of one file, of one transaction, bytes of an event.
FILE_EVENTS, TXN_EVENTS, EVENT_BYTES = 500, 7, 100
SERVER = "3a1c5b9e-0d52-4f0e-8c1a-000000000001"
TABLES = ("shop:users", "shop:visits", "shop:carts")
COLUMNS = ("user_id", "event_type", "value")
TYPE_LIST = (8, 15, 5)


def read_log(spark: SparkSession, path: str, start_offset: int | None = None, kind: str = "parquet") -> DataFrame:
    """A decoded log (schema BINLOG_EVENTS) from Parquet or JSON files, from an offset on.

    offset and file_no are stored columns, so the bound is pushed down to the files; a log partitioned by source_id and
    file_no is pruned.
    """
    log = spark.read.schema(BINLOG_EVENTS).format(kind).load(path)
    return log if start_offset is None else log.filter(F.col("offset") >= start_offset)


def decoded(raw: DataFrame, kind: str = "raw_type") -> DataFrame:
    """Event types of a raw log: families of write, update and delete events, table maps, commits, ids, statements and
    format descriptions (the start of a file). Others are dropped."""
    k = F.upper(kind)
    event = (
        F.when(k.rlike("^(EXT_|PRE_GA_)?WRITE_ROWS"), "WRITE").when(k.rlike("^(EXT_|PRE_GA_)?UPDATE_ROWS"), "UPDATE").when(k.rlike("^(EXT_|PRE_GA_)?DELETE_ROWS"), "DELETE")
        .when(k == "TABLE_MAP", "TABLE_MAP").when(k == "XID", "XID").when(k == "GTID", "GTID").when(k == "QUERY", "QUERY").when(k == "FORMAT_DESCRIPTION", "START")
    )
    return raw.withColumn("event_type", event).filter(F.col("event_type").isNotNull())


def start_condition(starting: str):
    """Predicate for earliest, latest, file:position (its number and place), or gtid:set (what the set does not hold yet).

    Events without GTID set are all kept by the last.
    """
    if starting.startswith("gtid:"):
        return F.coalesce(~gtid.contained(gtid.parse("gtid_set"), gtid.parse(F.lit(starting[5:]))), F.lit(True))
    if starting == "earliest":
        return F.lit(True)
    if starting == "latest":
        return F.lit(False)
    name, position = starting.rsplit(":", 1)
    return F.col("offset") >= offset_of(F.lit(int(name.rpartition(".")[2])), F.lit(int(position)))


def log_from_events(events: DataFrame) -> DataFrame:
    """A log in the shape of BINLOG_EVENTS from the table events (event_id, ts, user_id, event_type, value).

    Every TXN_EVENTS events make a transaction BEGIN, TABLE_MAP, row events, XID; every FILE_EVENTS events fill a file,
    which begins with START. Transactions cross files, so a row event may be without table map.
    """
    i = F.col("event_id")
    in_txn, txn = i % TXN_EVENTS, F.floor(i / TXN_EVENTS)
    row = F.when(F.col("event_type") == "signup", "WRITE").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    kind = F.when(i % FILE_EVENTS == 0, "START").when(in_txn == 0, "QUERY").when(in_txn == 1, "TABLE_MAP").when(in_txn == 6, "XID").when((in_txn == 2) & (txn % 5 == 0), "GTID").otherwise(row)
    names = F.array(*[F.lit(t.partition(":")[2]) for t in TABLES])
    user = F.col("user_id")
    after = F.array(user.cast("string"), F.col("event_type"), F.floor(F.col("value") * 100).cast("string"))
    before = F.array(F.when(i % 10 == 0, user + 1000).otherwise(user).cast("string"), F.lit("seen"), F.floor(F.col("value") * 100).cast("string"))
    image = F.struct(F.when(F.col("_kind") != "WRITE", before).alias("before"), F.when(F.col("_kind") != "DELETE", after).alias("after"))
    file_no, position = F.floor(i / FILE_EVENTS) + 1, 4 + (i % FILE_EVENTS) * EVENT_BYTES
    return events.withColumn("_kind", kind).select(
        F.lit("shop-log").alias("source_id"), F.col("_kind").alias("event_type"),
        F.when(F.col("_kind").isin("TABLE_MAP", "WRITE", "UPDATE", "DELETE"), 100 + txn % 3).otherwise(0).cast("long").alias("table_id"), F.lit(7).cast("long").alias("server_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), log_file_name("shop-bin", file_no).alias("file_name"),
        position.cast("long").alias("position"), (position + EVENT_BYTES).cast("long").alias("next_position"),
        F.concat(F.lit(f"{SERVER}:1-"), txn.cast("string")).alias("gtid_set"), F.lit(SERVER).alias("server_uuid"), file_no.cast("long").alias("file_no"), offset_of(file_no, position).alias("offset"),
        F.when(F.col("_kind").isin("TABLE_MAP", "QUERY"), "shop").alias("database"), F.when(F.col("_kind") == "TABLE_MAP", F.get(names, (txn % 3).cast("int"))).alias("table_name"),
        F.when(F.col("_kind") == "TABLE_MAP", F.lit(list(TYPE_LIST))).alias("column_types"),
        F.when(F.col("_kind") == "QUERY", F.when(txn % 11 == 10, F.lit("ALTER TABLE shop.users ADD INDEX ix (user_id)")).otherwise(F.lit("BEGIN"))).alias("sql"),
        F.when(F.col("_kind") == "XID", txn).alias("xid"), F.when(F.col("_kind") == "GTID", F.concat(F.lit(f"{SERVER}:"), txn.cast("string"))).alias("gtid"),
        F.when(F.col("_kind").isin("WRITE", "UPDATE", "DELETE"), F.array_repeat(image, (1 + i % 2).cast("int"))).alias("rows"),
    )
