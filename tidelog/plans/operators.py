"""Queries of the single operators, over the change feed and over a log made from the table events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import gtid, keys, positions, statements
from tidelog.model import BINLOG_EVENTS, TYPE_CODES, type_name
from tidelog.operators import enrich, filters, ledger, metrics, mutate, route, state, validate
from tidelog.operators.asof import previous_row
from tidelog.plans.feed import TABLE_KEY, order_hint, table, version_order, with_term
from tidelog.schema import ddl, store
from tidelog.session import shared_folder
from tidelog.sources import metadata
from tidelog.sources.log import COLUMNS, SERVER, TABLES, decoded, log_from_events, start_condition
from tidelog.streaming import pipe, sink
from tidelog.streaming.context import packed_context, stream_context, unpacked
from tidelog.streaming.mutations import TableColumns, mutations_of
from tidelog.streaming.sink import wire_records

SUBSCRIBED = ["shop:users", "shop:carts"]
FROM_POSITION, LAST_OFFSET, LAST_TXN = "shop-bin.000003:1004", 3 * 2**32 + 1004, 700
OTHER_SERVER = "3a1c5b9e-0d52-4f0e-8c1a-000000000002"
POOL, IDLE_MEMBER, HISTORY, NOW_MS, DELAY_MS = 4, 3, 5, 1_719_000_000_000, 3_600_000


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return log_from_events(table(spark, sf, "events"))


def _log_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same log as a stream, made of the table's files as they are read."""
    events = table(spark, sf, "events")
    return log_from_events(spark.readStream.schema(events.schema).parquet(f"{sf}/event[s].parquet"))  # a pattern, as the table may be one file


def _mutations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "mutations")


def _image_text(image: str):
    ks = F.array_sort(F.map_keys(image))
    return F.array_join(F.transform(ks, lambda k: F.concat_ws("=", k, F.coalesce(F.try_element_at(image, k), F.lit("")))), ";")


def o02_decoded(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("EXT_WRITE_ROWS", "UPDATE_ROWS", "PRE_GA_DELETE_ROWS", "TABLE_MAP", "XID", "HEARTBEAT", "FORMAT_DESCRIPTION", "ROTATE", "QUERY", "GTID")])
    raw = table(spark, sf, "events").select("event_id", F.get(names, (F.col("event_id") % 10).cast("int")).alias("raw_type"))
    return decoded(raw).groupBy("event_type").agg(F.count("*").alias("n"))


def o03_from_position(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf).filter(start_condition(FROM_POSITION)).select("offset", "event_type", "file_name", "next_position")


def o03_from_gtid(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf).filter(start_condition(f"gtid:{SERVER}:1-{LAST_TXN}")).select("offset", "event_type")


def o13_known_types(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf).filter(filters.known_type()).groupBy("event_type").agg(F.count("*").alias("n"), F.min("offset").alias("first_offset"))


def o14_subscribed(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.table_maps(_log(spark, sf)).filter(filters.subscribed(SUBSCRIBED)).select("offset", "event_type", "resolved_table")


def o15_unpublished(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf).filter(filters.not_published(LAST_OFFSET)).select("offset", "event_type")


def o15_unpublished_gtid(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf).filter(filters.not_published(LAST_OFFSET, f"{SERVER}:1-{LAST_TXN}", OTHER_SERVER)).select("offset", "event_type")


def o15_beyond_states(spark: SparkSession, sf: str) -> DataFrame:
    """Mutations beyond the highest offset that any state of their source has saved, failed ones too."""
    marks = table(spark, sf, "source_states").groupBy("source_id").agg(F.max("last_offset").alias("last_offset"))
    events = _mutations(spark, sf).select("source_id", "delivery_id", F.col("mutation_id").alias("offset"), F.lit("WRITE").alias("event_type"))
    return filters.beyond_mark(events, marks).select("source_id", "delivery_id")


def o16_event_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.event_filter(SUBSCRIBED, LAST_OFFSET)(enrich.table_maps(_log(spark, sf))).select("offset", "event_type")


def o17_statement_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "schema_history").select("schema_id", statements.statement_kind("sql_text").alias("kind"), statements.changes_schema("sql_text").alias("relevant"))


def o18_transaction_marks(spark: SparkSession, sf: str) -> DataFrame:
    marks = _log(spark, sf).filter("event_type in ('QUERY', 'XID')")
    return marks.groupBy("file_no").agg(F.count_if(statements.is_begin("sql")).alias("begins"), F.count_if(~statements.is_begin("sql")).alias("ends"))


def o22_zipped_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _log(spark, sf).filter("event_type = 'WRITE'").select("offset", F.posexplode("rows").alias("row_position", "row"))
    names = F.array(*[F.lit(c) for c in (*COLUMNS, "one_too_many")])
    return rows.withColumn("image", mutate.zip_row(F.col("row.after"), names)).select("offset", "row_position", _image_text("image").alias("image_text"))


def o23_table_maps(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.table_maps(_log(spark, sf)).filter(filters.is_row_event()).select("offset", "table_id", "resolved_table")


def o23_map_refetches(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.map_refetches(_log(spark, sf)).select("file_no", "table_id", "offset")


def o24_table_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Schema columns zipped with one type code fewer than there are columns."""
    rows = table(spark, sf, "schema_history").filter(F.size("column_list") > 0)
    codes = F.transform(F.slice("column_list", F.lit(1), F.size("column_list") - 1), lambda c: F.length(c["col_name"]))
    made = enrich.table_columns(F.transform("column_list", lambda c: c["col_name"]), F.transform("column_list", lambda c: c["primary_key"]), codes)
    text = F.array_join(F.transform(made, lambda c: F.concat_ws(":", c["position"].cast("string"), c["name"], c["type_code"].cast("string"), c["is_pk"].cast("string"))), ",")
    return rows.select("schema_id", text.alias("columns_text"))


def o26_transaction_context(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.transaction_context(_log(spark, sf)).select("offset", F.col("begin_txn.offset").alias("begin_offset"), F.col("last_txn.offset").alias("last_offset"), "current_gtid", F.col("last_txn.gtid").alias("last_gtid"))


def o29_event_header(spark: SparkSession, sf: str) -> DataFrame:
    """Header of the log's mutations: what identifies each and the transaction it belongs to."""
    return _exploded(spark, sf, context=True).select(F.col("offset").alias("mutation_id"), "event_row_position", "op_seq", "op", "timestamp_ms", F.col("begin_txn.position").alias("begin_position"), F.col("last_txn.position").alias("last_position"))


def o30_gtid_canonical(spark: SparkSession, sf: str) -> DataFrame:
    sets = _mutations(spark, sf).select("last_transaction_gtid_set").filter("last_transaction_gtid_set is not null").distinct()
    return sets.select(F.col("last_transaction_gtid_set").alias("written"), gtid.text(gtid.parse("last_transaction_gtid_set")).alias("canonical"))


def o30_gtid_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    """Overlapping intervals of twenty servers, gathered from the table events, collapsed."""
    e = table(spark, sf, "events").select((F.col("event_id") % 20).alias("server"), (3 * F.floor(F.col("event_id") / 20)).alias("s"), (F.col("event_id") % 7).alias("w"), F.floor(F.col("event_id") / 2000).alias("part"))
    lists = e.groupBy("server", "part").agg(F.collect_list(F.struct("s", (F.col("s") + F.col("w")).alias("e"))).alias("i"))
    return lists.select("server", "part", F.explode(gtid.collapse(F.col("i"))).alias("x")).select("server", "part", "x.s", "x.e")


def o30_gtid_contained(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the set of each state lies within that of the source's state saved before it."""
    from pyspark.sql import Window

    states = table(spark, sf, "source_states").withColumn("before", F.lag("gtid_set").over(Window.partitionBy("source_id").orderBy("state_id"))).filter("gtid_set is not null and before is not null")
    return states.select("state_id", gtid.contained(gtid.parse("gtid_set"), gtid.parse("before")).alias("within"))


def o31_positions(spark: SparkSession, sf: str) -> DataFrame:
    m = _mutations(spark, sf)
    name, start, following = positions.file_name("binlog_pos"), positions.position_start("binlog_pos"), positions.position_next("binlog_pos")
    return m.select("delivery_id", name.alias("file_name"), positions.file_number(name).alias("file_no"), start.alias("position"), following.alias("next_position"), positions.position_offset("binlog_pos").alias("log_offset"), positions.position_text(name, start, following).alias("position_text"))


def _exploded(spark: SparkSession, sf: str, context: bool = False) -> DataFrame:
    log = _log(spark, sf)
    log = enrich.transaction_context(log) if context else log
    return mutate.explode_mutations(log.withColumns({"column_names": F.array(*[F.lit(c) for c in COLUMNS]), "pk_names": F.array(F.lit("user_id"))}))


def o32_mutations(spark: SparkSession, sf: str) -> DataFrame:
    return _exploded(spark, sf).select("offset", "event_row_position", "op_seq", "op", _image_text("entity").alias("entity_text"), _image_text("previous_entity").alias("previous_text"))


def o35_changed_columns(spark: SparkSession, sf: str) -> DataFrame:
    return _mutations(spark, sf).select("delivery_id", F.array_join(mutate.changed_columns(F.col("entity"), F.col("previous_entity"), F.col("mutation_type")), ",").alias("changed"))


def o36_pk_text(spark: SparkSession, sf: str) -> DataFrame:
    names = F.transform(F.array_sort(F.transform(F.filter("table_columns", lambda c: c["is_primary_key"]), lambda c: F.struct(c["col_position"], c["col_name"]))), lambda x: x["col_name"])
    return _mutations(spark, sf).select("delivery_id", keys.pk_text(keys.image_values("entity", names)).alias("pk"))


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    key = keys.routing_key("database_name", "table_name", keys.pk_text(keys.image_values("entity", F.array_sort("primary_key"))))
    return _mutations(spark, sf).select("source_id", "delivery_id", "mutation_id", "event_row_position", key.alias("routing_key"))


def o37_routed(spark: SparkSession, sf: str) -> DataFrame:
    # A segment is 16 log files.
    return route.to_pool(_routed(spark, sf), "routing_key", POOL, ["mutation_id", "event_row_position", "delivery_id"], segment=F.shiftright("mutation_id", 36)).select("delivery_id", "routing_key", "member")


def o38_databases(spark: SparkSession, sf: str) -> DataFrame:
    return _mutations(spark, sf).select(keys.database_of(keys.canonical_name("database_name", "table_name")).alias("database_name")).distinct()


def o40_wire_records(spark: SparkSession, sf: str) -> DataFrame:
    records = wire_records(_mutations(spark, sf), "tidelog", F.col("source_id"))
    size = lambda m: F.coalesce(F.reduce(F.map_values(m), F.lit(0), lambda a, v: a + F.coalesce(F.octet_length(v), F.lit(0))), F.lit(0))
    return records.select(
        "topic", "key", "header.id", "header.event_row_position", "header.type", F.array_join("table.primary_key", ",").alias("pk_columns"), F.array_join(F.transform("table.columns", lambda c: c["name"]), ",").alias("column_names"),
        F.col("table.overriding_database").alias("overriding"), size("entity").alias("entity_bytes"), F.col("previous_entity").isNotNull().alias("has_previous"),
    )


def o42_joined(spark: SparkSession, sf: str) -> DataFrame:
    """Three inputs by table, any of which may lack it: deliveries, schema versions, statements about indexes."""
    k = ["source_id", "database_name"]
    a = _mutations(spark, sf).groupBy(*k).agg(F.count("*").alias("deliveries"))
    h = table(spark, sf, "schema_history")
    b = h.filter("table_name is not null").groupBy(*k).agg(F.count("*").alias("versions"))
    c = h.filter("table_name is null").groupBy(*k).agg(F.count("*").alias("markers"))
    return mutate.join_three(a, b, c, k)


def o43_counters(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.counters(_mutations(spark, sf), "publish.success", ["database_name", "table_name", "mutation_type"])


def o44_histograms(spark: SparkSession, sf: str) -> DataFrame:
    lag = F.unix_millis(F.col("delivered_at").cast("timestamp")) - F.col("ts_ms")
    found = metrics.histograms(_mutations(spark, sf).withColumn("lag_ms", lag), "mutation.lag", "lag_ms", ["database_name", "table_name"], exact=True)
    return found.withColumns({c: F.round(c, 3) for c in ("mean", "p50", "p95")})


def o45_lag_gauge(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.lag_gauge(_mutations(spark, sf), NOW_MS, "ts_ms", ["source_id"])


def o48_pool_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    published = route.with_member(_routed(spark, sf), "routing_key", POOL).withColumnRenamed("delivery_id", "offset")
    members = spark.range(POOL).select(F.col("id").cast("int").alias("member"), (F.col("id") != IDLE_MEMBER).alias("active"))
    return route.pool_checkpoint(published, members)


def _judged_history(spark: SparkSession, sf: str) -> DataFrame:
    """schema_history with after: whether a row lies beyond its source's last valid state (null without one)."""
    sources = table(spark, sf, "data_sources")
    marks = with_term(ledger.last_valid_states(table(spark, sf, "source_states")), sources).select("source_id", F.col("term_no").alias("t"), F.col("done_offset").alias("o"))
    rows = version_order(table(spark, sf, "schema_history"), sources).join(marks, "source_id", "left")
    return rows.withColumn("after", (F.col("term_no") > F.col("t")) | ((F.col("term_no") == F.col("t")) & (F.col("change_id") > F.col("o"))))


def o55_schemas_until(spark: SparkSession, sf: str) -> DataFrame:
    found = store.until(_judged_history(spark, sf), F.col("after"), TABLE_KEY, "schema_id", ["source_id"])
    return found.filter(F.size("column_list") > 0).select(*TABLE_KEY, "schema_id")


def o57_compress(spark: SparkSession, sf: str) -> DataFrame:
    return store.rows_to_delete(_judged_history(spark, sf), ~F.col("after"), TABLE_KEY, "table_name", "column_list", "schema_id")


def o58_without_comments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "schema_history").filter("sql_text is not null").select("schema_id", statements.without_comments("sql_text").alias("statement"))


def o60_kept_history(spark: SparkSession, sf: str) -> DataFrame:
    return state.kept_history(table(spark, sf, "source_states"), ["source_id"], "state_id", HISTORY).select("source_id", "state_id", "back")


def o60_kept_history_full(spark: SparkSession, sf: str) -> DataFrame:
    """With the operator's own capacity of 50; o60_kept_history has a small one, so that small tables exceed it."""
    return state.kept_history(table(spark, sf, "source_states"), ["source_id"], "state_id").select("source_id", "state_id", "back")


def o61_fenced(spark: SparkSession, sf: str) -> DataFrame:
    return state.fenced(table(spark, sf, "source_states"), ["source_id"], "leader_epoch", "state_id").select("source_id", "state_id", "leader_epoch")


def o63_accepted_checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    states = table(spark, sf, "source_states").withColumn("server", F.coalesce(positions.canonical_uuid("server_uuid"), F.lit("")))
    return state.accepted_checkpoints(states, ["source_id", "server"], "last_offset", "state_id").select("state_id", "last_offset")


def o64_rollback_targets(spark: SparkSession, sf: str) -> DataFrame:
    return state.rollback_targets(table(spark, sf, "source_states"), ["source_id"], "state_id").select("source_id", "attempt", "state_id")


def o66_event_order(spark: SparkSession, sf: str) -> DataFrame:
    """The log as it would arrive if every sixth event came three places late."""
    i = F.col("event_id")
    arrival = F.when(i % 6 == 0, i * 2 + 7).otherwise(i * 2)
    events = table(spark, sf, "events").select(F.lit("log").alias("source_id"), i.alias("offset"), arrival.alias("arrival"))
    return validate.order_violations(events, "offset", "arrival", ["source_id"], ignore_special=True, piece=1000).select("offset", "previous_offset")


def o67_mutation_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = _mutations(spark, sf).select("source_id", "delivery_id", "mutation_id")
    return validate.mutation_order_violations(rows, "delivery_id", ["source_id"]).select("delivery_id", "mutation_id", "previous_offset")


def o68_schema_violations(spark: SparkSession, sf: str) -> DataFrame:
    bad = validate.schema_violations(_mutations(spark, sf), F.map_keys("entity"), F.transform("table_columns", lambda c: c["col_name"]))
    return bad.select("delivery_id", "source_id", "table_name")


def o75_delayed(spark: SparkSession, sf: str) -> DataFrame:
    return route.delayed(_mutations(spark, sf), NOW_MS, DELAY_MS).select("delivery_id", "ts_ms")


def _rocksdb(spark: SparkSession, run: Callable[[], None]) -> None:
    """Run with the state store that stateful streams need; the session's setting comes back."""
    provider, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)


def o80_streamed_mutations(spark: SparkSession, sf: str) -> DataFrame:
    """The log as a stream through a pipe: context in state, subscribed tables beyond a saved state, mutations into files; then read."""
    folder = shared_folder(spark, "streamed")
    saved = state.SourceState(last_offset=LAST_OFFSET)
    tables = {t: TableColumns(COLUMNS, ("user_id",)) for t in SUBSCRIBED}

    def build(session: SparkSession, _: state.SourceState) -> DataFrame:
        return packed_context(_log_stream(session, sf))

    def transform(context: DataFrame, _: int) -> DataFrame:
        return mutations_of(unpacked(context, spread=True), tables, saved)

    made = transform(build(spark, saved), 0).schema

    def run() -> None:
        p = pipe.Pipe("o80", build, sink.Destination(sink.file_sink(f"{folder}/mutations"), keep=False), f"{folder}/checkpoint", {"availableNow": True}, transform=transform)
        p.open(spark)
        p.query.awaitTermination()
        p.close()

    spark.createDataFrame([], made).write.parquet(f"{folder}/mutations/batch=-1")  # so that there is a table without mutations, too
    _rocksdb(spark, run)
    found = spark.read.schema(made).parquet(f"{folder}/mutations")
    offset = lambda c: F.get_json_object(c, "$.offset").cast("long")
    return found.select("offset", "event_row_position", "op_seq", "op", "database_name", "table_name", "routing_key", offset("begin_txn").alias("begin_offset"), offset("last_txn").alias("last_offset"), _image_text("entity").alias("entity_text"))


def o27_streamed_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The log with statements that rename a column of one table to and fro: names of the columns in force at each row event."""
    folder = shared_folder(spark, "columns")
    log = _log_stream(spark, sf)
    txn = F.shiftright("offset", 32)  # the file's number
    renamed = F.when((txn + F.floor(F.col("position") / 700)) % 2 == 0, "ALTER TABLE shop.users CHANGE event_type kind varchar(20)").otherwise("ALTER TABLE shop.users CHANGE kind event_type varchar(20)")
    log = log.withColumn("sql", F.when(F.col("sql") == "BEGIN", F.col("sql")).otherwise(F.when(F.col("sql").isNotNull(), renamed))).withColumn("gtid", F.lit(None).cast("string"))
    tracker = store.SchemaTracker()
    tracker.bootstrap(ddl.Catalog({"shop": {t.split(":")[1]: [ddl.Column("user_id", "bigint", "bigint", True), ddl.Column("event_type", "varchar", "varchar(20)"), ddl.Column("value", "double", "double")] for t in TABLES}}), ":4:4")
    context = stream_context(log, {"shop-log": tracker.rows}, spread=True).select("offset", "resolved_table", "columns_json").filter("columns_json is not null")

    def run() -> None:
        context.writeStream.format("parquet").option("path", f"{folder}/context").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    _rocksdb(spark, run)
    found = spark.read.schema(context.schema).parquet(f"{folder}/context")
    names = F.transform(F.from_json("columns_json", "array<struct<name:string>>"), lambda c: c["name"])
    return found.select("offset", "resolved_table", F.array_join(names, ",").alias("names"))


def o20_mapped_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Which kinds of events make mutations."""
    return _log(spark, sf).filter(filters.known_type()).groupBy("event_type", mutate.mapped().alias("mapped")).agg(F.count("*").alias("n"))


def o41_typed_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Values of new images by the types of their columns, as bytes and back."""
    m = _mutations(spark, sf)
    code = F.try_element_at(F.map_from_entries(F.transform("table_columns", lambda c: F.struct(c["col_name"], c["col_type"]))), F.col("k")).cast("int")
    values = m.select("delivery_id", "table_columns", F.explode("entity").alias("k", "v")).withColumn("code", code).filter((F.col("code") != 0) | F.col("code").isNull())
    whole = F.coalesce(F.col("code").isin(*mutate.WHOLE_NUMBERS), F.lit(False))
    data = values.withColumn("data", mutate.typed_bytes(F.when(~whole | F.col("v").try_cast("bigint").isNotNull(), F.col("v")), F.coalesce("code", F.lit(253))))
    back = mutate.typed_value(F.col("data"), F.coalesce("code", F.lit(253)))
    return data.groupBy("code").agg(F.count("*").alias("n"), F.count("data").alias("with_data"), F.sum(F.octet_length("data")).alias("n_bytes"), F.count_if(back == F.when(whole, F.col("v").try_cast("bigint").cast("string")).otherwise(F.col("v"))).alias("back"), F.max(F.hex("data")).alias("highest"))


def o06_server_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of tables as read from a server's catalog (made here of the recorded versions), gathered by table in their order."""
    v = table(spark, sf, "schema_history").filter(F.size("column_list") > 0)
    rows = v.select(F.concat_ws("/", "source_id", "database_name", F.col("schema_id").cast("string")).alias("TABLE_SCHEMA"), F.col("table_name").alias("TABLE_NAME"), F.posexplode("column_list").alias("ORDINAL_POSITION", "c"))
    catalog = rows.select("TABLE_SCHEMA", "TABLE_NAME", F.col("c.col_name").alias("COLUMN_NAME"), F.col("c.data_type").alias("DATA_TYPE"), F.col("c.column_type").alias("COLUMN_TYPE"), F.when(F.col("c.primary_key"), "PRI").otherwise("").alias("COLUMN_KEY"), "ORDINAL_POSITION")
    text = F.array_join(F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["column_type"], c["primary_key"].cast("string"))), ",")
    return metadata.table_columns(catalog).select(F.col("database").alias("place"), "table_name", text.alias("columns_text"))


def _version_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Versions with what the table had before (was, at)."""
    rows = version_order(table(spark, sf, "schema_history"), table(spark, sf, "data_sources")).dropna(subset=TABLE_KEY)
    return previous_row(rows, TABLE_KEY, ["term_no", "change_id", "schema_id"], ["column_list", "binlog_file_position"], order_hint(), "was")


def o52_applied_statements(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that statements make of a table's version before: what was then recorded. Statements recorded twice are looked at once."""
    some = _version_pairs(spark, sf).filter((F.size("was.column_list") > 0) & F.col("sql_text").isNotNull() & ~F.col("was.binlog_file_position").eqNullSafe(F.col("binlog_file_position")))
    made = store.applied(some.withColumn("had", F.col("was.column_list")), "sql_text", "database_name", "table_name", "had", "made")
    text = F.array_join(F.array_sort(F.transform("made", lambda c: F.concat_ws(" ", F.lower(c["name"]), F.lower(F.regexp_replace(c["column_type"], r"\s", ""))))), ",")
    return made.select("schema_id", text.alias("columns_text"))


def o53_changed_tables(spark: SparkSession, sf: str) -> DataFrame:
    """What the schemas read up to each source's last valid state must gain to become those at the end of the history."""
    some = lambda df: df.filter(F.size("column_list") > 0)
    judged = _judged_history(spark, sf)
    before = some(store.until(judged, F.col("after"), TABLE_KEY, "schema_id", ["source_id"]))
    after = some(store.until(judged, F.lit(False), TABLE_KEY, "schema_id", ["source_id"]))
    return store.changed_tables(before, after, TABLE_KEY, "column_list").select(*TABLE_KEY, F.size("column_list").alias("n_columns"))


def o54_prefixed(spark: SparkSession, sf: str) -> DataFrame:
    """Statements about tables with the source's name before the database's."""
    rows = table(spark, sf, "schema_history").filter(F.col("sql_text").rlike(r"(?i)^(alter|drop|create)\s+table\s"))
    return rows.select("schema_id", store.prefixed("sql_text", "source_id").alias("statement"))


def o56_stored_schemas(spark: SparkSession, sf: str) -> DataFrame:
    """The history put into a store, then asked by position, by gtid, and after a second append of the same rows."""
    h = table(spark, sf, "schema_history")
    columns = F.transform("column_list", lambda c: F.struct(c["col_name"].alias("name"), c["data_type"].alias("data_type"), c["column_type"].alias("column_type"), c["primary_key"].alias("primary_key")))
    rows = h.select(F.col("schema_id").alias("id"), F.col("database_name").alias("database"), "table_name", F.col("binlog_file_position").alias("position"), "server_uuid", "gtid_set", "gtid", F.col("sql_text").alias("sql"), F.unix_millis(F.col("recorded_at").cast("timestamp")).alias("timestamp_ms"), columns.alias("columns"), F.col("meta_data").alias("metadata"))
    kept = store.SchemaStore(spark, shared_folder(spark, "schemas"))
    kept.append(rows)
    kept.append_new(rows)
    marks = h.agg(F.max("binlog_file_position").alias("p"), F.max("gtid").alias("g")).first()
    found = kept.at(marks.p).select("id", F.lit("position").alias("asked_by")).unionByName(kept.by_gtid(marks.g).select("id", F.lit("gtid").alias("asked_by"))) if marks.p is not None else kept.read().limit(0).select("id", F.lit("").alias("asked_by"))
    return found.unionByName(kept.read().agg(F.count("*").alias("id")).select("id", F.lit("rows").alias("asked_by")))


def o59_initialized(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog that a source's tracker starts with, read up to the source's last valid state; of the first source by name."""
    rows = _judged_history(spark, sf)
    first = rows.agg(F.min("source_id")).first()[0]
    columns = F.transform("column_list", lambda c: F.struct(c["col_name"].alias("name"), c["data_type"].alias("data_type"), c["column_type"].alias("column_type"), c["primary_key"].alias("primary_key")))
    own = rows.filter(F.col("source_id") == F.lit(first)).select(F.col("schema_id").alias("id"), F.col("database_name").alias("database"), "table_name", F.col("binlog_file_position").alias("position"), "server_uuid", "gtid_set", "gtid", F.col("sql_text").alias("sql"), columns.alias("columns"), "after")
    tracker = store.SchemaTracker.initialize(own, F.coalesce(F.col("after"), F.lit(False)), ddl.Catalog(), ":4:4")
    found = [(d, t, len(c)) for d, tables in tracker.current.databases.items() for t, c in tables.items()]
    return spark.createDataFrame(found, "database_name string, table_name string, n_columns int")


def o76_buffered(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries in batches through a buffer of two into files; what arrived, by table."""
    folder = shared_folder(spark, "buffered")
    rows = _mutations(spark, sf).select(F.col("delivery_id").alias("offset"), "ts_ms", "source_id", "table_name")
    rows.limit(0).write.parquet(f"{folder}/out/batch=-1")
    d = sink.build_destination(sink.file_sink(f"{folder}/out"), lambda df: df, buffer_size=2, spark=spark, buffers=f"{folder}/buffer")
    d.open()
    for n in range(4):
        d.send(rows.filter(F.pmod(F.xxhash64("offset"), F.lit(4)) == n), n)
    d.close(3600.0)
    return spark.read.schema(rows.schema).parquet(f"{folder}/out").groupBy("source_id", "table_name").agg(F.count("*").alias("n"), F.max("offset").alias("last_offset"))


def o77_pooled(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries through a pool of members that write on their own; the member that each came to."""
    folder = shared_folder(spark, "pooled")
    rows = _routed(spark, sf).withColumnRenamed("delivery_id", "offset").withColumn("ts_ms", F.lit(0).cast("long"))
    rows.limit(0).write.parquet(f"{folder}/batch=-1")
    d = sink.build_destination(sink.file_sink(folder), lambda df: df, pool_size=POOL)
    d.open()
    d.send(rows, 0)
    d.close()
    found = spark.read.parquet(folder)
    return found.select(F.col("offset").alias("delivery_id"), F.col("batch").cast("int").alias("member"))


def type_names(spark: SparkSession, sf: str) -> DataFrame:
    codes = _mutations(spark, sf).select(F.explode("table_columns").alias("c")).select(F.col("c.col_type").alias("code")).distinct()
    return codes.select("code", type_name("code").alias("type_name"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        o02_decoded, o03_from_position, o03_from_gtid, o13_known_types, o14_subscribed, o15_unpublished, o15_unpublished_gtid, o15_beyond_states, o16_event_filter, o17_statement_kinds, o18_transaction_marks,
        o22_zipped_rows, o23_table_maps, o23_map_refetches, o24_table_columns, o26_transaction_context, o29_event_header, o30_gtid_canonical, o30_gtid_collapsed, o30_gtid_contained, o31_positions,
        o32_mutations, o35_changed_columns, o36_pk_text, o37_routed, o38_databases, o40_wire_records, o42_joined, o43_counters, o44_histograms, o45_lag_gauge, o48_pool_checkpoint,
        o55_schemas_until, o57_compress, o58_without_comments, o60_kept_history, o60_kept_history_full, o61_fenced, o63_accepted_checkpoints, o64_rollback_targets, o66_event_order, o67_mutation_order,
        o68_schema_violations, o75_delayed, o80_streamed_mutations, o27_streamed_columns, o20_mapped_kinds, o41_typed_bytes, o06_server_columns, o52_applied_statements, o53_changed_tables, o54_prefixed,
        o56_stored_schemas, o59_initialized, o76_buffered, o77_pooled, type_names,
    )
}

_LOG = f"""a as (
  select event_id as i, event_id % 7 as in_txn, event_id // 7 as txn, event_id // 500 + 1 as file_no, 4 + (event_id % 500) * 100 as position, event_type as e, user_id as u, floor(value * 100)::bigint::varchar as cents, epoch_us(ts) // 1000 as timestamp_ms from events),
log as (
  select *, file_no * 4294967296 + position as "offset", format('shop-bin.{{:06d}}', file_no) as file_name, position + 100 as next_position,
    case when i % 500 = 0 then 'START' when in_txn = 0 then 'QUERY' when in_txn = 1 then 'TABLE_MAP' when in_txn = 6 then 'XID' when in_txn = 2 and txn % 5 = 0 then 'GTID'
      when e = 'signup' then 'WRITE' when e = 'error' then 'DELETE' else 'UPDATE' end as event_type from a),
mapped as (
  select l.*, case when event_type in ('TABLE_MAP', 'WRITE', 'UPDATE', 'DELETE') then 100 + txn % 3 else 0 end as table_id,
    case when event_type in ('WRITE', 'UPDATE', 'DELETE') then (select k.name from (select max(i) as at from log t where t.event_type = 'TABLE_MAP' and t.file_no = l.file_no and t.i <= l.i and t.txn % 3 = l.txn % 3) x
      join (values (0, 'shop:users'), (1, 'shop:visits'), (2, 'shop:carts')) k(r, name) on x.at is not null and k.r = l.txn % 3) end as resolved_table from log l)"""
_IS_ROW = "event_type in ('WRITE', 'UPDATE', 'DELETE')"
_MARK = """terms as (
  select source_id, term_no, lower(trim(server_uuid)) as u, count(*) over (partition by source_id) as servers from data_sources),
good as (select *, row_number() over (partition by source_id order by leader_epoch desc, state_id desc) as rn from source_states where upper(trim(run_status)) = 'COMMITTED'),
mark as (
  select g.source_id, coalesce(t.term_no, 0) as t, g.last_offset as o from good g left join terms t on t.source_id = g.source_id and (t.servers = 1 or coalesce(t.u, '') = coalesce(lower(trim(g.server_uuid)), '')) where rn = 1),
j as (
  select s.*, coalesce(t.term_no, 0) as term_no, cast(regexp_extract(binlog_file_position, '(\\d+):(\\d+):\\d+$', 1) as bigint) * 4294967296 + cast(regexp_extract(binlog_file_position, '(\\d+):(\\d+):\\d+$', 2) as bigint) as id
  from schema_history s left join terms t on t.source_id = s.source_id and (t.servers = 1 or coalesce(t.u, '') = coalesce(lower(trim(s.server_uuid)), ''))),
judged as (select j.*, m.t is not null and (j.term_no, j.id) > (m.t, m.o) as after, m.t is not null as marked from j left join mark m on m.source_id = j.source_id)"""
_HASH = "list_reduce(list_prepend(0::bigint, list_transform(string_split(k, ''), lambda c: ascii(c)::bigint)), lambda a, x: (a * 31 + x) & 4294967295)"
_KEYED = f"""keyed as (
  select delivery_id, database_name || ':' || table_name || ':' || case when len(primary_key) > 0 then array_to_string(list_transform(list_sort(primary_key), lambda c: coalesce(entity[c], 'null')), '') else 'null' end as k from mutations),
pooled as (select *, {_HASH} as h from keyed),
member as (select delivery_id, k as routing_key, cast(abs((case when h >= 2147483648 then h - 4294967296 else h end) % 4) as integer) as member from pooled)"""
_PARTS = """parts as (
  select id, lower(trim(string_split(p, ':')[1])) as u, unnest(string_split(p, ':')[2:]) as r from (select id, unnest(string_split(replace(replace(g, chr(10), ''), chr(13), ''), ',')) as p from sets)),
ends as (select id, u, trim(string_split(r, '-')[1])::bigint as s, coalesce(trim(string_split(r, '-')[2])::bigint, trim(string_split(r, '-')[1])::bigint) as e from parts),
flagged as (select *, case when s <= max(e) over (partition by id, u order by s, e rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end as new from ends),
islands as (select *, sum(new) over (partition by id, u order by s, e) as n from flagged),
intervals as (select id, u, min(s) as s, max(e) as e from islands group by id, u, n)"""


def _text(m: str) -> str:
    return f"array_to_string(list_transform(list_sort(map_keys({m})), lambda k: k || '=' || coalesce({m}[k], '')), ';')"


_ROW_IMAGES = """r as (
  select "offset", i, event_type, unnest(range(0, (1 + i % 2)::bigint))::integer as event_row_position, timestamp_ms,
    map(['user_id', 'event_type', 'value'], [u::varchar, e, cents]) as fresh, map(['user_id', 'event_type', 'value'], [(case when i % 10 = 0 then u + 1000 else u end)::varchar, 'seen', cents]) as old
  from log where event_type in ('WRITE', 'UPDATE', 'DELETE')),
mut as (
  select *, 1 as op, 1 as op_seq, fresh as entity, null as previous from r where event_type = 'WRITE'
  union all select *, 3, 0, old, null from r where event_type = 'DELETE'
  union all select *, 2, 1, fresh, old from r where event_type = 'UPDATE' and i % 10 <> 0
  union all select *, 3, 0, old, null from r where event_type = 'UPDATE' and i % 10 = 0
  union all select *, 1, 1, fresh, null from r where event_type = 'UPDATE' and i % 10 = 0)"""
_CONTEXT = f"""marks as (
  select *, case when event_type = 'QUERY' and txn % 11 <> 10 then "offset" end as b, case when event_type = 'XID' or (event_type = 'QUERY' and txn % 11 = 10) then "offset" end as x,
    case when event_type = 'GTID' then '{SERVER}:' || txn end as g from log),
named as (select *, last_value(g ignore nulls) over (order by i) as current_gtid from marks),
context as (
  select *, last_value(b ignore nulls) over (order by i) as begin_offset, last_value(x ignore nulls) over (order by i) as last_offset, last_value(case when x is not null then coalesce(current_gtid, '-') end ignore nulls) over (order by i) as lg from named)"""
_POS = "'shop-bin.' || printf('%06d', o >> 32) || ':' || (o & 4294967295) || ':' || ((o & 4294967295) + 100)"

SQL: dict[str, str] = {
    "o02_decoded": """select t as event_type, count(*) as n from (select ['WRITE', 'UPDATE', 'DELETE', 'TABLE_MAP', 'XID', null, 'START', null, 'QUERY', 'GTID'][event_id % 10 + 1] as t from events) where t is not null group by t""",
    "o03_from_position": f"""with {_LOG} select "offset", event_type, file_name, next_position from log where "offset" >= {LAST_OFFSET}""",
    "o03_from_gtid": f"""with {_LOG} select "offset", event_type from log where txn > {LAST_TXN}""",
    "o13_known_types": f"""with {_LOG} select event_type, count(*) as n, min("offset") as first_offset from log group by 1""",
    "o14_subscribed": f"""with {_LOG} select "offset", event_type, case when event_type = 'TABLE_MAP' then ['shop:users', 'shop:visits', 'shop:carts'][txn % 3 + 1] else resolved_table end as resolved_table
from mapped where case when {_IS_ROW} then resolved_table in ('shop:users', 'shop:carts') when event_type = 'TABLE_MAP' then txn % 3 in (0, 2) else true end""",
    "o15_unpublished": f"""with {_LOG} select "offset", event_type from log where not ({_IS_ROW}) or "offset" > {LAST_OFFSET}""",
    "o15_unpublished_gtid": f"""with {_LOG} select "offset", event_type from log where not ({_IS_ROW}) or txn > {LAST_TXN}""",
    "o15_beyond_states": """select source_id, delivery_id from mutations m left join (select source_id, max(last_offset) as o from source_states group by 1) s using (source_id) where o is null or mutation_id > o""",
    "o16_event_filter": f"""with {_LOG} select "offset", event_type from mapped where case when {_IS_ROW} then resolved_table in ('shop:users', 'shop:carts') and "offset" > {LAST_OFFSET} when event_type = 'TABLE_MAP' then txn % 3 in (0, 2) else true end""",
    "o17_statement_kinds": """select schema_id, case when sql_text is null then null when regexp_matches(sql_text, '^(alter|create|drop|rename)\\s+table', 'i') then 'table'
  when regexp_matches(sql_text, '^((create(\\s+(unique|fulltext|spatial))?)|drop)\\s+index', 'i') then 'index' when regexp_matches(sql_text, '^(create|drop)\\s+(database|schema)', 'i') then 'database'
  when regexp_matches(sql_text, '^grant\\s+', 'i') then 'grant' else 'other' end as kind, coalesce(kind in ('table', 'index', 'database'), false) as relevant from schema_history""",
    "o18_transaction_marks": f"""with {_LOG} select file_no, count(*) filter (event_type = 'QUERY' and txn % 11 <> 10) as begins, count(*) filter (not (event_type = 'QUERY' and txn % 11 <> 10)) as ends from log where event_type in ('QUERY', 'XID') group by 1""",
    "o22_zipped_rows": f"""with {_LOG} select "offset", unnest(range(0, (1 + i % 2)::bigint))::integer as row_position, 'event_type=' || e || ';user_id=' || u || ';value=' || cents as image_text from log where event_type = 'WRITE'""",
    "o23_table_maps": f"""with {_LOG} select "offset", table_id, resolved_table from mapped where {_IS_ROW}""",
    "o23_map_refetches": f"""with {_LOG} select file_no, 100 + txn % 3 as table_id, min("offset") as "offset" from log where event_type = 'TABLE_MAP' group by file_no, txn % 3""",
    "o24_table_columns": """select schema_id, array_to_string(list_transform(column_list[1:len(column_list) - 1], lambda c, i: i || ':' || c.col_name || ':' || length(c.col_name) || ':' || c.primary_key), ',') as columns_text from schema_history where len(column_list) > 0""",
    "o26_transaction_context": f"""with {_LOG}, {_CONTEXT} select "offset", begin_offset, last_offset, current_gtid, nullif(lg, '-') as last_gtid from context""",
    "o29_event_header": f"""with {_LOG}, {_ROW_IMAGES}, {_CONTEXT} select m."offset" as mutation_id, event_row_position, op_seq, op, m.timestamp_ms,
  {_POS.replace("o >>", "c.begin_offset >>").replace("(o &", "(c.begin_offset &")} as begin_position, {_POS.replace("o >>", "c.last_offset >>").replace("(o &", "(c.last_offset &")} as last_position from mut m join context c using (i)""",
    "o30_gtid_canonical": f"""with sets as (select distinct last_transaction_gtid_set as id, last_transaction_gtid_set as g from mutations where last_transaction_gtid_set is not null), {_PARTS},
by_server as (select id, u, u || ':' || string_agg(s || '-' || e, ':' order by s) as t from intervals group by id, u) select id as written, string_agg(t, ',' order by u) as canonical from by_server group by id""",
    "o30_gtid_collapsed": """with x as (select event_id % 20 as server, event_id // 2000 as part, 3 * (event_id // 20) as s, 3 * (event_id // 20) + event_id % 7 as e from events),
f as (select *, case when s <= max(e) over (partition by server, part order by s, e rows between unbounded preceding and 1 preceding) + 1 then 0 else 1 end as new from x),
g as (select *, sum(new) over (partition by server, part order by s, e) as n from f) select server, part, min(s) as s, max(e) as e from g group by server, part, n""",
    "o30_gtid_contained": f"""with c as (select state_id, gtid_set, lag(gtid_set) over (partition by source_id order by state_id) as before from source_states),
sets as (select state_id * 2 as id, gtid_set as g from c where gtid_set is not null and before is not null union all select state_id * 2 + 1, before from c where gtid_set is not null and before is not null), {_PARTS}
select c.state_id, not exists (select 1 from intervals a where a.id = c.state_id * 2 and not exists (select 1 from intervals b where b.id = c.state_id * 2 + 1 and b.u = a.u and b.s <= a.s and a.e <= b.e)) as within
from c where gtid_set is not null and before is not null""",
    "o31_positions": """select delivery_id, regexp_extract(binlog_pos, '^(.*):(\\d+):(\\d+)$', 1) as file_name, regexp_extract(binlog_pos, '\\.(\\d+):\\d+:\\d+$', 1)::bigint as file_no,
  regexp_extract(binlog_pos, ':(\\d+):(\\d+)$', 1)::bigint as position, regexp_extract(binlog_pos, ':(\\d+):(\\d+)$', 2)::bigint as next_position, file_no * 4294967296 + position as log_offset,
  file_name || ':' || position || ':' || next_position as position_text from mutations""",
    "o32_mutations": f"""with {_LOG}, {_ROW_IMAGES} select "offset", event_row_position, op_seq, op, {_text("entity")} as entity_text, {_text("previous")} as previous_text from mut""",
    "o35_changed_columns": """select delivery_id, array_to_string(list_sort(case when mutation_type = 2 and previous_entity is not null and entity is not null then
  list_filter(list_distinct(list_concat(map_keys(previous_entity), map_keys(entity))), lambda k: list_contains(map_keys(previous_entity), k) <> list_contains(map_keys(entity), k) or previous_entity[k] is distinct from entity[k])
  else map_keys(coalesce(entity, previous_entity)) end), ',') as changed from mutations""",
    "o36_pk_text": """select delivery_id, case when len(p) > 0 then array_to_string(list_transform(p, lambda n: coalesce(entity[n.n], 'null')), '') end as pk from (
  select delivery_id, entity, list_sort(list_transform(list_filter(table_columns, lambda c: c.is_primary_key), lambda c: {'p': c.col_position, 'n': c.col_name})) as p from mutations)""",
    "o37_routed": f"""with {_KEYED} select * from member""",
    "o38_databases": """select distinct database_name from mutations""",
    "o40_wire_records": """select 'tidelog.' || source_id || '-' || coalesce(nullif(overriding_database, ''), database_name) || '-' || table_name as topic,
  array_to_string(list_concat([database_name, table_name], list_transform(list_sort(primary_key), lambda k: coalesce(entity[k], 'null'))), ':') as key, mutation_id as id, event_row_position, mutation_type as type,
  array_to_string(list_sort(primary_key), ',') as pk_columns, array_to_string(list_sort(list_transform(table_columns, lambda c: c.col_name)), ',') as column_names, nullif(overriding_database, '') as overriding,
  coalesce(list_sum(list_transform(map_values(entity), lambda v: octet_length(encode(v)))), 0)::integer as entity_bytes, mutation_type = 2 and previous_entity is not null as has_previous from mutations""",
    "o42_joined": """select coalesce(a.source_id, b.source_id, c.source_id) as source_id, coalesce(a.database_name, b.database_name, c.database_name) as database_name, deliveries, versions, markers
from (select source_id, database_name, count(*) as deliveries from mutations group by 1, 2) a
full join (select source_id, database_name, count(*) as versions from schema_history where table_name is not null group by 1, 2) b on a.source_id = b.source_id and a.database_name = b.database_name
full join (select source_id, database_name, count(*) as markers from schema_history where table_name is null group by 1, 2) c on coalesce(a.source_id, b.source_id) = c.source_id and coalesce(a.database_name, b.database_name) = c.database_name""",
    "o43_counters": """select case when grouping(table_name) = 1 then 'publish.success.untagged' else 'publish.success' end as metric, database_name, table_name, mutation_type, count(*) as value
from mutations group by grouping sets ((database_name, table_name, mutation_type), ())""",
    "o44_histograms": """select 'mutation.lag' as metric, database_name, table_name, count(*) as n, min(l) as least, max(l) as most, round(avg(l), 3) as mean, round(quantile_cont(l, 0.5), 3) as p50, round(quantile_cont(l, 0.95), 3) as p95
from (select *, epoch_us(delivered_at) // 1000 - ts_ms as l from mutations) group by all""",
    "o45_lag_gauge": f"""select source_id, {NOW_MS} - max(ts_ms) as lag_ms from mutations group by 1""",
    "o48_pool_checkpoint": f"""with {_KEYED}, l as (select member, max(delivery_id) as o from member where member <> 3 group by 1) select case when count(*) = 3 then min(o) end as last_published from l""",
    "o55_schemas_until": f"""with {_MARK}, stop as (select source_id, min(schema_id) as s from judged where after group by 1),
l as (select d.*, row_number() over (partition by d.source_id, database_name, table_name order by schema_id desc) as rn from judged d left join stop using (source_id) where table_name is not null and (s is null or schema_id < s))
select source_id, database_name, table_name, schema_id from l where rn = 1 and len(column_list) > 0""",
    "o57_compress": f"""with {_MARK}, o as (select *, marked and not after as older from judged),
w as (select *, min(case when not older then schema_id end) over (partition by source_id, database_name, table_name) as stop, max(schema_id) over (partition by source_id, database_name, table_name) as last from o where table_name is not null)
select schema_id from o where table_name is null and older union all select schema_id from w where (stop is null or schema_id < stop) and not (schema_id = last and len(column_list) > 0)""",
    "o58_without_comments": """select schema_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(sql_text, '/\\*!(?:\\d{5})?(.*?)\\*/', '\\1', 'g'), '/\\*.*?\\*/', ' ', 'gs'), '[ \\t]+', ' ', 'g'), '^\\s+', '') as statement from schema_history where sql_text is not null""",
    "o60_kept_history": """select source_id, state_id, cast(rn as integer) as back from (select *, row_number() over (partition by source_id order by state_id desc) as rn from source_states) where rn <= 5""",
    "o60_kept_history_full": """select source_id, state_id, cast(rn as integer) as back from (select *, row_number() over (partition by source_id order by state_id desc) as rn from source_states) where rn <= 50""",
    "o61_fenced": """select source_id, state_id, leader_epoch from (select *, row_number() over (partition by source_id order by leader_epoch desc nulls last, state_id desc) as rn from source_states) where rn = 1""",
    "o63_accepted_checkpoints": """select state_id, last_offset from (select *, max(last_offset) over (partition by source_id, coalesce(lower(trim(server_uuid)), '') order by state_id rows between unbounded preceding and 1 preceding) as high from source_states) where high is null or last_offset > high""",
    "o64_rollback_targets": """select source_id, cast(log2(rn + 1) as integer) as attempt, state_id from (select *, row_number() over (partition by source_id order by state_id desc) as rn from source_states) where rn in (1, 3, 7, 15, 31)""",
    "o66_event_order": """select "offset", previous_offset from (select "offset", lag("offset") over (order by arrival) as previous_offset from (select event_id as "offset", case when event_id % 6 = 0 then event_id * 2 + 7 else event_id * 2 end as arrival from events)) where previous_offset > "offset" and "offset" > 0""",
    "o67_mutation_order": """select * from (select delivery_id, mutation_id, lag(mutation_id) over (partition by source_id order by delivery_id) as previous_offset from mutations) where previous_offset > mutation_id""",
    "o68_schema_violations": """select delivery_id, source_id, table_name from mutations where list_sort(map_keys(entity)) <> list_sort(list_transform(table_columns, lambda c: c.col_name))""",
    "o75_delayed": f"""select delivery_id, ts_ms from mutations where ts_ms <= {NOW_MS} - {DELAY_MS}""",
    "o80_streamed_mutations": f"""with {_LOG}, {_ROW_IMAGES}, {_CONTEXT}
select m."offset", event_row_position, op_seq, op, 'shop' as database_name, substr(p.resolved_table, 6) as table_name, p.resolved_table || ':' || entity['user_id'] as routing_key, c.begin_offset, c.last_offset, {_text("entity")} as entity_text
from mut m join context c using (i) join mapped p using (i) where p.resolved_table in ('shop:users', 'shop:carts') and m."offset" > {LAST_OFFSET}""",
    "o20_mapped_kinds": f"""with {_LOG} select event_type, {_IS_ROW} as mapped, count(*) as n from log group by all""",
    "o27_streamed_columns": f"""with {_LOG}, said as (select i, (file_no + position // 700) % 2 = 0 as to_kind, row_number() over (order by i) as k from log where event_type = 'QUERY' and txn % 11 = 10),
-- a rename counts if the column has the name that it renames
kept as (select i, to_kind, lag(to_kind) over (order by i) as before from said), real as (select i, to_kind from kept where to_kind <> coalesce(before, false)),
m as (select l.i, l."offset", l.txn % 3 as r, (select max(t.i) from log t where t.event_type = 'TABLE_MAP' and t.file_no = l.file_no and t.i <= l.i and t.txn % 3 = l.txn % 3) as at from log l where {_IS_ROW})
select "offset", ['shop:users', 'shop:visits', 'shop:carts'][r + 1] as resolved_table,
  case when r = 0 and (select arg_max(to_kind, real.i) from real where real.i < m.at) then 'user_id,kind,value' else 'user_id,event_type,value' end as names from m where m.at is not null""",
    "o41_typed_bytes": """with e as (select delivery_id, unnest(map_keys(entity)) as k, unnest(map_values(entity)) as v, table_columns from mutations),
c as (select v, (list_filter(table_columns, lambda c: c.col_name = k)[1]).col_type::integer as code from e),
w as (select *, coalesce(code in (1, 2, 3, 8, 9, 13, 247, 248), false) as whole, try_cast(v as bigint) as b from c where code is distinct from 0)
select code, count(*) as n, count(case when whole then b::varchar else v end) as with_data, cast(sum(case when whole and b is not null then 8 when not whole then octet_length(encode(v)) end) as bigint) as n_bytes,
  count(case when whole then b::varchar else v end) as back, max(case when whole then upper(case when b < 0 then printf('%016x', b::hugeint + 18446744073709551616::hugeint) else printf('%016x', b) end) else hex(encode(v)) end) as highest from w group by code""",
    "o06_server_columns": """select source_id || '/' || database_name || '/' || schema_id as place, table_name, array_to_string(list_transform(column_list, lambda c: c.col_name || ' ' || c.column_type || ' ' || c.primary_key), ',') as columns_text from schema_history where len(column_list) > 0""",
    "o52_applied_statements": f"""with {_MARK}, p as (select schema_id, sql_text, column_list, binlog_file_position as at, lag(column_list) over w as was, lag(binlog_file_position) over w as was_at
  from j where table_name is not null window w as (partition by source_id, database_name, table_name order by term_no, id, schema_id))
select schema_id, array_to_string(list_sort(list_transform(column_list, lambda c: lower(c.col_name) || ' ' || lower(regexp_replace(c.column_type, '\\s', '', 'g')))), ',') as columns_text from p where len(was) > 0 and sql_text is not null and was_at is distinct from p.at""",
    "o53_changed_tables": f"""with {_MARK}, stop as (select source_id, min(schema_id) as s from judged where after group by 1),
b as (select source_id, database_name, table_name, arg_max(column_list, schema_id) as c from judged d left join stop using (source_id) where table_name is not null and (s is null or schema_id < s) group by 1, 2, 3),
a as (select source_id, database_name, table_name, arg_max(column_list, schema_id) as c from judged where table_name is not null group by 1, 2, 3)
select coalesce(a.source_id, b.source_id) as source_id, coalesce(a.database_name, b.database_name) as database_name, coalesce(a.table_name, b.table_name) as table_name, coalesce(len(a.c), 0)::integer as n_columns
from (select * from a where len(c) > 0) a full join (select * from b where len(c) > 0) b on a.source_id = b.source_id and a.database_name = b.database_name and a.table_name = b.table_name where a.c is distinct from b.c""",
    "o54_prefixed": """select schema_id, regexp_replace(sql_text, '(?i)^(\\w+\\s+table\\s+(?:if\\s+(?:not\\s+)?exists\\s+)?)`?(\\w+)`?\\.`?(\\w+)`?', '\\1`' || source_id || '/\\2`.`\\3`') as statement
from schema_history where regexp_matches(sql_text, '^(alter|drop|create)\\s+table\\s', 'i')""",
    "o56_stored_schemas": """select schema_id as id, 'position' as asked_by from schema_history where binlog_file_position = (select max(binlog_file_position) from schema_history)
union all select schema_id, 'gtid' from schema_history where gtid = (select max(gtid) from schema_history) union all select count(*), 'rows' from schema_history""",
    "o59_initialized": f"""with {_MARK}, d as (select * from judged where source_id = (select min(source_id) from schema_history)), l as (
  select database_name, table_name, arg_max(column_list, schema_id) as c from d where table_name is not null and schema_id < coalesce((select min(schema_id) from d where after), 9223372036854775807) group by 1, 2)
select database_name, table_name, len(c)::integer as n_columns from l where len(c) > 0""",
    "o76_buffered": """select source_id, table_name, count(*) as n, max(delivery_id) as last_offset from mutations group by 1, 2""",
    "o77_pooled": f"""with {_KEYED} select delivery_id, member from member""",
    "type_names": "select distinct c.col_type as code, case c.col_type " + " ".join(f"when {k} then '{n}'" for k, (n, _) in TYPE_CODES.items()) + " else 'UNKNOWN' end as type_name from (select unnest(table_columns) as c from mutations)",
}
