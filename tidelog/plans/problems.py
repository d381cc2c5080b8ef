"""Queries p1 to p7 over the change feed, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.positions import canonical_uuid
from tidelog.operators import asof, dedupe, drift, history, ledger, replay, skew
from tidelog.operators.asof import previous_row
from tidelog.operators.skew import plan_order
from tidelog.plans.feed import DELETE, IDENTITY, INSERT, ORDER, ROW_KEY, TABLE_KEY, UPDATE, full_image, order_hint, pk_value, table, version_order, with_order, with_term
from tidelog.session import shared_folder, small_side

#: A key is heavy from this share of its source's rows.
HEAVY_SHARE = 0.03
HISTORY_TABLE = ("harbor_core", "berth_profile")
HISTORY_COLUMNS = ["berth_status", "fee_cents", "capacity"]


def _ordered(spark: SparkSession, sf: str) -> DataFrame:
    return with_order(table(spark, sf, "mutations"), table(spark, sf, "data_sources"))


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    return _ordered(spark, sf).withColumn("pk_value", pk_value()).filter(F.col("pk_value").isNotNull())


def _current(spark: SparkSession, sf: str) -> DataFrame:
    return replay.replay(_keyed(spark, sf), ROW_KEY, ORDER, "mutation_type", "entity", order_hint(), full_image())


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _current(spark, sf).select(*ROW_KEY, F.col("change_id").alias("mutation_id"), F.col("row_pos").alias("event_row_position"))


def p1_table_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and image columns that live in each table at the end of the feed."""
    return _current(spark, sf).groupBy(*TABLE_KEY).agg(F.count("*").alias("row_count"), F.sum(F.size("entity")).cast("long").alias("value_count"))


def _identified(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "mutations").withColumn("server", F.coalesce(canonical_uuid("server_uuid"), F.lit("")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = _identified(spark, sf).select(*IDENTITY, "delivered_at", "delivery_id", "batch_id")
    return dedupe.repeated_deliveries(rows, IDENTITY, ["delivered_at", "delivery_id"], "delivery_id", "batch_id")[1].select("delivery_id")


def p2_unique(spark: SparkSession, sf: str) -> DataFrame:
    """Exactly one copy of each mutation with all that was delivered; the wide columns travel once."""
    first = dedupe.first_copies(_identified(spark, sf), IDENTITY, ["delivered_at", "delivery_id"])
    return first.select("delivery_id", "source_id", "mutation_id", "event_row_position", "mutation_type", F.size("entity").alias("value_count"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Through a ledger whose items are pieces of the sources' logs, seeded from the states that earlier runs have saved."""
    sources = table(spark, sf, "data_sources")
    states = with_term(table(spark, sf, "source_states"), sources).withColumn("saved_ms", F.unix_millis(F.col("saved_at").cast("timestamp")))
    rows = with_order(_identified(spark, sf), sources).select(*IDENTITY, "term_no", "change_id", "delivered_at", "delivery_id")
    rows = rows.withColumn("item", ledger.item_name("source_id", "term_no", F.shiftright("change_id", 32)))
    items = rows.groupBy("item", "source_id", "term_no").agg(F.min("change_id").alias("low"), F.max("change_id").alias("high"))
    once = lambda df: dedupe.first_copies(df, IDENTITY, ["delivered_at", "delivery_id"])
    return ledger.process_new(spark, rows, once, ["delivery_id"], known=ledger.run_events(states, items), offset="change_id")


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    return version_order(table(spark, sf, "schema_history"), table(spark, sf, "data_sources"))


_VERSION_ORDER = ["term_no", "change_id", "schema_id"]
_LIST_KEY = [*TABLE_KEY, "list_print"]
_NO_COLUMNS = "array<struct<name:string,type:string>>"


def _version_steps(spark: SparkSession, sf: str) -> DataFrame:
    return drift.schema_versions(_versions(spark, sf), TABLE_KEY, _VERSION_ORDER, order_hint())


def _kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded versions with (name, kind) columns, their fingerprint, and a key that lists without a version have, too."""
    kinds = F.coalesce(drift.recorded_kinds(F.col("column_list")), F.array().cast(_NO_COLUMNS))
    rows = _versions(spark, sf).dropna(subset=TABLE_KEY).withColumn("kinds", kinds)
    return rows.withColumns({"list_print": drift.kind_fingerprint(F.col("kinds")), "version_key": F.concat(F.lit("v"), F.col("schema_id").cast("string"))})


def _feed_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Each distinct column list (Table.columns) of a table with its first place in the feed, whether a recorded version has the
    same fingerprint (recorded), and whether it came before the table's first recorded version (early).

    One row a list, kept in a working table, as it is used several times."""
    rows = _ordered(spark, sf).dropna(subset=TABLE_KEY).filter(F.size("table_columns") > 0)
    raw = rows.groupBy(*TABLE_KEY, "table_columns").agg(F.min(F.struct("term_no", "change_id")).alias("at"), F.count("*").alias("n"))  # as delivered: what is worked out is so once a list
    lists = raw.groupBy(*TABLE_KEY, F.array_sort(drift.listed_kinds(F.col("table_columns"))).alias("kinds")).agg(F.min("at").alias("at"), F.sum("n").alias("deliveries"))
    recorded = _kinds(spark, sf).filter(F.size("kinds") > 0)
    first = recorded.groupBy(*TABLE_KEY).agg(F.min(F.struct("term_no", "change_id")).alias("first_at"))
    lists = lists.withColumn("list_print", drift.kind_fingerprint(F.col("kinds"))).join(recorded.select(*_LIST_KEY, F.lit(True).alias("known")).distinct(), _LIST_KEY, "left").join(first, TABLE_KEY, "left")
    early = F.coalesce(F.col("at") < F.col("first_at"), F.lit(True))
    lists = lists.select(*_LIST_KEY, "kinds", "at.*", "deliveries", F.coalesce("known", F.lit(False)).alias("recorded"), early.alias("early"))
    lists.write.parquet(path := shared_folder(spark, "lists"))
    return spark.read.parquet(path)


def _as_versions(lists: DataFrame) -> DataFrame:
    """Column lists without a version of their own in the form of schema_history's rows; schema_id is null."""
    key = F.concat_ws(":", F.lit("l"), *TABLE_KEY, "list_print")
    return lists.filter(~F.col("recorded")).select(*_LIST_KEY, "kinds", "term_no", "change_id", "early", drift.as_recorded(F.col("kinds")).alias("column_list"), key.alias("version_key"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.column_changes(_version_steps(spark, sf), ["schema_id"])


def p4_feed_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Drift seen only in Table.columns: changes to a column list that no recorded version has from the version or list before it, and
    from such lists to the table's first recorded version. Names and kinds count; no statement tells renames here."""
    lists = _as_versions(_feed_lists(spark, sf)).withColumn("listed", F.lit(True))
    rows = _kinds(spark, sf).withColumn("listed", F.lit(False)).unionByName(lists, allowMissingColumns=True)
    rows = previous_row(rows.select(*TABLE_KEY, "term_no", "change_id", "schema_id", "version_key", "kinds", "listed", "early"), TABLE_KEY, ["term_no", "change_id", "schema_id", "version_key"], ["kinds", "listed", "early"], order_hint(), "before")
    seen = F.col("listed") | (F.col("before.listed") & F.col("before.early"))
    steps = drift.migration_steps(F.col("before.kinds"), F.col("kinds"), F.array().cast("array<struct<old:string,new:string>>"))
    changed = rows.filter(seen & (F.size("kinds") > 0) & (F.size("before.kinds") > 0)).withColumn("steps", steps)
    return drift.column_changes(changed, [*TABLE_KEY, "term_no", "change_id", "schema_id"])


def p4_unified(spark: SparkSession, sf: str) -> DataFrame:
    """Every delivery's image in its table's one schema, with every column of it: routed by a version through all later renames and casts.

    The version is the one in force if it lists the image's columns. Else (none is recorded yet, or the image is of another
    one) it is the one with the fingerprint of the delivery's own Table.columns, else the table's first. Lists of before the
    first version that no version has are versions, too (schema_id null). Absent columns have the default stated when they were
    added later, else null (\\N).

    Versions are control data: what can be worked out of them is, once a version, and put beside the images by joins that broadcast
    it if a count proves it small. Images are not shuffled then."""
    lists = _feed_lists(spark, sf)
    kinds = _kinds(spark, sf)  # looked at several times: control data, kept in a working table
    kinds.write.parquet(at := shared_folder(spark, "kinds"))
    kinds = spark.read.parquet(at)
    history = kinds.unionByName(_as_versions(lists).filter("early").drop("early"), allowMissingColumns=True)
    order = [*_VERSION_ORDER, "version_key"]
    path = shared_folder(spark, "drift")
    drift.schema_versions(history, TABLE_KEY, order, order_hint()).drop("renames", "fingerprint", "column_list").write.parquet(f"{path}/versions")
    versions = spark.read.parquet(f"{path}/versions")
    routes = drift.unified_columns(drift.lineage(versions, TABLE_KEY, order, "version_key"), versions, TABLE_KEY, order, "version_key", "sql_text")

    # Of each table: its versions by place (the lowest id of a place), by fingerprint, the first one, and names that only the feed has.
    names = F.transform("kinds", lambda c: c["name"])
    version = F.struct("version_key", "schema_id", names.alias("names"))
    place = F.struct("term_no", "change_id", version.alias("version"))
    some = history.filter(F.size("kinds") > 0)
    by_place = kinds.groupBy(*TABLE_KEY, "term_no", "change_id").agg(F.min_by(version, "schema_id").alias("version")).groupBy(*TABLE_KEY).agg(F.array_sort(F.collect_list(F.struct("term_no", "change_id", "version"))).alias("places"))
    by_list = some.groupBy(*_LIST_KEY).agg(F.array_sort(F.collect_list(place)).alias("same")).groupBy(*TABLE_KEY).agg(F.map_from_entries(F.collect_list(F.struct("list_print", "same"))).alias("by_list"))
    first = some.groupBy(*TABLE_KEY).agg(F.min_by(version, F.struct(F.col("schema_id").isNull(), "term_no", "change_id", "schema_id", "version_key")).alias("first"))
    named = F.array_distinct(F.flatten(F.collect_list(names)))
    extra = lists.groupBy(*TABLE_KEY).agg(named.alias("seen")).join(history.groupBy(*TABLE_KEY).agg(named.alias("known")), TABLE_KEY, "full_outer")
    extra = extra.select(*TABLE_KEY, F.array_sort(F.array_except(F.coalesce("seen", F.array().cast("array<string>")), F.coalesce("known", F.array().cast("array<string>")))).alias("extra"))
    tables = extra.join(by_place, TABLE_KEY, "left").join(by_list, TABLE_KEY, "left").join(first, TABLE_KEY, "left")
    plans = routes.join(extra, TABLE_KEY).select("version_key", drift.column_plan(F.col("route"), F.col("target"), F.col("extra")).alias("plan"))
    tables.select(*TABLE_KEY, "places", "by_list", "first", drift.extra_plan(F.col("extra")).alias("unknown")).write.parquet(f"{path}/tables")
    plans.write.parquet(f"{path}/plans")
    rows = _ordered(spark, sf).select("delivery_id", *TABLE_KEY, "entity", "table_columns", "term_no", "change_id")
    rows = rows.join(small_side(spark.read.parquet(f"{path}/tables")), TABLE_KEY, "left")
    before = lambda places: F.try_element_at(F.filter(places, lambda v: F.struct(v["term_no"], v["change_id"]) <= F.struct("term_no", "change_id")), F.lit(-1))["version"]
    force = before(F.col("places"))
    same = F.try_element_at("by_list", drift.kind_fingerprint(F.array_sort(drift.listed_kinds(F.col("table_columns")))))
    listed = F.coalesce(before(same), F.get(same, F.lit(0))["version"])
    fits = lambda v: F.when(F.coalesce(F.forall(F.map_keys("entity"), lambda k: F.array_contains(v["names"], F.lower(k))), F.lit(True)), v)
    rows = rows.withColumn("force", force).withColumn("force", F.when(F.size("force.names") > 0, F.col("force")))
    rows = rows.withColumn("chosen", F.coalesce(fits(F.col("force")), fits(listed), fits(F.col("first")), "force", listed, "first"))
    lean = rows.select("delivery_id", *TABLE_KEY, "entity", "unknown", F.col("chosen.schema_id").alias("schema_id"), F.col("chosen.version_key").alias("version_key"))
    routed = lean.join(small_side(spark.read.parquet(f"{path}/plans")), "version_key", "left")
    routed = drift.planned_rows(routed.withColumn("_planned", F.coalesce("plan", "unknown")), "entity", "_planned", "unified")
    text = F.array_join(F.transform("unified", lambda c: F.concat_ws("=", c["name"], F.coalesce(c["value"], F.lit("\\N")))), ";")
    return routed.select("delivery_id", *TABLE_KEY, "schema_id", text.alias("unified_row"))


def _in_force(spark: SparkSession, sf: str, columns: list[str]) -> DataFrame:
    rows = _ordered(spark, sf).select(*columns, *TABLE_KEY, "term_no", "change_id")
    versions = _versions(spark, sf).withColumn("column_count", F.size("column_list"))
    return asof.asof_join(rows, versions, TABLE_KEY, ["term_no", "change_id"], ["schema_id", "column_count"], order_hint(), [-F.col("schema_id")])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _in_force(spark, sf, ["delivery_id"]).filter("version.column_count > 0").select("delivery_id", F.col("version.schema_id").alias("schema_id"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    database, name = HISTORY_TABLE
    rows = _ordered(spark, sf).filter((F.col("database_name") == database) & (F.col("table_name") == name) & F.col("mutation_type").isin(INSERT, UPDATE, DELETE))
    rows = rows.withColumn("pk_value", pk_value()).filter(F.col("pk_value").isNotNull())
    keys = ["source_id", "pk_value"]
    states = history.snapshots(rows, keys, "ts_ms", ORDER, F.col("mutation_type") != DELETE, {c: F.try_element_at("entity", F.lit(c)) for c in HISTORY_COLUMNS})
    plan = plan_order(rows, keys, F.col("ts_ms").cast("double"))  # of the changes themselves: their states are made once
    periods = history.validity(states, keys, "ts_ms", plan)
    return periods.select(*keys, F.col("valid_from").alias("valid_from_ms"), F.coalesce("valid_to", F.lit(-1)).cast("long").alias("valid_to_ms"))


def _key_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries of each key and of its source. The feed is read once: partial counts are what moves, and what the plans weigh. The
    sources' totals (the matching side) are replicated to the fragments that hold a source's keys."""
    rows = table(spark, sf, "mutations").select(*TABLE_KEY, pk_value().alias("pk_value"))
    parts = skew.partial_rows(rows, ROW_KEY, {"n": F.count("*")})
    counts = skew.fragment_aggregate(parts, ROW_KEY, {"n": F.sum("n")})
    totals = skew.fragment_aggregate(parts, ["source_id"], {"source_rows": F.sum("n")})
    keyed = counts.filter(F.col("pk_value").isNotNull())
    return skew.fragment_join(keyed, totals, ["source_id"], F.xxhash64(*ROW_KEY), plan=skew.plan_fragments(parts, ["source_id"]))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _key_counts(spark, sf).filter(F.col("n") >= HEAVY_SHARE * F.col("source_rows")).select(*ROW_KEY)


def p7_key_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _key_counts(spark, sf).select(*ROW_KEY, "n", "source_rows")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_table_sizes, p2_found, p2_unique, p3_found, p4_found, p4_feed_changes, p4_unified, p5_found, p6_found, p7_found, p7_key_counts)
}

# The SQL states each problem directly (one window or aggregate over everything), without the operators' plans.

_TERMS = """terms as (
  select source_id, term_no, lower(trim(server_uuid)) as u, count(*) over (partition by source_id) as servers from data_sources),
m as (
  select x.*, coalesce(t.term_no, 0) as term_no, case when x.mutation_type = 3 then 0 else 1 end as op_seq,
    case when len(x.primary_key) > 0 then array_to_string(list_transform(list_sort(x.primary_key),
      lambda k: coalesce(x.entity[k], x.previous_entity[k], '')), '|') end as pk_value,
    coalesce(lower(trim(x.server_uuid)), '') as server
  from mutations x left join terms t on t.source_id = x.source_id
    and (t.servers = 1 or coalesce(t.u, '') = coalesce(lower(trim(x.server_uuid)), '')))"""
_HISTORY = """h as (
  select s.*, coalesce(t.term_no, 0) as term_no,
    cast(regexp_extract(binlog_file_position, '(\\d+):(\\d+):\\d+$', 1) as bigint) as file_no,
    cast(regexp_extract(binlog_file_position, '(\\d+):(\\d+):\\d+$', 2) as bigint) as pos
  from schema_history s left join terms t on t.source_id = s.source_id
    and (t.servers = 1 or coalesce(t.u, '') = coalesce(lower(trim(s.server_uuid)), ''))
  where table_name is not null)"""
_IDENTITY = "source_id, server, mutation_id, event_row_position, mutation_type"
_CURRENT = f"""with {_TERMS}, last as (
  select *, row_number() over (partition by source_id, database_name, table_name, pk_value
    order by term_no desc, mutation_id desc, event_row_position desc, op_seq desc) as rn
  from m where pk_value is not null and mutation_type in (1, 2, 3))"""

SQL: dict[str, str] = {
    "p1_found": f"""{_CURRENT}
select source_id, database_name, table_name, pk_value, mutation_id, event_row_position from last where rn = 1 and mutation_type <> 3""",
    "p1_table_sizes": f"""{_CURRENT}
select source_id, database_name, table_name, count(*) as row_count, cast(sum(cardinality(entity)) as bigint) as value_count
from last where rn = 1 and mutation_type <> 3 group by all""",
    "p2_found": f"""with {_TERMS}
select delivery_id from (select delivery_id, row_number() over (partition by {_IDENTITY} order by delivered_at, delivery_id) as rn from m) where rn > 1""",
    "p2_unique": f"""with {_TERMS}
select delivery_id, source_id, mutation_id, event_row_position, mutation_type, cast(cardinality(entity) as integer) as value_count
from (select *, row_number() over (partition by {_IDENTITY} order by delivered_at, delivery_id) as rn from m) where rn = 1""",
    "p3_found": f"""with {_TERMS}, good as (
  select *, row_number() over (partition by source_id order by leader_epoch desc, state_id desc) as rn
  from source_states where upper(trim(run_status)) = 'COMMITTED'),
mark as (
  select g.source_id, t.term_no, g.last_offset from good g join terms t on t.source_id = g.source_id
    and (t.servers = 1 or coalesce(t.u, '') = coalesce(lower(trim(g.server_uuid)), '')) where rn = 1)
select delivery_id from (
  select m.delivery_id, m.source_id, m.term_no, m.mutation_id,
    row_number() over (partition by {", ".join("m." + c.strip() for c in _IDENTITY.split(","))} order by delivered_at, delivery_id) as rn from m) m
left join mark k on k.source_id = m.source_id
where rn = 1 and (k.source_id is null or m.term_no > k.term_no or (m.term_no = k.term_no and m.mutation_id > k.last_offset))""",
    "p5_found": f"""with {_TERMS}, {_HISTORY}, v as (
  select source_id, database_name, table_name, term_no, file_no * 4294967296 + pos as id, min(schema_id) as schema_id, arg_min(len(column_list), schema_id) as n
  from h group by all),
spans as (
  select *, lead((term_no, id)) over (partition by source_id, database_name, table_name order by term_no, id) as until from v)
select m.delivery_id, s.schema_id from m join spans s on m.source_id = s.source_id and m.database_name = s.database_name and m.table_name = s.table_name
  and (m.term_no, m.mutation_id) >= (s.term_no, s.id) and (s.until is null or (m.term_no, m.mutation_id) < s.until)
where s.n > 0""",
    "p6_found": f"""with {_TERMS}, e as (
  select source_id, pk_value, ts_ms, mutation_type <> 3 as live, (entity['berth_status'], entity['fee_cents'], entity['capacity'])::varchar as attrs,
    row_number() over (partition by source_id, pk_value, ts_ms order by term_no desc, mutation_id desc, event_row_position desc, op_seq desc) as rn
  from m where database_name = 'harbor_core' and table_name = 'berth_profile' and mutation_type in (1, 2, 3) and pk_value is not null),
c as (
  select *, lag(live) over w as was_live, lag(attrs) over w as was from e where rn = 1 window w as (partition by source_id, pk_value order by ts_ms)),
d as (
  select *, lead(ts_ms) over (partition by source_id, pk_value order by ts_ms) as until from c
  where was_live is null or live <> was_live or (live and attrs <> was))
select source_id, pk_value, ts_ms as valid_from_ms, coalesce(until, -1) as valid_to_ms from d where live""",
    "p7_found": f"""with {_TERMS}
select source_id, database_name, table_name, pk_value from (
  select *, sum(n) over (partition by source_id) as total from (select source_id, database_name, table_name, pk_value, count(*) as n from m group by all))
where pk_value is not null and n >= 0.03 * total""",
    "p7_key_counts": f"""with {_TERMS}
select * from (
  select *, cast(sum(n) over (partition by source_id) as bigint) as source_rows from (select source_id, database_name, table_name, pk_value, count(*) as n from m group by all))
where pk_value is not null""",
    "p4_found": f"""with {_TERMS}, {_HISTORY}, p as (
  select schema_id, sql_text, column_list as cur, lag(column_list) over (partition by source_id, database_name, table_name order by term_no, file_no, pos, schema_id) as prev from h),
q as (
  select schema_id, list_transform(prev, lambda x: {{'n': lower(x.col_name), 't': lower(regexp_replace(x.column_type, '\\s', '', 'g'))}}) as a,
    list_transform(cur, lambda x: {{'n': lower(x.col_name), 't': lower(regexp_replace(x.column_type, '\\s', '', 'g'))}}) as b,
    string_split(regexp_replace(regexp_replace(coalesce(sql_text, ''), '/\\*.*?\\*/', '', 'gs'), '[`;]', '', 'g'), ',') as clauses
  from p where len(prev) > 0 and len(cur) > 0),
said as (
  select schema_id, a, b, regexp_extract(lower(regexp_replace(regexp_replace(c, '(?i)^\\s*alter\\s+table\\s+\\S+', ''), '^\\s+', '')),
    '^(?:change(?:\\s+column)?|rename\\s+column)\\s+(\\w+)\\s+(?:to\\s+)?(\\w+)', ['old', 'new']) as r from (select schema_id, a, b, unnest(clauses) as c from q)),
ren as (
  select distinct schema_id, r.old as o, r.new as n from said where r.old <> '' and r.old <> r.new
    and list_contains(list_transform(a, lambda x: x.n), r.old) and list_contains(list_transform(b, lambda x: x.n), r.new)),
oldc as (select schema_id, unnest(a, recursive := true) from q), newc as (select schema_id, unnest(b, recursive := true) from q),
paired as (
  select o.schema_id, o.n as o, coalesce(r.n, o.n) as n, o.t, r.n is not null as moved from oldc o left join ren r on r.schema_id = o.schema_id and r.o = o.n),
joined as (
  select coalesce(p.schema_id, c.schema_id) as schema_id, p.o, c.n, p.t as ot, c.t as nt, p.moved from paired p full join newc c on p.schema_id = c.schema_id and p.n = c.n)
select schema_id, 'added' as change_kind, '' as old_name, n as new_name from joined where o is null
union all select schema_id, 'removed', o, '' from joined where n is null
union all select schema_id, 'renamed', o, n from joined where moved and n is not null
union all select schema_id, 'retyped', o, n from joined where ot <> nt""",
}
