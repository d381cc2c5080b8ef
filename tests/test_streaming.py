

import json
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidelog import config
from tidelog.config import Config, SourceConfig
from tidelog.operators.enrich import table_maps, transaction_context
from tidelog.operators.state import Checkpointer, Repository, SourceState
from tidelog.operators.validate import event_order_violations
from tidelog.schema import ddl
from tidelog.sources.log import SERVER, log_from_events, read_log, start_condition
from tidelog.sources.metadata import Server, base_tables, table_columns, user_databases
from tidelog.sources.stream import LogSource
from tidelog.streaming import pipe, sink
from tidelog.streaming.context import stream_context


@pytest.fixture(scope="module")
def log(spark):
    events = spark.range(1200).select(F.col("id").alias("event_id"), (F.col("id") % 17).alias("user_id"), F.element_at(F.array(*[F.lit(x) for x in ("signup", "error", "click")]), (F.col("id") % 3 + 1).cast("int")).alias("event_type"), (F.col("id") / 7).alias("value"), F.timestamp_millis(F.col("id") * 1000 + 1).alias("ts"))
    return log_from_events(events).cache()


@pytest.fixture(scope="module")
def log_dir(spark, log, tmp_path_factory):
    spark.dataSource.register(LogSource)
    folder = tmp_path_factory.mktemp("log")
    for n in (1, 2, 3):
        lines = log.filter(F.col("file_no") == n).orderBy("position").toJSON().collect()
        (folder / f"shop-bin.{n:06d}.json").write_text("\n".join(lines) + "\n")
    return str(folder)


def test_batch_read(spark, log, log_dir, tmp_path):
    assert sorted(r.offset for r in spark.read.format("tidelog_files").load(log_dir).collect()) == sorted(r.offset for r in log.collect())
    log.write.partitionBy("source_id", "file_no").parquet(str(tmp_path / "p"))
    got = read_log(spark, str(tmp_path / "p"), start_offset=2 << 32)
    assert got.count() == log.filter(F.col("file_no") >= 2).count()
    assert "PushedFilters: [IsNotNull(offset)" in got._jdf.queryExecution().executedPlan().toString()


def run(stream, path, checkpoint, **trigger):
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_stream_resumes_without_loss_or_repeats(spark, log, log_dir, tmp_path):
    out, cp = str(tmp_path / "o"), str(tmp_path / "c")
    stream = spark.readStream.format("tidelog_files").option("maxEvents", "500").load(log_dir)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).start()
    for _ in range(2):  # stop somewhere, go on
        q.processAllAvailable()
        q.stop()
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.offset for r in spark.read.parquet(out).collect()) == sorted(r.offset for r in log.collect())


@pytest.mark.parametrize(("start", "first"), [("shop-bin.000002:1004", (2 << 32) + 1004), ("latest", None)])
def test_stream_starts_where_it_is_told(spark, log_dir, tmp_path, start, first):
    q = spark.readStream.format("tidelog_files").option("startingPosition", start).load(log_dir).writeStream.format("memory").queryName("started").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("started").agg(F.min("offset")).first()[0] == first


def test_streamed_context_equals_the_batch_operators(spark, log, log_dir, tmp_path):
    stream = spark.readStream.format("tidelog_files").option("maxEvents", "301").load(log_dir)
    q = stream_context(stream).writeStream.format("memory").queryName("context").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    off = lambda c: F.get_json_object(c, "$.offset").cast("long")
    got = {tuple(r) for r in spark.table("context").select("offset", off("begin_txn"), off("last_txn"), "current_gtid", "resolved_table").collect()}
    both = transaction_context(log).select("offset", F.col("begin_txn.offset").alias("b"), F.col("last_txn.offset").alias("e"), "current_gtid")
    maps = table_maps(log).select("offset", F.when(F.col("event_type").isin("WRITE", "UPDATE", "DELETE"), F.col("resolved_table")).alias("t"))
    assert got == {tuple(r) for r in both.join(maps, "offset").collect()}


def batch(spark, *rows):
    return spark.createDataFrame(rows, "offset long, ts_ms long, routing_key string, source_id string")


def test_destination_publishes_and_remembers(spark):
    kept = []
    late = lambda df: event_order_violations(df, "ts_ms", ["source_id"])
    d = sink.Destination(sink.memory_sink(kept), lambda df: df.select("offset"), pool_size=4, validators={"out.of.order": late})
    d.send(batch(spark, (1, 1, "4", "s")).limit(0), 0)
    assert kept == []
    d.send(batch(spark, (1, 1, "4", "s"), (5, 2, "6", "s"), (3, 3, "4", "s")), 1)
    assert sorted(r.offset for r in kept[0][1]) == [1, 3, 5]
    assert d.last_published == {0: 3, 2: 5} and d.checkpoint_offset() == 3 and d.counts == {"publish.success": 3, "send.failure": 0, "out.of.order": 1}


def test_a_batch_that_is_not_kept_is_published_in_one_look(spark):
    kept, looks = [], spark.sparkContext.accumulator(0)
    seen = F.udf(lambda o: (looks.add(1), o)[1], "long").asNondeterministic()
    rows = batch(spark, (1, 1, "4", "s"), (5, 2, "6", "s"), (3, 3, "4", "s")).coalesce(1)
    d = sink.Destination(sink.memory_sink(kept), lambda df: df.select("offset"), keep=False)
    d.send(rows.limit(0), 0)
    assert kept == [] and d.last_mutation is None
    d.send(rows.withColumn("offset", seen("offset")), 1)
    assert sorted(r.offset for r in kept[0][1]) == [1, 3, 5] and looks.value <= 6  # once, and once whether there are any
    assert d.checkpoint_offset() == 5 and d.last_mutation == {"ts_ms": 2, "offset": 5} and d.counts == {"publish.success": 3, "send.failure": 0}


def test_errors_are_told_once_and_raised(spark):
    heard = []

    def broken(df, n):
        raise OSError("no")

    d = sink.Destination(broken, on_error=[heard.append])
    with pytest.raises(sink.DestinationError):
        d.send(batch(spark, (1, 1, "4", "s")), 1)
    assert len(heard) == 1 and d.counts["send.failure"] == 1 and d.checkpoint_offset() is None


def test_file_sink_replaces_a_repeated_batch(spark, tmp_path):
    publish = sink.file_sink(str(tmp_path))
    for _ in range(2):
        publish(batch(spark, (1, 1, "4", "s")), 7)
    assert spark.read.parquet(str(tmp_path)).count() == 1


def test_pipe_restarts_after_failure_and_checkpoints(spark, log_dir, tmp_path):
    state, done, committed = {"fail": True}, [], []

    def publish(df, n):
        if state["fail"]:
            state["fail"] = False
            raise OSError("first time")
        done.extend(r.offset for r in df.select("offset").collect())

    def build(s, state):
        return s.readStream.format("tidelog_files").load(log_dir).withColumns({"ts_ms": F.col("timestamp_ms"), "routing_key": F.lit("k")})

    p = pipe.Pipe("p", build, sink.Destination(publish), str(tmp_path / "c"), {"processingTime": "0 seconds"}, committed.append)
    manager = pipe.PipeManager(spark)
    manager.add("s", "s_0", [p])
    assert manager.contains("s") and manager.partitions("s") == {"s_0"} and not manager.contains("t")
    with pytest.raises(Exception, match="first time"):
        p.query.processAllAvailable()
    assert p.failed() and p.keep_alive(spark) and not p.keep_alive(spark)
    p.query.processAllAvailable()
    assert manager.stop() and p.restarts == 1 and not p.is_running()
    assert len(done) == len(set(done)) == 1200 and committed[-1] == max(done)


def test_a_lost_position_rolls_the_source_back(spark, log_dir, tmp_path):
    states = Checkpointer(Repository(spark, str(tmp_path / "state")))
    for offset in (1, 2, 3):
        states.add(SourceState(last_offset=offset))

    def publish(df, n):
        raise OSError("1236; could not find first log file name")

    asked = []

    def build(s, state):
        asked.append(state.last_offset)
        return s.readStream.format("tidelog_files").load(log_dir).withColumns({"ts_ms": F.col("timestamp_ms"), "routing_key": F.lit("k")})

    p = pipe.Pipe("lost", build, sink.Destination(publish), str(tmp_path / "c"), {"availableNow": True}, states=states)
    for expected in (3, 1, 0):
        p.open(spark)
        with pytest.raises(Exception, match="1236"):
            p.query.awaitTermination(60)
        assert p.keep_alive(spark)
        assert states.state().last_offset == expected == asked[-1]
        p.query.stop()
    assert Checkpointer(Repository(spark, str(tmp_path / "state"))).generation == 3


def test_after_a_roll_back_the_stream_goes_on_from_the_state(spark, log_dir, tmp_path):
    """The position that Spark's checkpoint holds is lost: what is read again begins at the state gone back to, not there."""
    states = Checkpointer(Repository(spark, str(tmp_path / "state")))
    states.add(SourceState(last_offset=(2 << 32) + 4, last_position="shop-bin.000002:4:1004"))
    got, lost = [], {"now": False}

    def publish(df, n):
        if lost["now"]:
            lost["now"] = False
            raise OSError("1236; could not find first log file name")
        got.extend(r.offset for r in df.select("offset").collect())

    def build(s, state):
        source = SourceConfig("n", ["a:b"], "h", initial_binlog_position="earliest")
        return s.readStream.format("tidelog_files").option("startingPosition", pipe.starting_position(state, source)).option("maxEvents", "400").load(log_dir).withColumns({"ts_ms": F.col("timestamp_ms"), "routing_key": F.lit("k")})

    p = pipe.Pipe("again", build, sink.Destination(publish), str(tmp_path / "c"), {"processingTime": "0 seconds"}, states=states)
    p.open(spark)
    p.query.processAllAvailable()
    p.query.stop()
    first = list(got)
    assert min(first) == (1 << 32) + 4  # nothing was saved yet
    lost["now"] = True
    p.destination.last_mutation = None
    p.checkpoint_path = str(tmp_path / "other")
    p.open(spark)
    with pytest.raises(Exception, match="1236"):
        p.query.processAllAvailable()
    got.clear()
    assert p.keep_alive(spark)
    p.query.processAllAvailable()
    p.close()
    assert min(got) == (2 << 32) + 1004 and max(got) == max(first)
    assert states.state().last_offset == max(got)


def test_order_checks_remember_the_batch_before_and_reset(spark):
    check = sink.OrderCheck(order=("at",))
    rows = lambda *r: spark.createDataFrame(r, "source_id string, offset long, at int")
    assert check.validate(rows(("s", 5, 1), ("s", 6, 2), ("t", 1, 1))).count() == 0
    assert [(r.source_id, r.offset, r.previous_offset) for r in check.validate(rows(("s", 4, 3), ("s", 7, 4), ("t", 2, 3))).collect()] == [("s", 4, 6)]
    check.reset()
    assert check.validate(rows(("s", 1, 5))).count() == 0


def test_a_buffer_holds_batches_and_sends_them_together(spark, tmp_path):
    kept, gate = [], threading.Event()

    def publish(df, n):
        gate.wait(60)
        kept.append((n, sorted(r.offset for r in df.collect())))

    b = sink.build_destination(publish, lambda df: df, buffer_size=2, spark=spark, buffers=str(tmp_path), offset="offset")
    with pytest.raises(sink.DestinationError, match="does not run"):
        b.send(batch(spark, (1, 1, "4", "s")), 0)
    b.open()
    b.open()
    b.send(batch(spark, (1, 1, "4", "s")), 1)
    while b.remaining_capacity() < 2:  # the thread has taken it and waits
        time.sleep(0.05)
    b.send(batch(spark, (2, 1, "4", "s")), 2)
    b.send(batch(spark, (3, 1, "4", "s")), 3)
    assert b.remaining_capacity() == 0 and b.checkpoint_offset() is None
    late = threading.Thread(target=lambda: b.send(batch(spark, (4, 1, "4", "s")), 4))
    late.start()
    late.join(3)
    assert late.is_alive() and b.counts["buffer.full"] == 1
    gate.set()
    late.join(60)
    b.close()
    assert not b.is_running() and kept[0] == (1, [1]) and sorted(o for _, some in kept for o in some) == [1, 2, 3, 4] and len(kept) < 4
    assert b.checkpoint_offset() == 4


def test_what_a_buffer_held_is_sent_when_it_is_opened_again(spark, tmp_path):
    kept, heard, state = [], [], {"fail": True}

    def publish(df, n):
        if state["fail"]:
            raise OSError("no")
        kept.extend(r.offset for r in df.collect())

    make = lambda: sink.build_destination(publish, lambda df: df, buffer_size=5, spark=spark, buffers=str(tmp_path))
    b = make()
    b.on_error.append(heard.append)
    b.open()
    b.send(batch(spark, (1, 1, "4", "s")), 1)
    b._thread.join(60)
    assert len(heard) == 1 and b.checkpoint_offset() is None and b.counts["send.failure.OSError"] == 1
    with pytest.raises(sink.DestinationError):
        b.send(batch(spark, (2, 1, "4", "s")), 2)
    state["fail"] = False
    again = make()
    again.open()
    again.send(batch(spark, (2, 1, "4", "s")), 2)
    again.close()
    assert sorted(kept) == [1, 2]


def test_a_pool_publishes_by_member_and_fails_by_member(spark):
    kept, heard = {}, []

    def publish(df, n):
        rows = df.collect()
        if any(r.routing_key == "9" for r in rows) and not kept.get("fixed"):
            raise OSError("member 1")
        kept.setdefault(n % 1000, []).extend(r.offset for r in rows)

    pool = sink.build_destination(publish, lambda df: df, pool_size=4)
    pool.on_error.append(heard.append)
    pool.open()
    some = batch(spark, (1, 1, "4", "s"), (3, 1, "9", "s"), (2, 1, "6", "s"), (4, 1, "2", "s"), (5, 1, "1", "s"))
    with pytest.raises(sink.DestinationError):
        pool.send(some, 0)
    assert len(heard) == 1 and kept == {0: [1], 2: [2, 4]} and pool.counts["send.failure"] == 1
    kept["fixed"] = True
    pool.send(some, 0)
    assert sorted(kept[1]) == [3, 5] and pool.checkpoint_offset() == 1 and pool.last_mutation["offset"] == 1
    with pytest.raises(ValueError, match="publisher"):
        sink.build_destination(None, lambda df: df)


def test_a_batch_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    d = sink.Destination(sink.memory_sink([]), validators={"a": sink.OrderCheck(), "b": lambda df: df.limit(0)})
    rows = batch(spark, *[(i, i, "k", "s") for i in range(50)])
    d.send(rows.mapInPandas(count, rows.schema), 0)
    assert seen.value == 50


def test_unknown_destinations_are_refused(spark, tmp_path):
    source = SourceConfig("n", ["a:b"], "h", destination={"type": "pigeon"})
    with pytest.raises(ValueError, match="unknown destination"):
        pipe.pipe_of(spark, Config(), source, lambda *a: None, str(tmp_path))


@pytest.mark.parametrize("options", [{"pieceBytes": "5000"}, {"maxEvents": "301"}])
@pytest.mark.parametrize(("start", "first"), [("earliest", (1 << 32) + 4), ("shop-bin.000002:1004", (2 << 32) + 1004), (f"gtid:{SERVER}:1-100", None), ("latest", None)])
def test_readers_by_pieces_and_by_events_start_alike(spark, log, log_dir, tmp_path, start, first, options):
    q = spark.readStream.format("tidelog_files").options(startingPosition=start, **options).load(log_dir).writeStream.format("memory").queryName("read_parts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(r.offset for r in spark.table("read_parts").select("offset").collect())
    assert got == ([] if start == "latest" else sorted(r.offset for r in log.filter(start_condition(start)).select("offset").collect()))
    assert first is None or got[0] == first


def test_pieces_follow_a_file_that_grows(spark, log, log_dir, tmp_path):
    folder = tmp_path / "grows"
    folder.mkdir()
    lines = [json.loads(x) for x in (Path(log_dir) / "shop-bin.000001.json").read_text().splitlines()]
    texts = [json.dumps(x) + "\n" for x in lines]
    (folder / "shop-bin.000001.json").write_text("".join(texts[:100]) + texts[100][:20])  # the last line is being written
    q = spark.readStream.format("tidelog_files").option("pieceBytes", "999").load(str(folder)).writeStream.format("memory").queryName("growing").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    assert spark.table("growing").count() == 100
    (folder / "shop-bin.000001.json").write_text("".join(texts))
    (folder / "shop-bin.000002.json").write_text((Path(log_dir) / "shop-bin.000002.json").read_text())
    q.processAllAvailable()
    q.stop()
    assert sorted(r.offset for r in spark.table("growing").collect()) == sorted(r.offset for r in log.filter("file_no <= 2").collect())


YAML = """
mysql_sources:
  - name: shop-log
    host: h
    port: 3306
    tables: [shop:users, shop:carts]
    schema_version_enabled: true
    initial_binlog_position: earliest
    destination: {type: file, pool_size: 2, buffer_size: 3, producer_config: {path: %s}}
mysql_schema_store: {host: h, database: store}
"""


def test_a_pipe_from_its_configuration_follows_schema_changes(spark, log, tmp_path):
    """A column is renamed in mid-stream: images before and after have the names in force; the history is stored; a restart repeats nothing."""
    folder = tmp_path / "log"
    folder.mkdir()
    n = F.col("offset")
    at = log.filter("event_type = 'QUERY' and sql = 'BEGIN' and file_no = 2").agg(F.min("offset")).first()[0]
    changed = log.withColumn("sql", F.when(n == at, "ALTER TABLE shop.users CHANGE event_type kind varchar(20)").otherwise(F.col("sql")))
    for k in (1, 2, 3):
        (folder / f"shop-bin.{k:06d}.json").write_text("\n".join(changed.filter(F.col("file_no") == k).orderBy("position").toJSON().collect()) + "\n")
    live = ddl.Catalog({"shop": {t: [ddl.Column("user_id", "bigint", "bigint", True), ddl.Column("event_type", "varchar", "varchar(20)"), ddl.Column("value", "double", "double")] for t in ("users", "visits", "carts")}})
    settings = config.load(YAML % (tmp_path / "out"))
    source = settings.mysql_sources[0]

    def events(s, source, start):
        return s.readStream.format("tidelog_files").options(startingPosition=start, maxEvents="250").load(str(folder))

    def run():
        p = pipe.pipe_of(spark, settings, source, events, str(tmp_path / "root"), live=live)
        p.trigger = {"processingTime": "0 seconds"}
        p.open(spark)
        p.query.processAllAvailable()
        p.close()
        return p

    p = run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    want = mutations_by_hand(changed, at)
    assert sorted((r.header.id, r.header.event_row_position, r.header.type, r.table.name, ",".join(sorted(r.entity))) for r in rows) == want
    assert {c.type for r in rows for c in r.table.columns} == {8, 15, 5} and all(r.topic.startswith("tidelog.shop-log-shop-") for r in rows)
    assert p.destination.counts["schema.mismatch"] == 0 and p.destination.counts["send.failure"] == 0
    stored = pipe.schema_store(spark, settings, source, str(tmp_path / "root")).read().orderBy("id").collect()
    assert [r.table_name for r in stored[:3]] == ["carts", "users", "visits"] and len({r.id for r in stored}) == len(stored)
    renamed = [r for r in stored[3:] if "CHANGE" in r.sql]
    assert [(r.table_name, [c.name for c in r.columns]) for r in renamed] == [("users", ["user_id", "kind", "value"])]
    assert all(r.table_name is None for r in stored[3:] if "ADD INDEX" in r.sql) and len(stored) > 6
    assert p.states.state().last_offset > 0
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def mutations_by_hand(log, at):
    out, maps = [], {}
    for e in log.orderBy("offset").collect():
        if e.event_type == "START":
            maps = {}
        elif e.event_type == "TABLE_MAP":
            maps[e.table_id] = (e.table_name, "kind" if e.table_name == "users" and e.offset > at else "event_type")
        elif e.event_type in ("WRITE", "UPDATE", "DELETE") and maps.get(e.table_id, ("",))[0] in ("users", "carts"):
            name, second = maps[e.table_id]
            names = ",".join(sorted(["user_id", second, "value"]))
            for k, r in enumerate(e.rows):
                moved = e.event_type == "UPDATE" and r.before[0] != r.after[0]
                for op in ([3, 1] if moved else [{"WRITE": 1, "UPDATE": 2, "DELETE": 3}[e.event_type]]):
                    out.append((e.offset, k, op, name, names))
    return sorted(out)


def test_server_metadata_from_tables(spark):
    cols = spark.createDataFrame([("d", "t", "b", "int", "int(11)", "", 2), ("d", "t", "a", "int", "int(11)", "PRI", 1)], "TABLE_SCHEMA string, TABLE_NAME string, COLUMN_NAME string, DATA_TYPE string, COLUMN_TYPE string, COLUMN_KEY string, ORDINAL_POSITION long")
    assert [(c.name, c.primary_key) for c in table_columns(cols).first()["columns"]] == [("a", True), ("b", False)]
    tables = spark.createDataFrame([("d", "t", "BASE TABLE"), ("d", "v", "VIEW"), ("mysql", "user", "BASE TABLE")], "TABLE_SCHEMA string, TABLE_NAME string, TABLE_TYPE string")
    assert [r.table_name for r in base_tables(tables, "d").collect()] == ["t"] and [r.database for r in user_databases(tables).collect()] == ["d"]
    answers = {"server_uuid": "U", "gtid_mode": "on"}
    server = Server(lambda sql: spark.createDataFrame([(v,) for k, v in answers.items() if f"'{k}'" in sql], "value string"))
    assert server.uuid() == "U" and server.gtid_mode() and server.variable("none") is None


def test_events_in_pieces_come_in_order_and_few_at_a_time():
    import numpy as np
    import pyarrow as pa

    from tidelog.streaming import pieces

    rng = np.random.default_rng(5)
    n = 30_000
    at = rng.permutation(n)
    log = pa.table({"source_id": ["s"] * n, "offset": pa.array([None if o == n - 1 else int(o) for o in at]), "text": [f"{o:0200d}" for o in at]})
    for order in (slice(None), np.argsort(at)):  # every piece reaches over all of the log; pieces one behind the other
        spool = pieces.Spool(together=200_000)
        put = [spool.put(r["first"], r["last"], r["size"], r["data"]) for b in pieces.into_pieces(log.take(np.arange(n)[order]).to_batches(max_chunksize=500)) for r in b.to_pylist()]
        found = [*spool.ordered(put)]
        assert [int(t) for f in found for t in f["text"].to_pylist()] == [*range(n)]
        assert max(f.nbytes for f in found) < 600_000


class _Kept:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_a_batch_is_walked_in_parts_with_the_same_context(log, monkeypatch):
    import pyarrow as pa

    from tidelog.streaming import context, pieces

    lean = log.select(*[c for c in context._PASSED if c != "rows_json"], F.to_json("rows").alias("rows_json"), "database", "table_name", "gtid", "column_types").toArrow()

    def walked(size, together):
        p = context.ContextProcessor({"shop-log": []})
        p.state = _Kept()
        rows = pa.Table.from_batches(pieces.into_pieces(lean.to_batches(max_chunksize=size))).to_pandas()
        monkeypatch.setattr(context, "Spool", lambda: pieces.Spool(together))
        out = [*p.handleInputRows(("shop-log",), iter([rows.sample(frac=1.0, random_state=3)]), None)]
        made = [r for b in context._out_of_pieces(pa.RecordBatch.from_pandas(o) for o in out) for r in b.to_pylist()]
        return len(out), made, p.state.value

    one, parts = walked(2000, 1 << 30), walked(97, 20_000)
    assert one[0] == 1 and parts[0] > 5
    assert one[1:] == parts[1:] and len(one[1]) == 1200
