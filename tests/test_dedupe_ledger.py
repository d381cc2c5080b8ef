import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelog.operators import dedupe, ledger

SCHEMA = "delivery long, batch long, at long, a string, b long, note string"


def copies(spark):
    rows = [(i, i // 10, 100 - i % 7, f"id{i % 9}" if i % 4 else "hot", (i % 9) % 3, "n") for i in range(120)]
    rows += [(200, 3, 1, None, None, None), (201, 4, 1, None, None, "late")]
    return rows, spark.createDataFrame(rows, SCHEMA)


def firsts(rows):
    best = {}
    for r in rows:
        k = (r[3], r[4])
        best[k] = min(best.get(k, (r[2], r[0])), (r[2], r[0]))
    return {d for _, d in best.values()}


def test_store_keeps_the_first_copy_over_runs(spark):
    rows, df = copies(spark)
    first, repeats = dedupe.repeated_deliveries(df, ["a", "b"], ["at", "delivery"], "delivery", "batch")
    want = firsts(rows)
    assert {r.delivery for r in first.collect()} == want
    assert Counter(r.delivery for r in repeats.collect()) == Counter(r[0] for r in rows if r[0] not in want)
    assert {r.delivery for r in dedupe.first_copies(df, ["a", "b"], ["at", "delivery"]).collect()} == want


def test_upserts_are_idempotent(spark):
    rows, df = copies(spark)
    store = dedupe.CopyStore(spark, ["a", "b"], ["at", "delivery"], ["note"], buckets=3)
    store.upsert(df.filter("batch < 6"), "one")
    store.upsert(df.filter("batch >= 4"), "two")  # overlaps with the first
    store.upsert(df.filter("batch >= 4"), "two")  # a retry
    got = store.compact().collect()
    assert len(got) == len(firsts(rows))
    assert {r.delivery for r in got} == firsts(rows)


def test_merging_runs_needs_neither_exchange_nor_sort(spark):
    _, df = copies(spark)
    store = dedupe.CopyStore(spark, ["a", "b"], ["at", "delivery"], ["note"], buckets=3)
    store.upsert(df, dedupe.batches_by(df, "batch", 2))
    state, known = store.log.read()[1][-1], []
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    try:
        plan = store.merged(*[store._run(f, state, known) for f in state["runs"].values()])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.legacy.bucketedTableScan.outputOrdering")
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan


def test_a_store_lasts_beyond_its_object_and_cleans_up(spark):
    from tidelog.session import shared_folder
    from tidelog.shared import Folder

    rows, df = copies(spark)
    path = shared_folder(spark, "lasting")
    dedupe.CopyStore(spark, ["a", "b"], ["at", "delivery"], [], path, buckets=3).upsert(df.filter("batch < 6"), "one")
    assert dedupe.CopyStore(spark, ["a", "b"], ["at", "delivery"], [], path).compact().count() > 0
    other = spark.newSession()  # nothing but the path is known here
    again = dedupe.CopyStore(other, ["a", "b"], ["at", "delivery"], [], path)
    again.upsert(other.createDataFrame(df.filter("batch >= 4").collect(), SCHEMA), "two")
    assert {r.delivery for r in again.compact().collect()} == firsts(rows)
    assert len(Folder(spark, f"{path}/runs").names()) <= 3 and len(Folder(spark, f"{path}/log").names()) == 1
    files = [f for f in again.compact().inputFiles()]
    assert files and all("/runs/" in f for f in files)
    again.remove()


def test_identities_are_told_apart_exactly(spark):
    df = spark.createDataFrame([(1, "a", "b:c"), (2, "a:b", "c"), (3, None, "-"), (4, "-", None), (5, "", ""), (6, None, "-")], "d long, a string, b string")
    store = dedupe.CopyStore(spark, ["a", "b"], ["d"], [])
    store.upsert(df, "r")
    assert {r.d for r in store.compact().collect()} == {1, 2, 3, 4, 5}


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    first, repeats = dedupe.repeated_deliveries(df, ["a", "b"], ["at", "delivery"], "delivery", "batch")
    assert first.count() == repeats.count() == 0


def items(spark, names):
    return spark.createDataFrame([(n, n + "-row") for n in names], "item string, v string")


def states(led, now):
    return {r.item: (r.state, r.token) for r in led.state(now).collect()}


def test_leases_expire_and_tokens_fence_late_writers(spark):
    led = ledger.WorkLedger(spark)
    led.enqueue(items(spark, ["a", "b"]))
    led.enqueue(items(spark, ["b", "c"]))
    assert states(led, 0) == {x: ("pending", 0) for x in "abc"}
    slow = led.lease("slow", lease_ms=100, now_ms=0)
    assert {r.item for r in slow.collect()} == set("abc")
    slow = spark.createDataFrame(slow.collect(), slow.schema)
    assert states(led, 50)["a"] == ("leased", 1)
    assert states(led, 500)["a"] == ("pending", 1)
    assert led.lease("other", now_ms=50).count() == 0
    quick = led.lease("quick", lease_ms=1000, now_ms=500)
    quick = spark.createDataFrame(quick.collect(), quick.schema)
    led.write(items(spark, ["a", "b", "c"]).withColumn("v", F.lit("quick")), quick)
    led.commit(quick.filter("item <> 'c'"))
    led.write(items(spark, ["a", "b", "c"]).withColumn("v", F.lit("slow")), slow)  # it lost its lease long ago
    led.commit(slow)
    assert states(led, 600) == {"a": ("done", 2), "b": ("done", 2), "c": ("leased", 2)}
    assert {(r.v) for r in led.results("v string").collect()} == {"quick"}
    assert led.results("v string").count() == 2


def test_a_second_run_repeats_and_skips_nothing(spark):
    from tidelog.session import shared_folder

    path = shared_folder(spark, "twice")
    rows = items(spark, ["a", "b"])
    assert sorted(r.v for r in ledger.process_new(spark, rows, lambda d: d, ["v"], path=path).collect()) == ["a-row", "b-row"]
    again = ledger.process_new(spark, items(spark, ["b", "c"]), lambda d: d, ["v"], worker="later", path=path)
    assert sorted(r.v for r in again.collect()) == ["a-row", "b-row", "c-row"]


def test_last_valid_states(spark):
    saved = [(1, "s", " committed", 3, 10, "U"), (2, "s", "COMMITTED", 2, 99, "U"), (3, "s", "FAILED", 9, 50, "U"), (4, "s", "Committed", 3, 12, "u"), (5, "t", "failed", 1, 1, None)]
    marks = ledger.last_valid_states(spark.createDataFrame(saved, "state_id long, source_id string, run_status string, leader_epoch long, last_offset long, server_uuid string"))
    assert [(r.source_id, r.done_offset) for r in marks.collect()] == [("s", 12)]


STATES = "state_id long, source_id string, run_status string, leader_epoch long, last_offset long, term_no int, saved_ms long"
SAVED = [(1, "s", " committed", 3, 10, 1, 5), (2, "s", "COMMITTED", 2, 99, 1, 6), (3, "s", "FAILED", 9, 50, 1, 7), (4, "s", "Committed", 3, 12, 1, 8), (5, "t", "failed", 1, 1, 1, 9), (6, "u", "COMMITTED", None, None, 1, None)]
ROWS = [("s", 1, 12), ("s", 1, 13), ("s", 1, 98), ("s", 2, 1), ("s", 0, 99), ("t", 1, 1), ("u", 1, 3), (None, 1, 1), ("v", 1, 4)]
NEW = {("s", 1, 13), ("s", 1, 98), ("s", 2, 1), ("t", 1, 1), ("u", 1, 3), (None, 1, 1), ("v", 1, 4)}


def source_rows(spark, per_item):
    rows = spark.createDataFrame(ROWS, "source_id string, term_no int, change_id long")
    return rows.withColumn("item", ledger.item_name("source_id", "term_no", F.col("change_id"), per_item))


def from_runs(spark, rows, **more):
    items = rows.groupBy("item", "source_id", "term_no").agg(F.min("change_id").alias("low"), F.max("change_id").alias("high"))
    known = ledger.run_events(spark.createDataFrame(SAVED, STATES), items)
    return ledger.process_new(spark, rows, lambda d: d, ["source_id", "term_no", "change_id"], known=known, offset="change_id", **more)


@pytest.mark.parametrize("per_item", [1, 16, 1000])
def test_states_of_runs_decide_through_the_ledger(spark, per_item):
    got = from_runs(spark, source_rows(spark, per_item)).collect()
    assert len(got) == len(NEW) and {tuple(r) for r in got} == NEW


def test_what_runs_say_of_items(spark):
    rows = source_rows(spark, 16)
    items = rows.groupBy("item", "source_id", "term_no").agg(F.min("change_id").alias("low"), F.max("change_id").alias("high"))
    led = ledger.WorkLedger(spark)
    led.seed(ledger.run_events(spark.createDataFrame(SAVED, STATES), items))
    found = {r.item: (r.state, r.token, r.through, r.worker) for r in led.state().collect()}
    assert found["s~1~0"] == ("pending", 4, 12, "run-4")  # the lease of the last valid run has run out; the state lies within the item
    assert found["s~0~6"][:2] == ("done", 4) and found["s~1~6"] == ("pending", 4, None, "run-4")  # the replaced leader's 99 counts for nothing
    assert found["t~1~0"][:2] == ("pending", 0) and found["v~1~0"][:2] == ("pending", 0)
    assert {r.item: r.token for r in led.lease().collect()}["t~1~0"] == 4  # above the token that was given back


@pytest.mark.parametrize("crash", ["lease", "work", "write", "commit"])
def test_a_crash_neither_skips_nor_repeats(spark, crash, monkeypatch):
    from tidelog.session import shared_folder

    path, rows = shared_folder(spark, "crash"), source_rows(spark, 16)
    now = [1_000_000]
    monkeypatch.setattr(ledger.time, "time", lambda: now[0])
    real = {n: getattr(ledger.WorkLedger, n) for n in ("lease", "write", "commit")}

    def fail(*a, **k):
        if crash in real and crash != "commit":
            real[crash](*a, **k)
        raise OSError("lost")

    with monkeypatch.context() as m:
        if crash in real:
            m.setattr(ledger.WorkLedger, crash, fail)
            with pytest.raises(OSError, match="lost"):
                from_runs(spark, rows, path=path)
        else:
            with pytest.raises(OSError, match="lost"):
                ledger.process_new(spark, rows, fail, ["source_id"], path=path, offset="change_id", known=ledger.run_events(spark.createDataFrame(SAVED, STATES), rows.groupBy("item", "source_id", "term_no").agg(F.min("change_id").alias("low"), F.max("change_id").alias("high"))))
    now[0] += 3600  # leases run out
    got = from_runs(spark, rows, path=path).collect()
    assert len(got) == len(NEW) and {tuple(r) for r in got} == NEW


def test_leases_at_once_never_share_a_token(spark):
    led = ledger.WorkLedger(spark)
    led.enqueue(items(spark, list("abcdefgh")))
    got = []
    threads = [threading.Thread(target=lambda: got.append([(r.item, r.token) for r in ledger.WorkLedger(spark, led.path).lease(now_ms=0, lease_ms=10).collect()])) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    every = [x for some in got for x in some]
    assert len(got) == 4 and len(every) == len(set(every)) == 8
    assert led.lease(now_ms=5).count() == 0


def test_compaction_keeps_states_tokens_and_released_leases(spark):
    led = ledger.WorkLedger(spark)
    led.enqueue(items(spark, ["a", "b", "c"]))
    held = led.lease("w", now_ms=0, lease_ms=100)
    held = spark.createDataFrame(held.collect(), held.schema)
    led.commit(held.filter("item = 'a'"))
    led.release(held.filter("item = 'b'"))
    before = {tuple(r) for r in led.state(50).select("item", "state", "token").collect()}
    assert before == {("a", "done", 1), ("b", "pending", 0), ("c", "leased", 1)}
    led.compact()
    assert {tuple(r) for r in led.state(50).select("item", "state", "token").collect()} == before
    assert len(led.log.folder.names()) == 1
    assert {(r.item, r.token) for r in led.lease("x", now_ms=50).collect()} == {("b", 2)}


def test_shared_log_has_one_writer_a_number(spark):
    from tidelog.session import shared_folder
    from tidelog.shared import SharedLog

    log = SharedLog(spark, shared_folder(spark, "log"))
    threads = [threading.Thread(target=lambda: [log.change(lambda e: ({"n": len(e)}, None)) for _ in range(5)]) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert [e["n"] for e in log.read()[1]] == list(range(20))
    log.folder._local = False  # by rename, as on other file systems
    assert log.put(20, {"n": 20}) and not log.put(20, {"n": 99}) and log.read()[1][-1] == {"n": 20}
