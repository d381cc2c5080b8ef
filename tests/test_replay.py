from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.operators import replay, skew
from tidelog.plans import problems

SCHEMA = "key string, seq long, op int, image map<string,string>, extra string"


def brute(rows, full=False):
    state, last = {}, {}
    for key, seq, op, image, _ in sorted((r for r in rows if r[2] in (1, 2, 3)), key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        if key in last and seq <= last[key]:
            continue
        last[key] = seq
        if op == 3:
            state.pop(key, None)
        elif op == 1 or full:
            state[key] = (seq, dict(image or {}))
        else:
            state[key] = (seq, {**state.get(key, (0, {}))[1], **(image or {})})
    return state


def run(spark, rows, cuts=False, full=None):
    df = spark.createDataFrame(rows, SCHEMA)
    hint = F.col("seq").cast("double")
    plan = skew.plan_order(df, ["key"], hint, tasks=4, min_task_rows=2) if cuts else None
    out = replay.replay(df, ["key"], ["seq"], "op", "image", hint, full, plan)
    return {r.key: (r.seq, dict(r.image)) for r in out.collect()}


def places(spark, rows, cuts=False):
    """Without images."""
    df = spark.createDataFrame(rows, SCHEMA)
    hint = F.col("seq").cast("double")
    plan = skew.plan_order(df, ["key"], hint, tasks=4, min_task_rows=2) if cuts else None
    found = replay.replay(df, ["key"], ["seq"], "op", None, hint, None, plan).collect()
    assert len({r.key for r in found}) == len(found)
    return {r.key: r.seq for r in found}


def test_batches_without_images_carry_their_last_row(spark):
    rows = [(k, i, 2 if i % 50 else 3, None, None) for k in ("a", "b", None) for i in range(1, 400)] + [("gone", 1, 1, None, None), ("gone", 2, 3, None, None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert places(spark, rows) == {"a": 399, "b": 399, None: 399}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_partial_updates_deletes_repeats_and_nulls(spark):
    rows = [
        ("a", 1, 1, {"x": "1", "y": "1"}, None), ("a", 3, 2, {"y": "3"}, None), ("a", 2, 2, {"y": "2", "z": "2"}, None), ("a", 3, 2, {"y": "3"}, None),
        ("b", 1, 1, {"x": "1"}, None), ("b", 2, 3, {"x": "1"}, None), ("c", 5, 2, {"x": None}, None), (None, 1, 1, None, None), ("d", 1, 4, {"x": "1"}, None), ("e", 2, 1, {"n": "new"}, None), ("e", 1, 3, None, None),
    ]
    assert run(spark, rows) == {"a": (3, {"x": "1", "y": "3", "z": "2"}), "c": (5, {"x": None}), None: (1, {}), "e": (2, {"n": "new"})}
    assert run(spark, []) == {}


def test_full_updates_replace_the_row(spark):
    rows = [("a", 1, 1, {"x": "1"}, None), ("a", 2, 2, {"y": "2"}, None)]
    assert run(spark, rows, full=F.lit(True)) == {"a": (2, {"y": "2"})}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "b", "c"]), st.integers(0, 60), st.sampled_from([1, 2, 2, 2, 3]), st.dictionaries(st.sampled_from("xyz"), st.sampled_from("123"), max_size=2)), max_size=80))
def test_any_order_any_cut_equals_sequential_replay(spark, made):
    seen = {}
    rows = []
    for key, seq, op, image in made:  # a place has one change, which may be delivered again
        op, image = seen.setdefault((key, seq), (op, image))
        rows.append((key, seq, op, image, "x"))
    want = brute(rows)
    assert run(spark, rows, cuts=True) == run(spark, rows) == want
    for cuts in (False, True):
        assert places(spark, rows, cuts) == {k: seq for k, (seq, _) in want.items()}


def test_places_without_images_come_from_the_state_machine(spark):
    """What is not after the last applied change is skipped, whether images are asked for or not."""
    rows = [("a", 1, 1, {"x": "1"}, None), ("a", 1, 3, None, None), ("b", 1, 1, {"x": "1"}, None), ("b", 4, 2, {"y": "4"}, None), ("b", 4, 3, None, None), ("c", 2, 3, None, None)]
    rows += [("hot", i // 2, 2 + i % 2, {f"c{i % 3}": str(i)}, None) for i in range(60)]
    for cuts in (False, True):
        got = run(spark, rows, cuts)
        assert got == {"a": (1, {"x": "1"}), "b": (4, {"x": "1", "y": "4"}), "hot": (29, {"c0": "54", "c1": "58", "c2": "56"})}
        assert places(spark, rows, cuts) == {k: seq for k, (seq, _) in got.items()}


def test_rows_of_p1_are_replayed_whole(spark, monkeypatch, tmp_path):
    """Partial updates of p1_found's rows are merged: images go into its state machine and come out whole."""
    calls, whole = [], replay.replay
    monkeypatch.setattr(replay, "replay", lambda *a: calls.append(whole(*a)) or calls[-1])
    kinds = "source_id string, server_uuid string, mutation_id long, binlog_pos string, event_row_position int, mutation_type int, database_name string, table_name string, primary_key array<string>, entity map<string,string>, previous_entity map<string,string>"
    changes = [(1, 1, {"id": "7", "x": "1", "y": "1"}, None), (2, 2, {"id": "7", "y": "2"}, {"y": "1"}), (3, 2, {"id": "7", "z": "3"}, None), (1, 1, {"id": "8"}, None), (4, 3, {"id": "8"}, None)]
    spark.createDataFrame([("s", "u", n, None, 0, kind, "d", "t", ["id"], new, old) for n, kind, new, old in changes], kinds).write.parquet(f"{tmp_path}/mutations.parquet")
    spark.createDataFrame([("s", 1, "u")], "source_id string, term_no int, server_uuid string").write.parquet(f"{tmp_path}/data_sources.parquet")
    assert [tuple(r) for r in problems.p1_found(spark, str(tmp_path)).collect()] == [("s", "d", "t", "7", 3, 0)]
    assert [r.entity for r in calls[0].collect()] == [{"id": "7", "x": "1", "y": "2", "z": "3"}]


def test_states_are_carried_from_batch_to_batch(spark):
    rows = [(k, i, 3 if i % 37 == 0 else 1 if i % 23 == 0 else 2, {f"c{i % 5}": str(i)}, None) for k in ("a", "b", None) for i in range(1, 200)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert run(spark, rows) == run(spark, rows, cuts=True) == brute(rows)
        assert places(spark, rows) == {"a": 199, "b": 199, None: 199}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_keys_of_any_type(spark):
    nan, none = float("nan"), None
    rows = [(nan, [1, None], 1, 1, {"x": 1}), (nan, [1, None], 2, 2, {"y": 2}), (none, none, 1, 2, none), (none, none, 2, 2, none), (1.0, [2], 1, 1, {"x": 1}), (1.0, [3], 1, 1, {"x": 3})]
    df = spark.createDataFrame(rows, "f double, a array<int>, seq long, op int, image map<string,int>")
    found = replay.replay(df, ["f", "a"], ["seq"], "op", "image", F.col("seq").cast("double")).collect()
    assert sorted(repr(tuple(r)) for r in found) == sorted(map(repr, [(nan, [1, None], 2, {"x": 1, "y": 2}), (none, none, 2, {}), (1.0, [2], 1, {"x": 1}), (1.0, [3], 1, {"x": 3})]))
