import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelog.model import BINLOG_EVENTS, DELETE, INSERT, UPDATE
from tidelog.operators import enrich, filters, metrics, mutate, route, state, validate

SCHEMA = BINLOG_EVENTS.replace("\n", " ")
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
F123 = (123 << 32)


def log(spark, *events):
    base = {"source_id": "s", "table_id": 0, "server_id": 1, "timestamp_ms": 6, "file_name": "test.123", "file_no": 123, "server_uuid": "u"}
    rows = []
    for n, e in enumerate(events):
        x = base | {"position": n, "next_position": n + 1} | e
        rows.append(tuple((x | {"offset": (x["file_no"] << 32) + x["position"]}).get(c) for c in NAMES))
    return spark.createDataFrame(rows, SCHEMA)


def row(before=None, after=None):
    return (before and [*map(str, before)], after and [*map(str, after)])


def test_filter_golden(spark):
    events = [
        {"event_type": "TABLE_MAP", "table_id": 1, "database": "db", "table_name": "users", "position": 10}, {"event_type": "TABLE_MAP", "table_id": 2, "database": "db", "table_name": "other", "position": 11},
        {"event_type": "WRITE", "table_id": 1, "position": 14}, {"event_type": "WRITE", "table_id": 1, "position": 15}, {"event_type": "UPDATE", "table_id": 1, "position": 16},
        {"event_type": "DELETE", "table_id": 1, "position": 17}, {"event_type": "WRITE", "table_id": 2, "position": 18}, {"event_type": "WRITE", "table_id": 9, "position": 19},
        {"event_type": "XID", "position": 12}, {"event_type": "QUERY", "position": 13}, {"event_type": "START", "position": 9}, {"event_type": "ROTATE", "position": 20}, {"event_type": None, "position": 21},
    ]
    kept = filters.event_filter(["db:users"], F123 + 14)(enrich.table_maps(log(spark, *events)))
    assert sorted(r.position for r in kept.collect()) == [9, 10, 12, 13, 15, 16, 17]
    assert filters.event_filter([], 0)(enrich.table_maps(log(spark, *events[:1]))).count() == 0
    assert spark.range(1).filter(filters.all_of()).count() == 1


def test_duplicates_by_gtid(spark):
    u1, u2 = "a" * 8, "b" * 8
    rows = [{"event_type": "WRITE", "gtid_set": g, "server_uuid": u, "position": p} for p, (g, u) in enumerate([(f"{u1}:1-5", u2), (f"{u1}:1-9", u2), (f"{u1}:1-10", u2), (f"{u1}:1-9", u1), (None, u2)])]
    at = lambda **k: sorted(r.position for r in log(spark, *rows).filter(filters.not_published(F123 + 3, f"{u1}:1-9", u1, **k)).collect())
    assert at() == [2, 4]
    assert at(strict_subset=True) == [1, 2, 4]


def test_context_over_files_equals_one_walk(spark):
    events = [("QUERY", "BEGIN"), ("WRITE", None), ("XID", None), ("GTID", "g1"), ("QUERY", "BEGIN"), ("WRITE", None), ("WRITE", None), ("QUERY", "ALTER TABLE x"), ("WRITE", None), ("START", None), ("XID", None), ("WRITE", None)]
    made = [{"event_type": t, "sql": s if t == "QUERY" else None, "gtid": s if t == "GTID" else None, "file_no": 123 + n // 3, "position": 4 + n} for n, (t, s) in enumerate(events)]
    got = {r.position: (r.begin_txn and r.begin_txn.offset & 0xFFFF, r.last_txn and r.last_txn.offset & 0xFFFF, r.current_gtid, r.last_txn and r.last_txn.gtid) for r in enrich.transaction_context(log(spark, *made)).collect()}
    begin = last = g = lg = None
    for n, (t, s) in enumerate(events):
        if t == "GTID":
            g = s
        elif t == "QUERY" and s == "BEGIN":
            begin = 4 + n
        elif t in ("QUERY", "XID"):
            last, lg = 4 + n, g
        assert got[4 + n] == (begin, last, g, lg), n


def test_table_maps_end_with_their_file(spark):
    tm = {"event_type": "TABLE_MAP", "table_id": 5, "database": "d", "column_types": [1, 2]}
    events = [tm | {"table_name": "a"}, {"event_type": "WRITE", "table_id": 5}, tm | {"table_name": "b"}, {"event_type": "WRITE", "table_id": 5}, {"event_type": "WRITE", "table_id": 5, "file_no": 124, "position": 1}, tm | {"table_name": "b", "position": 50}, tm | {"table_name": "b", "position": 60, "column_types": [1]}]
    df = log(spark, *events)
    rows = enrich.table_maps(df).filter("event_type = 'WRITE'").orderBy("offset").collect()
    assert [r.resolved_table for r in rows] == ["d:a", "d:b", None]
    assert sorted(r.position for r in enrich.map_refetches(df).collect()) == [0, 2, 60]


def test_columns_are_cut_to_the_shorter_list(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [True, False, False], [1, 254]), (["a"], [True], [1, 2]), (None, None, [1])], "n array<string>, p array<boolean>, t array<int>")
    got = [r.c and [tuple(x) for x in r.c] for r in df.select(enrich.table_columns(F.col("n"), F.col("p"), F.col("t")).alias("c")).collect()]
    assert got == [[("a", 1, True, 1), ("b", 254, False, 2)], [("a", 1, True, 1)], None]


def exploded(spark, *events, by_column=False):
    df = log(spark, *events).withColumns({"column_names": F.array(*[F.lit(c) for c in ("id", "name", "age")]), "pk_names": F.array(F.lit("id"))})
    return [(r.op, r.event_row_position, r.op_seq, r.entity, r.previous_entity) for r in mutate.explode_mutations(df, by_column=by_column).orderBy("offset", "event_row_position", "op_seq").collect()]


def test_mutations_golden(spark):
    img = lambda i, a: {"id": str(i), "name": "u", "age": str(a)}
    w = {"event_type": "WRITE", "rows": [row(after=(1, "u", 25)), row(after=(2, "u", 12))]}
    assert exploded(spark, w) == [(INSERT, 0, 1, img(1, 25), None), (INSERT, 1, 1, img(2, 12), None)]
    u = {"event_type": "UPDATE", "rows": [row((1, "u", 25), (1, "u", 26)), row((2, "u", 1), (3, "u", 2))]}
    assert exploded(spark, u) == [(UPDATE, 0, 1, img(1, 26), img(1, 25)), (DELETE, 1, 0, img(2, 1), None), (INSERT, 1, 1, img(3, 2), None)]
    d = {"event_type": "DELETE", "rows": [row(before=(1, "u", 25))]}
    assert exploded(spark, d) == [(DELETE, 0, 0, img(1, 25), None)]
    assert exploded(spark, {"event_type": "XID"}, {"event_type": "TABLE_MAP"}, {"event_type": "WRITE", "rows": []}) == []
    null_key = {"event_type": "UPDATE", "rows": [([None, "a"], [None, "b"])]}
    assert [x[0] for x in exploded(spark, null_key)] == [UPDATE]


def test_changed_columns_golden(spark):
    rows = [({"s": "1", "removed": "x"}, {"s": "1", "added": "y"}, 2), ({"s": "1", "u": "p"}, {"s": "1", "u": "c"}, 2), ({"s": None}, {"s": None}, 2), (None, {"b": "1", "a": "2"}, 1), ({"a": None}, {"a": ""}, 2)]
    df = spark.createDataFrame(rows, "p map<string,string>, e map<string,string>, op int")
    got = [r.c for r in df.select(mutate.changed_columns(F.col("e"), F.col("p"), F.col("op")).alias("c")).collect()]
    assert got == [["added", "removed"], ["u"], [], ["a", "b"], ["a"]]


def test_wire_images_come_back(spark):
    df = spark.createDataFrame([({"a": "é", "b": None, "c": ""},), (None,)], "m map<string,string>")
    assert [r.x for r in df.select(mutate.unwire_image(mutate.wire_image(F.col("m"))).alias("x")).collect()] == [{"a": "é", "b": None, "c": ""}, None]


def test_joiners(spark):
    a, b, c = (spark.createDataFrame([(k, k + n) for k in ks], f"k string, {n} string") for ks, n in (("xy", "a"), ("yz", "b"), ("w", "c")))
    assert {r.k for r in mutate.join_three(a, b, c, ["k"]).collect()} == set("wxyz")


@pytest.mark.parametrize("piece", [1, 3, 1000])
def test_order_is_checked_against_the_row_before(spark, piece):
    offsets = [5, 7, 6, 6, -1, 0, 9, None, 3]
    df = spark.createDataFrame([("s", n, o) for n, o in enumerate(offsets)], "source_id string, n long, offset long")
    at = lambda **k: [r.n for r in validate.order_violations(df, "offset", "n", ["source_id"], piece=piece, **k).orderBy("n").collect()]
    assert at(ignore_special=True) == [2]
    assert at(ignore_special=False) == [2, 4]


def test_schema_validation(spark):
    df = spark.createDataFrame([(1, ["a", "b"], ["b", "a"]), (2, ["a"], ["a", "b"]), (3, ["a", "b", "c"], ["a", "b"]), (4, None, None), (5, None, ["a"])], "i int, r array<string>, t array<string>")
    assert [r.i for r in validate.schema_violations(df, F.col("r"), F.col("t")).orderBy("i").collect()] == [2, 3, 5]


def test_pool(spark):
    df = spark.createDataFrame([("s", k, n) for n, k in enumerate(["4", "6", "9", "2", "1", None])], "source_id string, key string, offset long")
    pooled = route.to_pool(df, "key", 4, ["offset"])
    assert {r.offset: r.member for r in pooled.collect()} == {0: 0, 1: 2, 2: 1, 3: 2, 4: 1, 5: 0}
    last = spark.createDataFrame([(0, 3), (1, 4), (2, 2), (2, 1)], "member int, offset long")
    members = lambda *active: spark.createDataFrame([(m, m in active) for m in range(4)], "member int, active boolean")
    at = lambda m: route.pool_checkpoint(last, m).first().last_published
    assert at(members(0, 1, 2)) == 2
    assert at(members(0, 1, 2, 3)) is None
    assert at(members()) is None


def test_delay_holds_back_young_and_undated_rows(spark):
    df = spark.createDataFrame([(1, 100), (2, 900), (3, None)], "i int, ts_ms long")
    assert [r.i for r in route.delayed(df, 1000, 500).collect()] == [1]


def test_metrics(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 30), ("b", 3, None), (None, 4, 5)], "t string, n int, lag long")
    got = Counter(map(tuple, metrics.counters(df, "m", ["t"], F.col("n")).collect()))
    assert got == Counter([("m", "a", 3), ("m", "b", 3), ("m", None, 4), ("m.untagged", None, 10)])
    assert [tuple(r) for r in metrics.counters(df.limit(0), "m", ["t"]).collect()] == [("m.untagged", None, 0)]
    h = {r.t: (r.n, r.least, r.most, r.mean, r.p50) for r in metrics.histograms(df, "lag", "lag", ["t"], exact=True).collect()}
    assert h["a"] == (2, 10, 30, 20.0, 20.0) and h["b"] == (0, None, None, None, None)
    sketched = {r.t: (r.n, r.least, r.most, r.mean, r.p50) for r in metrics.histograms(df, "lag", "lag", ["t"]).collect()}
    assert sketched["a"] == (2, 10, 30, 20.0, 10) and sketched["b"] == h["b"] and sketched[None] == (1, 5, 5, 5.0, 5)


def test_exact_quantiles_equal_sorting(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 4 + ["b"]), rng.choice([None, 0, 1, 2.5, rng.random() * 9])) for _ in range(400)]
    df = spark.createDataFrame([(t, None if v is None else float(v)) for t, v in rows], "t string, v double")
    got = {r.t: (r.n, r.p50, r.p95) for r in metrics.histograms(df, "m", "v", ["t"], exact=True).collect()}
    for t in ("hot", "b"):
        some = sorted(v for k, v in rows if k == t and v is not None)
        at = lambda q: some[int(q * (len(some) - 1))] + (some[min(len(some) - 1, int(q * (len(some) - 1)) + 1)] - some[int(q * (len(some) - 1))]) * (q * (len(some) - 1) % 1)
        assert got[t] == (len(some), pytest.approx(at(0.5)), pytest.approx(at(0.95)))


def test_kinds_without_mapper_are_an_error(spark):
    df = spark.createDataFrame([("TABLE_MAP",), ("WRITE",)], "event_type string")
    assert [r.m for r in df.select(mutate.mapped().alias("m")).collect()] == [False, True]
    for bad in ("HEARTBEAT", None):
        with pytest.raises(Exception, match="no mapper"):
            spark.createDataFrame([(bad,)], "event_type string").select(mutate.mapped()).collect()


def test_lag_gauge(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 30), ("b", 3, None), (None, 4, 5)], "t string, n int, lag long")
    assert {r.t: r.lag_ms for r in metrics.lag_gauge(df, 100, "lag", ["t"]).collect()} == {"a": 70, "b": None, None: 95}


def test_states_as_tables(spark):
    df = spark.createDataFrame([("s", 1, 5, 10), ("s", 2, 4, 20), ("s", 3, 5, 15), ("t", 4, None, None), ("s", 5, 3, 16)], "source_id string, id long, epoch long, off long")
    assert {r.source_id: r.id for r in state.fenced(df, ["source_id"], "epoch", "id").collect()} == {"s": 3, "t": 4}
    assert sorted((r.id, r.back) for r in state.kept_history(df, ["source_id"], "id", 2).collect()) == [(3, 2), (4, 1), (5, 1)]
    assert sorted((r.attempt, r.id) for r in state.rollback_targets(df, ["source_id"], "id").filter("source_id = 's'").collect()) == [(1, 5), (2, 2)]
    assert sorted(r.id for r in state.accepted_checkpoints(df, ["source_id"], "off", "id").collect()) == [1, 2]
