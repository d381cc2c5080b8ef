import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import gtid, keys, positions, statements
from tidelog.model import mutation_type, spark_type, type_name

U1, U2 = "aaaaaaaa-0000-0000-0000-000000000001", "aaaaaaaa-0000-0000-0000-000000000002"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("written", "canonical"), [
    (f"{U1}:1-123:124:125-200", f"{U1}:1-200"), (f"{U1}:1-201:202-211:239-244:245-300:400-409", f"{U1}:1-211:239-300:400-409"),
    (f"{U1}:1-200:100-123:40-255:40-100:60-100:280-290:270-279", f"{U1}:1-255:270-290"), (f"{U1.upper()}:1-24,\n{U1}:25-706,{U2}:1-23", f"{U1}:1-706,{U2}:1-23"),
    (f"{U2}:5 , {U1}:7", f"{U1}:7-7,{U2}:5-5"), ("", ""), (None, None), (f"{U1}:x", f"{U1}:"),
])
def test_gtid_sets_are_collapsed(spark, written, canonical):
    assert one(spark, gtid.text(gtid.parse(F.lit(written).cast("string")))) == canonical


def test_gtid_containment_matrix(spark):
    sets = ["", "1-191", "192-199", "1-191:192-199", "1-191:193-199", "2-199", "1-200"]
    matrix = ["1111111", "0101101", "0011011", "0001001", "0001101", "0001011", "0000001"]
    text = lambda s: f"{U1}:{s}" if s else ""
    df = spark.createDataFrame([(i, j, text(a), text(b)) for i, a in enumerate(sets) for j, b in enumerate(sets)], "i int, j int, a string, b string")
    got = {(r.i, r.j): r.x for r in df.select("i", "j", gtid.contained(gtid.parse("a"), gtid.parse("b")).alias("x")).collect()}
    assert got == {(i, j): matrix[i][j] == "1" for i in range(7) for j in range(7)}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(0, 8)), max_size=8), st.lists(st.tuples(st.integers(1, 40), st.integers(0, 8)), max_size=8))
def test_gtid_algebra_equals_integer_sets(spark, a, b):
    text = lambda x: f"{U1}:" + ":".join(f"{s}-{s + n}" for s, n in x) if x else ""
    numbers = lambda x: {i for s, n in x for i in range(s, s + n + 1)}
    row = spark.createDataFrame([(text(a), text(b))], "a string, b string").select(gtid.contained(gtid.parse("a"), gtid.parse("b")).alias("c"), gtid.parse("a").alias("p")).first()
    assert row.c == (numbers(a) <= numbers(b))
    got = [i for x in (row.p or {}).get(U1, []) for i in range(x.s, x.e + 1)]
    assert got == sorted(numbers(a))


def position(no, place, gtids, uuid):
    g = gtid.parse(F.lit(gtids).cast("string"))
    return {"file_no": F.lit(no), "position": F.lit(place), "gtids": g, "uuid": F.lit(uuid).cast("string")}


@pytest.mark.parametrize(("a", "b", "want"), [
    ((218, 14, None, None), (218, 27, None, None), -1), ((218, 27, None, None), (219, 11, None, None), -1), ((219, 11, None, None), (219, 11, None, None), 0),
    ((218, 123, f"{U1}:1-200", "u1"), (218, 456, f"{U1}:1-300", "U1"), -1), ((218, 123, f"{U1}:1-200", "u1"), (100, 10, f"{U1}:1-200", "u2"), 0),
    ((218, 123, f"{U1}:1-200", "u1"), (100, 20, f"{U1}:1-200,{U2}:1-456", "u2"), -1), ((218, 456, f"{U1}:1-300", "u1"), (100, 10, f"{U1}:1-200", "u2"), 1),
])
def test_positions_are_compared(spark, a, b, want):
    assert one(spark, gtid.compare_positions(position(*a), position(*b))) == want


def test_position_texts(spark):
    df = spark.createDataFrame([("a.b.000218:14:100",), ("null:0:0",), ("bad",), (None,)], "p string")
    got = [tuple(r) for r in df.select(positions.file_name("p"), positions.position_file_number("p"), positions.position_start("p"), positions.position_next("p"), positions.position_offset("p")).collect()]
    assert got == [("a.b.000218", 218, 14, 100, (218 << 32) + 14), (None, None, 0, 0, None), (None,) * 5, (None,) * 5]
    assert one(spark, positions.offset_of(positions.file_number(F.lit(None).cast("string")), F.lit(0))) == -4294967296
    assert one(spark, positions.offset_of(positions.file_number(F.lit("")), F.lit(4))) == 4
    assert one(spark, positions.log_file_name("mysql-bin-changelog", F.lit(80887))) == "mysql-bin-changelog.080887"
    assert one(spark, positions.log_file_name("mysql-bin-changelog", F.lit(1080887))) == "mysql-bin-changelog.1080887"
    assert one(spark, positions.position_text(F.lit(None).cast("string"), F.lit(None).cast("long"), F.lit(None).cast("long"))) == "null:0:0"


def test_keys(spark):
    arr = lambda *v: F.array(*[F.lit(x).cast("string") for x in v]).cast("array<string>")
    assert one(spark, keys.pk_text(arr())) is None
    assert one(spark, keys.pk_text(arr(None))) == "null"
    assert one(spark, keys.pk_text(arr("1", "Bob"))) == "1Bob"
    assert one(spark, keys.routing_key(F.lit("test"), F.lit("users"), F.lit("1234"))) == "test:users:1234"
    assert one(spark, keys.routing_key(F.lit("test"), F.lit("users"), F.lit(None))) == "test:users:null"
    assert [one(spark, keys.pool_member(F.lit(k), 4)) for k in "46921"] == [0, 2, 1, 2, 1]
    assert one(spark, keys.java_hash(F.lit("a long key whose hash wraps around: zzzzzzzz"))) == _java("a long key whose hash wraps around: zzzzzzzz")
    assert one(spark, keys.java_hash(F.lit(""))) == 0
    image = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    assert one(spark, keys.record_key(F.lit("d"), F.lit("t"), image, arr("b", "a"))) == "d:t:1:2"
    assert one(spark, keys.topic("p", F.lit("localhost"), F.lit("db"), F.lit("t"), F.lit(""))) == "p.localhost-db-t"
    assert one(spark, keys.topic("p", F.lit("localhost"), F.lit("db"), F.lit("t"), F.lit("other"))) == "p.localhost-other-t"


def _java(s):
    h = 0
    for c in s:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return h - 2**32 if h >= 2**31 else h


def test_statements(spark):
    kinds = {"ALTER  TABLE x": "table", "create unique index i on t(a)": "index", "drop SCHEMA s": "database", "GRANT all": "grant", "TRUNCATE t": "other", " CREATE TABLE t": "other", "/* c */ CREATE TABLE t": "other", "CREATE TEMPORARY TABLE t": "other"}
    df = spark.createDataFrame([(s,) for s in kinds], "s string")
    assert {r.s: r.k for r in df.select("s", statements.statement_kind("s").alias("k")).collect()} == kinds
    assert [one(spark, statements.is_begin(F.lit(x))) for x in ("BEGIN", "begin")] == [True, False]
    clean = lambda s: one(spark, statements.without_comments(F.lit(s)))
    assert clean("CREATE/* ! COMMENTS ! */UNIQUE /* ANOTHER COMMENTS ! */INDEX unique_index\nON `d`.`t` (`c`)") == "CREATE UNIQUE INDEX unique_index\nON `d`.`t` (`c`)"
    assert clean("CREATE UNIQUE /*\nLine1  \nLine 2\n*/\nINDEX ON t (c)") == "CREATE UNIQUE \nINDEX ON t (c)"
    assert clean("CREATE TABLE t1(a INT, KEY (a)) /*!50110 KEY_BLOCK_SIZE=1024 */") == "CREATE TABLE t1(a INT, KEY (a)) KEY_BLOCK_SIZE=1024 "
    assert clean("/*!CREATE TABLE t1(a INT, KEY (a))*/") == "CREATE TABLE t1(a INT, KEY (a))"


def test_type_codes(spark):
    names = spark.createDataFrame([(3,), (-4,), (252,), (245,), (None,)], "c int").select(type_name("c").alias("n")).collect()
    assert [r.n for r in names] == ["LONG", "BLOB", "BLOB", "UNKNOWN", "UNKNOWN"]
    kinds = spark.createDataFrame([(1,), (4,), (9,), (None,)], "c int").select(mutation_type("c").alias("k")).collect()
    assert [r.k for r in kinds] == [1, 4, 4, 4]
    assert spark_type(8, "bigint(20) unsigned").simpleString() == "decimal(20,0)"
    assert spark_type(246, "decimal(9,4)").simpleString() == "decimal(9,4)"
    assert spark_type(246, "decimal(65,4)").simpleString() == "string"
    assert spark_type(11).simpleString() == "interval day to second"
    assert spark_type(1, "tinyint(3) unsigned").simpleString() == "smallint"
    assert spark_type(245).simpleString() == "string"
