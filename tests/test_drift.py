from pyspark.sql import functions as F

from tidelog.operators import drift
from tidelog.plans import problems

HISTORY = "id long, t string, columns array<struct<col_name:string,data_type:string,column_type:string,primary_key:boolean>>, sql string"


def cols(*specs):
    return [(n, k.split("(")[0], k, False) for n, k in (s.split(" ", 1) for s in specs)]


def changes(spark, rows):
    df = spark.createDataFrame(rows, HISTORY)
    v = drift.schema_versions(df, ["t"], ["id"], F.col("id").cast("double"), "columns", "sql")
    return sorted(map(tuple, drift.column_changes(v, ["id"]).collect()))


def test_stated_renames(spark):
    statements = {
        "ALTER TABLE t CHANGE a b int": [("a", "b")],
        "alter  table `d`.`t` add x int, change column `A` `c d` varchar(3) , rename column e to f;": [("a", "c d"), ("e", "f")],
        "ALTER TABLE t CHANGE a a int": [],
        "ALTER TABLE t ADD c int /* , change x y int */": [],
        "ALTER TABLE t ADD c varchar(20) DEFAULT ', change x y int'": [],
        "RENAME TABLE a TO b": [],
        "ALTER TABLE t RENAME TO u": [],
        "ALTER TABLE t MODIFY x decimal(9,4),\n  CHANGE COLUMN y z int": [("y", "z")],
        None: [],
    }
    df = spark.createDataFrame([(s,) for s in statements], "sql string").select("sql", drift.stated_renames(F.col("sql")).alias("r"))
    assert {r.sql: [tuple(x) for x in r.r] for r in df.collect()} == statements


def test_column_changes(spark):
    rows = [
        (1, "t", cols("id int", "a varchar(3)", "b int"), None),
        (2, "t", cols("b INT", "id  int", "a varchar( 3 )"), None),  # order and spelling
        (3, "t", cols("id bigint", "c varchar(9)", "d int"), "ALTER TABLE t CHANGE a c varchar(9), DROP b, ADD d int, MODIFY id bigint"),
        (4, "t", cols("id bigint", "x varchar(9)", "d int"), "ALTER TABLE t COMMENT 'CHANGE c x'"),  # no rename is stated
        (5, "t", [], "DROP TABLE t"),
        (6, "t", cols("id int"), "CREATE TABLE t (id int)"),
        (7, "t", None, None),
        (8, "t", cols("id int", "n int"), None),
        (9, "t", cols("n int", "id int"), "ALTER TABLE t CHANGE id n int, CHANGE n id int"),  # swapped
        (10, None, cols("z int"), None),
    ]
    assert changes(spark, rows) == sorted([
        (3, "renamed", "a", "c"), (3, "retyped", "a", "c"), (3, "removed", "b", ""), (3, "added", "", "d"), (3, "retyped", "id", "id"),
        (4, "removed", "c", ""), (4, "added", "", "x"), (9, "renamed", "id", "n"), (9, "renamed", "n", "id"),
    ])
    assert changes(spark, []) == []


def test_fingerprint_ignores_order_and_spelling(spark):
    rows = [(1, "t", cols("a int(11)", "b text"), None), (2, "t", cols("b TEXT", "a INT( 11 )"), None), (3, "t", cols("a int(11)"), None), (4, "t", None, None)]
    f = [r.f for r in spark.createDataFrame(rows, HISTORY).orderBy("id").select(drift.fingerprint(F.col("columns")).alias("f")).collect()]
    assert f[0] == f[1] and len(set(f)) == 3


def test_rows_are_routed_through_all_later_renames_and_casts(spark):
    rows = [
        (1, "t", cols("id int", "a varchar(3)"), None),
        (2, "t", cols("id int", "b varchar(3)"), "ALTER TABLE t CHANGE a b varchar(3)"),
        (3, "t", cols("id bigint", "c int"), "ALTER TABLE t CHANGE b c int, MODIFY id bigint"),
        (4, "t", cols("id bigint"), "ALTER TABLE t DROP c"),
        (5, "t", cols("id bigint", "c text"), "ALTER TABLE t ADD c text"),
    ]
    df = spark.createDataFrame(rows, HISTORY)
    v = drift.schema_versions(df, ["t"], ["id"], F.col("id").cast("double"), "columns", "sql").withColumnRenamed("id", "version")
    routes = drift.unified_columns(drift.lineage(v, ["t"], ["version"], "version"), v, ["t"], ["version"], "version")
    images = spark.createDataFrame([(1, {"id": " 07", "a": "12"}), (2, {"id": "8", "b": "x"}), (5, {"id": "9", "c": "new", "stray": "s"})], "version long, image map<string,string>")
    got = {r.version: dict(r.out) for r in images.join(routes, "version").select("version", drift.route_image(F.col("image"), F.col("route")).alias("out")).collect()}
    assert got == {1: {"id": "7", "c_2": "12"}, 2: {"id": "8", "c_2": "x"}, 5: {"id": "9", "c": "new", "stray": "s"}}


def _feed(tmp_path, spark, mutations, versions):
    """A change feed of one table: mutations (id, image, columns with their codes), versions (schema_id, position, columns, sql)."""
    spark.createDataFrame([("s", 1, None)], "source_id string, term_no int, server_uuid string").write.parquet(f"{tmp_path}/data_sources.parquet")
    rows = [(p, "s", None, 2**32 + p, 0, 1, f"b.1:{p}:0", "d", "t", image, [(n, c, False, i) for i, (n, c) in enumerate(cs)]) for p, image, cs in mutations]
    kinds = "delivery_id long, source_id string, server_uuid string, mutation_id long, event_row_position int, mutation_type int, binlog_pos string, database_name string, table_name string, entity map<string,string>, table_columns array<struct<col_name:string,col_type:long,is_primary_key:boolean,col_position:int>>"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/mutations.parquet")
    rows = [(i, "s", None, f"b.000001:{p}:0", "d", "t", c, sql) for i, p, c, sql in versions]
    kinds = "schema_id long, source_id string, server_uuid string, binlog_file_position string, database_name string, table_name string, column_list array<struct<col_name:string,data_type:string,column_type:string,primary_key:boolean>>, sql_text string"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/schema_history.parquet")
    return str(tmp_path)


def test_deliveries_before_the_first_version_are_routed_by_their_column_list(spark, tmp_path):
    ab, cb = [("id", 3), ("a", 15)], [("id", 3), ("c", 15)]
    versions = [(7, 50, cols("id int(11)", "a varchar(3)"), None), (8, 90, cols("id int(11)", "c varchar(3)"), "ALTER TABLE t CHANGE a c varchar(3)")]
    early = [("id", 3), ("a", 15), ("gone", 15)]  # in no version
    mutations = [(5, {"id": "1", "a": "x", "gone": "g"}, early), (10, {"id": "2", "a": "y"}, ab), (20, {"id": "3", "a": "z"}, cb), (60, {"id": "4", "a": "w"}, cb), (95, {"id": "5", "c": "v"}, cb)]
    sf = _feed(tmp_path, spark, mutations, versions)
    got = {r.delivery_id: (r.schema_id, dict(e.split("=") for e in r.unified_row.split(";"))) for r in problems.p4_unified(spark, sf).collect()}
    assert {k: v[0] for k, v in got.items()} == {5: None, 10: 7, 20: 7, 60: 7, 95: 8}
    assert {k: v[1]["c"] for k, v in got.items()} == {5: "x", 10: "y", 20: "z", 60: "w", 95: "v"}
    assert got[5][1]["gone"] == "g" and all("a" not in v[1] for v in got.values())
    steps = [(r.schema_id, r.change_kind, r.old_name, r.new_name) for r in problems.p4_feed_changes(spark, sf).collect()]
    assert steps == [(7, "removed", "gone", "")]


def test_stated_defaults(spark):
    statements = {
        "ALTER TABLE t ADD a int NOT NULL DEFAULT 0 AFTER x, ADD COLUMN `B` varchar(9) DEFAULT 'it''s, add q int default 3'": {"a": "0", "b": "it's, add q int default 3"},
        "ALTER TABLE t ADD a decimal(9,2) COMMENT 'default 9' default -1.5 /* don't, add q int default 1 */, add d int": {"a": "-1.5"},
        "ALTER TABLE t ADD a timestamp DEFAULT CURRENT_TIMESTAMP, ADD b int DEFAULT NULL, MODIFY c int DEFAULT 4": {},
        None: {},
    }
    df = spark.createDataFrame([(s,) for s in statements], "sql string").select("sql", drift.stated_defaults(F.col("sql")).alias("d"))
    assert {r.sql: r.d for r in df.collect()} == statements


def test_every_row_has_all_columns_of_the_one_schema(spark, tmp_path):
    first, last = [("id", 3), ("a", 15), ("old", 15)], [("id", 3), ("a", 15), ("n", 3), ("m", 3)]
    versions = [(1, 1, cols("id int", "a varchar(3)", "old varchar(3)"), None), (2, 50, cols("id int", "a varchar(3)", "n int", "m int"), "ALTER TABLE t DROP old, ADD n int NOT NULL DEFAULT '07', ADD m int")]
    mutations = [(10, {"id": "1", "a": "x", "old": "o"}, first), (20, {"id": "2", "a": None, "old": ""}, first), (60, {"id": "3", "a": "y", "n": "4", "m": None}, last), (70, {"id": "5"}, last), (80, {"id": "6", "only": "f"}, [*last, ("only", 15)])]
    got = {r.delivery_id: r.unified_row for r in problems.p4_unified(spark, _feed(tmp_path, spark, mutations, versions)).collect()}
    assert got == {
        10: r"a=x;id=1;m=\N;n=7;old=o;only=\N", 20: r"a=\N;id=2;m=\N;n=7;old=;only=\N", 60: r"a=y;id=3;m=\N;n=4;old=\N;only=\N",
        70: r"a=\N;id=5;m=\N;n=\N;old=\N;only=\N", 80: r"a=\N;id=6;m=\N;n=\N;old=\N;only=f",
    }
