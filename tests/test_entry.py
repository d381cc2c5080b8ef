import os

import pytest

import __spark_entry__ as entry


def test_names_match():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {f"p{n}_found" for n in range(1, 8)} <= set(queries)
    assert all(callable(f) for f in queries.values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["source_id", "database_name", "table_name", "pk_value", "mutation_id", "event_row_position"]
    assert df.count() > 0


def test_the_package_can_be_sent_to_executors(spark):
    import zipfile

    from pyspark import SparkFiles

    from tidelog.session import ship_package

    ship_package(spark)
    with zipfile.ZipFile(SparkFiles.get("tidelog.zip")) as z:
        assert {"tidelog/__init__.py", "tidelog/operators/replay.py"} <= set(z.namelist())


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from tidelog.session import shared_root

    session = lambda master, root: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: root), sparkContext=SimpleNamespace(master=master))
    assert shared_root(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_root(session(master, None))
    assert shared_root(session("local[2]", None)) == shared_root(session("local", None))
