"""Session set-up, the shared working folder, and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a dimension is broadcast. Beyond it the join is left to the planner (sort-merge, AQE skew split).
BROADCAST_ROWS = 200_000
#: Characters of its texts, arrays and maps, written out.
BROADCAST_BYTES = 128 << 20


def build_session(app: str = "tidelog", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session with the settings this library expects; conf (dots as __) overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster on which it is not installed: its Python operators run there. Once a session is enough."""
    folder = tempfile.mkdtemp(prefix="tidelog-package-")  # the driver serves the file from here for as long as executors come and go
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    here = os.path.dirname(os.path.abspath(__file__))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/tidelog", "zip", os.path.dirname(here), os.path.basename(here)))


_own_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster names it in spark.checkpoint.dir.

    Only in local mode (tests, a laptop), where one machine is all there is, a temporary folder stands in for a missing setting; it is
    removed when the process ends. The session's settings are not changed. On a cluster a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="tidelog-"))
        atexit.register(shutil.rmtree, _own_root[0], ignore_errors=True)
    return _own_root[0]


def shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh path for this application below the shared folder; see remove_working_tables()."""
    return f"{shared_root(spark)}/tidelog/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex[:12]}"


def remove_working_tables(spark: SparkSession) -> None:
    """Remove all that shared_folder() has given to this application. DataFrames that read it must have been computed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/tidelog/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    """Tasks that a balanced shuffle should have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, at_most: DataFrame | None = None) -> DataFrame:
    """Mark df for broadcasting if it is proved to have at most max_rows rows and BROADCAST_BYTES of texts, else return it unmarked.

    Rows after the first max_rows + 1 are not looked at. at_most: a DataFrame that has as many rows (or entries of df's maps and arrays) as df
    or more, of bounded width, and is cheaper to count. An unmarked side gets whatever join the planner picks.
    """
    if at_most is not None:
        return F.broadcast(df) if at_most.limit(max_rows + 1).count() <= max_rows else df
    wide = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    width = F.sum(sum((F.coalesce(F.length(F.to_json(F.struct(F.col(f"`{c}`").alias("x")))), F.lit(0)) for c in wide), F.lit(0)))
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(width, F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= BROADCAST_BYTES else df


def spread_out(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are tasks, for work that is heavy a row. Large inputs are left as they are."""
    n = parallelism(df.sparkSession)
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)
