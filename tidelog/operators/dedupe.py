"""Exactly one copy of records that were delivered at least once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.session import parallelism, shared_folder
from tidelog.shared import Folder, SharedLog

#: Rows that a bucket of a new store has at most, about.
BUCKET_ROWS = 5_000_000


def first_copies(df: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """The first row of each identity; nulls equal nulls. Row number 1 is kept on the map side too, so a group of copies of any size shrinks to one row a task before the exchange."""
    w = Window.partitionBy(*identity).orderBy(*order)
    return df.withColumn("_copy", F.row_number().over(w)).filter("_copy = 1").drop("_copy")


class CopyStore:
    """Hash-bucketed, sorted runs of records, one record an identity; a table that lasts.

    Each upsert collapses copies within itself and adds one run, sorted by identity in every bucket. Compaction merges two
    runs at a time into one: a sort-merge join of bucketed and sorted tables, which needs neither an exchange nor a sort to
    bring equal identities together; the first by order stays. Upserts are idempotent: a run of a name that the store has
    is replaced, and copies in different runs collapse at compaction.

    The store's runs stand in a log beside them (SharedLog), so a store opened on the same path, in another session too,
    goes on where the last one was; two writers cannot lose each other's runs. Files of runs that were replaced are removed.

    identity, order, payload: columns of the records; order and payload are kept, and may hold identity's columns. order must be
    total for a defined result; ties leave either. Null identities equal each other. Names starting with _ and ending
    with _ are reserved. buckets: of a new store; default: one a task, and one for each BUCKET_ROWS rows of its first upsert.
    """

    def __init__(self, spark: SparkSession, identity: list[str], order: list[str], payload: list[str], path: str | None = None, buckets: int | None = None):
        self.spark, self.identity, self.order = spark, identity, order
        self.columns = list(dict.fromkeys([*order, *payload]))
        self.path = path or shared_folder(spark, "copies")
        self.wanted = buckets
        self.log = SharedLog(spark, f"{self.path}/log")

    def _key(self) -> Column:
        """Identity as one text: every value with its length before it, null as a sign of its own."""
        text = lambda c: F.col(c).cast("string")
        return F.concat(*[F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in self.identity])

    def _state(self, entries: list[dict]) -> dict:
        return entries[-1] if entries else {"snapshot": True, "buckets": None, "schema": None, "runs": {}}

    def _buckets(self, df: DataFrame) -> int:
        found = self._state(self.log.read()[1])["buckets"]
        return found or self.wanted or max(parallelism(self.spark), -(-df.count() // BUCKET_ROWS))

    def _save(self, rows: DataFrame, folder: str, buckets: int, by: list[str]) -> None:
        name = f"tidelog_copies_{uuid.uuid4().hex}"
        writer = rows.write.format("parquet").option("path", f"{self.path}/runs/{folder}").bucketBy(buckets, "_key").sortBy("_key")
        (writer.partitionBy(*by) if by else writer).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the files stay

    def _replace(self, gone: list[str], new: dict[str, str], buckets: int, schema: str) -> bool:
        """Put new runs (name -> folder) in the place of others; False if one that should go is no longer there."""

        def decide(entries: list[dict]) -> tuple[dict | None, tuple]:
            state = self._state(entries)
            if any(n not in state["runs"] for n in gone) or state["buckets"] not in (None, buckets):
                return None, (False, [])
            left = {n: f for n, f in state["runs"].items() if n not in gone}
            old = [state["runs"][n] for n in gone] + [f for n, f in left.items() if n in new]
            return {"snapshot": True, "buckets": buckets, "schema": schema, "runs": left | new}, (True, old)

        done, old = self.log.change(decide)
        self.log.trim()
        files = Folder(self.spark, f"{self.path}/runs")
        for f in old:
            files.remove(f)
        return done

    def upsert(self, df: DataFrame, run: str | Column) -> None:
        """Apply a batch. run: its name, or a column that names the run of each row (several batches in one pass)."""
        named = F.lit(run) if isinstance(run, str) else F.coalesce(run.cast("string"), F.lit("none"))
        buckets = self._buckets(df)
        rows = df.select(*self.columns, self._key().alias("_key"), named.alias("run_"))
        w = Window.partitionBy("_key", "run_").orderBy(*self.order)
        kept = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
        folder = uuid.uuid4().hex
        self._save(kept.repartition(buckets, "_key").sortWithinPartitions("run_", "_key"), folder, buckets, ["run_"])
        runs = {n: f"{folder}/{n}" for n in Folder(self.spark, f"{self.path}/runs/{folder}").names()}
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "run_")
        if runs and not self._replace([], runs, buckets, schema):
            raise RuntimeError("another writer has made the store with another number of buckets")

    def _run(self, folder: str, state: dict, known: list[str]) -> DataFrame:
        name = f"tidelog_copies_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({state['schema']}) USING parquet CLUSTERED BY (_key) SORTED BY (_key) INTO {state['buckets']} BUCKETS LOCATION '{self.path}/runs/{folder}'")
        known.append(name)
        return self.spark.table(name)

    def merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Two runs as one: of an identity that both have, the first by order."""
        x, y = a.alias("x"), b.alias("y")
        both = x.hint("merge").join(y, "_key", "full_outer")
        first = F.struct(*[f"x.{c}" for c in self.order]) <= F.struct(*[f"y.{c}" for c in self.order])
        left = F.col("x._key").isNotNull() & (F.col("y._key").isNull() | first)
        return both.select(F.coalesce("x._key", "y._key").alias("_key"), *[F.when(left, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}")).alias(c) for c in self.columns])

    def compact(self) -> DataFrame:
        """Merge all runs into one; one row an identity, the first by order over all runs. An empty store has no rows."""
        while len((state := self._state(self.log.read()[1]))["runs"]) > 1:
            pair = [*state["runs"]][:2]  # merged ones are put at the end: runs of like size meet
            known: list[str] = []
            folder = uuid.uuid4().hex
            ordered, before = "spark.sql.legacy.bucketedTableScan.outputOrdering", self.spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering")
            self.spark.conf.set(ordered, "true")  # a bucket of a run is one sorted file
            try:
                self._save(self.merged(*[self._run(state["runs"][n], state, known) for n in pair]), folder, state["buckets"], [])
            finally:
                self.spark.conf.set(ordered, before)
                for name in known:
                    self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            if not self._replace(pair, {f"merged-{folder}": folder}, state["buckets"], state["schema"]):
                Folder(self.spark, f"{self.path}/runs").remove(folder)  # another writer was quicker
        if not state["runs"]:
            raise ValueError("nothing was upserted")
        (folder,) = state["runs"].values()
        return self.spark.read.schema(state["schema"]).parquet(f"{self.path}/runs/{folder}").select(*self.columns)

    def remove(self) -> None:
        """Remove the store and its files. What compact() returned must have been computed by then."""
        Folder(self.spark, self.path).remove()


def batches_by(df: DataFrame, column: str, runs: int) -> Column:
    """Name of one of `runs` runs of about equal ranges of an integer column; null rows and an empty df have run 0."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return F.lit("0")
    width = max(1, -(-(high - low + 1) // runs))
    return F.coalesce(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(0)).cast("string")


def repeated_deliveries(df: DataFrame, identity: list[str], order: list[str], delivery: str, batch: str, runs: int = 4, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(first copies, repeated deliveries) through a CopyStore.

    delivery must be unique; it is also the last tie-break if order holds it; rows without one cannot be named and are all repeats. Repeats are all rows whose delivery is not
    a first copy's: an anti-join on the unique delivery, which cannot be uneven. path: of a store that lasts; else it is one of
    this application (see session.remove_working_tables). An empty df has no copies.
    """
    store = CopyStore(df.sparkSession, identity, order, [delivery], path)
    store.upsert(df, batches_by(df, batch, runs))
    first = store.compact() if store.log.folder.names() else df.select(*store.columns).limit(0)
    return first, df.join(first.select(delivery), delivery, "left_anti")
