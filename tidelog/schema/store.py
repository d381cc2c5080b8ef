"""History of table schemas, made from statements in the log, and its lookup and clean-up."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.statements import SYSTEM_DATABASES
from tidelog.schema import ddl

SCHEMA = """id bigint, database string, table_name string, position string, server_uuid string, gtid_set string, gtid string, sql string,
timestamp_ms bigint, columns array<struct<name:string,data_type:string,column_type:string,primary_key:boolean>>, metadata string"""


@dataclass(frozen=True)
class Statement:
    """One QUERY event."""

    sql: str
    database: str | None
    position: str
    timestamp_ms: int = 0
    server_uuid: str | None = None
    gtid_set: str | None = None
    gtid: str | None = None


def _relevant(sql: str) -> str | None:
    import re

    from tidelog.functions import statements as s

    for kind, pattern in (("table", s.TABLE_STATEMENT), ("index", s.INDEX_STATEMENT), ("database", s.DATABASE_STATEMENT)):
        if re.match(pattern, sql, re.IGNORECASE):
            return kind
    return None


class SchemaTracker:
    """Folds statements, in their order, into rows of schema history. Schema statements are few; this runs on the driver.

    Two catalogs: `current`, what the history's rows say, and `shadow`, what the statements made. After a statement the
    two are compared database by database: a table that is gone gives a row without columns, a new or changed one a row
    with its columns; if nothing differs, a marker row without table keeps the statement from being processed again.
    A statement that was processed before (same gtid, or same position without one) changes nothing, and a statement the
    interpreter cannot follow gives a marker whose metadata says so.
    """

    def __init__(self, rows: Iterable[dict] = (), enabled: bool = True):
        self.enabled = enabled
        self.rows: list[dict] = []
        self._next = 1
        self._seen: set = set()  # what statements are known by: their gtid, else position and server
        self.current, self.shadow = ddl.Catalog(), ddl.Catalog()
        for row in rows:
            self._keep(dict(row))
        self.shadow = self.current.copy()

    def _keep(self, row: dict) -> None:
        self.rows.append(row)
        self._next = max(self._next, row["id"] + 1)
        self._seen.add(("place", row["position"], row["server_uuid"]))
        if row["gtid"] is not None:
            self._seen.add(("gtid", row["gtid"]))
        if row["database"] is None or row["table_name"] is None:
            return
        tables = self.current.databases.setdefault(row["database"], {})
        if row["columns"]:
            tables[row["table_name"]] = [ddl.Column(**c) for c in row["columns"]]
        else:
            tables.pop(row["table_name"], None)

    def _put(self, s: Statement, database: str | None, table: str | None, columns: list[ddl.Column], metadata: dict | None = None) -> dict:
        row = {"id": self._next, "database": database, "table_name": table, "position": s.position, "server_uuid": s.server_uuid, "gtid_set": s.gtid_set, "gtid": s.gtid, "sql": s.sql, "timestamp_ms": s.timestamp_ms, "columns": [asdict(c) for c in columns], "metadata": json.dumps(metadata or {})}
        self._keep(row)
        return row

    def bootstrap(self, catalog: ddl.Catalog, position: str, server_uuid: str | None = None, gtid_set: str | None = None) -> list[dict]:
        """First rows of a history: all tables as they are now, at the earliest position; the server's own databases are left out."""
        now = int(time.time() * 1000)
        self.shadow = ddl.Catalog({d: tables for d, tables in catalog.copy().databases.items() if d not in SYSTEM_DATABASES})
        return [self._put(Statement("", d, position, now, server_uuid, gtid_set), d, t, columns) for d, tables in sorted(self.shadow.databases.items()) for t, columns in sorted(tables.items())]

    @classmethod
    def initialize(cls, history: DataFrame | None, beyond: Column, live: ddl.Catalog, earliest: str) -> SchemaTracker:
        """Tracker of a source that starts: its history read up to a position, or, without history, the live tables at the earliest one."""
        if history is None or history.isEmpty():
            tracker = cls()
            tracker.bootstrap(live, earliest)
            return tracker
        stop = history.filter(beyond).agg(F.min("id")).first()[0]
        read = history if stop is None else history.filter(F.col("id") < stop)
        return cls(r.asDict(recursive=True) for r in read.orderBy("id").toLocalIterator())  # schema statements are few

    def process(self, s: Statement) -> list[dict]:
        """Rows that a statement adds to the history."""
        kind = _relevant(s.sql)
        if not self.enabled or kind is None:
            return []
        if (("gtid", s.gtid) if s.gtid is not None else ("place", s.position, s.server_uuid)) in self._seen:
            return []
        session = None if kind == "database" or (s.database or "") in SYSTEM_DATABASES else s.database
        try:
            self.shadow = ddl.apply(self.shadow, s.sql, session)
        except (ddl.UnsupportedStatement, KeyError) as e:
            return [self._put(s, s.database, None, [], {"unsupported": str(e)})]
        added: list[dict] = []
        known, made = self.current.databases, self.shadow.databases
        for database in [*sorted(set(made) - set(known)), *sorted(known)]:
            before, after = known.get(database, {}), made.get(database, {})
            added += [self._put(s, database, t, []) for t in sorted(set(before) - set(after))]
            added += [self._put(s, database, t, after[t]) for t in sorted(after) if before.get(t) != after[t]]
        return added or [self._put(s, s.database, None, [])]

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r[c.split()[0]] for c in ("id", "database", "table_name", "position", "server_uuid", "gtid_set", "gtid", "sql", "timestamp_ms", "columns", "metadata")) for r in self.rows], SCHEMA)


def until(history: DataFrame, beyond: Column, keys: list[str], id_column: str = "id", scope: list[str] | None = None) -> DataFrame:
    """Schemas in force when the history is read up to a position: in the order of ids, up to the first row that lies beyond it.

    beyond: whether a row lies after the position. Rows of a later id are not read even if they lie before it. Per table
    the last row counts; a table whose last row has no columns is gone; rows without table are no schemas.
    scope: columns that tell histories apart (each source has its own).
    """
    scope = scope or []
    stops = history.filter(beyond).groupBy(*scope).agg(F.min(id_column).alias("_stop"))
    read = history.join(stops, scope, "left") if scope else history.crossJoin(F.broadcast(stops))  # one row without scope
    read = read.filter(F.col("_stop").isNull() | (F.col(id_column) < F.col("_stop"))).drop("_stop").dropna(subset=keys)
    w = Window.partitionBy(*scope, *[k for k in keys if k not in scope]).orderBy(F.desc(id_column))
    return read.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def changed_tables(before: DataFrame, after: DataFrame, keys: list[str], columns: str) -> DataFrame:
    """What a history must gain so that it says `after` instead of `before`: keys, columns. A table that is gone gets no columns; one that is new
    or has other columns gets those it has now. Both sides have one row a table; null keys equal each other."""
    a, b = before.select(*keys, F.col(columns).alias("_was")).alias("a"), after.select(*keys, F.col(columns).alias("_is")).alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = a.join(b, reduce(lambda x, y: x & y, same), "full_outer").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], "_was", "_is")
    return both.filter(~F.col("_was").eqNullSafe(F.col("_is"))).select(*keys, F.coalesce("_is", F.slice("_was", 1, 0)).alias(columns))


def applied(rows: DataFrame, sql: str, database: str, table: str, columns: str, into: str) -> DataFrame:
    """The columns (name, column_type) that a table has after a statement, from those it had before: by row, in batches of rows.

    into is null where the statement cannot be followed (see ddl.apply) or there is none. columns: array of (col_name, column_type).
    """
    @F.pandas_udf("array<struct<name:string,column_type:string>>")
    def run(s: pd.Series, d: pd.Series, t: pd.Series, c: pd.Series) -> pd.Series:
        def one(statement, db, name, had):
            if statement is None or db is None or name is None:
                return None
            catalog = ddl.Catalog({db: {name: [ddl.Column(x["col_name"], "", x["column_type"]) for x in ([] if had is None else had)]}})
            try:
                found = ddl.apply(catalog, statement, db).table(db, name)
            except (ddl.UnsupportedStatement, KeyError):
                return None
            return [{"name": x.name, "column_type": x.column_type} for x in found or []]

        return pd.Series([one(*x) for x in zip(s, d, t, c)], dtype=object)

    return rows.withColumn(into, run(F.col(sql), F.col(database), F.col(table), F.transform(columns, lambda c: F.struct(c["col_name"].alias("col_name"), c["column_type"].alias("column_type")))))


def prefixed(sql: str, prefix: str) -> Column:
    """Statements with a prefix before every database name (ddl.with_prefix)."""
    @F.pandas_udf("string")
    def run(s: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else ddl.with_prefix(a, b) for a, b in zip(s, p)], dtype=object)

    return run(F.col(sql), F.col(prefix))


def rows_to_delete(history: DataFrame, older: Column, keys: list[str], table: str, columns: str, id_column: str = "id") -> DataFrame:
    """Ids that a clean-up removes: rows older than the earliest position that anyone still needs.

    Marker rows (no table) if they are older. Of each table, in the order of ids, the rows before the first that is not
    older, but for the one that is in force now (the table's last row, if it has columns).
    """
    marked = history.withColumn("_older", F.coalesce(older, F.lit(False)))
    markers = marked.filter(F.col(table).isNull() & F.col("_older")).select(id_column)
    of_table = marked.filter(F.col(table).isNotNull())
    first_newer = F.min(F.when(~F.col("_older"), F.col(id_column))).over(Window.partitionBy(*keys))
    last = F.max(id_column).over(Window.partitionBy(*keys))
    judged = of_table.withColumns({"_stop": first_newer, "_last": last})
    in_force = (F.col(id_column) == F.col("_last")) & (F.size(columns) > 0)
    rows = judged.filter((F.col("_stop").isNull() | (F.col(id_column) < F.col("_stop"))) & ~in_force).select(id_column)
    return markers.unionByName(rows)


class SchemaStore:
    """Append-only Parquet table of schema history of one source."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def append_new(self, rows: DataFrame) -> None:
        """Append the rows whose ids the store does not have, so that a repeated batch adds nothing."""
        if not rows.isEmpty():
            self.append(rows.join(self.read().select("id"), "id", "left_anti") if self.exists() else rows)

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def at(self, position: str) -> DataFrame:
        return self.read().filter(F.col("position") == position)

    def by_gtid(self, gtid: str) -> DataFrame:
        return self.read().filter(F.col("gtid") == gtid)

    def compress(self, older: Column, to: str) -> SchemaStore:
        """Write what a clean-up leaves to a new place (readers of the old one are not disturbed)."""
        history = self.read()
        gone = rows_to_delete(history, older, ["database", "table_name"], "table_name", "columns")
        history.join(gone, "id", "left_anti").write.mode("overwrite").parquet(to)
        return SchemaStore(self.spark, to)

    def archive(self, now: time.struct_time | None = None) -> str:
        """Move the history aside, under its name and the time; returns the new place."""
        to = f"{self.path}_{time.strftime('%Y%m%d%H%M%S', now or time.gmtime())}"
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        source = jvm.org.apache.hadoop.fs.Path(self.path)
        source.getFileSystem(conf).rename(source, jvm.org.apache.hadoop.fs.Path(to))
        return to
