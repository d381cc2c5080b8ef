"""What a server says about itself: by JDBC, or from tables of the same shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.statements import SYSTEM_DATABASES

Query = Callable[[str], DataFrame]


def jdbc_queries(spark: SparkSession, url: str, user: str, password: str) -> Query:
    """Runs a query on the server. Needs a MySQL driver on the class path, which this library does not bring."""
    return lambda sql: spark.read.format("jdbc").options(url=url, user=user, password=password, query=sql).load()


class Server:
    """Metadata of a server through a function that runs queries."""

    def __init__(self, query: Query):
        self.query = query

    def variable(self, name: str) -> str | None:
        rows = self.query(f"SELECT VARIABLE_VALUE AS value FROM performance_schema.global_variables WHERE VARIABLE_NAME = '{name}'").take(1)
        return rows[0]["value"] if rows else None

    def uuid(self) -> str | None:
        return self.variable("server_uuid")

    def gtid_mode(self) -> bool:
        return (self.variable("gtid_mode") or "").upper() == "ON"

    def master_status(self) -> DataFrame:
        return self.query("SHOW MASTER STATUS")

    def log_files(self) -> DataFrame:
        return self.query("SHOW BINARY LOGS")

    def create_statement(self, database: str, table: str) -> str:
        quote = lambda n: "`" + n.replace("`", "``") + "`"
        return self.query(f"SHOW CREATE TABLE {quote(database)}.{quote(table)}").first()[1]

    def columns(self) -> DataFrame:
        return self.query("SELECT TABLE_SCHEMA, TABLE_NAME, COLUMN_NAME, DATA_TYPE, COLUMN_TYPE, COLUMN_KEY, ORDINAL_POSITION FROM information_schema.COLUMNS")

    def tables(self) -> DataFrame:
        return self.query("SELECT TABLE_SCHEMA, TABLE_NAME, TABLE_TYPE FROM information_schema.TABLES")


def user_databases(tables: DataFrame) -> DataFrame:
    return tables.select(F.col("TABLE_SCHEMA").alias("database")).distinct().filter(~F.col("database").isin(*SYSTEM_DATABASES))


def base_tables(tables: DataFrame, database: str) -> DataFrame:
    """Tables proper: no views."""
    return tables.filter((F.col("TABLE_SCHEMA") == database) & (F.col("TABLE_TYPE") == "BASE TABLE")).select(F.col("TABLE_NAME").alias("table_name"))


def table_columns(columns: DataFrame) -> DataFrame:
    """(database, table_name, columns) with columns in their order; primary_key where the server's key mark is PRI."""
    c = F.struct(F.col("ORDINAL_POSITION").cast("int").alias("at"), F.col("COLUMN_NAME").alias("name"), F.col("DATA_TYPE").alias("data_type"), F.col("COLUMN_TYPE").alias("column_type"), (F.col("COLUMN_KEY") == "PRI").alias("primary_key"))
    grouped = columns.groupBy(F.col("TABLE_SCHEMA").alias("database"), F.col("TABLE_NAME").alias("table_name")).agg(F.array_sort(F.collect_list(c)).alias("c"))
    return grouped.select("database", "table_name", F.transform("c", lambda x: F.struct(x["name"].alias("name"), x["data_type"].alias("data_type"), x["column_type"].alias("column_type"), x["primary_key"].alias("primary_key"))).alias("columns"))
