"""The change feed's tables in the form the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.positions import canonical_uuid, position_offset
from tidelog.session import small_side

INSERT, UPDATE, DELETE, INVALID = 1, 2, 3, 4
#: Order of one source's mutations, after which only copies of one mutation are equal.
ORDER = ["term_no", "change_id", "row_pos", "op_seq"]
#: What makes deliveries copies of one mutation.
IDENTITY = ["source_id", "server", "mutation_id", "event_row_position", "mutation_type"]
ROW_KEY = ["source_id", "database_name", "table_name", "pk_value"]
TABLE_KEY = ["source_id", "database_name", "table_name"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_term(df: DataFrame, data_sources: DataFrame) -> DataFrame:
    """Add term_no of the row's server (columns source_id, server_uuid): 1 for a source's first server.

    A source with one server has that server's term whatever the row says. A server that is not listed, or a source
    that is not, gets term 0, before all others. The map of servers has one row a source and is broadcast only if
    it is counted to be small.
    """
    servers = data_sources.filter(F.col("source_id").isNotNull() & F.col("term_no").isNotNull()).select("source_id", F.coalesce(canonical_uuid("server_uuid"), F.lit("")).alias("u"), F.col("term_no").cast("int").alias("t"))
    by_source = servers.groupBy("source_id", "u").agg(F.min("t").alias("t")).groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("u", "t"))).alias("_terms"), F.when(F.count("*") == 1, F.max("t")).alias("_only"))
    named = F.try_element_at("_terms", F.coalesce(canonical_uuid("server_uuid"), F.lit("")))
    return df.drop("term_no").join(small_side(by_source, at_most=data_sources), "source_id", "left").withColumn("term_no", F.coalesce("_only", named, F.lit(0))).drop("_terms", "_only")


def order_hint(term: str = "term_no", change: str = "change_id") -> Column:
    """A double that never decreases in (term, change): ids are below 2^60, and rounding keeps the order."""
    return F.col(term).cast("double") * F.lit(2.0**60) + F.col(change).cast("double")


def with_order(mutations: DataFrame, data_sources: DataFrame) -> DataFrame:
    """Add the columns of ORDER. A null id is read from the position text, a null row position is 0."""
    return (
        with_term(mutations, data_sources)
        .withColumn("change_id", F.coalesce("mutation_id", position_offset("binlog_pos"), F.lit(0)).cast("long"))
        .withColumn("row_pos", F.coalesce("event_row_position", F.lit(0)).cast("int"))
        .withColumn("op_seq", F.when(F.col("mutation_type") == DELETE, 0).otherwise(1))
    )


def pk_value() -> Column:
    """Values of the primary key in the order of its column names, joined by |; null for tables without one.

    A value that the new image lacks is taken from the previous image; one that neither has is the empty text.
    """
    value = lambda k: F.coalesce(F.try_element_at("entity", k), F.try_element_at("previous_entity", k), F.lit(""))
    return F.when(F.size("primary_key") > 0, F.array_join(F.transform(F.array_sort("primary_key"), value), "|"))


def full_image() -> Column:
    """Whether an UPDATE's image replaces the row: it has the key and every column of the previous image, which has more than the key."""
    return (
        (F.size(F.array_except(F.map_keys("previous_entity"), F.map_keys("entity"))) == 0)
        & (F.size(F.array_except("primary_key", F.map_keys("entity"))) == 0)
        & (F.size("previous_entity") > F.size("primary_key"))
    )


def version_order(schema_history: DataFrame, data_sources: DataFrame) -> DataFrame:
    """Add term_no and change_id (from binlog_file_position; 0 if it cannot be read)."""
    return with_term(schema_history, data_sources).withColumn("change_id", F.coalesce(position_offset("binlog_file_position"), F.lit(0)))
