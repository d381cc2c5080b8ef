"""Queries p8 to p10 over the texts. SQL cannot express their operators; tests/llm hold them against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import leakage, packing, reading


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Every text, or piece of a text beyond the capacity, with its container."""
    return packing.pack(_table(spark, sf, "documents"), "doc_id", "text")


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How full the containers are: by tenths of the capacity."""
    by_container = p8_packed(spark, sf).groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return by_container.groupBy(F.floor(F.col("used") * 10 / packing.CAPACITY).cast("int").alias("tenth")).agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_packed(spark, sf).filter("piece_no > 0").select("doc_id").distinct()


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Affected documents with the items that leaked, where, how much of the item, and how many words were altered."""
    return leakage.leaked(_table(spark, sf, "documents"), "doc_id", "text", _table(spark, sf, "eval_items"), "eval_id", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_leaks(spark, sf).select("doc_id", "eval_id")


def p10_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Reading level of every document."""
    documents = _table(spark, sf, "documents")
    return reading.reading_levels(documents, reading.fit(documents, _table(spark, sf, "reading_labels")))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_levels(spark, sf).filter("level >= 4").select("doc_id")


def p10_grades(spark: SparkSession, sf: str) -> DataFrame:
    """The grade of each graded text: what the model is fitted on."""
    return reading.text_grades(_table(spark, sf, "reading_labels"), "doc_id", "grader", "grade_level")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p8_found, p8_packed, p8_fill, p9_found, p9_leaks, p10_found, p10_levels, p10_grades)}
SQL: dict[str, str] = {
    "p10_grades": """select doc_id, cast(floor(avg(g) + 0.5) as integer) as grade from (
  select doc_id, grader, avg(grade_level) as g from reading_labels where doc_id is not null and grade_level between 1 and 5 group by doc_id, grader) group by doc_id""",
}
