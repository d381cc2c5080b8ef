"""Counters, histograms and gauges over events and mutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNTAGGED = ".untagged"


def counters(rows: DataFrame, metric: str, tags: list[str], amount: Column | None = None) -> DataFrame:
    """metric, tags and value: one series by tags, and one of all rows under metric.untagged (tags null).

    Combined on the map side; an empty input has an untagged series of 0.
    """
    value = F.coalesce(F.sum(amount if amount is not None else F.lit(1)), F.lit(0)).cast("long").alias("value")
    tagged = rows.groupBy(*tags).agg(value)
    kinds = {f.name: f.dataType for f in tagged.schema}
    total = tagged.agg(F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("value"))
    every = total.select(F.lit(metric + UNTAGGED).alias("metric"), *[F.lit(None).cast(kinds[t]).alias(t) for t in tags], "value")
    return tagged.select(F.lit(metric).alias("metric"), *tags, "value").unionByName(every)


def histograms(rows: DataFrame, metric: str, value: str, tags: list[str], quantiles: tuple[float, ...] = (0.5, 0.95), exact: bool = False) -> DataFrame:
    """metric, tags, n, least, most, mean and the quantiles (p50, p95) of a value.

    Quantiles come from sketches of bounded size; exact=True counts equal values first (combined on the map side), then looks the ranks up in a
    running count, between neighbours in proportion: sorted and spilled by Spark, never held for a series. Null values do not count; null
    tags are a series; no rows give no series.
    """
    names = [f"p{round(q * 100)}" for q in quantiles]
    if not exact:
        at = [F.percentile_approx(value, q).alias(n) for q, n in zip(quantiles, names)]
        return rows.groupBy(*tags).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), *at).select(F.lit(metric).alias("metric"), *tags, "n", "least", "most", "mean", *names)
    counted = rows.groupBy(*tags, F.col(value).alias("_v")).agg(F.count(value).alias("_c"))
    all_of = Window.partitionBy(*tags)
    ranked = counted.withColumns({"_upto": F.sum("_c").over(all_of.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)), "_n": F.sum("_c").over(all_of)})

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto")), F.col("_v")))

    ends = [c for q, n in zip(quantiles, names) for c in (at_rank(F.floor(q * (F.col("_n") - 1))).alias(f"_low_{n}"), at_rank(F.ceil(q * (F.col("_n") - 1))).alias(f"_high_{n}"))]
    found = ranked.groupBy(*tags).agg(F.sum("_c").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"), F.try_divide(F.sum(F.col("_v") * F.col("_c")), F.sum("_c")).alias("mean"), *ends)
    part = lambda q: q * (F.col("n") - 1) - F.floor(q * (F.col("n") - 1))
    return found.select(F.lit(metric).alias("metric"), *tags, "n", "least", "most", "mean", *[(F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * part(q)).alias(n) for q, n in zip(quantiles, names)])


def lag_gauge(rows: DataFrame, now_ms: int, timestamp: str, tags: list[str]) -> DataFrame:
    """tags and lag_ms: how far the latest row of each series lies behind now."""
    return rows.groupBy(*tags).agg((F.lit(now_ms) - F.max(timestamp)).cast("long").alias("lag_ms"))
