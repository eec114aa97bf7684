"""Gaps of series and days, and whether stored data are complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions import scalars as X

DAY = 86_400_000


def find_gaps(bars: DataFrame, start: int, end: int, ms: int, keys: list[str] | None = None, of: DataFrame | None = None) -> DataFrame:
    """(keys, gap_start, gap_end): leading, inner and trailing gaps of [start, end) at steps of ``ms``. A row of ``of``
    (keys) without bars is a gap over the whole range, and so is a table without bars if there are no keys."""
    keys = keys if keys is not None else ["exchange", "symbol"]
    w = Window.partitionBy(*keys).orderBy("timestamp") if keys else Window.partitionBy(F.lit(0)).orderBy("timestamp")
    b = bars.where((F.col("timestamp") >= start) & (F.col("timestamp") < end)).select(*keys, "timestamp").distinct()
    inner = b.withColumn("next", F.lead("timestamp").over(w)).where(F.col("next") > F.col("timestamp") + ms).select(*keys, (F.col("timestamp") + ms).alias("gap_start"), F.col("next").alias("gap_end"))
    edge = b.groupBy(*keys).agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    if of is not None:
        edge = of.select(*keys).distinct().join(edge, keys, "left")
    lead = edge.where((F.col("lo") > start + ms) | F.col("lo").isNull()).select(*keys, F.lit(start).alias("gap_start"), F.coalesce("lo", F.lit(end)).alias("gap_end"))
    trail = edge.where(F.col("hi") + ms < end).select(*keys, (F.col("hi") + ms).alias("gap_start"), F.lit(end).alias("gap_end"))
    return lead.unionByName(inner).unionByName(trail)


def days_with_data(bars: DataFrame) -> DataFrame:
    """Distinct (exchange, symbol, day): days since the epoch of close - 1 min."""
    return bars.select("exchange", "symbol", F.floor((F.col("timestamp") - X.MINUTE) / DAY).alias("day")).distinct()


def expand_days(df: DataFrame, start: int, end: int) -> DataFrame:
    first, last = start // DAY, end // DAY
    return df.select("*", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day")) if first <= last else df.select("*", F.lit(0).alias("day")).where(F.lit(False))


def missing_day_ranges(bars: DataFrame, start: int, end: int, of: DataFrame | None = None) -> DataFrame:
    """(exchange, symbol, first_day, last_day, until_day): islands of days without data; an island that data
    follow runs until one day past its end, as callers load it so. ``of`` (exchange, symbol) names the symbols to look
    at, which may have no data at all; else those of ``bars`` are."""
    have = days_with_data(bars)
    days = expand_days((have if of is None else of).select("exchange", "symbol").distinct(), start, end)
    w = Window.partitionBy("exchange", "symbol").orderBy("day")
    miss = days.join(have, ["exchange", "symbol", "day"], "left_anti").withColumn("island", F.col("day") - F.row_number().over(w))
    g = miss.groupBy("exchange", "symbol", "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day")).drop("island")
    return g.withColumn("until_day", F.when(F.col("last_day") < end // DAY, F.col("last_day") + 1).otherwise(F.col("last_day")))


def step_gaps(series: DataFrame, keys: list[str], limits: dict[str, int], largest: str, unit: int) -> DataFrame:
    """(keys, <name> = steps over each limit in ms, ``largest`` in ``unit`` ms, 0 for a single row, last): distances
    between neighbouring timestamps."""
    w = Window.partitionBy(*keys).orderBy("timestamp")
    s = series.withColumn("gap", F.lead("timestamp").over(w) - F.col("timestamp"))
    return s.groupBy(*keys).agg(*[F.count_if(F.col("gap") > v).alias(k) for k, v in limits.items()], F.coalesce(F.max("gap") / unit, F.lit(0.0)).alias(largest), F.max("timestamp").alias("last"))


def flow_gaps(flows: DataFrame, hours: int = 1) -> DataFrame:
    return step_gaps(flows, ["asset", "exchange"], {"n_gaps": hours * 3_600_000}, "max_gap_h", 3_600_000)


def macro_gaps(obs: DataFrame) -> DataFrame:
    return step_gaps(obs, ["series_id"], {"over_8d": 8 * DAY, "over_35d": 35 * DAY}, "max_gap_d", DAY)


def data_complete(bars: DataFrame, start: int, end: int, ms: int = X.MINUTE) -> DataFrame:
    """(exchange, symbol, n, complete): bars of ``ms`` cover the end of [start, end) to a bar, the start to five minutes
    after the first bar's open, and 95 % of those expected are there. A bar's length is the step of the first two; the
    number expected goes by ``ms``. A range of under a minute is complete once its edges are; a key without bars isn't there."""
    w = Window.partitionBy("exchange", "symbol").orderBy("timestamp")
    b = bars.where((F.col("timestamp") >= start) & (F.col("timestamp") < end)).withColumn("r", F.row_number().over(w))
    g = b.groupBy("exchange", "symbol").agg(F.count("*").alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"), F.max(F.when(F.col("r") == 2, F.col("timestamp"))).alias("second"))
    step = F.when(F.col("second") > F.col("lo"), F.col("second") - F.col("lo")).otherwise(F.lit(ms))
    minutes = (end - start) // X.MINUTE
    expected = minutes // max(ms // X.MINUTE, 1)
    enough = F.lit(True) if minutes <= 0 or expected <= 0 else F.col("n") >= int(expected * 0.95)
    return g.select("exchange", "symbol", "n", ((F.col("hi") >= end - step) & (F.col("lo") - step <= start + 300_000) & enough).alias("complete"))
