"""Whole bars: assembly of their parts, carries, resampling, de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions import scalars as X
from barlake.operators import trades as T

KEY = T.KEY
ALWAYS = ["vwap", "trade_count", "buy_volume", "sell_volume", "avg_spread", "spread_std_dev", "depth_imbalance", "depth_ratio"]


def liquidation_volume(liq: DataFrame) -> DataFrame:
    """liq_short_vol (bought back) and liq_long_vol per minute of rows (exchange, symbol, trade_time, last_filled_quantity, side)."""
    q, buy = F.col("last_filled_quantity"), F.col("side") == "BUY"
    return liq.withColumn("timestamp", X.close_ts(F.col("trade_time"))).groupBy(*KEY).agg(F.sum(F.when(buy, q).otherwise(0.0)).alias("liq_short_vol"), F.sum(F.when(buy, 0.0).otherwise(q)).alias("liq_long_vol"))


def covered(bars: DataFrame, volumes: DataFrame, hours: DataFrame) -> DataFrame:
    """``bars`` with liquidation columns: in covered ``hours`` (exchange, symbol, hour) zeros are true, elsewhere they are null."""
    b = bars.withColumn("hour", F.floor((F.col("timestamp") - X.MINUTE) / 3_600_000) * 3_600_000)
    b = b.join(hours.select("exchange", "symbol", "hour", F.lit(1).alias("liq_covered")), ["exchange", "symbol", "hour"], "left").join(volumes, KEY, "left")
    vol = lambda c: F.when(F.col("liq_covered") == 1, F.coalesce(c, F.lit(0.0))).alias(c)
    return b.select(*[c for c in bars.columns], F.coalesce("liq_covered", F.lit(0)).alias("liq_covered"), vol("liq_long_vol"), vol("liq_short_vol"))


def last_oi(samples: DataFrame) -> DataFrame:
    """open_interest: the last sample (by ts, then seq) of each minute of rows (exchange, symbol, ts, seq, value)."""
    return samples.withColumn("timestamp", X.close_ts(F.col("ts"))).groupBy(*KEY).agg(F.max_by("value", F.struct("ts", "seq")).alias("open_interest"))


def assemble(*parts: DataFrame) -> DataFrame:
    """One bar for each key that any part has: parts are stacked and grouped once, so there is one shuffle."""
    names = list(dict.fromkeys(c for p in parts for c in p.columns if c not in KEY))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p, allowMissingColumns=True)
    b = all_.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in names])
    return b.select(*KEY, *[F.coalesce(c, F.lit(0)).alias(c) if c in ALWAYS else F.col(c) for c in names])


def oi_carry(bars: DataFrame, value: str = "open_interest") -> DataFrame:
    """``value`` filled from the bar before, and its change: null before the second known one, 0 where filled."""
    w = Window.partitionBy("exchange", "symbol").orderBy("timestamp")
    filled = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = bars.withColumn("filled_", filled)
    return b.withColumn(f"{value}_change", F.col("filled_") - F.lag("filled_").over(w)).withColumn(value, F.col("filled_")).drop("filled_")


funding_carry = lambda bars: oi_carry(bars, "funding_rate")


def funding_change(bars: DataFrame) -> DataFrame:
    """Change to the last known rate before; null for the first."""
    w = Window.partitionBy("exchange", "symbol").orderBy("timestamp").rowsBetween(Window.unboundedPreceding, -1)
    return bars.withColumn("funding_rate_change", F.col("funding_rate") - F.last("funding_rate", True).over(w))


def resample_ohlcv(bars: DataFrame, ms: int) -> DataFrame:
    """Bars of ``ms`` from minute bars; buckets count from the epoch, partial ones stay."""
    if ms <= X.MINUTE:
        return bars.select(*KEY, "open", "high", "low", "close", "volume")
    b = bars.withColumn("bucket", X.bucket_close(F.col("timestamp"), ms))
    g = b.groupBy("exchange", "symbol", "bucket").agg(F.min_by("open", "timestamp").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "timestamp").alias("close"), F.sum("volume").alias("volume"))
    return g.withColumnRenamed("bucket", "timestamp").select(*KEY, "open", "high", "low", "close", "volume")


def resample_orderbook(bars: DataFrame, n: int, aligned: bool = False) -> DataFrame:
    """Chunks of ``n`` bars by position, or with ``aligned`` by time, which a gap doesn't shift. Changes are those from
    the chunk's first row to its last, 0 where either is null."""
    w = Window.partitionBy("exchange", "symbol").orderBy("timestamp")
    chunk = F.floor((F.col("timestamp") - X.MINUTE) / (n * X.MINUTE)) if aligned else F.floor((F.row_number().over(w) - 1) / n)
    vol = F.col("buy_volume") + F.col("sell_volume")
    last = lambda c: F.max_by(c, "timestamp")
    change = lambda c: F.coalesce(F.max_by(c, "timestamp") - F.min_by(c, "timestamp"), F.lit(0.0))
    g = bars.withColumn("chunk", chunk).groupBy("exchange", "symbol", "chunk").agg(
        F.max("timestamp").alias("timestamp"), F.sum(F.col("vwap") * vol).alias("pv"), F.sum(vol).alias("v"), last("vwap").alias("last_vwap"), F.sum("trade_count").alias("trade_count"), F.sum("buy_volume").alias("buy_volume"), F.sum("sell_volume").alias("sell_volume"),
        F.avg("avg_spread").alias("avg_spread"), last("spread_std_dev").alias("spread_std_dev"), F.avg("depth_imbalance").alias("depth_imbalance"), F.avg("depth_ratio").alias("depth_ratio"), last("open_interest").alias("open_interest"), change("open_interest").alias("open_interest_change"),
        last("funding_rate").alias("funding_rate"), change("funding_rate").alias("funding_rate_change"), F.sum(F.coalesce("liq_long_vol", F.lit(0.0))).alias("liq_long_vol"), F.sum(F.coalesce("liq_short_vol", F.lit(0.0))).alias("liq_short_vol"), F.max("liq_covered").alias("liq_covered"),
    )
    return g.withColumn("vwap", F.when(F.col("v") > 0, F.try_divide("pv", "v")).otherwise(F.col("last_vwap"))).drop("chunk", "pv", "v", "last_vwap")


def dedup_bars(bars: DataFrame, seq: str = "seq") -> DataFrame:
    """Of each key the bar with most trades, then one with a spread, then the first by ``seq``."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("trade_count"), F.desc((F.col("avg_spread") > 0).cast("int")), seq)
    return bars.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def dedup_sorted(bars: DataFrame, seq: str = "seq") -> DataFrame:
    """Of each key the first bar by ``seq``."""
    w = Window.partitionBy(*KEY).orderBy(seq)
    return bars.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")
