"""Trades to minute bars: flow, OHLCV and the volume-by-level footprint.

Trades have exchange, symbol, trade_time (ms), price, quantity, is_buyer_maker and trade_id; first and
last are by (trade_time, trade_id). Results are per (exchange, symbol, timestamp), the close in ms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions import scalars as X

KEY = ["exchange", "symbol", "timestamp"]
FOOTPRINT = ["trade_open", "trade_high", "trade_low", "trade_close", "buy_vwap", "sell_vwap", "poc_price", "poc_volume_share", "buy_poc_price", "sell_poc_price", "trade_price_std", "hi_band_buy_vol", "hi_band_sell_vol", "lo_band_buy_vol", "lo_band_sell_vol"]


def _minutes(trades: DataFrame) -> DataFrame:
    return trades.withColumn("timestamp", X.close_ts(F.col("trade_time")))


def trade_flow(trades: DataFrame) -> DataFrame:
    """trade_count, buy_volume, sell_volume, vwap; rows of no value count too. A maker's buy is a sell."""
    t = _minutes(trades)
    n = F.greatest(F.col("trade_count"), F.lit(1)) if "trade_count" in trades.columns else F.lit(1)
    q, sell = F.col("quantity"), F.col("is_buyer_maker")
    agg = t.groupBy(*KEY).agg(F.sum(n).cast("long").alias("trade_count"), F.sum(F.when(~sell, q).otherwise(0.0)).alias("buy_volume"), F.sum(F.when(sell, q).otherwise(0.0)).alias("sell_volume"), F.sum(F.col("price") * q).alias("pq"), F.sum(q).alias("q"))
    vwap = F.when(~F.isnan("q") & (F.col("q") > 0), F.try_divide("pq", "q")).otherwise(0.0)
    return agg.select(*KEY, "trade_count", "buy_volume", "sell_volume", vwap.alias("vwap"))


def ticks_to_price_bars(trades: DataFrame) -> DataFrame:
    """open, high, low, close, volume of all trades."""
    order = F.struct("trade_time", "trade_id")
    return _minutes(trades).groupBy(*KEY).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("quantity").alias("volume"))


def level_histogram(trades: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Per price key of the valid trades: buy, sell, pq, p2q per side, first and last trade. The first of two
    aggregates: tasks add up levels before the shuffle, so a hot symbol arrives as its levels."""
    t = _minutes(trades.where(X.valid_trade(F.col("price"), F.col("quantity")))).withColumn("key", X.price_key(F.col("price")))
    q, p, sell = F.col("quantity"), F.col("price"), F.col("is_buyer_maker")
    order = F.struct("trade_time", "trade_id", "price")
    return t.groupBy(*keys, "key").agg(
        F.sum(F.when(~sell, q).otherwise(0.0)).alias("buy"), F.sum(F.when(sell, q).otherwise(0.0)).alias("sell"), F.sum(F.when(~sell, p * q).otherwise(0.0)).alias("buy_pq"), F.sum(F.when(sell, p * q).otherwise(0.0)).alias("sell_pq"),
        F.sum(p * p * q).alias("p2q"), F.min(order).alias("first"), F.max(order).alias("last"), F.max("price").alias("high"), F.min("price").alias("low"),
    )


def footprint(trades: DataFrame, k: int = 3) -> DataFrame:
    """The FOOTPRINT columns. Sides without volume are null, bands are true zeros; ties of volume go to the lower price."""
    return footprint_of(level_histogram(trades), k)


def footprint_of(h: DataFrame, k: int = 3) -> DataFrame:
    """footprint() of the levels of level_histogram()."""
    by = Window.partitionBy(*KEY)
    h = h.withColumn("low_rank", F.row_number().over(by.orderBy("key"))).withColumn("high_rank", F.row_number().over(by.orderBy(F.desc("key"))))
    key = lambda vol: F.max(F.struct(vol.alias("v"), (-F.col("key")).alias("k")))
    band = lambda rank, side: F.sum(F.when(F.col(rank) <= k, F.col(side)).otherwise(0.0))
    a = h.groupBy(*KEY).agg(
        F.min("first")["price"].alias("trade_open"), F.max("high").alias("trade_high"), F.min("low").alias("trade_low"), F.max("last")["price"].alias("trade_close"),
        F.sum("buy").alias("b"), F.sum("sell").alias("s"), F.sum("buy_pq").alias("bpq"), F.sum("sell_pq").alias("spq"), F.sum("p2q").alias("p2q"),
        key(F.col("buy") + F.col("sell")).alias("poc"), key(F.col("buy")).alias("bpoc"), key(F.col("sell")).alias("spoc"),
        band("high_rank", "buy").alias("hi_band_buy_vol"), band("high_rank", "sell").alias("hi_band_sell_vol"), band("low_rank", "buy").alias("lo_band_buy_vol"), band("low_rank", "sell").alias("lo_band_sell_vol"),
    )
    total = F.col("b") + F.col("s")
    mean = F.try_divide(F.col("bpq") + F.col("spq"), total)
    std = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("p2q"), total) - mean * mean))
    price = lambda c: -F.col(c)["k"] / F.lit(1e8)
    side = lambda v, c: F.when(F.col(v) > 0, c)
    return a.select(
        *KEY, "trade_open", "trade_high", "trade_low", "trade_close", side("b", F.try_divide("bpq", "b")).alias("buy_vwap"), side("s", F.try_divide("spq", "s")).alias("sell_vwap"),
        price("poc").alias("poc_price"), F.try_divide(F.col("poc")["v"], total).alias("poc_volume_share"), side("b", price("bpoc")).alias("buy_poc_price"), side("s", price("spoc")).alias("sell_poc_price"),
        std.alias("trade_price_std"), "hi_band_buy_vol", "hi_band_sell_vol", "lo_band_buy_vol", "lo_band_sell_vol",
    )
