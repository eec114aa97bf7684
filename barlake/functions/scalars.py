"""Column functions of bars, books and comparisons. NaN never counts as greater than 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = 60_000


def number(c: Column) -> Column:
    """Text or number as double; what can't be read is 0."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def minute_of(ts: Column) -> Column:
    return F.try_divide(ts - ts % MINUTE, F.lit(MINUTE)).cast("long")


def close_ts(ts: Column) -> Column:
    return (minute_of(ts) + 1) * MINUTE


def bucket_close(close: Column, ms: int) -> Column:
    """Close of the bucket of ``ms`` that holds a minute bar's close; buckets count from the epoch."""
    start = close - MINUTE
    return (F.floor(start / F.lit(ms)) * ms + ms).cast("long")


def positive(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf"))


def valid_trade(price: Column, quantity: Column) -> Column:
    return positive(price) & positive(quantity)


def normalize_side(side: Column) -> Column:
    return F.when(F.lower(F.trim(side.cast("string"))).isin("b", "bid", "buy", "1", "true"), "bid").otherwise("ask")


def oi_value(base: Column, notional: Column) -> Column:
    return F.when(base == 0, notional).otherwise(base)


def snap_price(price: Column) -> Column:
    """Price in ten-thousandths, cut; a price below one is 0, which means no book."""
    return F.coalesce((price * 10000).try_cast("long"), F.lit(0))


def price_key(price: Column) -> Column:
    return F.round(price * 1e8).try_cast("long")


def spread_bps(bid: Column, ask: Column) -> Column:
    return F.when((bid == 0) | (ask <= bid), 0.0).otherwise(F.try_divide(ask - bid, bid) * 10000)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or null."""
    return F.try_divide(a, b)


def range_epsilon(high: Column, low: Column) -> Column:
    return F.greatest(F.lit(1e-9) * F.greatest(F.abs(high), F.abs(low)), F.lit(1e-6) * F.greatest(high - low, F.lit(0.0)))


#: How far two versions of a field may lie apart.
TOLERANCE = {
    "vwap": 0.01, "trade_count": 5.0, "buy_volume": 0.05, "sell_volume": 0.05, "avg_spread": 0.01, "spread_std_dev": 0.05, "depth_imbalance": 0.05, "depth_ratio": 0.05,
    "funding_rate": 0.0001, "funding_rate_change": 0.0001, "liq_long_vol": 0.001, "liq_short_vol": 0.001, "liq_covered": 0.0,
}
#: The same as shares of the larger one, which counts as 1 at least.
RELATIVE = {"open_interest": 0.003, "open_interest_change": 0.003}


def within_tolerance(field: str, a: Column, b: Column) -> Column:
    """Whether two values of a field agree; two nulls do, one doesn't."""
    if field in RELATIVE:
        near = F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) <= RELATIVE[field]
    else:
        near = F.abs(a - b) <= TOLERANCE[field]
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(near)


def floor_to_step(qty: Column, step: Column) -> Column:
    return F.when((qty <= 0) | (step <= 0), qty).otherwise(F.floor(qty / F.when(step > 0, step).otherwise(1.0) + 1e-9) * step)


def in_hour(ts: Column, hour: Column) -> Column:
    return (ts >= hour) & (ts < hour + 3_600_000)


def in_request(ts: Column, start: int, end: int) -> Column:
    """Open below, and one second past the end."""
    return (ts > start) & (ts < end + 1000)


def open_to_close_time(ts: Column, ms: int = MINUTE) -> Column:
    return ts + ms


def merged_moments(parts: Column) -> Column:
    """(n, mean, m2) of an array of such parts, merged pair by pair, so that no large squares cancel."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def merge(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        d, share = b["mean"] - a["mean"], F.try_divide(b["n"], n)
        both = F.struct(n.alias("n"), (a["mean"] + d * share).alias("mean"), (a["m2"] + b["m2"] + d * d * share * a["n"]).alias("m2"))
        return F.when(b["n"] == 0, a).otherwise(both)

    return F.aggregate(parts, zero, merge)
