"""Audits and reports over stored bars; each is one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.functions import scalars as X

HOUR, DAY = 3_600_000, 86_400_000


def _c(name: str) -> Column:
    return F.col(name)


def checks() -> dict[str, Column]:
    """Violations by name. Comparisons with a null are none."""
    eps = X.range_epsilon(_c("trade_high"), _c("trade_low"))
    foot, traded = _c("trade_open").isNotNull(), _c("trade_count") > 0
    sides = _c("buy_volume") + _c("sell_volume")
    outside = lambda c: (_c(c) < _c("trade_low") - eps) | (_c(c) > _c("trade_high") + eps)
    some = lambda c: F.coalesce(outside(c), F.lit(False))
    slack = F.lit(1e-12) * F.greatest(sides, F.lit(1e-6))
    over = lambda band, side: F.coalesce(_c(band) > _c(side) + slack, F.lit(False))
    bands = ("hi_band_buy_vol", "hi_band_sell_vol", "lo_band_buy_vol", "lo_band_sell_vol")
    paid = lambda side: F.coalesce(_c(f"{side}_vwap") * _c(f"{side}_volume"), F.lit(0.0))
    ordered = (_c("trade_low") - eps <= _c("trade_open")) & (_c("trade_open") <= _c("trade_high") + eps) & (_c("trade_low") <= _c("trade_close")) & (_c("trade_close") <= _c("trade_high"))
    return {
        "01_footprint_missing_on_traded_bar": traded & ~foot,
        "02_footprint_on_tradeless_bar": (_c("trade_count") == 0) & foot,
        "03_traded_bar_without_volume": traded & (sides == 0),
        "04_buy_vwap_or_poc_missing": _c("buy_vwap").isNull() != _c("buy_poc_price").isNull(),
        "05_sell_vwap_or_poc_missing": _c("sell_vwap").isNull() != _c("sell_poc_price").isNull(),
        "06_band_missing": foot & F.greatest(*[_c(b).isNull().cast("int") for b in bands]).cast("boolean"),
        "07_ohlc_order": foot & ~ordered,
        "08_poc_outside_range": foot & outside("poc_price"),
        "09_poc_share_outside_bounds": (_c("poc_volume_share") <= 0) | (_c("poc_volume_share") > 1 + 1e-9),
        "10_side_vwap_outside_range": foot & (some("buy_vwap") | some("sell_vwap")),
        "11_side_poc_outside_range": foot & (some("buy_poc_price") | some("sell_poc_price")),
        "12_band_above_its_side": foot & (over("hi_band_buy_vol", "buy_volume") | over("hi_band_sell_vol", "sell_volume") | over("lo_band_buy_vol", "buy_volume") | over("lo_band_sell_vol", "sell_volume")),
        "13_vwap_not_the_sides_mean": (sides > 0) & (F.coalesce("vwap", F.lit(0.0)) != 0) & (F.try_divide(F.abs(_c("vwap") - F.try_divide(paid("buy") + paid("sell"), sides)), F.abs("vwap")) > 1e-9),
    }


def audit(bars: DataFrame, start: int, end: int) -> DataFrame:
    """(check, violations, status): all checks in one aggregate, failures last."""
    found = checks()
    one = bars.where((_c("timestamp") >= start) & (_c("timestamp") < end)).agg(*[F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in found.items()])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("violations")) for k in found])).alias("x")).select("x.*")
    return long.withColumn("status", F.when(_c("violations") == 0, "PASS").otherwise("FAIL")).orderBy(F.desc("status"), "check")


def symbol_ranges(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.count("*").alias("n"))


def progress(bars: DataFrame, start: int, end: int) -> DataFrame:
    b = bars.where((_c("timestamp") >= start) & (_c("timestamp") < end))
    text = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd HH:mm")
    return b.agg(F.count("*").alias("n"), text(F.min("timestamp")).alias("earliest"), text(F.max("timestamp")).alias("latest"), F.round((F.max("timestamp") - F.min("timestamp")) / DAY, 2).alias("days"))


def bar_outliers(bars: DataFrame) -> DataFrame:
    """Symbol-days that don't have 1440 bars."""
    d = bars.groupBy("symbol", F.floor((_c("timestamp") - 60_000) / DAY).alias("day")).agg(F.count("*").alias("n"))
    return d.where("n <> 1440").withColumn("missing", 1440 - _c("n"))


def footprint_coverage(bars: DataFrame) -> DataFrame:
    traded = _c("trade_count") > 0
    return bars.agg(
        F.count("*").alias("bars"), F.count_distinct("symbol").alias("symbols"), F.min("timestamp").alias("first_close"), F.max("timestamp").alias("last_close"),
        F.count_if(traded).alias("traded_bars"), F.count_if(traded & _c("trade_open").isNotNull()).alias("with_footprint"), F.count_if(_c("trade_count") == 0).alias("trade_less"),
    )


#: Fixed: the columns whose presence a pattern tells, in its order.
PATTERN = ["trade_open", "trade_high", "trade_low", "trade_close", "buy_vwap", "sell_vwap", "poc_price", "buy_poc_price", "sell_poc_price", "trade_price_std", "hi_band_buy_vol"]


def null_patterns(bars: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(pattern, n): which of the columns are known, as ones and zeros, and in how many bars."""
    bits = F.concat(*[F.when(_c(c).isNotNull(), "1").otherwise("0") for c in columns or PATTERN])
    return bars.groupBy(bits.alias("pattern")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern")


def hourly_coverage(bars: DataFrame) -> DataFrame:
    """(hour, symbols, bars) by the hour that a close lies in."""
    return bars.groupBy((F.floor(_c("timestamp") / HOUR) * HOUR).alias("hour")).agg(F.count_distinct("symbol").alias("symbols"), F.count("*").alias("bars"))


def hourly_floor(bars: DataFrame) -> DataFrame:
    """(hours, min_symbols, min_bars, below, universe_floor): below counts hours with fewer symbols than the most of any
    hour, the universe's floor."""
    h = hourly_coverage(bars)
    top = h.agg(F.max("symbols").alias("top"))
    return h.join(F.broadcast(top)).agg(F.count("*").alias("hours"), F.min("symbols").alias("min_symbols"), F.min("bars").alias("min_bars"), F.count_if(_c("symbols") < _c("top")).alias("below"), F.max("top").alias("universe_floor"))


def column_health(bars: DataFrame) -> DataFrame:
    """(funding_nonnull, oi_nonnull, liq_covered_rate): shares of the bars, to four places."""
    known = lambda c: F.round(F.avg(_c(c).isNotNull().cast("int")), 4)
    return bars.agg(known("funding_rate").alias("funding_nonnull"), known("open_interest").alias("oi_nonnull"), F.round(F.avg("liq_covered"), 4).alias("liq_covered_rate"))


def distinct_symbols(bars: DataFrame, exchange: str) -> DataFrame:
    return bars.where(_c("exchange") == exchange).select("symbol").distinct().orderBy("symbol")


def bar_range(bars: DataFrame, exchange: str, symbol: str) -> DataFrame:
    return bars.where((_c("exchange") == exchange) & (_c("symbol") == symbol)).agg(F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


def newest_hour(table: DataFrame, now: int, limit_ms: int) -> DataFrame:
    hour = (F.floor(F.max("timestamp") / HOUR) * HOUR).alias("newest_hour")
    return table.agg(hour).withColumn("age_ms", now - _c("newest_hour")).withColumn("stale", F.coalesce(_c("age_ms") > limit_ms, F.lit(True)))


def funding_missing_pct(bars: DataFrame) -> DataFrame:
    p = F.avg(_c("funding_rate").isNull().cast("int")) * 100
    return bars.groupBy("exchange", "symbol").agg(F.round(p, 4).alias("missing_pct")).withColumn("warn", _c("missing_pct") > 50)


def bar_exists(bars: DataFrame, exchange: str, symbol: str, ts: int) -> DataFrame:
    hit = bars.where((_c("exchange") == exchange) & (_c("symbol") == symbol) & (_c("timestamp") == ts)).limit(1)
    return hit.agg((F.count("*") > 0).alias("found"))


def hour_exists(bars: DataFrame, exchange: str, symbol: str, hour: int) -> DataFrame:
    hit = bars.where((_c("exchange") == exchange) & (_c("symbol") == symbol) & (_c("timestamp") > hour) & (_c("timestamp") <= hour + HOUR)).limit(1)
    return hit.agg((F.count("*") > 0).alias("found"))


def from_first_stored_hour(hours: DataFrame, bars: DataFrame) -> DataFrame:
    """Hours of each symbol from its first stored bar's on."""
    first = bars.groupBy("exchange", "symbol").agg((F.floor((F.min("timestamp") - 60_000) / HOUR) * HOUR).alias("first_"))
    return hours.join(first, ["exchange", "symbol"]).where("hour >= first_").drop("first_")


def last_bar(bars: DataFrame) -> DataFrame:
    """Of each symbol the latest bar."""
    return bars.groupBy("exchange", "symbol").agg(F.max_by(F.struct(*[c for c in bars.columns if c not in ("exchange", "symbol")]), "timestamp").alias("b")).select("exchange", "symbol", "b.*")


def tail_bars(bars: DataFrame, exchange: str, symbol: str, n: int) -> DataFrame:
    b = bars.where((_c("exchange") == exchange) & (_c("symbol") == symbol))
    return b.orderBy(F.desc("timestamp")).limit(n).orderBy("timestamp")


def first_differences(compared: DataFrame, n: int = 20) -> DataFrame:
    return compared.where("status <> 'exact'").orderBy("timestamp", "symbol", "field").limit(n)
