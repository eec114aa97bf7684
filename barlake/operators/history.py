"""The query surface: histories at any timeframe and whole hydration runs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.functions import scalars as X
from barlake.functions import symbols as S
from barlake.functions import timeframe
from barlake.functions.scalars import MINUTE
from barlake.operators import bars as B
from barlake.operators import book, gaps, joins, tables, trades
from barlake.scratch import spool
from barlake.sources import files

DAY = 86_400_000


def normalize_time_range(start: int | None, end: int | None, now: int | None = None) -> tuple[int, int]:
    """Defaults (now, and a day before the end) and the shift from open to close times."""
    end = end or now or int(time.time() * 1000)
    return (start or end - DAY) + MINUTE, end + MINUTE


def of_missing_days(raw: DataFrame, stored: DataFrame, exchange: str, symbol: str, lo: int, hi: int) -> DataFrame:
    """The rows of ``raw`` on the islands of days of [lo, hi) that ``stored`` has no bars for, and on the day that ends an island.

    The few days of the range are broadcast. If ``raw`` has a date, the folder its files lie in, other folders are
    pruned when the query runs; a bar that closes at midnight lies in the folder of the day before."""
    one = raw.sparkSession.range(1).select(F.lit(exchange).alias("exchange"), S.normalize_canonical(F.lit(symbol)).alias("symbol"))
    islands = gaps.missing_day_ranges(stored, lo, hi, one)
    days = islands.select(F.explode(F.sequence(F.col("first_day").cast("long"), F.col("until_day").cast("long"))).alias("day_")).distinct()
    out = raw
    if "date" in raw.columns:
        folders = islands.select(F.explode(F.sequence(F.col("first_day").cast("long") - 1, F.col("until_day").cast("long"))).alias("day_")).select(F.date_from_unix_date(F.col("day_").cast("int")).cast(raw.schema["date"].dataType).alias("date")).distinct()
        out = out.join(F.broadcast(folders), "date", "left_semi")
    return out.withColumn("day_", F.floor(F.col("timestamp") / DAY)).join(F.broadcast(days), "day_", "left_semi").select(*raw.columns)


def get_history(stored: DataFrame, exchange: str, symbol: str, tf: str, start: int | None, end: int | None, raw: DataFrame | None = None, now: int | None = None, overwrite: bool = False) -> DataFrame:
    """Bars of ``tf`` in the range from stored minute bars of the canonical form of ``symbol``; a start after the end fails.

    Where the stored bars of a timeframe under a day are complete (data_complete), they alone are taken; else, and
    for a day and more, ``raw`` ones fill in the days that have no stored bars (of_missing_days). With ``overwrite``
    nothing stored is looked at, raw ones alone are taken."""
    lo, hi = normalize_time_range(start, end, now)
    if lo > hi:
        raise ValueError("start must be before end")
    ms = timeframe.parse_or_minute(tf).ms
    mine = (F.col("exchange") == exchange) & (F.col("symbol") == S.normalize_canonical(F.lit(symbol))) & (F.col("timestamp") >= lo) & (F.col("timestamp") < hi)
    base = stored.where(mine)
    if overwrite:
        base = raw.where(mine)
    elif raw is not None:
        more = of_missing_days(raw.where(mine), base, exchange, symbol, lo, hi).select(*stored.columns)
        if ms < DAY:
            done = gaps.data_complete(B.resample_ohlcv(base, ms), lo, hi, ms).where("complete")
            more = more.join(F.broadcast(done), ["exchange", "symbol"], "left_anti")  # one row at most
        base = joins.append_missing(more, base)
    return B.resample_ohlcv(base, ms)


def history_1m(stored: DataFrame, exchange: str, symbol: str, start: int | None, end: int | None, raw: DataFrame | None = None) -> DataFrame:
    return get_history(stored, exchange, symbol, "1m", start, end, raw)


def fill_missing_days(stored: DataFrame, source: DataFrame, start: int, end: int) -> DataFrame:
    """``stored`` and the bars of ``source`` on days that have none."""
    miss = gaps.missing_day_ranges(stored, start, end).select("exchange", "symbol", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    new = source.withColumn("day", F.floor((F.col("timestamp") - MINUTE) / DAY)).join(miss, ["exchange", "symbol", "day"], "left_semi").drop("day")
    return joins.append_missing(new, stored)


def get_orderbook_bars(stored: DataFrame, exchange: str, symbol: str, start: int, end: int) -> DataFrame:
    """Stored bars of the canonical form of ``symbol``."""
    return stored.where((F.col("exchange") == exchange) & (F.col("symbol") == S.normalize_canonical(F.lit(symbol))) & (F.col("timestamp") >= start) & (F.col("timestamp") < end))


def minute_bars(tr: DataFrame, bk: DataFrame | None = None, oi: DataFrame | None = None, liq: DataFrame | None = None, exchange: str = "test", covered: DataFrame | None = None, chunk: int = book.CHUNK) -> DataFrame:
    """Whole bars of all symbols and minutes of the given sources in one plan. Book rows may have an exchange, else they are
    of ``exchange``. With ``covered`` hours (exchange, symbol, hour) liquidations are zeros where those have none and null
    in the others, and liq_covered says which."""
    parts = [trades.trade_flow(tr), trades.footprint(tr)]
    if bk is not None:
        if "exchange" in bk.columns:  # a book's rows are those of one exchange and symbol
            stats = book.book_stats(bk.withColumn("symbol", F.to_json(F.struct("exchange", "symbol"))), chunk)
            stats = stats.withColumn("of", F.from_json("symbol", "exchange string, symbol string")).select("of.*", *_BOOK)
        else:
            stats = book.book_stats(bk, chunk).select(F.lit(exchange).alias("exchange"), "symbol", *_BOOK)
        parts.append(stats)
    if oi is not None:
        parts.append(B.last_oi(oi))
    if liq is not None and covered is None:
        parts.append(B.liquidation_volume(liq))
    out = B.assemble(*parts)
    if covered is not None:
        volumes = B.liquidation_volume(liq)
        alone = volumes.select(*B.KEY).withColumn("alone_", F.lit(1))  # minutes with liquidations alone have bars too
        out = B.covered(B.assemble(*parts, alone).drop("alone_"), volumes, covered)
    return B.oi_carry(out) if oi is not None else out


_BOOK = ("timestamp", "avg_spread", "spread_std_dev", "depth_imbalance", "depth_ratio")


def hydrate_files(spark: SparkSession, root: str, funding: DataFrame, chunk: int = book.CHUNK) -> DataFrame:
    """Whole bars of the market files under ``root`` (exchange/date/hour/symbol_kind.parquet).

    An hour without a file of trades is left out with all its other files. Of the other kinds a missing file leaves
    its columns empty: without one of liquidations volumes are null and liq_covered is 0, while a file without
    rows gives zeros. Rows outside their file's hour don't count. The book and the last interest are carried over the
    borders of hours, and rates are those as of each close."""
    listed = spool(files.list_hours(spark, root), "hours")  # written once, as are rows that several parts read: each scan of many files takes long
    hour = ["exchange", "symbol", "hour"]
    loaded = listed.where("type = 'trades'").select(*hour).distinct()
    covered = listed.where("type = 'liquidations'").select(*hour).distinct().join(loaded, hour, "left_semi")

    def rows(kind: str, at: str) -> DataFrame:
        r = files.read_hours(spark, root, kind)
        return r.where(X.in_hour(F.col(at), F.col("hour"))).join(F.broadcast(loaded) if kind == "trades" else loaded, hour, "left_semi")

    tr = spool(rows("trades", "trade_time").withColumn("trade_id", F.col("row")), "trades")
    oi = rows("open_interest", "timestamp").select("exchange", "symbol", F.col("timestamp").alias("ts"), F.col("row").alias("seq"), X.oi_value(F.col("sum_open_interest"), F.col("sum_open_interest_value")).alias("value"))
    bk = spool(rows("orderbook", "event_time").withColumn("seq", F.col("row")), "book")
    liq = spool(rows("liquidations", "trade_time"), "liquidations")
    bars_ = spool(minute_bars(tr, bk, oi, liq, covered=covered, chunk=chunk), "bars")
    return B.funding_change(joins.asof_funding(bars_, funding)).select(*WHOLE)


WHOLE = [*B.KEY, *B.ALWAYS, "open_interest", "open_interest_change", "funding_rate", "funding_rate_change", "liq_long_vol", "liq_short_vol", "liq_covered", *trades.FOOTPRINT]


def hydrate(stored: DataFrame, new: DataFrame, funding: DataFrame, resume: bool = True, overwrite: bool = False) -> DataFrame:
    """``stored`` after the bars ``new``: with ``resume`` only hours without stored bars are taken, with ``overwrite``
    new bars replace those of their keys; rates come as of each close. A dry run just doesn't write the result."""
    new = B.funding_change(joins.asof_funding(new, funding))
    if resume and not overwrite:
        hour = (F.floor((F.col("timestamp") - MINUTE) / 3_600_000) * 3_600_000).alias("hour")
        todo = joins.remaining_hours(new.select("exchange", "symbol", hour).distinct(), stored)
        new = new.withColumn("hour", hour).join(todo, ["exchange", "symbol", "hour"], "left_semi").drop("hour")
    if overwrite:
        return tables.replace_rows(stored, new.select(*stored.columns), B.KEY)
    return tables.upsert_orderbook_bars(stored, new.select(*stored.columns))
