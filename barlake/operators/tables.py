"""Changes to stored bars as keyed rewrites. Each takes and returns DataFrames; overwrite_partitions writes
the touched partitions of a table through Spark's dynamic partition overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions import scalars as X
from barlake.operators.bars import KEY, liquidation_volume, resample_ohlcv
from barlake.operators.joins import append_missing, minute_grid, update_liq
from barlake.operators.trades import FOOTPRINT

insert_price_bars = append_missing


def _columns(df: DataFrame) -> tuple[list[str], list[str]]:
    late = [c for c in ("open_interest", "open_interest_change", "funding_rate", "funding_rate_change", "liq_long_vol", "liq_short_vol") if c in df.columns]
    return late, [c for c in FOOTPRINT if c in df.columns]


def fold_versions(versions: DataFrame, seq: str = "seq") -> DataFrame:
    """One bar for each key of its ``versions`` in the order of ``seq``, as upserting them one by one gives.

    Trades and footprint come from the last version with at least as many trades as any before it,
    spread and its deviation each from the last above 0, depth from the last with a ratio above 0, interest, funding and
    liquidations from the last known, counts and coverage are the largest; where none qualifies the
    first version's value stays. One window per key, so stored and new versions need one shuffle."""
    late, foot = _columns(versions)
    w = Window.partitionBy(*KEY).orderBy(seq)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    v = versions.withColumn("most_", F.coalesce(F.max("trade_count").over(before), F.lit(-1))).withColumn("first_", F.row_number().over(w) == 1)
    fuller = F.col("trade_count") >= F.col("most_")

    def group(names: list[str], good: Column) -> Column:
        # the first version counts as good, and a later one must really be
        return F.max_by(F.when(F.col("first_") | good, F.struct(*names)), F.when(F.col("first_") | good, F.col(seq)))

    aggs = [
        group(["vwap", "buy_volume", "sell_volume"], fuller & (F.col("trade_count") > 0)).alias("t_"), group(["avg_spread"], F.col("avg_spread") > 0).alias("s_"), group(["spread_std_dev"], F.col("spread_std_dev") > 0).alias("v_"),
        group(["depth_imbalance", "depth_ratio"], F.col("depth_ratio") > 0).alias("d_"), F.max("trade_count").alias("trade_count"),
    ]
    if foot:
        aggs.append(group(foot, F.col("trade_open").isNotNull() & fuller).alias("f_"))
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in late]
    if "liq_covered" in versions.columns:
        aggs.append(F.max("liq_covered").alias("liq_covered"))
    g = v.groupBy(*KEY).agg(*aggs)
    out = g.select(*KEY, "t_.*", "s_.*", "v_.*", "d_.*", "trade_count", *(["f_.*"] if foot else []), *late, *(["liq_covered"] if "liq_covered" in versions.columns else []))
    return out.select(*[c for c in versions.columns if c != seq])


def upsert_orderbook_bars(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` after ``new``, which may hold several versions of a key by ``seq``."""
    late = new if "seq" in new.columns else new.withColumn("seq", F.lit(1).cast("long"))
    return fold_versions(stored.withColumn("seq", F.lit(-1).cast("long")).unionByName(late))


def in_range(start: int | None, end: int | None) -> Column:
    c = F.lit(True)
    if start is not None:
        c = c & (F.col("timestamp") >= start)
    return c & (F.col("timestamp") < end) if end is not None else c


def of_symbol(exchange: str, symbol: str) -> Column:
    return (F.col("exchange") == exchange) & (F.col("symbol") == symbol)


def delete_range(bars: DataFrame, exchange: str, symbol: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """``bars`` without those of one symbol in [start, end); a bound that is missing is open."""
    return bars.where(~(of_symbol(exchange, symbol) & in_range(start, end)))


def deleted_count(bars: DataFrame, exchange: str, symbol: str, start: int | None = None, end: int | None = None) -> DataFrame:
    return bars.agg(F.count_if(of_symbol(exchange, symbol) & in_range(start, end)).alias("deleted"))


def deleted_counts(bars: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """(exchange, symbol, deleted): what deleted_count() says of each symbol, all in one pass."""
    return bars.groupBy("exchange", "symbol").agg(F.count_if(in_range(start, end)).alias("deleted"))


def set_liq_unknown(bars: DataFrame, exchange: str, symbol: str, start: int, end: int) -> DataFrame:
    """``bars`` with the liquidations of one symbol in [start, end) unknown."""
    return _liq_unknown(bars, of_symbol(exchange, symbol) & in_range(start, end))


def _liq_unknown(bars: DataFrame, hit: Column) -> DataFrame:
    null = F.lit(None).cast("double")
    new = {"liq_long_vol": null, "liq_short_vol": null, "liq_covered": F.lit(0)}
    return bars.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in bars.columns])


def backfill_liquidations(bars: DataFrame, liq: DataFrame, hours: DataFrame, start: int, end: int) -> DataFrame:
    """``bars`` whose liquidations in [start, end), of every symbol, are set from ``liq`` in covered ``hours`` and unknown elsewhere."""
    return update_liq(_liq_unknown(bars, in_range(start, end)), minute_grid(hours, liquidation_volume(liq)).where(in_range(start, end)))


def mark_progress(marks: DataFrame, done: DataFrame) -> DataFrame:
    """Marks (symbol, hour) with ``done`` added; marking again changes nothing."""
    return marks.select("symbol", "hour").unionByName(done.select("symbol", "hour")).distinct()


def pending(work: DataFrame, marks: DataFrame) -> DataFrame:
    return work.join(marks, ["symbol", "hour"], "left_anti")


def replace_rows(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with the rows of ``new`` in place of those of the same keys."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upsert_flow(stored: DataFrame, new: DataFrame) -> DataFrame:
    return replace_rows(stored, new, ["asset", "exchange", "timestamp"])


def upsert_labels(stored: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    return replace_rows(stored, new.withColumn("updated_at", now), ["chain", "address"])


def upsert_observations(stored: DataFrame, new: DataFrame) -> DataFrame:
    return replace_rows(stored, new, ["series_id", "timestamp"])


def upsert_series(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Series metadata: new text that isn't empty wins, else the old one stays."""
    names = [c for c in stored.columns if c != "series_id"]
    n = new.select("series_id", *[F.col(c).alias(f"n_{c}") for c in names])
    return stored.join(n, "series_id", "full_outer").select("series_id", *[F.coalesce(F.nullif(F.col(f"n_{c}"), F.lit("")), F.col(c)).alias(c) for c in names])


def next_loads(marks: DataFrame, key: str, newest: int, step: int) -> DataFrame:
    """(key, start, end): loads resume ``step`` after the mark (0: at it) and end an hour past the newest source hour."""
    return marks.select(key, (F.col("last_ts") + step).alias("start"), F.lit(newest + 3_600_000).alias("end")).where("start < end")


def advance(marks: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """Marks moved to the latest loaded timestamp of their key; they never move back."""
    return marks.select(key, "last_ts").unionByName(loaded.groupBy(key).agg(F.max("timestamp").alias("last_ts"))).groupBy(key).agg(F.max("last_ts").alias("last_ts"))


def changed_keys(batch: DataFrame) -> DataFrame:
    return batch.select(*KEY).distinct()


def change_feed(stored: DataFrame, after: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """(keys, kind, old, new): what makes ``after`` of ``stored``, both with one row per key: rows of kind insert, update and
    delete, with the values before and after as structs. Rows that stay as they are make none. One shuffle on the keys."""
    names = [c for c in stored.columns if c not in keys]
    none = F.lit(None).cast(stored.select(F.struct(*names).alias("x")).schema["x"].dataType)
    tagged = stored.select(*keys, F.struct(*names).alias("old"), none.alias("new")).unionByName(after.select(*keys, none.alias("old"), F.struct(*names).alias("new")))
    g = tagged.groupBy(*keys).agg(F.first("old", True).alias("old"), F.first("new", True).alias("new"))
    kind = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(~F.col("old").eqNullSafe(F.col("new")), "update")
    return g.select(*keys, kind.alias("kind"), "old", "new").where("kind is not null")


def upsert_feed(stored: DataFrame, new: DataFrame, upsert=upsert_orderbook_bars, keys: list[str] = KEY) -> DataFrame:
    """The changes that upserting a batch makes. Only stored rows of the batch's keys are looked at."""
    old = stored.join(new.select(*keys).distinct(), keys, "left_semi")
    return change_feed(old, upsert(old, new).select(*stored.columns), keys)


def apply_feed(stored: DataFrame, feed: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """``stored`` after the changes of ``feed``."""
    return stored.join(feed.select(*keys), keys, "left_anti").unionByName(feed.where("kind <> 'delete'").select(*keys, "new.*").select(*stored.columns))


def refresh_rollup(rollup: DataFrame, after: DataFrame, feed: DataFrame, ms: int) -> DataFrame:
    """Bars of ``ms`` after the changes of ``feed`` to the minute bars, which are ``after`` now: only buckets that a changed
    minute lies in are resampled anew, the others stay."""
    bucket = X.bucket_close(F.col("timestamp"), ms).alias("bucket")
    touched = feed.select("exchange", "symbol", bucket).distinct()
    anew = resample_ohlcv(after.withColumn("bucket", bucket).join(touched, ["exchange", "symbol", "bucket"], "left_semi").drop("bucket"), ms)
    kept = rollup.join(touched.withColumnRenamed("bucket", "timestamp"), KEY, "left_anti")
    return kept.unionByName(anew.select(*rollup.columns))


def hour_keys(start: int) -> Column:
    """Closes that belong to the hour from ``start``: after it and up to the next one."""
    return (F.col("timestamp") > start) & (F.col("timestamp") <= start + 3_600_000)


def overwrite_hour(bars: DataFrame, new: DataFrame, hour: int) -> DataFrame:
    return bars.where(~hour_keys(hour)).unionByName(new.where(hour_keys(hour)))


def overwrite_partitions(bars: DataFrame, path: str) -> None:
    """Write ``bars`` by exchange and date over those partitions of the table at ``path`` alone; ``bars`` mustn't read it."""
    day = F.date_format(F.timestamp_millis(F.col("timestamp") - X.MINUTE), "yyyy-MM-dd")
    b = bars.withColumn("date", day)
    b.repartition("exchange", "date").sortWithinPartitions("symbol", "timestamp").write.partitionBy("exchange", "date").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def oi_change_backfill(bars: DataFrame, start: int, end: int, scope: str = "missing") -> DataFrame:
    """(keys, open_interest_change): the difference to the bar before among those with interest but, with scope
    ``missing``, without a change."""
    todo = in_range(start, end) & F.col("open_interest").isNotNull()
    if scope == "missing":
        todo = todo & F.col("open_interest_change").isNull()
    w = Window.partitionBy("exchange", "symbol").orderBy("timestamp")
    return bars.where(todo).select(*KEY, (F.col("open_interest") - F.lag("open_interest").over(w)).alias("open_interest_change"))


def backfill_oi_change(bars: DataFrame, start: int, end: int, symbol: str | None = None) -> DataFrame:
    """``bars`` with the changes of interest that are missing in [start, end), of ``symbol`` or of all: the difference to the
    bar before among those, which stays missing for the first."""
    todo = in_range(start, end) & F.col("open_interest").isNotNull() & F.col("open_interest_change").isNull()
    if symbol is not None:
        todo = todo & (F.col("symbol") == symbol)
    w = Window.partitionBy("exchange", "symbol", "todo_").orderBy("timestamp")
    b = bars.withColumn("todo_", todo).withColumn("new_", F.when(F.col("todo_"), F.col("open_interest") - F.lag("open_interest").over(w)))
    return b.withColumn("open_interest_change", F.coalesce("new_", "open_interest_change")).select(*bars.columns)


def pending_oi_change(bars: DataFrame, start: int, end: int) -> DataFrame:
    return bars.agg(F.count_if(in_range(start, end) & F.col("open_interest").isNotNull() & F.col("open_interest_change").isNull()).alias("pending"))


def funding_change_backfill(filled: DataFrame) -> DataFrame:
    """(keys, funding_rate, funding_rate_change) of filled rows: null first, then the difference to the row before."""
    w = Window.partitionBy("exchange", "symbol").orderBy("timestamp")
    return filled.select(*KEY, "funding_rate", (F.col("funding_rate") - F.lag("funding_rate").over(w)).alias("funding_rate_change"))
