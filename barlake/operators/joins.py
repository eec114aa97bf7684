"""Joins of bars with slow series, grids and other versions of themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions import scalars as X
from barlake.operators.bars import KEY

#: Milliseconds of a day, the stretch of a symbol that one task sorts.
DAY = 86_400_000


def asof_funding(bars: DataFrame, funding: DataFrame) -> DataFrame:
    """``bars`` with funding_rate: the last point (symbol, time, rate) at or before the close; null before the first.

    Points and bars are stacked and sorted per symbol and day, so that no range is joined and a hot symbol is
    spread over its days. Each day begins with the last rate before it, found over one row per symbol and day
    (``bars`` are read a second time for these, two columns of them). Of points at one time the largest rate counts."""
    b = bars.drop("funding_rate")
    day = (F.col("t_") - F.pmod("t_", F.lit(DAY))).alias("day_")
    rows = b.select("symbol", F.col("timestamp").alias("t_"), F.lit(1).alias("is_bar_"), F.lit(None).cast("double").alias("rate_"), F.struct(*b.columns).alias("b_"))
    none = F.lit(None).cast(rows.schema["b_"].dataType).alias("b_")
    points = funding.select("symbol", F.col("time").alias("t_"), F.lit(0).alias("is_bar_"), F.col("rate").alias("rate_"))
    seen = points.unionByName(rows.drop("b_")).select("symbol", day, F.when(F.col("rate_").isNotNull(), F.struct("t_", "rate_")).alias("at_"))
    days = seen.groupBy("symbol", "day_").agg(F.max("at_").alias("at_"))
    earlier = Window.partitionBy("symbol").orderBy("day_").rowsBetween(Window.unboundedPreceding, -1)
    starts = days.select("symbol", F.col("day_").alias("t_"), F.lit(-1).alias("is_bar_"), F.last("at_", True).over(earlier)["rate_"].alias("rate_")).where("rate_ is not null")
    every = rows.unionByName(points.unionByName(starts).select("*", none)).withColumn("day_", day)
    w = Window.partitionBy("symbol", "day_").orderBy("t_", "is_bar_", "rate_").rowsBetween(Window.unboundedPreceding, 0)
    return every.withColumn("funding_rate", F.last("rate_", True).over(w)).where("is_bar_ = 1").select("b_.*", "funding_rate")


def backfill_funding(bars: DataFrame, funding: DataFrame, start: int, end: int) -> DataFrame:
    """``bars`` whose missing rates in [start, end) are filled as of their close, their changes with them: the difference to
    the filled bar before, null for the first. Other bars keep both. Without a change column there is none to fill."""
    todo = F.col("funding_rate").isNull() & (F.col("timestamp") >= start) & (F.col("timestamp") < end)
    b = asof_funding(bars.withColumn("todo_", todo).withColumn("old_", F.col("funding_rate")), funding)
    if "funding_rate_change" in bars.columns:
        w = Window.partitionBy("exchange", "symbol", "todo_").orderBy("timestamp")
        b = b.withColumn("funding_rate_change", F.when(F.col("todo_"), F.col("funding_rate") - F.lag("funding_rate").over(w)).otherwise(F.col("funding_rate_change")))
    return b.withColumn("funding_rate", F.when(F.col("todo_"), F.col("funding_rate")).otherwise(F.col("old_"))).select(*bars.columns)


def expand_hours(df: DataFrame, start: int, end: int) -> DataFrame:
    """``df`` times the hours from start's to end's, both included."""
    first, last = start // 3_600_000 * 3_600_000, end // 3_600_000 * 3_600_000
    return df.select("*", F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(3_600_000))).alias("hour")) if first <= last else df.select("*", F.lit(0).cast("long").alias("hour")).where(F.lit(False))


def remaining_hours(hours: DataFrame, bars: DataFrame) -> DataFrame:
    """The (exchange, symbol, hour) without a stored bar."""
    done = bars.select("exchange", "symbol", (F.floor((F.col("timestamp") - X.MINUTE) / 3_600_000) * 3_600_000).alias("hour")).distinct()
    return hours.join(done, ["exchange", "symbol", "hour"], "left_anti")


def compare_bars(a: DataFrame, b: DataFrame, fields: list[str]) -> DataFrame:
    """(key, field, a, b, diff, within) per field, and status of the bar: exact, near (a field outside its
    tolerance), diff (all within), missing_db, extra_db; within_all says what near and diff don't. A null that the
    other side has counts as 0 in diff, and as a difference."""
    x = a.select(*KEY, F.struct(*[F.col(f).cast("double").alias(f) for f in fields]).alias("a_"))
    y = b.select(*KEY, F.struct(*[F.col(f).cast("double").alias(f) for f in fields]).alias("b_"))
    j = x.join(y, KEY, "full_outer")
    ok = reduce(lambda p, q: p & q, [X.within_tolerance(f, F.col(f"a_.{f}"), F.col(f"b_.{f}")) for f in fields])
    same = reduce(lambda p, q: p & q, [F.col(f"a_.{f}").eqNullSafe(F.col(f"b_.{f}")) for f in fields])
    status = F.when(F.col("b_").isNull(), "missing_db").when(F.col("a_").isNull(), "extra_db").when(same, "exact").when(~ok, "near").otherwise("diff")
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_.{f}").alias("a"), F.col(f"b_.{f}").alias("b"), F.when(F.col("a_").isNotNull() & F.col("b_").isNotNull(), F.abs(F.coalesce(F.col(f"a_.{f}"), F.lit(0.0)) - F.coalesce(F.col(f"b_.{f}"), F.lit(0.0)))).alias("diff"), X.within_tolerance(f, F.col(f"a_.{f}"), F.col(f"b_.{f}")).alias("within")) for f in fields]))
    both = F.col("a_").isNotNull() & F.col("b_").isNotNull()
    return j.select(*KEY, status.alias("status"), (both & ok).alias("within_all"), long.alias("f")).select(*KEY, "status", "within_all", "f.*")


def diff_summary(compared: DataFrame) -> DataFrame:
    """(field, compared, within, max_diff, mean_diff) of bars that both sides have."""
    c = compared.where("status not in ('missing_db', 'extra_db')")
    return c.groupBy("field").agg(F.count("*").alias("compared"), F.count_if("within").alias("within"), F.max("diff").alias("max_diff"), F.avg("diff").alias("mean_diff"))


def net_flow(inflow: DataFrame, outflow: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, inflow, outflow, netflow, tx_count) of two tables (keys, value, n); a missing side is 0."""
    j = inflow.select(*keys, F.col("value").alias("i"), F.col("n").alias("n_i")).join(outflow.select(*keys, F.col("value").alias("o"), F.col("n").alias("n_o")), keys, "full_outer")
    z = lambda c: F.coalesce(c, F.lit(0))
    return j.select(*keys, z("i").alias("inflow"), z("o").alias("outflow"), (z("i") - z("o")).alias("netflow"), (z("n_i") + z("n_o")).alias("tx_count"))


def minute_grid(hours: DataFrame, volumes: DataFrame) -> DataFrame:
    """The 60 closes of each covered hour with liquidation volumes, 0 where there are none."""
    g = hours.select("exchange", "symbol", F.explode(F.sequence(F.col("hour") + X.MINUTE, F.col("hour") + 3_600_000, F.lit(X.MINUTE))).alias("timestamp"))
    return g.join(volumes, KEY, "left").select(*KEY, F.coalesce("liq_long_vol", F.lit(0.0)).alias("liq_long_vol"), F.coalesce("liq_short_vol", F.lit(0.0)).alias("liq_short_vol"))


def update_liq(bars: DataFrame, grid: DataFrame) -> DataFrame:
    """``bars`` with the grid's liquidation columns where it has their minute; others stay."""
    g = grid.select(*KEY, F.col("liq_long_vol").alias("l_"), F.col("liq_short_vol").alias("s_"), F.lit(1).alias("hit_"))
    new = {"liq_long_vol": "l_", "liq_short_vol": "s_", "liq_covered": "hit_"}
    j = bars.join(g, KEY, "left")
    return j.select(*[F.when(F.col("hit_") == 1, F.col(new[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in bars.columns])


def symbol_universe(coins: DataFrame, instruments: DataFrame, vendor: DataFrame | None, stables: list[str]) -> DataFrame:
    """(symbol, base, rank) in the order of rank, those without one last: coins (base, rank) with a trading USDT
    perpetual under their own name or, up to six letters, 1000 of it, that the vendor has (if asked);
    ``stables`` (in lower case) and names beyond ASCII are left out."""
    low = F.lower("base")
    c = coins.where(~low.isin(stables) & F.col("base").rlike(r"^[\x00-\x7F]*$")).select(F.upper("base").alias("base"), "rank")
    names = F.array_compact(F.array(F.concat("base", F.lit("USDT")), F.when(F.length("base") <= 6, F.concat(F.lit("1000"), "base", F.lit("USDT")))))
    c = c.select("base", "rank", F.posexplode(names).alias("i", "name"))
    live = instruments.where("status = 'TRADING' and contract_type = 'PERPETUAL' and quote = 'USDT'").select(F.col("symbol").alias("name")).distinct()
    best = c.join(live, "name").groupBy("base", "rank").agg(F.min_by("name", "i").alias("name"))
    if vendor is not None:
        best = best.join(vendor.select(F.col("symbol").alias("name")).distinct(), "name", "left_semi")
    return best.select(F.replace("name", F.lit("USDT"), F.lit("/USDT:PERP")).alias("symbol"), "base", "rank").orderBy(F.coalesce("rank", F.lit(999)), "symbol")


def asof_macro(bars: DataFrame, obs: DataFrame) -> DataFrame:
    """``bars`` with value: the last observation (symbol as series, timestamp, value) at or before the close."""
    return asof_funding(bars, obs.select("symbol", F.col("timestamp").alias("time"), F.col("value").alias("rate"))).withColumnRenamed("funding_rate", "value")


def append_missing(new: DataFrame, stored: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """``stored`` and the rows of ``new`` whose keys it lacks, one of each key."""
    return stored.unionByName(new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti"))
