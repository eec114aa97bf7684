"""The supplied tables in the shapes of market data, by the same formulas in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.operators import trades as T

BASE = 1_704_067_200_000  # 2024-01-01 00:00 UTC


def events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.withColumn("ms", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))"))


def trades(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.lit("test").alias("exchange"), F.col("event_type").alias("symbol"), F.col("ms").alias("trade_time"), (100 + F.col("user_id") % 50).cast("double").alias("price"), F.col("value").alias("quantity"), (F.col("event_id") % 2 == 0).alias("is_buyer_maker"), F.col("event_id").alias("trade_id"))


def dense_trades(spark: SparkSession, d: str) -> DataFrame:
    return trades(spark, d).withColumn("trade_time", BASE + F.col("trade_id") * 1000)


def old_trades(spark: SparkSession, d: str) -> DataFrame:
    return dense_trades(spark, d).where("trade_id % 10 <> 0")


def book(spark: SparkSession, d: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy("event_id"))
    e = events(spark, d).withColumn("symbol", F.col("user_id") % 4).withColumn("rn", rn)
    payload = F.expr("(rn - 1) div 3 + 1")
    k = F.get_json_object("props", "$.k").cast("int") % 20
    side = F.when(F.col("event_id") % 2 == 0, "bid").otherwise("ask")
    return e.select(
        "symbol", F.col("rn").cast("long").alias("seq"), F.col("ms").alias("event_time"), F.when(payload % 50 == 0, "snapshot").otherwise("depthUpdate").alias("event_type"), side.alias("side"),
        F.when(F.col("event_id") % 2 == 0, 99 - k).otherwise(101 + k).cast("double").alias("price"), F.when(F.col("event_id") % 7 == 0, 0.0).otherwise(F.col("value")).alias("quantity"),
        payload.alias("final_update_id"), F.when(payload % 97 == 0, payload - 6).otherwise(payload - 1).alias("prev_final_update_id"),
    )


def funding(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy(F.col("event_type").alias("symbol"), F.col("ms").alias("time")).agg((F.max("value") / 1e6).alias("rate"))


def oi(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.lit("test").alias("exchange"), F.col("event_type").alias("symbol"), F.col("ms").alias("ts"), F.col("event_id").alias("seq"), "value")


def liquidations(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.lit("test").alias("exchange"), F.col("event_type").alias("symbol"), F.col("ms").alias("trade_time"), F.col("value").alias("last_filled_quantity"), F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"))


def price_bars(spark: SparkSession, d: str) -> DataFrame:
    return T.ticks_to_price_bars(trades(spark, d))


def flow_bars(spark: SparkSession, d: str) -> DataFrame:
    return T.trade_flow(trades(spark, d))


def orders(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.withColumn("ms", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(o_orderdate as timestamp_ntz))"))


def caps(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).groupBy(F.col("o_orderpriority").alias("coin"), F.col("ms").alias("ts")).agg(F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double").alias("cap"))


def transfers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    at = F.col("ms") + (k % 24) * 3_600_000 + (k % 60) * 60_000
    a, b = F.concat(F.lit("a"), F.col("o_custkey") % 50), F.concat(F.lit("a"), k % 50)
    return orders(spark, d).select(at.alias("block_timestamp"), a.alias("from_address"), b.alias("to_address"), F.round(F.col("o_totalprice") * 100).cast("long").cast("string").alias("value"), F.col("o_orderpriority").alias("token_address"), k.cast("string").alias("transaction_hash"), F.array(a, b).alias("addresses"))


def labels(spark: SparkSession) -> DataFrame:
    return spark.range(10).select(F.concat(F.lit("a"), "id").alias("address"), F.lit("binance").alias("exchange"))


def obs(spark: SparkSession, d: str) -> DataFrame:
    g = orders(spark, d).groupBy(F.col("o_orderpriority").alias("series_id"), F.col("ms").alias("timestamp")).agg(F.sum(F.col("o_totalprice").cast("decimal(20,2)")).alias("s"), F.count("*").alias("c"))
    return g.select("series_id", "timestamp", F.round(F.col("s").cast("double") / F.col("c"), 4).alias("value"))


def obs_with_gaps(spark: SparkSession, d: str) -> DataFrame:
    """obs() with a week's day missing, for what looks for gaps."""
    return obs(spark, d).where(F.dayofmonth(F.timestamp_millis("timestamp")) % 7 != 0)


_E = "events_v as (select *, epoch_us(ts) // 1000 as ms from events)"
_T = "trades_v as (select 'test' as exchange, event_type as symbol, ms as trade_time, (100 + user_id % 50)::double as price, value as quantity, event_id % 2 = 0 as is_buyer_maker, event_id as trade_id, (ms // 60000 + 1) * 60000 as timestamp from events_v)"
_D = f"dense_v as (select * exclude (trade_time, timestamp), {BASE} + trade_id * 1000 as trade_time, (({BASE} + trade_id * 1000) // 60000 + 1) * 60000 as timestamp from trades_v)"
_PB = "price_bars_v as (select exchange, symbol, timestamp, arg_min(price, (trade_time, trade_id)) as open, max(price) as high, min(price) as low, arg_max(price, (trade_time, trade_id)) as close, sum(quantity) as volume from trades_v group by all)"
_FB = """flow_v as (select exchange, symbol, timestamp, count(*)::bigint as trade_count, sum(case when not is_buyer_maker then quantity else 0 end) as buy_volume, sum(case when is_buyer_maker then quantity else 0 end) as sell_volume,
  case when sum(quantity) > 0 then sum(price * quantity) / sum(quantity) else 0 end as vwap from trades_v group by all)"""
_BOOK = """book_v as (select symbol, rn as seq, ms as event_time, case when p % 50 = 0 then 'snapshot' else 'depthUpdate' end as event_type, case when event_id % 2 = 0 then 'bid' else 'ask' end as side,
  (case when event_id % 2 = 0 then 99 - k else 101 + k end)::double as price, case when event_id % 7 = 0 then 0.0 else value end::double as quantity, p as final_update_id, case when p % 97 = 0 then p - 6 else p - 1 end as prev_final_update_id
  from (select *, (rn - 1) // 3 + 1 as p from (select *, user_id % 4 as symbol, row_number() over (partition by user_id % 4 order by event_id) as rn, (props::json->>'$.k')::int % 20 as k from events_v)))"""
_BOOK2 = """cont_v as (select *, sum(case when reset then 1 else 0 end) over (partition by symbol order by seq) as epoch from (
  select *, (snap and final_update_id <> last_snap) or (not snap and pf <> 0 and final_update_id <> pf and prev_final_update_id <> pf) as reset from (
    select *, event_type = 'snapshot' as snap, lag(final_update_id, 1, 0) over (partition by symbol order by seq) as pf,
      coalesce(max(case when event_type = 'snapshot' then final_update_id end) over (partition by symbol order by seq rows between unbounded preceding and 1 preceding), 0) as last_snap from book_v))),
depth_v as (select *, max(case when snap or (round(bid_depth, 9) >= 100 and round(ask_depth, 9) >= 100) then 1 else 0 end) over (partition by symbol, epoch order by seq) = 1 as warm from (
  select *, sum(case when side = 'bid' then delta else 0 end) over w as bid_depth, sum(case when side = 'ask' then delta else 0 end) over w as ask_depth from (
    select *, (price * 10000)::bigint as level, quantity - lag(quantity, 1, 0.0) over (partition by symbol, epoch, side, price order by seq) as delta, lead(seq) over (partition by symbol, epoch, side, price order by seq) as next_seq from cont_v)
  window w as (partition by symbol, epoch order by seq))),
ends_v as (select symbol, epoch, max(seq) + 1 as stop from depth_v group by all),
live_v as (select d.symbol, d.epoch, side, level, seq, coalesce(next_seq, stop) as stop from depth_v d join ends_v e on d.symbol = e.symbol and d.epoch = e.epoch where quantity <> 0),
best_v as (select d.symbol, d.seq, coalesce(max(case when l.side = 'bid' then l.level end), 0) / 1e4 as best_bid, coalesce(min(case when l.side = 'ask' then l.level end), 0) / 1e4 as best_ask
  from depth_v d left join live_v l on d.symbol = l.symbol and d.epoch = l.epoch and l.seq <= d.seq and d.seq < l.stop group by all)"""
_FUND = "funding_v as (select event_type as symbol, ms as time, max(value) / 1e6 as rate from events_v group by all)"
_OI = "oi_v as (select 'test' as exchange, event_type as symbol, ms as ts, event_id as seq, value, (ms // 60000 + 1) * 60000 as timestamp from events_v)"
_LIQ = "liq_v as (select 'test' as exchange, event_type as symbol, ms as trade_time, value as last_filled_quantity, case when event_id % 2 = 0 then 'BUY' else 'SELL' end as side, (ms // 60000 + 1) * 60000 as timestamp from events_v)"
_O = "orders_v as (select *, epoch_ms(o_orderdate::timestamp) as ms from orders)"
_CAPS = "caps_v as (select o_orderpriority as coin, ms as ts, sum(o_totalprice::decimal(20,2))::double as cap from orders_v group by all)"
_TR = """transfers_v as (select ms + (o_orderkey % 24) * 3600000 + (o_orderkey % 60) * 60000 as block_timestamp, 'a' || (o_custkey % 50) as from_address, 'a' || (o_orderkey % 50) as to_address, round(o_totalprice * 100)::bigint as value, o_orderpriority as token_address,
  o_orderkey as transaction_hash from orders_v),
labels_v as (select 'a' || range as address, 'binance' as exchange from range(10))"""
_OBS = "obs_v as (select o_orderpriority as series_id, ms as timestamp, round(sum(o_totalprice::decimal(20,2))::double / count(*), 4) as value from orders_v group by all)"
_OBS_GAPS = "gaps_v as (select * from obs_v where day(make_timestamp(timestamp * 1000)) % 7 <> 0)"

#: From book_v on.
BOOK_STEPS = _BOOK2

VIEWS = {"t": [_E, _T], "d": [_E, _T, _D], "pb": [_E, _T, _PB], "fb": [_E, _T, _FB], "book": [_E, _BOOK, _BOOK2], "fund": [_E, _T, _PB, _FB, _FUND], "oi": [_E, _T, _FB, _OI], "liq": [_E, _T, _FB, _LIQ], "caps": [_O, _CAPS], "tr": [_O, _TR], "obs": [_O, _OBS], "gaps": [_O, _OBS, _OBS_GAPS]}


def sql(views: str, body: str) -> str:
    parts = list(dict.fromkeys(v for name in views.split() for v in VIEWS[name]))
    more = body.lstrip()
    return "with " + ",\n".join(parts) + (",\n" + more[5:] if more.startswith("with ") else "\n" + more)
