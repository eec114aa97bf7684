
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions import scalars as X
from barlake.functions import symbols as S
from barlake.operators import audit, bars, book, flows, gaps, history, joins, tables, trades
from barlake.plans import adapters as A
from barlake.scratch import new_path, spool
from barlake.sources import files, messages
from barlake.streaming import live

QUERIES: dict = {}
ORACLE_SQL: dict = {}
H, DAY = 3_600_000, 86_400_000
#: The range of the sample bars that range queries take.
LO, HI = A.BASE + 6 * H, A.BASE + 30 * H
K = "exchange, symbol, timestamp"


def query(name: str, views: str = "", oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = A.sql(views, oracle) if views else oracle
        return f

    return add


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) as {n}" for n in names)


def flagship(spark, d):
    return rounded(bars.resample_ohlcv(A.price_bars(spark, d), H))


_FLOW = "select exchange, symbol, timestamp, trade_count, " + _r("buy_volume", "sell_volume", "vwap") + " from flow_v"
query("A1_A2_trade_flow", "fb", _FLOW)(lambda s, d: rounded(A.flow_bars(s, d)))
_OHLCV = _r("open", "high", "low", "close", "volume")
query("A14_ticks_to_price_bars", "pb", f"select {K}, {_OHLCV} from price_bars_v")(lambda s, d: rounded(A.price_bars(s, d)))


def _resample_sql(ms: int) -> str:
    return f"""select exchange, symbol, b as timestamp, {_OHLCV} from (select exchange, symbol, ((timestamp - 60000) // {ms}) * {ms} + {ms} as b, arg_min(open, timestamp) as open, max(high) as high, min(low) as low,
      arg_max(close, timestamp) as close, sum(volume) as volume from price_bars_v group by all)"""


query("A15_A16_resample_ohlcv_1h", "pb", _resample_sql(H))(flagship)
query("A15_resample_ohlcv_7m", "pb", _resample_sql(7 * 60_000))(lambda s, d: rounded(bars.resample_ohlcv(A.price_bars(s, d), 7 * 60_000)))
query("A15_resample_ohlcv_1M", "pb", _resample_sql(2_629_746_000))(lambda s, d: rounded(bars.resample_ohlcv(A.price_bars(s, d), 2_629_746_000)))

_LEVELS = """with h as (select exchange, symbol, timestamp, round(price * 1e8)::bigint as key, sum(case when not is_buyer_maker then quantity else 0 end) as buy, sum(case when is_buyer_maker then quantity else 0 end) as sell,
  sum(case when not is_buyer_maker then price * quantity else 0 end) as bpq, sum(case when is_buyer_maker then price * quantity else 0 end) as spq, sum(price * price * quantity) as p2q from dense_v where price > 0 and quantity > 0 group by all)"""
query("A4_level_histogram", "d", _LEVELS + f"select {K}, key, {_r('buy', 'sell')} from h")(lambda s, d: rounded(trades.level_histogram(A.dense_trades(s, d)).select("exchange", "symbol", "timestamp", "key", "buy", "sell")))
_FOOT = (
    _LEVELS
    + f""", r as (select *, row_number() over (partition by {K} order by key) as lo, row_number() over (partition by {K} order by key desc) as hi, row_number() over (partition by {K} order by buy + sell desc, key) as rt,
  row_number() over (partition by {K} order by buy desc, key) as rb, row_number() over (partition by {K} order by sell desc, key) as rs from h),
g as (select {K}, sum(buy) as b, sum(sell) as s, sum(bpq) as bpq, sum(spq) as spq, sum(p2q) as p2q, max(case when rt = 1 then key end) / 1e8 as poc, max(case when rt = 1 then buy + sell end) as pv, max(case when rb = 1 then key end) / 1e8 as bp,
  max(case when rs = 1 then key end) / 1e8 as sp, sum(case when hi <= 3 then buy else 0 end) as hb, sum(case when hi <= 3 then sell else 0 end) as hs, sum(case when lo <= 3 then buy else 0 end) as lb, sum(case when lo <= 3 then sell else 0 end) as ls from r group by all),
o as (select {K}, arg_min(price, (trade_time, trade_id)) as trade_open, max(price) as trade_high, min(price) as trade_low, arg_max(price, (trade_time, trade_id)) as trade_close from dense_v where price > 0 and quantity > 0 group by all)
select {K}, trade_open, trade_high, trade_low, trade_close, case when b > 0 then round(bpq / b, 6) end as buy_vwap, case when s > 0 then round(spq / s, 6) end as sell_vwap, round(poc, 6) as poc_price, round(pv / (b + s), 6) as poc_volume_share,
  case when b > 0 then round(bp, 6) end as buy_poc_price, case when s > 0 then round(sp, 6) end as sell_poc_price, round(sqrt(greatest(0, p2q / (b + s) - ((bpq + spq) / (b + s)) ** 2)), 3) as trade_price_std,
  round(hb, 6) as hi_band_buy_vol, round(hs, 6) as hi_band_sell_vol, round(lb, 6) as lo_band_buy_vol, round(ls, 6) as lo_band_sell_vol from g join o using ({K})"""
)
query("A3_A5_A6_A7_A8_A9_footprint", "d", _FOOT)(lambda s, d: rounded(trades.footprint(A.dense_trades(s, d)).withColumn("trade_price_std", F.round("trade_price_std", 3))))

# the book
_CONT = "select symbol, seq, final_update_id, reset, epoch::bigint as epoch from cont_v"
query("W10_book_continuity", "book", _CONT)(lambda s, d: book.continuity(A.book(s, d), 1000).select("symbol", "seq", "final_update_id", "reset", F.col("epoch").cast("long").alias("epoch")))
_DEPTH = "select symbol, seq, " + _r("bid_depth", "ask_depth") + ", warm from depth_v"
query("W11_W13_book_depth", "book", _DEPTH)(lambda s, d: rounded(book.depth(A.book(s, d), 1000).select("symbol", "seq", "bid_depth", "ask_depth", "warm")))
query("W12_best_bid_ask", "book", "select symbol, seq, best_bid, best_ask from best_v")(lambda s, d: book.best_bid_ask(A.book(s, d), 1000))
_STATS = """select symbol, timestamp, count(*)::bigint as n_samples, round(coalesce(avg(x), 0), 5) as avg_spread, round(coalesce(stddev_samp(x), 0), 5) as spread_std_dev,
  case when round(avg(bid_depth) + avg(ask_depth), 9) > 0 then round((avg(bid_depth) - avg(ask_depth)) / (avg(bid_depth) + avg(ask_depth)), 5) else 0 end as depth_imbalance,
  case when round(avg(bid_depth) + avg(ask_depth), 9) > 0 then round(avg(ask_depth) / (avg(bid_depth) + avg(ask_depth)), 5) else 0 end as depth_ratio
from (select d.symbol, (event_time // 60000 + 1) * 60000 as timestamp, bid_depth, ask_depth, case when best_bid > 0 and best_ask > best_bid then (best_ask - best_bid) / best_bid * 10000 end as x
  from depth_v d join best_v b on d.symbol = b.symbol and d.seq = b.seq where warm) group by all"""
query("A10_A11_W14_book_stats", "book", _STATS)(lambda s, d: rounded(book.book_stats(A.book(s, d), 1000), 5))
_PROF = """select 'event_type' as what, event_type as value, count(*)::bigint as n from book_v group by all union all select 'side', side, count(*) from book_v group by all
union all select 'id_break', 'rows', count(*) filter (where l <> prev_final_update_id) from (select *, lag(final_update_id) over (partition by symbol order by seq) as l from book_v)"""
query("A39_profile_book", "book", _PROF)(lambda s, d: book.profile_book(A.book(s, d), 1000))

# parts and carries
_LIQ = f"select {K}, round(sum(case when side = 'BUY' then last_filled_quantity else 0 end), 6) as liq_short_vol, round(sum(case when side = 'BUY' then 0 else last_filled_quantity end), 6) as liq_long_vol from liq_v group by all"
query("A12_liquidation_volume", "liq", _LIQ)(lambda s, d: rounded(bars.liquidation_volume(A.liquidations(s, d))))
query("A13_last_oi", "oi", f"select {K}, arg_max(value, (ts, seq)) as open_interest from oi_v group by all")(lambda s, d: bars.last_oi(A.oi(s, d)))


def _hours(df: DataFrame) -> DataFrame:
    return df.select("exchange", "symbol", (F.floor((F.col("timestamp") - 60_000) / H) * H).alias("hour")).distinct()


def _covered_hours(s, d):
    return _hours(A.flow_bars(s, d)).where(F.col("hour") / H % 2 == 0)


_COV = f"""with l as ({_LIQ}) select f.exchange, f.symbol, f.timestamp, case when c then 1 else 0 end as liq_covered, case when c then coalesce(liq_long_vol, 0) end as liq_long_vol, case when c then coalesce(liq_short_vol, 0) end as liq_short_vol
from (select *, ((timestamp - 60000) // {H}) % 2 = 0 as c from flow_v) f left join l on f.exchange = l.exchange and f.symbol = l.symbol and f.timestamp = l.timestamp"""
query("A12_covered_liquidations", "liq", _COV)(lambda s, d: rounded(bars.covered(A.flow_bars(s, d).select("exchange", "symbol", "timestamp"), bars.liquidation_volume(A.liquidations(s, d)), _covered_hours(s, d))))
_ASM = f"""with o as (select {K}, arg_max(value, (ts, seq)) as open_interest from oi_v group by all), l as ({_LIQ})
select coalesce(f.exchange, o.exchange, l.exchange) as exchange, coalesce(f.symbol, o.symbol, l.symbol) as symbol, coalesce(f.timestamp, o.timestamp, l.timestamp) as timestamp, coalesce(trade_count, 0) as trade_count,
  round(coalesce(vwap, 0), 6) as vwap, open_interest, liq_long_vol, liq_short_vol
from flow_v f full join o on f.exchange = o.exchange and f.symbol = o.symbol and f.timestamp = o.timestamp full join l on coalesce(f.exchange, o.exchange) = l.exchange and coalesce(f.symbol, o.symbol) = l.symbol and coalesce(f.timestamp, o.timestamp) = l.timestamp"""


def _assembled(s, d):
    return bars.assemble(A.flow_bars(s, d), bars.last_oi(A.oi(s, d)), bars.liquidation_volume(A.liquidations(s, d)))


query("J12_assemble_bar", "oi liq", _ASM)(lambda s, d: rounded(_assembled(s, d).select("exchange", "symbol", "timestamp", "trade_count", "vwap", "open_interest", "liq_long_vol", "liq_short_vol")))
_OIC = f"""with o as (select {K}, arg_max(value, (ts, seq)) as oi from oi_v group by all), j as (select f.*, oi from flow_v f left join o using ({K})),
fl as (select {K}, last_value(oi ignore nulls) over (partition by exchange, symbol order by timestamp) as open_interest from j)
select {K}, open_interest, round(open_interest - lag(open_interest) over (partition by exchange, symbol order by timestamp), 6) as open_interest_change from fl"""


def _with_oi(s, d):
    k = ["exchange", "symbol", "timestamp"]
    return A.flow_bars(s, d).join(bars.last_oi(A.oi(s, d)), k, "left").select(*k, "open_interest")


query("W1_oi_carry", "oi", _OIC)(lambda s, d: rounded(bars.oi_carry(_with_oi(s, d))))

# as-of joins
_ASOF = f"""with b as (select p.exchange, p.symbol, p.timestamp, f.rate as funding_rate from price_bars_v p asof left join funding_v f on p.symbol = f.symbol and p.timestamp >= f.time)"""


def _funded(s, d):
    return joins.asof_funding(A.price_bars(s, d).select("exchange", "symbol", "timestamp"), A.funding(s, d))


query("J1_asof_funding", "fund", _ASOF + f"select {K}, round(funding_rate, 10) as funding_rate from b")(lambda s, d: rounded(_funded(s, d), 10))
_FC = _ASOF + f"select {K}, round(funding_rate - lag(funding_rate) over (partition by exchange, symbol order by timestamp), 10) as funding_rate_change from b"
query("W2_funding_change", "fund", _FC)(lambda s, d: rounded(bars.funding_change(_funded(s, d)).select("exchange", "symbol", "timestamp", "funding_rate_change"), 10))
query("W5_funding_change_backfill", "fund", _ASOF + f"select {K}, round(funding_rate, 10) as funding_rate, round(funding_rate - lag(funding_rate) over (partition by exchange, symbol order by timestamp), 10) as funding_rate_change from b where funding_rate is not null")(
    lambda s, d: rounded(tables.funding_change_backfill(_funded(s, d).where("funding_rate is not null")), 10)
)


def _sparse_funding(s, d):
    """Bars whose rate is known only on even minutes."""
    return _funded(s, d).withColumn("funding_rate", F.when(F.col("timestamp") / 60_000 % 2 == 0, F.col("funding_rate")))


query("W3_funding_carry", "fund", _ASOF + f", c as (select {K}, last_value(case when timestamp // 60000 % 2 = 0 then funding_rate end ignore nulls) over (partition by exchange, symbol order by timestamp) as funding_rate from b) select {K}, round(funding_rate, 10) as funding_rate, round(funding_rate - lag(funding_rate) over (partition by exchange, symbol order by timestamp), 10) as funding_rate_change from c")(
    lambda s, d: rounded(bars.funding_carry(_sparse_funding(s, d)), 10)
)
query("J2_backfill_funding", "fund", _ASOF + f""", x as (select *, timestamp // 60000 % 2 = 0 as known, timestamp // 60000 % 2 > 0 and timestamp >= {LO} and timestamp < {HI} as todo from b)
select {K}, round(case when known or todo then funding_rate end, 10) as funding_rate, round(case when todo then funding_rate - lag(funding_rate) over (partition by exchange, symbol, todo order by timestamp) when known then 0.5 end, 10) as funding_rate_change from x""")(
    lambda s, d: rounded(joins.backfill_funding(_sparse_funding(s, d).withColumn("funding_rate_change", F.when(F.col("timestamp") / 60_000 % 2 == 0, 0.5)), A.funding(s, d), LO, HI), 10)
)
query("A38_funding_missing_pct", "fund", _ASOF + "select exchange, symbol, round(avg(case when funding_rate is null then 1 else 0 end) * 100, 4) as missing_pct, avg(case when funding_rate is null then 1 else 0 end) > 0.5 as warn from b group by all")(lambda s, d: audit.funding_missing_pct(_funded(s, d)))

# hours, grids, comparisons
_REM = f"""with hr as (select exchange, symbol, unnest(range({LO}, {HI} + 1, {H})) as hour from (select distinct exchange, symbol from price_bars_v))
select * from hr where not exists (select 1 from price_bars_v p where p.exchange = hr.exchange and p.symbol = hr.symbol and (p.timestamp - 60000) // {H} * {H} = hr.hour)"""


def _symbols(s, d):
    return A.price_bars(s, d).select("exchange", "symbol").distinct()


query("J3_P9_remaining_hours", "pb", _REM)(lambda s, d: joins.remaining_hours(joins.expand_hours(_symbols(s, d), LO, HI), A.price_bars(s, d)))
query("J7_minute_grid", "liq", f"""with l as ({_LIQ}), h as (select distinct exchange, symbol, (timestamp - 60000) // {H} * {H} as hour from flow_v), g as (select exchange, symbol, hour + m * 60000 as timestamp from h, range(1, 61) r(m) where hour // {H} % 2 = 0)
select {K}, coalesce(liq_long_vol, 0) as liq_long_vol, coalesce(liq_short_vol, 0) as liq_short_vol from g left join l using ({K})""")(lambda s, d: rounded(joins.minute_grid(_covered_hours(s, d), bars.liquidation_volume(A.liquidations(s, d)))))
_NEW, _OLD = "select * from dense_v", "select * from dense_v where trade_id % 10 <> 0"
_F8 = ["vwap", "trade_count", "buy_volume", "sell_volume"]


def _flow_of(v: str) -> str:
    return f"""select {K}, count(*)::double as trade_count, sum(case when not is_buyer_maker then quantity else 0 end)::double as buy_volume, sum(case when is_buyer_maker then quantity else 0 end)::double as sell_volume,
      (case when sum(quantity) > 0 then sum(price * quantity) / sum(quantity) else 0 end)::double as vwap from ({v}) group by all"""


_CMP = f"""with a as ({_flow_of(_NEW)}), b as ({_flow_of(_OLD)}), j as (select coalesce(a.exchange, b.exchange) as exchange, coalesce(a.symbol, b.symbol) as symbol, coalesce(a.timestamp, b.timestamp) as timestamp, a.symbol is not null as ha, b.symbol is not null as hb,
  f as field, case f when 'vwap' then round(a.vwap, 6) when 'trade_count' then a.trade_count when 'buy_volume' then round(a.buy_volume, 6) else round(a.sell_volume, 6) end as a, case f when 'vwap' then round(b.vwap, 6) when 'trade_count' then b.trade_count when 'buy_volume' then round(b.buy_volume, 6) else round(b.sell_volume, 6) end as b
  from a full join b on a.exchange = b.exchange and a.symbol = b.symbol and a.timestamp = b.timestamp, unnest(['vwap', 'trade_count', 'buy_volume', 'sell_volume']) u(f)),
w as (select *, abs(a - b) as diff, coalesce(abs(a - b) <= case field when 'vwap' then 0.01 when 'trade_count' then 5 else 0.05 end, a is null and b is null) as within from j)"""
_COMPARED = f"""{_CMP} select {K}, field, a, b, round(diff, 6) as diff, within, case when not hb then 'missing_db' when not ha then 'extra_db' when bool_and(a is not distinct from b) over p then 'exact' when not bool_and(within) over p then 'near' else 'diff' end as status,
  ha and hb and bool_and(within) over p as within_all from w window p as (partition by {K})"""


def _versions(s, d):
    return rounded(trades.trade_flow(A.dense_trades(s, d))), rounded(trades.trade_flow(A.old_trades(s, d)))


query("J4_F13_F16_compare_bars", "d", _COMPARED)(lambda s, d: rounded(joins.compare_bars(*_versions(s, d), _F8)))
query("A28_diff_summary", "d", f"{_CMP} select field, count(*)::bigint as compared, count(*) filter (where within)::bigint as within, round(max(diff), 6) as max_diff, round(avg(diff), 6) as mean_diff from w where ha and hb group by all")(
    lambda s, d: rounded(joins.diff_summary(joins.compare_bars(*_versions(s, d), _F8)))
)
query("T5_first_differences", "d", f"select * from ({_COMPARED}) where status <> 'exact' order by timestamp, symbol, field limit 20")(lambda s, d: rounded(audit.first_differences(joins.compare_bars(*_versions(s, d), _F8))))
_OHLC_OF = "select exchange, symbol, timestamp, arg_min(price, (trade_time, trade_id)) as open, max(price) as high, min(price) as low, arg_max(price, (trade_time, trade_id)) as close, round(sum(quantity), 6) as volume from ({}) group by all"
query("M1_J13_insert_price_bars", "d", f"with n as ({_OHLC_OF.format(_NEW)}), o as ({_OHLC_OF.format(_OLD)}) select * from o union all select * from n anti join o using ({K})")(
    lambda s, d: rounded(tables.insert_price_bars(trades.ticks_to_price_bars(A.dense_trades(s, d)), trades.ticks_to_price_bars(A.old_trades(s, d))))
)


def _book_version(df: DataFrame, a: int, b: int) -> DataFrame:
    """A version of bars with book, late and footprint columns that differ by minute (m) as ``a`` and ``b`` say."""
    m = F.expr("timestamp div 60000")
    num = lambda k: (m % k).cast("double")
    some = lambda k, v: F.when(m % k > 0, v)
    late = {c: some(a + i, num(17 + a)) for i, c in enumerate(_LATE)}
    foot = {c: some(a + 2, F.col("vwap") + i) for i, c in enumerate(trades.FOOTPRINT)}
    return df.withColumns({"avg_spread": num(a), "spread_std_dev": num(b), "depth_imbalance": num(b + 7), "depth_ratio": num(b), "liq_covered": (m % a == 0).cast("int"), **late, **foot})


_LATE = ["open_interest", "open_interest_change", "funding_rate", "funding_rate_change", "liq_long_vol", "liq_short_vol"]


def _stored_and_new(s, d):
    """Stored bars from most trades; new ones from those of odd ids, so that counts differ both ways."""
    m = F.expr("timestamp div 60000")
    stored = _book_version(trades.trade_flow(A.old_trades(s, d)), 3, 2)
    new = _book_version(trades.trade_flow(A.dense_trades(s, d).where("trade_id % 2 = 1 or trade_id % 10 = 0")), 2, 3)
    return stored, new.where(m % 7 > 0)


def _version_sql(v: str, a: int, b: int) -> str:
    late = [f"case when m % {a + i} > 0 then (m % {17 + a})::double end as {c}" for i, c in enumerate(_LATE)]
    foot = [f"case when m % {a + 2} > 0 then vwap + {i} end as {c}" for i, c in enumerate(trades.FOOTPRINT)]
    return f"select *, (m % {a})::double as avg_spread, (m % {b})::double as spread_std_dev, (m % {b + 7})::double as depth_imbalance, (m % {b})::double as depth_ratio, case when m % {a} = 0 then 1 else 0 end as liq_covered, {', '.join(late + foot)} from (select *, timestamp // 60000 as m from ({_flow_of(v)}))"


def _merged(name: str, good: str) -> str:
    digits = f"round(case when o.symbol is null or ({good}) then n.{name} else o.{name} end, 6)"
    return f"{digits} as {name}"


_FULLER = "n.trade_count >= o.trade_count"
_UPS = f"""with o as ({_version_sql(_OLD, 3, 2)}), n as (select * from ({_version_sql(_NEW + ' where trade_id % 2 = 1 or trade_id % 10 = 0', 2, 3)}) where m % 7 > 0)
select coalesce(o.exchange, n.exchange) as exchange, coalesce(o.symbol, n.symbol) as symbol, coalesce(o.timestamp, n.timestamp) as timestamp, greatest(coalesce(o.trade_count, 0), coalesce(n.trade_count, 0))::bigint as trade_count, greatest(coalesce(o.liq_covered, 0), coalesce(n.liq_covered, 0)) as liq_covered,
  {", ".join([_merged(c, f"{_FULLER} and n.trade_count > 0") for c in ("vwap", "buy_volume", "sell_volume")] + [_merged(c, f"n.{c} > 0") for c in ("avg_spread", "spread_std_dev", "depth_ratio")] + [_merged("depth_imbalance", "n.depth_ratio > 0")] + [f"coalesce(n.{c}, o.{c}) as {c}" for c in _LATE] + [_merged(c, f"n.trade_open is not null and {_FULLER}") for c in trades.FOOTPRINT])}
from o full join n on o.exchange = n.exchange and o.symbol = n.symbol and o.timestamp = n.timestamp"""
query("M2_upsert_orderbook_bars", "d", _UPS)(lambda s, d: rounded(tables.upsert_orderbook_bars(*_stored_and_new(s, d))))


def _both_versions(s, d):
    a, b = _stored_and_new(s, d)
    return a.withColumn("seq", F.lit(1)).unionByName(b.withColumn("seq", F.lit(2)))


_BOTH = f"""with v as (select *, (timestamp // 60000 % 3)::double as sp, 1 as seq from ({_flow_of(_OLD)}) union all select *, (timestamp // 60000 % 2)::double, 2 from ({_flow_of(_NEW + ' where trade_id % 2 = 1 or trade_id % 10 = 0')}) where timestamp // 60000 % 7 > 0)"""
query("A17_dedup_bars", "d", f"{_BOTH} select {K}, trade_count::bigint as trade_count, seq, sp as avg_spread from v qualify row_number() over (partition by {K} order by trade_count desc, case when sp > 0 then 1 else 0 end desc, seq) = 1")(
    lambda s, d: bars.dedup_bars(_both_versions(s, d)).select("exchange", "symbol", "timestamp", "trade_count", "seq", "avg_spread")
)
query("A18_dedup_sorted", "d", f"{_BOTH} select {K}, trade_count::bigint as trade_count, seq from v qualify row_number() over (partition by {K} order by seq) = 1")(lambda s, d: bars.dedup_sorted(_both_versions(s, d)).select("exchange", "symbol", "timestamp", "trade_count", "seq"))

# positional resampling
_RICH = {
    "avg_spread": "(m % 3)::double", "spread_std_dev": "(m % 7)::double", "depth_imbalance": "(m % 4)::double", "depth_ratio": "(m % 5)::double", "funding_rate": "case when m % 3 > 0 then (m % 11)::double end", "liq_covered": "case when m % 9 = 0 then 1 else 0 end",
    "open_interest": "case when m % 4 > 0 then (m % 13)::double end",
}
_RES = f"""with a as (select f.*, liq_long_vol, liq_short_vol, f.timestamp // 60000 as m from flow_v f left join ({_LIQ}) l on f.exchange = l.exchange and f.symbol = l.symbol and f.timestamp = l.timestamp), f as (select *, {", ".join(f"{v} as {k}" for k, v in _RICH.items())}, (row_number() over (partition by exchange, symbol order by timestamp) - 1) // 5 as c from a)
select exchange, symbol, max(timestamp) as timestamp, sum(trade_count)::bigint as trade_count, round(sum(buy_volume), 6) as buy_volume, round(sum(sell_volume), 6) as sell_volume, round(case when sum(buy_volume + sell_volume) > 0 then sum(vwap * (buy_volume + sell_volume)) / sum(buy_volume + sell_volume) else arg_max(vwap, timestamp) end, 6) as vwap,
  round(avg(avg_spread), 6) as avg_spread, arg_max(spread_std_dev, timestamp) as spread_std_dev, round(avg(depth_imbalance), 6) as depth_imbalance, round(avg(depth_ratio), 6) as depth_ratio, arg_max_null(open_interest, timestamp) as open_interest, coalesce(arg_max_null(open_interest, timestamp) - arg_min_null(open_interest, timestamp), 0) as open_interest_change,
  arg_max_null(funding_rate, timestamp) as funding_rate, coalesce(arg_max_null(funding_rate, timestamp) - arg_min_null(funding_rate, timestamp), 0) as funding_rate_change, round(sum(coalesce(liq_long_vol, 0)), 6) as liq_long_vol, round(sum(coalesce(liq_short_vol, 0)), 6) as liq_short_vol, max(liq_covered) as liq_covered from f group by exchange, symbol, c"""


def _full_bars(s, d):
    b = A.flow_bars(s, d).join(bars.liquidation_volume(A.liquidations(s, d)), ["exchange", "symbol", "timestamp"], "left").withColumn("m", F.expr("timestamp div 60000"))
    return b.withColumns({k: F.expr(v.replace("(m % ", "cast(m % ").replace(")::double", " as double)")) for k, v in _RICH.items()}).drop("m")


query("A19_resample_orderbook", "liq", _RES)(lambda s, d: rounded(bars.resample_orderbook(_full_bars(s, d), 5)))

# gaps
_GAPS = f"""with b as (select distinct exchange, symbol, timestamp from price_bars_v where timestamp >= {LO} and timestamp < {HI}), e as (select exchange, symbol, min(timestamp) as lo, max(timestamp) as hi from b group by all)
select exchange, symbol, timestamp + 60000 as gap_start, nx as gap_end from (select *, lead(timestamp) over (partition by exchange, symbol order by timestamp) as nx from b) where nx > timestamp + 60000
union all select exchange, symbol, {LO}, lo from e where lo > {LO} + 60000 union all select exchange, symbol, hi + 60000, {HI} from e where hi + 60000 < {HI}"""
query("W6_find_gaps", "pb", _GAPS + f" union all select exchange, symbol, {LO}, {HI} from (select distinct exchange, upper(symbol) as symbol from price_bars_v)")(lambda s, d: gaps.find_gaps(A.price_bars(s, d), LO, HI, 60_000, of=_symbols(s, d).unionByName(_symbols(s, d).withColumn("symbol", F.upper("symbol")))).select("exchange", "symbol", F.col("gap_start").cast("long").alias("gap_start"), F.col("gap_end").cast("long").alias("gap_end")))


def _odd_days(s, d):
    return A.price_bars(s, d).where(F.floor((F.col("timestamp") - 60_000) / DAY) % 3 > 0)


_D0, _D1 = A.BASE - 2 * DAY, A.BASE + 9 * DAY
_DAYS = f"""with h as (select distinct exchange, symbol, (timestamp - 60000) // {DAY} as day from price_bars_v where (timestamp - 60000) // {DAY} % 3 > 0), r as (select exchange, symbol, unnest(range({_D0 // DAY}, {_D1 // DAY} + 1)) as day from (select distinct exchange, symbol from h)),
m as (select *, day - row_number() over (partition by exchange, symbol order by day) as i from r anti join h using (exchange, symbol, day))
select exchange, symbol, min(day) as first_day, max(day) as last_day, case when max(day) < {_D1 // DAY} then max(day) + 1 else max(day) end as until_day from m group by exchange, symbol, i"""
query("W7_P10_missing_day_ranges", "pb", _DAYS)(lambda s, d: gaps.missing_day_ranges(_odd_days(s, d), _D0, _D1).select("exchange", "symbol", *[F.col(c).cast("long").alias(c) for c in ("first_day", "last_day", "until_day")]))
query("A42_days_with_data", "pb", f"select distinct exchange, symbol, (timestamp - 60000) // {DAY} as day from price_bars_v")(lambda s, d: gaps.days_with_data(A.price_bars(s, d)))
_FULL = f"""with b as (select *, row_number() over (partition by exchange, symbol order by timestamp) as r from ({{src}}) where timestamp >= {{lo}} and timestamp < {{hi}}), g as (select exchange, symbol, count(*)::bigint as n, min(timestamp) as lo, max(timestamp) as hi, coalesce(nullif(max(case when r = 2 then timestamp end) - min(timestamp), 0), {{ms}}) as step from b group by all)
select exchange, symbol, n, hi >= {{hi}} - step and lo - step <= {{lo}} + 300000 and n >= floor((({{hi}} - {{lo}}) // 60000 // ({{ms}} // 60000)) * 0.95) as complete from g"""
query("A41_data_complete", "pb", _FULL.format(src="select * from price_bars_v", lo=LO, hi=HI, ms=60_000))(lambda s, d: gaps.data_complete(A.price_bars(s, d), LO, HI))
query("A41_data_complete_1h", "pb", _FULL.format(src=_resample_sql(H), lo=LO + 30 * 60_000, hi=HI + 30 * 60_000, ms=H))(lambda s, d: gaps.data_complete(bars.resample_ohlcv(A.price_bars(s, d), H), LO + 30 * 60_000, HI + 30 * 60_000, H))

# reports
query("A20_symbol_ranges", "pb", "select symbol, min(timestamp) as first_ts, max(timestamp) as last_ts, count(*)::bigint as n from price_bars_v group by all")(lambda s, d: audit.symbol_ranges(A.price_bars(s, d)))
query("A21_progress", "pb", f"select count(*)::bigint as n, strftime(make_timestamp(min(timestamp) * 1000), '%Y-%m-%d %H:%M') as earliest, strftime(make_timestamp(max(timestamp) * 1000), '%Y-%m-%d %H:%M') as latest, round((max(timestamp) - min(timestamp)) / {DAY}, 2) as days from price_bars_v where timestamp >= {LO} and timestamp < {HI}")(
    lambda s, d: audit.progress(A.price_bars(s, d), LO, HI)
)
query("A22_bar_outliers", "pb", f"select symbol, (timestamp - 60000) // {DAY} as day, count(*)::bigint as n, 1440 - count(*) as missing from price_bars_v group by all having count(*) <> 1440")(lambda s, d: audit.bar_outliers(A.price_bars(s, d)))


def _foot_bars(s, d):
    t = A.dense_trades(s, d)
    return bars.assemble(trades.trade_flow(t), trades.footprint(t))


def _broken(s, d):
    """Footprint bars of which some are wrong, each thirteenth kind in its own minutes."""
    m = F.expr("timestamp div 60000 % 29")
    bad = {
        1: ("trade_open", "cast(null as double)"), 2: ("trade_count", "0"), 3: ("buy_volume", "0"), 4: ("buy_poc_price", "case when buy_vwap is null then trade_low end"), 5: ("sell_poc_price", "case when sell_vwap is null then trade_low end"),
        6: ("lo_band_sell_vol", "cast(null as double)"), 7: ("trade_close", "trade_high + 1"), 8: ("poc_price", "trade_high + 1"), 9: ("poc_volume_share", "1.5"), 10: ("sell_vwap", "trade_low - 1 + 0 * sell_vwap"),
        11: ("buy_poc_price", "trade_high + 1 + 0 * buy_poc_price"), 12: ("hi_band_buy_vol", "buy_volume + 1"), 13: ("vwap", "vwap * 1.001"), 14: ("sell_volume", "0"),
    }
    b = _foot_bars(s, d)
    for k, (c, new) in bad.items():
        hit = m.isin(3, 14) if k in (3, 14) else m == k
        b = b.withColumn(f"new_{k}", F.when(hit, F.expr(new)).otherwise(F.lit(None)))
    out = {}
    for c in dict.fromkeys(c for c, _ in bad.values()):
        v = F.col(c)
        for k, (name, _) in bad.items():
            if name == c:
                v = F.when(m.isin(3, 14) if k in (3, 14) else m == k, F.col(f"new_{k}")).otherwise(v)
        out[c] = v
    return b.withColumns(out).drop(*[f"new_{k}" for k in bad])


_EXACT = _FOOT[: _FOOT.rindex("select " + K)] + f"""select {K}, trade_open, trade_high, trade_low, trade_close, b as buy_volume, s as sell_volume, (bpq + spq) / (b + s) as vwap, bpq / nullif(b, 0) as buy_vwap, spq / nullif(s, 0) as sell_vwap, poc as poc_price, pv / (b + s) as poc_volume_share,
  case when b > 0 then bp end as buy_poc_price, case when s > 0 then sp end as sell_poc_price, 1.0 as trade_price_std, hb as hi_band_buy_vol, hs as hi_band_sell_vol, lb as lo_band_buy_vol, ls as lo_band_sell_vol from g join o using ({K})"""
_BROKEN = f"""with n as (select {K}, count(*) as trade_count, timestamp // 60000 % 29 as m from dense_v group by all), x as (select * from n left join ({_EXACT}) using ({K})),
w as (select exchange, symbol, timestamp, case when m = 2 then 0 else trade_count end as trade_count, case when m <> 1 then trade_open end as trade_open, trade_high, trade_low, case when m = 7 then trade_high + 1 else trade_close end as trade_close,
  case when m in (3, 14) then 0 else coalesce(buy_volume, 0) end as buy_volume, case when m in (3, 14) then 0 else coalesce(sell_volume, 0) end as sell_volume, case when m = 13 then vwap * 1.001 else vwap end as vwap, buy_vwap, case when m = 10 and sell_vwap is not null then trade_low - 1 else sell_vwap end as sell_vwap,
  case when m = 8 then trade_high + 1 else poc_price end as poc_price, case when m = 9 then 1.5 else poc_volume_share end as poc_volume_share,
  case when m = 4 then (case when buy_vwap is null then trade_low end) when m = 11 and buy_poc_price is not null then trade_high + 1 else buy_poc_price end as buy_poc_price, case when m = 5 then (case when sell_vwap is null then trade_low end) else sell_poc_price end as sell_poc_price,
  trade_price_std, case when m = 12 then coalesce(buy_volume, 0) + 1 else hi_band_buy_vol end as hi_band_buy_vol, hi_band_sell_vol, lo_band_buy_vol, case when m <> 6 then lo_band_sell_vol end as lo_band_sell_vol from x),
e as (select *, greatest(1e-9 * greatest(abs(trade_high), abs(trade_low)), 1e-6 * greatest(trade_high - trade_low, 0)) as eps, 1e-12 * greatest(buy_volume + sell_volume, 1e-6) as sl from w)"""
_CHECKS = {
    "01_footprint_missing_on_traded_bar": "trade_count > 0 and trade_open is null", "02_footprint_on_tradeless_bar": "trade_count = 0 and trade_open is not null", "03_traded_bar_without_volume": "trade_count > 0 and buy_volume + sell_volume = 0",
    "04_buy_vwap_or_poc_missing": "(buy_vwap is null) <> (buy_poc_price is null)", "05_sell_vwap_or_poc_missing": "(sell_vwap is null) <> (sell_poc_price is null)",
    "06_band_missing": "trade_open is not null and (hi_band_buy_vol is null or hi_band_sell_vol is null or lo_band_buy_vol is null or lo_band_sell_vol is null)",
    "07_ohlc_order": "trade_open is not null and not (trade_open between trade_low - eps and trade_high + eps and trade_close between trade_low and trade_high)", "08_poc_outside_range": "trade_open is not null and not poc_price between trade_low - eps and trade_high + eps",
    "09_poc_share_outside_bounds": "poc_volume_share <= 0 or poc_volume_share > 1 + 1e-9", "10_side_vwap_outside_range": "trade_open is not null and (not buy_vwap between trade_low - eps and trade_high + eps or not sell_vwap between trade_low - eps and trade_high + eps)",
    "11_side_poc_outside_range": "trade_open is not null and (not buy_poc_price between trade_low - eps and trade_high + eps or not sell_poc_price between trade_low - eps and trade_high + eps)",
    "12_band_above_its_side": "trade_open is not null and (hi_band_buy_vol > buy_volume + sl or hi_band_sell_vol > sell_volume + sl or lo_band_buy_vol > buy_volume + sl or lo_band_sell_vol > sell_volume + sl)",
    "13_vwap_not_the_sides_mean": "buy_volume + sell_volume > 0 and coalesce(vwap, 0) <> 0 and abs(vwap - (coalesce(buy_vwap * buy_volume, 0) + coalesce(sell_vwap * sell_volume, 0)) / (buy_volume + sell_volume)) / abs(vwap) > 1e-9",
}
query("A23_T7_U1_audit", "d", f'{_BROKEN}, c as (select unnest([{", ".join(repr(k) for k in _CHECKS)}]) as "check", unnest([{", ".join(f"count(*) filter (where {v})" for v in _CHECKS.values())}]) as violations from e) select "check", violations::bigint as violations, case when violations = 0 then \'PASS\' else \'FAIL\' end as status from c')(
    lambda s, d: audit.audit(_broken(s, d), 0, 1 << 60)
)
query("A24_footprint_coverage", "d", f"{_BROKEN} select count(*)::bigint as bars, count(distinct symbol)::bigint as symbols, min(timestamp) as first_close, max(timestamp) as last_close, count(*) filter (where trade_count > 0)::bigint as traded_bars, count(*) filter (where trade_count > 0 and trade_open is not null)::bigint as with_footprint, count(*) filter (where trade_count = 0)::bigint as trade_less from e")(
    lambda s, d: audit.footprint_coverage(_broken(s, d))
)
query("A25_null_patterns", "d", f"{_BROKEN} select " + " || ".join(f"case when {c} is null then '0' else '1' end" for c in audit.PATTERN) + " as pattern, count(*)::bigint as n from e group by all")(lambda s, d: audit.null_patterns(_broken(s, d)))
query("A26_hourly_coverage", "pb", f"select timestamp // {H} * {H} as hour, count(distinct symbol)::bigint as symbols, count(*)::bigint as bars from price_bars_v group by all")(lambda s, d: audit.hourly_coverage(A.price_bars(s, d)))
query("J14_hourly_floor", "pb", f"with h as (select timestamp // {H} * {H} as hour, count(distinct symbol) as symbols, count(*) as bars from price_bars_v group by all) select count(*)::bigint as hours, min(symbols)::bigint as min_symbols, min(bars)::bigint as min_bars, count(*) filter (where symbols < (select max(symbols) from h))::bigint as below, max(symbols)::bigint as universe_floor from h")(
    lambda s, d: audit.hourly_floor(A.price_bars(s, d))
)
query("A27_column_health", "oi liq", f"with a as ({_ASM}) select round(avg(case when timestamp // 60000 % 3 = 0 then 1 else 0 end), 4) as funding_nonnull, round(avg(case when open_interest is not null and timestamp // 60000 % 2 = 0 then 1 else 0 end), 4) as oi_nonnull, round(avg(case when timestamp // {H} % 4 = 0 then 1 else 0 end), 4) as liq_covered_rate from a")(
    lambda s, d: audit.column_health(_assembled(s, d).selectExpr("case when timestamp div 60000 % 3 = 0 then 0.1 end as funding_rate", "case when timestamp div 60000 % 2 = 0 then open_interest end as open_interest", f"case when timestamp div {H} % 4 = 0 then 1 else 0 end as liq_covered"))
)
query("A35_distinct_symbols", "pb", "select distinct symbol from price_bars_v where exchange = 'test'")(lambda s, d: audit.distinct_symbols(A.price_bars(s, d), "test"))
query("A36_bar_range", "pb", "select min(timestamp) as first_ts, max(timestamp) as last_ts from price_bars_v where symbol = 'click'")(lambda s, d: audit.bar_range(A.price_bars(s, d), "test", "click"))
query("A37_newest_hour", "pb", f"select max(timestamp) // {H} * {H} as newest_hour, {HI} - max(timestamp) // {H} * {H} as age_ms, {HI} - max(timestamp) // {H} * {H} > 7200000 as stale from price_bars_v")(lambda s, d: audit.newest_hour(A.price_bars(s, d), HI, 2 * H))
query("P11_bar_exists", "pb", f"select count(*) > 0 as found from price_bars_v where symbol = 'click' and timestamp = {LO}")(lambda s, d: audit.bar_exists(A.price_bars(s, d), "test", "click", LO))
query("P11_hour_exists", "pb", f"select count(*) > 0 as found from price_bars_v where symbol = 'click' and timestamp > {LO} and timestamp <= {LO + H}")(lambda s, d: audit.hour_exists(A.price_bars(s, d), "test", "click", LO))
query("P13_from_first_stored_hour", "pb", f"""with f as (select exchange, symbol, (min(timestamp) - 60000) // {H} * {H} as f from price_bars_v where timestamp >= {LO + 3 * H} group by all), hr as (select exchange, symbol, unnest(range({LO}, {HI} + 1, {H})) as hour from (select distinct exchange, symbol from price_bars_v))
select exchange, symbol, hour from hr join f using (exchange, symbol) where hour >= f""")(lambda s, d: audit.from_first_stored_hour(joins.expand_hours(_symbols(s, d), LO, HI), A.price_bars(s, d).where(F.col("timestamp") >= LO + 3 * H)))
query("T2_last_bar", "pb", f"select {K}, {_OHLCV} from price_bars_v qualify row_number() over (partition by exchange, symbol order by timestamp desc) = 1")(lambda s, d: rounded(audit.last_bar(A.price_bars(s, d))))
query("T3_tail_bars", "pb", f"select {K}, {_OHLCV} from price_bars_v where symbol = 'view' order by timestamp desc limit 50")(lambda s, d: rounded(audit.tail_bars(A.price_bars(s, d), "test", "view", 50)))
query("S11_P2_T1_read_price_bars", "pb", f"select {K}, {_OHLCV} from price_bars_v where symbol = 'click' and timestamp >= {LO} and timestamp < {HI}")(lambda s, d: rounded(files.read_price_bars(A.price_bars(s, d), "test", "click", LO, HI)))
query("P14_in_request", "t", f"select trade_id from trades_v where trade_time > {LO} and trade_time < {HI} + 1000")(lambda s, d: A.trades(s, d).where(X.in_request(F.col("trade_time"), LO, HI)).select("trade_id"))
query("P1_hour_containment", "t", f"select trade_id from trades_v where trade_time % {6 * H} < {H}")(lambda s, d: A.trades(s, d).where(X.in_hour(F.col("trade_time"), F.expr("trade_time div 21600000 * 21600000"))).select("trade_id"))
query("P6_open_to_close_time", "pb", "select exchange, symbol, timestamp + 60000 as timestamp from price_bars_v")(lambda s, d: A.price_bars(s, d).select("exchange", "symbol", X.open_to_close_time(F.col("timestamp")).alias("timestamp")))
query("P8_valid_trade", "t", "select trade_id from trades_v where price > 0 and quantity - 5 > 0")(lambda s, d: A.trades(s, d).where(X.valid_trade(F.col("price"), F.col("quantity") - 5)).select("trade_id"))
query("P3_normalize_side", "t", "select trade_id, case when is_buyer_maker then 'bid' else 'ask' end as side from trades_v")(lambda s, d: A.trades(s, d).select("trade_id", X.normalize_side(F.when(F.col("is_buyer_maker"), " BUY ").otherwise("S")).alias("side")))
query("P5_oi_value", "t", "select trade_id, case when trade_id % 3 = 0 then quantity else (trade_id % 3)::double end as oi from trades_v")(lambda s, d: A.trades(s, d).select("trade_id", X.oi_value((F.col("trade_id") % 3).cast("double"), F.col("quantity")).alias("oi")))
query("P4_normalize_book_row", "book", "select seq, symbol, case when seq % 2 = 0 then seq else final_update_id end as final_update_id, case when seq % 3 = 0 then (case when prev_final_update_id = 0 then 'snapshot' else '' end) else 'depthUpdate' end as event_type, side from book_v")(
    lambda s, d: files.normalize_book_row(
        A.book(s, d).withColumn("last_update_id", F.col("seq")).withColumn("final_update_id", F.when(F.col("seq") % 2 == 0, 0).otherwise(F.col("final_update_id"))).withColumn("event_type", F.when(F.col("seq") % 3 == 0, "").otherwise("update"))
    ).select("seq", "symbol", "final_update_id", "event_type", "side")
)

# scalars
query("F8_F10_F11_prices", "t", "select trade_id, trade_time // 60000 as minute, (trade_time // 60000 + 1) * 60000 as close_ts, (price * 10000)::bigint as snap, round(price * 1e8)::bigint as key from trades_v")(
    lambda s, d: A.trades(s, d).select("trade_id", X.minute_of(F.col("trade_time")).alias("minute"), X.close_ts(F.col("trade_time")).alias("close_ts"), X.snap_price(F.col("price")).alias("snap"), X.price_key(F.col("price")).alias("key"))
)
query("F9_bucket_close", "pb", "select exchange, symbol, timestamp, ((timestamp - 60000) // 420000) * 420000 + 420000 as bucket from price_bars_v")(lambda s, d: A.price_bars(s, d).select("exchange", "symbol", "timestamp", X.bucket_close(F.col("timestamp"), 420_000).alias("bucket")))
query("F12_F15_F17_numbers", "pb", "select exchange, symbol, timestamp, round(case when low = 0 or high <= low then 0 else (high - low) / low * 10000 end, 6) as bps, round(greatest(1e-9 * greatest(abs(high), abs(low)), 1e-6 * (high - low)), 12) as eps, round(case when volume <= 0 then volume else floor(volume / 0.5 + 1e-9) * 0.5 end, 6) as stepped from price_bars_v")(
    lambda s, d: A.price_bars(s, d).select("exchange", "symbol", "timestamp", F.round(X.spread_bps(F.col("low"), F.col("high")), 6).alias("bps"), F.round(X.range_epsilon(F.col("high"), F.col("low")), 12).alias("eps"), F.round(X.floor_to_step(F.col("volume"), F.lit(0.5)), 6).alias("stepped"))
)
_EXCHANGES = ["binance_futures", "binance", "bybit", "bybit_perpetual", "hyperliquid", "dydx", "other_futures"]


def _all_names(s, d):
    """Each symbol in every form at every exchange."""
    names = F.array(*[F.concat(F.lit(p), f, F.lit(t)) for p, t in (("", "USDT"), ("", "USDC"), ("", "USD"), ("", "BUSD"), ("", "/USDT"), ("", ""), ("", "/USDT:SPOT"), ("", "/USDT:PERP"), ("", ":PERP"), ("", "/USDC:PERP"), (" ", " usdt ")) for f in (F.col("symbol"), F.upper("symbol"))])
    return A.trades(s, d).select("symbol").distinct().select(F.explode(names).alias("name")).select("name", F.explode(F.array(*map(F.lit, _EXCHANGES))).alias("exchange"))


def _ends(col: str, ends: tuple[str, ...], last: str, kind: str = "PERP") -> str:
    return "case " + " ".join(f"when ends_with({col}, '{e}') then left({col}, length({col}) - {len(e)}) || '/{e}:{kind}'" for e in ends) + f" else {last} end"


query("F1_F2_F3_F4_F5_F6_symbols", "t", f"""with y as (select distinct symbol from trades_v), u as (select unnest([symbol, upper(symbol)]) as f from y), n as (select p || f || t as name from u, (values {", ".join(f"('{p}', '{t}')" for p, t in (("", "USDT"), ("", "USDC"), ("", "USD"), ("", "BUSD"), ("", "/USDT"), ("", ""), ("", "/USDT:SPOT"), ("", "/USDT:PERP"), ("", ":PERP"), ("", "/USDC:PERP"), (" ", " usdt ")))}) as v(p, t)),
x as (select name, upper(name) as s, unnest([{", ".join(repr(e) for e in _EXCHANGES)}]) as exchange from n),
p as (select *, contains(s, '/') as sl, contains(s, ':') as co, split_part(s, '/', 1) as a, split_part(split_part(s, '/', 2), ':', 1) as q, split_part(s, ':', 2) as k, upper(replace(trim(name), ' ', '')) as w from x),
b as (select *, case when sl then a when co then split_part(s, ':', 1) else '' end as base, case when sl then q else '' end as quote from p)
select name, exchange, case when exchange in ('binance_futures', 'bybit_perpetual', 'dydx') then base || quote when exchange = 'hyperliquid' then base when (exchange = 'binance' and k <> 'SPOT') or (exchange not in ('binance') and k = 'PERP') then base || quote else base || '/' || quote end as at_exchange,
  case when exchange in ('binance_futures', 'bybit', 'bybit_perpetual') then {_ends("name", ("USDT", "USDC"), "name || ':PERP'")} when exchange = 'hyperliquid' then name || '/USDC:PERP' when exchange = 'dydx' then name || '/USDT:PERP' when exchange = 'binance' then (case when contains(name, '/') then name || ':SPOT' else {_ends("name", ("USDT",), "name || ':PERP'", "SPOT")} end) else name || ':PERP' end as canonical,
  case exchange when 'binance' then 'binance_futures' when 'bybit' then 'bybit_perpetual' else exchange end as exchange_name, case when ends_with(exchange, '_futures') then left(exchange, length(exchange) - 8) else exchange end as db_name,
  case when contains(w, '/') then w else {_ends("w", ("USDT", "USDC"), "w")} end as normal, {_ends("s", ("USDT", "USD", "BUSD"), "s || ':PERP'")} as feed_binance, {_ends("name", ("USDT", "USDC", "USD"), "name || ':PERP'")} as feed_bybit, s || '/USDC:PERP' as feed_hyperliquid from b""")(
    lambda s, d: _all_names(s, d).select(
        "name", "exchange", S.canonical_to_exchange(F.col("name"), F.col("exchange")).alias("at_exchange"), S.exchange_to_canonical(F.col("exchange"), F.col("name")).alias("canonical"), S.map_exchange_name(F.col("exchange")).alias("exchange_name"),
        S.map_exchange_to_db(F.col("exchange")).alias("db_name"), S.normalize_canonical(F.col("name")).alias("normal"), S.feed_binance(F.col("name")).alias("feed_binance"), S.feed_bybit(F.col("name")).alias("feed_bybit"), S.feed_hyperliquid(F.col("name")).alias("feed_hyperliquid"),
    )
)


# mutations
query("M3_delete_range", "pb", f"select {K} from price_bars_v where not (exchange = 'test' and symbol = 'click' and timestamp >= {LO} and timestamp < {HI})")(lambda s, d: tables.delete_range(A.price_bars(s, d), "test", "click", LO, HI).select("exchange", "symbol", "timestamp"))
query("M3_deleted_count", "pb", f"select exchange, symbol, count(*) filter (where timestamp < {HI})::bigint as deleted from price_bars_v group by all")(lambda s, d: tables.deleted_counts(A.price_bars(s, d), None, HI))
query("M13_overwrite_hour", "pb", f"select {K}, round(case when timestamp > {LO} and timestamp <= {LO + H} then volume * 2 else volume end, 6) as volume from price_bars_v")(
    lambda s, d: rounded(tables.overwrite_hour(A.price_bars(s, d), A.price_bars(s, d).withColumn("volume", F.col("volume") * 2), LO).select("exchange", "symbol", "timestamp", "volume"))
)
query("M12_changed_keys", "d", f"select distinct {K} from dense_v where trade_id % 10 <> 0")(lambda s, d: tables.changed_keys(trades.ticks_to_price_bars(A.old_trades(s, d))))


def _liq_bars(s, d):
    return A.flow_bars(s, d).select("exchange", "symbol", "timestamp", F.lit(7.0).alias("liq_long_vol"), F.lit(7.0).alias("liq_short_vol"), F.lit(1).alias("liq_covered"))


query("M4_set_liq_unknown", "fb", f"select {K}, case when x then null else 7.0::double end as liq_long_vol, case when x then 0 else 1 end as liq_covered from (select *, exchange = 'test' and symbol = 'click' and timestamp >= {LO} and timestamp < {HI} as x from flow_v)")(
    lambda s, d: tables.set_liq_unknown(_liq_bars(s, d), "test", "click", LO, HI).select("exchange", "symbol", "timestamp", "liq_long_vol", "liq_covered")
)
query("M5_J8_backfill_liquidations", "liq", f"""with l as ({_LIQ}), b as (select f.exchange, f.symbol, f.timestamp, timestamp >= {LO} and timestamp < {HI} as r, (timestamp - 60000) // {H} % 2 = 0 as c from flow_v f)
select b.exchange, b.symbol, b.timestamp, case when not r then 7.0 when c then coalesce(l.liq_long_vol, 0) end as liq_long_vol, case when not r then 7.0 when c then coalesce(l.liq_short_vol, 0) end as liq_short_vol, case when not r or c then 1 else 0 end as liq_covered
from b left join l on b.exchange = l.exchange and b.symbol = l.symbol and b.timestamp = l.timestamp""")(lambda s, d: rounded(tables.backfill_liquidations(_liq_bars(s, d), A.liquidations(s, d), _covered_hours(s, d), LO, HI)))
query("M6_progress_marks", "pb", f"select distinct symbol, (timestamp - 60000) // {H} * {H} as hour from price_bars_v where (timestamp - 60000) // {H} % 2 = 1")(
    lambda s, d: tables.pending(_hours(A.price_bars(s, d)).select("symbol", "hour"), tables.mark_progress(_covered_hours(s, d), _covered_hours(s, d)))
)
_OIB = f"with o as (select {K}, arg_max(value, (ts, seq)) as oi from oi_v group by all) "
query("W4_backfill_oi_change", "oi", _OIB + f"select {K}, round(oi - lag(oi) over (partition by exchange, symbol order by timestamp), 6) as open_interest_change from o where timestamp >= {LO} and timestamp < {HI}")(
    lambda s, d: rounded(tables.oi_change_backfill(bars.last_oi(A.oi(s, d)).withColumn("open_interest_change", F.lit(None).cast("double")), LO, HI))
)
query("W4_backfill_oi_change_of_bars", "oi", _OIB + f", x as (select *, timestamp // 60000 % 4 > 0 as had, symbol = 'click' and timestamp // 60000 % 4 = 0 and timestamp >= {LO} and timestamp < {HI} as todo from o) select {K}, round(oi, 6) as open_interest, round(case when had then 0.5 when todo then oi - lag(oi) over (partition by exchange, symbol, todo order by timestamp) end, 6) as open_interest_change from x")(
    lambda s, d: rounded(tables.backfill_oi_change(bars.last_oi(A.oi(s, d)).withColumn("open_interest_change", F.when(F.expr("timestamp div 60000 % 4") > 0, 0.5)), LO, HI, "click"))
)
query("A40_pending_oi_change", "oi", _OIB + f"select count(*)::bigint as pending from o where timestamp >= {LO} and timestamp < {HI}")(lambda s, d: tables.pending_oi_change(bars.last_oi(A.oi(s, d)).withColumn("open_interest_change", F.lit(None).cast("double")), LO, HI))


def _obs_split(s, d):
    o = A.obs(s, d)
    return o.where(F.floor(F.col("timestamp") / DAY) % 2 == 0), o.where(F.floor(F.col("timestamp") / DAY) % 3 == 0).withColumn("value", F.col("value") + 1)


query("M9_upsert_observations", "obs", f"select series_id, timestamp, case when timestamp // {DAY} % 3 = 0 then round(value + 1, 4) else value end as value from obs_v where timestamp // {DAY} % 2 = 0 or timestamp // {DAY} % 3 = 0")(lambda s, d: rounded(tables.upsert_observations(*_obs_split(s, d)), 4))
query("M7_upsert_flow", "pb", f"select 'btc' as asset, symbol as exchange, timestamp, round(case when timestamp // 60000 % 2 = 0 then volume * 2 else volume end, 6) as inflow from price_bars_v")(
    lambda s, d: rounded(
        tables.upsert_flow(
            A.price_bars(s, d).select(F.lit("btc").alias("asset"), F.col("symbol").alias("exchange"), "timestamp", F.col("volume").alias("inflow")),
            A.price_bars(s, d).where("timestamp div 60000 % 2 = 0").select(F.lit("btc").alias("asset"), F.col("symbol").alias("exchange"), "timestamp", (F.col("volume") * 2).alias("inflow")),
        )
    )
)
query("M11_load_watermarks", "obs", f"select series_id, max(timestamp) as last_ts from obs_v group by all")(
    lambda s, d: tables.advance(A.obs(s, d).groupBy("series_id").agg(F.min("timestamp").alias("last_ts")), A.obs(s, d), "series_id")
)
query("M10_upsert_series", "obs", "select distinct series_id, 'old' as title, case when series_id = '1-URGENT' then 'new' else 'u' end as units from obs_v")(
    lambda s, d: tables.upsert_series(A.obs(s, d).select("series_id", F.lit("old").alias("title"), F.lit("u").alias("units")).distinct(), A.obs(s, d).where("series_id = '1-URGENT'").select("series_id", F.lit("").alias("title"), F.lit("new").alias("units")).distinct())
)
query("M8_upsert_labels", "tr", "select 'bitcoin' as chain, to_address as address, case when length(to_address) = 2 then 'binance' else 'none' end as exchange, case when length(to_address) = 2 then 5 else 1 end::bigint as updated_at from (select distinct to_address from transfers_v)")(
    lambda s, d: tables.upsert_labels(
        A.transfers(s, d).select(F.lit("bitcoin").alias("chain"), F.col("to_address").alias("address"), F.lit("none").alias("exchange"), F.lit(1).cast("long").alias("updated_at")).distinct(),
        A.transfers(s, d).where("length(to_address) = 2").select(F.lit("bitcoin").alias("chain"), F.col("to_address").alias("address"), F.lit("binance").alias("exchange")).distinct(), F.lit(5).cast("long"),
    ).select("chain", "address", "exchange", "updated_at")
)

_BATCHES = f"""with o as (select * from price_bars_v where timestamp // 60000 % 3 > 0), n as (select * replace (case when timestamp // 60000 % 4 = 0 then volume * 2 else volume end as volume) from price_bars_v where timestamp // 60000 % 2 = 0)"""


def _feed_batches(s, d):
    """Stored bars, and three batches of later ones, some of them with other volumes."""
    m = F.expr("timestamp div 60000")
    b = A.price_bars(s, d)
    new = b.where(m % 2 == 0).withColumn("volume", F.when(m % 4 == 0, F.col("volume") * 2).otherwise(F.col("volume")))
    return b.where(m % 3 > 0), [new.where(m % 10 == k) for k in (0, 2)] + [new.where(m % 10 > 2)]


def _replace(stored: DataFrame, new: DataFrame) -> DataFrame:
    return tables.replace_rows(stored, new, bars.KEY)


query("M12_change_feed", "pb", f"{_BATCHES} select {K}, case when o.volume is null then 'insert' else 'update' end as kind, round(o.volume, 6) as old_volume, round(n.volume, 6) as new_volume from n left join o using ({K}) where o.volume is distinct from n.volume")(
    lambda s, d: _feed(s, d).select("exchange", "symbol", "timestamp", "kind", F.round("old.volume", 6).alias("old_volume"), F.round("new.volume", 6).alias("new_volume"))
)


def _feed(s, d):
    stored, batches = _feed_batches(s, d)
    new = batches[0].unionByName(batches[1]).unionByName(batches[2])
    return tables.upsert_feed(stored, new, _replace)


query("M12_A15_rollup_by_changes", "pb", f"""{_BATCHES}, price_now as (select * from n union all by name select * from o anti join n using ({K})) """ + _resample_sql(H).replace("price_bars_v", "price_now"))(lambda s, d: rounded(_rolled(s, d)))


def _rolled(s, d):
    """Hourly bars kept up to date over three batches of changes."""
    now, batches = _feed_batches(s, d)
    hours = bars.resample_ohlcv(now, H)
    for new in batches:
        feed = spool(tables.upsert_feed(now, new, _replace), "feed")
        now = spool(tables.apply_feed(now, feed), "minutes")
        hours = tables.refresh_rollup(hours, now, feed, H)
    return hours


query("M11_next_loads", "obs", f"select series_id, min(timestamp) + {DAY} as start, {A.BASE} + {H} as \"end\" from obs_v group by all having min(timestamp) + {DAY} < {A.BASE} + {H}")(
    lambda s, d: tables.next_loads(A.obs(s, d).groupBy("series_id").agg(F.min("timestamp").alias("last_ts")), "series_id", A.BASE, DAY).select("series_id", "start", F.col("end").cast("long").alias("end"))
)

# flows, dominance, macro
_HR = f"block_timestamp // {H} * {H} as hour"
query("A29_J6_btc_flow", "tr", f"select l.exchange, {_HR}, round(sum(value) / 1e8, 8) as value, count(distinct transaction_hash)::bigint as n from (select *, unnest([from_address, to_address]) as address from transfers_v) t join labels_v l using (address) group by all")(
    lambda s, d: rounded(flows.btc_flow(A.transfers(s, d), A.labels(s)), 8)
)


def _flow_sql(col: str, cond: str) -> str:
    return f"select l.exchange, {_HR}, round(sum(value) / 1e6, 8) as value, count(*)::bigint as n from transfers_v t join labels_v l on t.{col} = l.address where {cond} group by all"


query("A30_eth_flow", "tr", _flow_sql("to_address", "value > 0"))(lambda s, d: rounded(flows.account_flow(A.transfers(s, d), "to_address", A.labels(s), 10**6), 8))
query("A31_erc20_flow", "tr", _flow_sql("from_address", "token_address = '2-HIGH'"))(lambda s, d: rounded(flows.account_flow(A.transfers(s, d), "from_address", A.labels(s), 10**6, token="2-HIGH"), 8))
query("J5_U3_net_flow", "tr", f"with i as ({_flow_sql('to_address', 'value > 0')}), o as ({_flow_sql('from_address', 'value > 0')}) select exchange, hour, round(coalesce(i.value, 0), 6) as inflow, round(coalesce(o.value, 0), 6) as outflow, round(coalesce(i.value, 0) - coalesce(o.value, 0), 6) as netflow, coalesce(i.n, 0) + coalesce(o.n, 0) as tx_count from i full join o using (exchange, hour)")(
    lambda s, d: rounded(joins.net_flow(*[flows.account_flow(A.transfers(s, d), c, A.labels(s), 10**6) for c in ("to_address", "from_address")], ["exchange", "hour"]))
)
_DOM = "select ts as timestamp, t / a * 100 as dominance from (select ts, sum(case when coin = '1-URGENT' then cap end) as t, sum(cap) as a, count(distinct coin) as n from caps_v where cap > 0 group by ts) where t > 0 and n >= 0.8 * (select count(distinct coin) from caps_v)"
query("A32_J9_dominance", "caps", f"select timestamp, round(dominance, 6) as dominance from ({_DOM})")(lambda s, d: rounded(flows.dominance(A.caps(s, d), "1-URGENT")))
query("A32_dominance_bounded", "caps", f"select timestamp, round(dominance, 6) as dominance from ({_DOM}) where dominance < 25")(lambda s, d: rounded(flows.dominance(A.caps(s, d), "1-URGENT", below=25.0)))
query("A33_dominance_summary", "caps", f"select count(*)::bigint as n, round(min(dominance), 6) as low, round(max(dominance), 6) as high, round(arg_max(dominance, timestamp), 6) as latest from ({_DOM})")(lambda s, d: rounded(flows.dominance_summary(flows.dominance(A.caps(s, d), "1-URGENT"))))
query("U2_append_newer", "caps", f"select timestamp, round(dominance, 6) as dominance from ({_DOM})")(
    lambda s, d: rounded(flows.append_newer((x := flows.dominance(A.caps(s, d), "1-URGENT")).where("timestamp < 800000000000"), x.unionByName(x)))
)
query("P12_exclude_stablecoins", "caps", "select coin, ts, cap from caps_v where coin not in ('5-LOW')")(lambda s, d: flows.exclude_stablecoins(A.caps(s, d), ["5-LOW", "1-URGENT"], "1-URGENT"))
query("T4_top_coins", "caps", "select coin, ts, cap from caps_v order by cap desc, coin limit 10")(lambda s, d: flows.top_coins(A.caps(s, d), 10))
query("A34_S16_macro_coverage", "obs", "select series_id, count(*)::bigint as n, min(timestamp) as first_ts, max(timestamp) as last_ts, arg_max(value, timestamp) as last_value from obs_v group by all")(lambda s, d: flows.macro_coverage(A.obs(s, d)))
query("W9_macro_gaps", "gaps", f"select series_id, count(*) filter (where g > {8 * DAY})::bigint as over_8d, count(*) filter (where g > {35 * DAY})::bigint as over_35d, coalesce(max(g) / {DAY}, 0) as max_gap_d, max(timestamp) as last from (select *, lead(timestamp) over (partition by series_id order by timestamp) - timestamp as g from gaps_v) group by all")(
    lambda s, d: gaps.macro_gaps(A.obs_with_gaps(s, d))
)
query("W8_flow_gaps", "tr", f"with f as ({_flow_sql('to_address', 'value > 0')}), g as (select exchange, hour, lead(hour) over (partition by exchange order by hour) - hour as g from f) select 'btc' as asset, exchange, count(*) filter (where g > {H})::bigint as n_gaps, coalesce(max(g) / {H}, 0) as max_gap_h, max(hour) as last from g group by all")(
    lambda s, d: gaps.flow_gaps(flows.account_flow(A.transfers(s, d), "to_address", A.labels(s), 10**6).select(F.lit("btc").alias("asset"), "exchange", F.col("hour").alias("timestamp")))
)
query("J11_asof_macro", "pb obs", "select p.exchange, p.symbol, i.series_id, p.timestamp, o.value from (price_bars_v p cross join (select distinct series_id from obs_v) i) asof left join (select series_id, timestamp + 826000000000 as timestamp, value from obs_v) o on i.series_id = o.series_id and p.timestamp >= o.timestamp")(
    lambda s, d: joins.asof_macro(_series_bars(s, d), A.obs(s, d).select(F.col("series_id").alias("symbol"), (F.col("timestamp") + 826_000_000_000).alias("timestamp"), "value")).select("exchange", F.col("of").alias("symbol"), F.col("symbol").alias("series_id"), "timestamp", "value")
)


def _series_bars(s, d):
    """Each bar beside each of the few series."""
    series = A.obs(s, d).agg(F.collect_set("series_id").alias("series"))  # one row
    return A.price_bars(s, d).crossJoin(F.broadcast(series)).select("exchange", F.col("symbol").alias("of"), F.explode("series").alias("symbol"), "timestamp")


query("J10_symbol_universe", "tr", """with n as (select to_address as base, count(*) as n from transfers_v group by all), c as (select case when r % 5 = 0 then base || '_X-' when r % 7 = 0 then base || 'é' when r % 11 = 0 then base || 'longer' else base end as base, case when r % 6 > 0 then r end as rank, r from (select *, row_number() over (order by n desc, base) as r from n)),
i as (select upper(base) || 'USDT' as name, r from c where r % 2 = 0 union select '1000' || upper(base) || 'USDT', r from c where r % 3 < 2)
select replace(arg_min(name, length(name)), 'USDT', '/USDT:PERP') as symbol, upper(base) as base, rank::int as rank from c join i on i.name = upper(base) || 'USDT' or (length(base) <= 6 and i.name = '1000' || upper(base) || 'USDT')
where upper(base) not in ('A1') and not contains(base, 'é') group by base, rank having arg_min(i.r, length(name)) % 13 > 0""")(lambda s, d: _universe(s, d))


def _universe(s, d):
    c = A.transfers(s, d).groupBy(F.col("to_address").alias("base")).agg(F.count("*").alias("n"))
    r = F.col("r")
    c = c.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "base")))
    c = c.select(F.when(r % 5 == 0, F.concat("base", F.lit("_X-"))).when(r % 7 == 0, F.concat("base", F.lit("é"))).when(r % 11 == 0, F.concat("base", F.lit("longer"))).otherwise(F.col("base")).alias("base"), F.when(r % 6 > 0, r).alias("rank"), "r")
    name = F.concat(F.upper("base"), F.lit("USDT"))
    inst = c.select(F.explode(F.array_compact(F.array(F.when(r % 2 == 0, name), F.when(r % 3 < 2, F.concat(F.lit("1000"), name))))).alias("symbol"), "r", F.lit("TRADING").alias("status"), F.lit("PERPETUAL").alias("contract_type"), F.lit("USDT").alias("quote"))
    return joins.symbol_universe(c, inst, inst.where("r % 13 > 0").select("symbol"), ["a1"])


# messages
_WIRE = f"""select 'trade' as type, upper(symbol) || '/USDT:PERP' as symbol, trade_time as timestamp, price, quantity, is_buyer_maker from trades_v"""


def _trade_rows(e: DataFrame) -> DataFrame:
    return e.select("type", "symbol", "timestamp", "trade.price", "trade.quantity", "trade.is_buyer_maker")


def _name(suffix: str = "USDT"):
    return F.concat(F.upper("symbol"), F.lit(suffix))


def _text(c: str):
    return F.col(c).cast("string")


def _binance(s, d):
    j = F.to_json(F.struct(_name().alias("s"), _text("price").alias("p"), _text("quantity").alias("q"), F.col("trade_id").alias("f"), F.col("trade_id").alias("l"), F.col("trade_time").alias("T"), F.col("is_buyer_maker").alias("m")))
    return A.trades(s, d).select(F.concat(F.lit('{"stream":"x@aggTrade","data":'), j, F.lit("}")).alias("value"))


def _bybit(s, d):
    j = F.to_json(F.array(F.struct(_name().alias("s"), F.when(F.col("is_buyer_maker"), "Sell").otherwise("Buy").alias("S"), _text("price").alias("p"), _text("quantity").alias("v"), F.col("trade_time").alias("T"))))
    return A.trades(s, d).select(F.concat(F.lit('{"topic":"publicTrade.x","ts":1,"data":'), j, F.lit("}")).alias("value"))


def _hyper(s, d):
    j = F.to_json(F.array(F.struct(F.col("symbol").alias("coin"), F.when(F.col("is_buyer_maker"), "S").otherwise("B").alias("side"), _text("price").alias("px"), _text("quantity").alias("sz"), F.col("trade_time").alias("time"))))
    return A.trades(s, d).select(F.concat(F.lit('{"channel":"trades","data":'), j, F.lit("}")).alias("value"))


query("S18_parse_binance", "t", _WIRE)(lambda s, d: _trade_rows(messages.parse_binance(_binance(s, d))))
query("S19_parse_bybit", "t", _WIRE)(lambda s, d: _trade_rows(messages.parse_bybit(_bybit(s, d))))
query("S20_parse_hyperliquid", "t", _WIRE.replace("/USDT", "/USDC"))(lambda s, d: _trade_rows(messages.parse_hyperliquid(_hyper(s, d))))
query("S21_events_json", "t", _WIRE)(lambda s, d: _trade_rows(messages.events_from_json(messages.events_to_json(messages.parse_binance(_binance(s, d))))))
_BAR_TOPICS = f"with b as ({_OHLC_OF.format(_NEW)}), t as (select max(trade_time) as t from dense_v) select 'market.binance.' || symbol || '.bars.1m' as topic, timestamp - 60000 as timestamp, open, high, low, close, volume from b, t where timestamp <= t - 60000"
query("S22_published_bars", "d", _BAR_TOPICS)(lambda s, d: rounded(_published(s, d)))


def _published(s, d):
    """Closed minutes of a stream, published by topic; the query ends halfway and starts again."""
    path, progress, src = new_path(s, "topics"), new_path(s, "progress"), new_path(s, "trades")
    t = A.dense_trades(s, d)
    early = F.col("trade_time") < A.BASE + 5_000_000
    for part in (t.where(early), t.where(~early)):
        part.write.mode("append").parquet(src)
        stream = live.live_price_bars(s.readStream.schema(t.schema).parquet(src), "1 minute")
        messages.publish(messages.bars_to_topics(stream), path, progress, {"availableNow": True}).awaitTermination()
    b = F.from_json("value", "timestamp bigint, open double, high double, low double, close double, volume double")
    return s.read.parquet(path).select("topic", b.alias("b")).select("topic", "b.*")


query("S22_event_topics", "t", "select 'market.' || upper(symbol) || '/USDT:PERP.trades' as topic, count(*)::bigint as n from trades_v group by all")(lambda s, d: messages.to_topics(messages.parse_binance(_binance(s, d))).groupBy("topic").agg(F.count("*").alias("n")))
query("S7_parse_kline_json", "pb", f"select timestamp, {_OHLCV} from price_bars_v")(
    lambda s, d: rounded(messages.parse_kline_json(A.price_bars(s, d).select(F.to_json(F.array(F.array((F.col("timestamp") - 60_000).cast("string"), *[_text(c) for c in ("open", "high", "low", "close", "volume")]))).alias("value")), 60_000))
)
query("S6_read_kline_csv", "pb", f"select timestamp, {_OHLCV} from price_bars_v")(lambda s, d: rounded(files.read_kline_csv(s, _csv(s, d))))


def _csv(s, d) -> str:
    """Text files of bars, one with a header and lines that are no bars."""
    path = new_path(s, "klines")
    A.price_bars(s, d).select(F.concat_ws(",", F.col("timestamp") - 60_000, *[_text(c) for c in ("open", "high", "low", "close", "volume")]).alias("value")).write.text(path)
    s.createDataFrame([("open_time,open,high,low,close,volume",), ("",), ("1,2",)], "value string").coalesce(1).write.mode("append").text(path)
    return path


query("S6_kline_csv", "pb", f"select timestamp, {_OHLCV} from price_bars_v")(
    lambda s, d: rounded(files.parse_kline_lines(A.price_bars(s, d).select(F.concat_ws(",", F.col("timestamp") - 60_000, *[_text(c) for c in ("open", "high", "low", "close", "volume")]).alias("value")).unionByName(s.createDataFrame([("open_time,open,high,low,close,volume",), ("",), ("1,2",)], "value string"))))
)
query("S8_parse_funding_json", "fund", "select upper(symbol) as symbol, time, round(rate, 10) as rate from funding_v")(
    lambda s, d: rounded(messages.parse_funding_json(A.funding(s, d).select(F.to_json(F.array(F.struct(F.upper("symbol").alias("symbol"), _text("rate").alias("fundingRate"), F.col("time").alias("fundingTime")))).alias("value"))), 10)
)
query("S13_market_caps", "caps", "select coin, ts, cap from caps_v")(lambda s, d: files.read_market_caps(A.caps(s, d).groupBy("coin").agg(F.collect_list(F.array(F.col("ts").cast("double"), "cap")).alias("market_caps"))))
query("S14_labels", "tr", "select 'ethereum' as chain, to_address as address, 'binance' as exchange, 'exchange' as kind, 'manual' as source from (select distinct to_address from transfers_v)")(
    lambda s, d: files.read_labels(A.transfers(s, d).select(F.lit(1).alias("seq"), F.lit("ethereum").alias("chain"), F.upper("to_address").alias("address"), F.lit("binance").alias("exchange"), F.lit("").alias("kind"), F.lit(None).cast("string").alias("source")))
)

# histories
_HIST = f"""select exchange, 'CLICK' as symbol, (timestamp - 60000) // 900000 * 900000 + 900000 as timestamp, arg_min(open, t) as open, max(high) as high, min(low) as low, arg_max(close, t) as close, round(sum(volume), 6) as volume from (select *, timestamp as t from price_bars_v where symbol = 'click' and timestamp >= {LO + 60_000} and timestamp < {HI + 60_000}) group by exchange, 3"""


def _upper_bars(s, d):
    return A.price_bars(s, d).withColumn("symbol", F.upper("symbol"))


query("Q1_Q2_get_history", "pb", _HIST)(lambda s, d: rounded(history.get_history(_upper_bars(s, d), "test", " click", "15m", LO, HI)))
query("Q1_get_history_filled", "pb", _HIST)(lambda s, d: rounded(history.get_history(_upper_bars(s, d).where(f"(timestamp - 60000) div {DAY} <> {A.BASE // DAY}"), "test", "click", "15m", LO, HI, raw=_upper_bars(s, d))))
query("Q3_fill_missing_days", "pb", f"select {K}, {_OHLCV} from price_bars_v where (timestamp - 60000) // {DAY} % 3 > 0 or (timestamp - 60000) // {DAY} between {_D0 // DAY} and {_D1 // DAY}")(lambda s, d: rounded(history.fill_missing_days(_odd_days(s, d), A.price_bars(s, d), _D0, _D1)))
query("Q4_S12_get_orderbook_bars", "fb", f"select * replace ('VIEW' as symbol) from ({_FLOW}) where symbol = 'view' and timestamp >= {LO} and timestamp < {HI}")(lambda s, d: rounded(history.get_orderbook_bars(A.flow_bars(s, d).withColumn("symbol", F.upper("symbol")), "test", " view", LO, HI)))
query("S23_bars_to_response", "pb", f"select exchange, symbol, (row_number() over (partition by exchange, symbol order by timestamp) - 1)::int as pos, timestamp, {_OHLCV} from price_bars_v")(lambda s, d: rounded(_replies(s, d)))


def _replies(s, d):
    """The replies' bars in the order they have there."""
    r = messages.bars_to_response(A.price_bars(s, d)).withColumn("bars", F.from_json("value", "bars array<struct<timestamp:bigint,open:double,high:double,low:double,close:double,volume:double>>")["bars"])
    return r.select("exchange", "symbol", F.posexplode("bars").alias("pos", "b")).select("exchange", "symbol", "pos", "b.*")


# minutes of histories: stored bars alone where they are complete, else days without any are filled from raw ones, which differ
_DENSE_PB = _OHLC_OF.format("select * replace (upper(symbol) as symbol) from dense_v where symbol = 'click'")


def _dense_bars(s, d, f=lambda c: c):
    return trades.ticks_to_price_bars(A.dense_trades(s, d).withColumn("symbol", F.upper("symbol"))).withColumn("volume", f(F.col("volume")))


query("Q2_history_1m_complete", "d", f"select {K}, {_OHLCV} from ({_DENSE_PB}) where timestamp >= {A.BASE + 180_000} and timestamp < {A.BASE + 7_200_000} and timestamp // 60000 % 50 > 0")(
    lambda s, d: rounded(history.history_1m(_dense_bars(s, d).where("timestamp div 60000 % 50 > 0"), "test", "click", A.BASE + 120_000, A.BASE + 7_140_000, raw=_dense_bars(s, d, lambda v: v * 2)))
)
_HELD = f"(timestamp - 60000) // {DAY} % 3 = 0 and timestamp // 60000 % 2 = 0"
_FILLED = f"""with p as (select *, timestamp // {DAY} as d, {_HELD} as held from price_bars_v where symbol = 'click' and timestamp >= {A.BASE + 60_000} and timestamp < {A.BASE + 20 * DAY + 60_000}), have as (select distinct (timestamp - 60000) // {DAY} as d from p where held),
m as (select d from (select unnest(range({A.BASE // DAY}, {A.BASE // DAY + 21})) as d) anti join have using (d)), fill as (select d from m union select d + 1 from m where d < {A.BASE // DAY + 20})
select 'test' as exchange, 'CLICK' as symbol, timestamp, round(open, 6) as open, round(high, 6) as high, round(low, 6) as low, round(close, 6) as close, round(case when held then volume else volume * 2 end, 6) as volume from p where held or d in (select d from fill)"""
query("Q2_history_1m_filled", "pb", _FILLED)(lambda s, d: rounded(history.history_1m(_upper_bars(s, d).where(f"(timestamp - 60000) div {DAY} % 3 = 0 and timestamp div 60000 % 2 = 0"), "test", "click", A.BASE, A.BASE + 20 * DAY, raw=_dated_bars(s, d))))


def _dated_bars(s, d):
    """Raw bars of twice the volume in folders by date, of which a query reads those it needs."""
    b = _upper_bars(s, d).withColumn("volume", F.col("volume") * 2)
    path = new_path(s, "raw")
    tables.overwrite_partitions(b, path)
    return s.read.parquet(path).withColumn("date", F.col("date").cast("string"))


query("Q1_history_overwrite", "pb", _HIST.replace("sum(volume)", "2 * sum(volume)"))(lambda s, d: rounded(history.get_history(_upper_bars(s, d), "test", "click", "15m", LO, HI, raw=_upper_bars(s, d).withColumn("volume", F.col("volume") * 2), overwrite=True)))


# files written from the tables and read back
def _written(s, df: DataFrame, name: str, form: str = "parquet", *by: str) -> str:
    path = new_path(s, name)
    df.write.partitionBy(*by).format(form).save(path)
    return path


query("S1_read_trades", "t", "select trade_time, price, quantity, is_buyer_maker from trades_v")(lambda s, d: files.read_trades(s, _written(s, A.trades(s, d).withColumn("price", F.col("price").cast("string")), "trades")))
query("S3_read_open_interest", "oi", "select ts as timestamp, value as sum_open_interest, 0.0::double as sum_open_interest_value from oi_v")(lambda s, d: files.read_open_interest(s, _written(s, A.oi(s, d).select(F.col("ts").alias("timestamp"), F.col("value").alias("sum_open_interest")), "oi")))
query("S4_read_liquidations", "liq", "select trade_time, last_filled_quantity, side from liq_v")(lambda s, d: files.read_liquidations(s, _written(s, A.liquidations(s, d), "liq")))
query("S2_read_book", "book", "select event_time, event_type, price, quantity, side, final_update_id, prev_final_update_id, sum(case when final_update_id is distinct from lf then 1 else 0 end) over (partition by symbol order by seq) as grp from (select *, lag(final_update_id) over (partition by symbol order by seq) as lf from book_v)")(
    lambda s, d: files.read_book(s, _written(s, A.book(s, d).repartition("symbol").sortWithinPartitions("symbol", "seq"), "book", "parquet", "symbol")).select("event_time", "event_type", "price", "quantity", "side", "final_update_id", "prev_final_update_id", "grp")
)
query("S5_hour_layout", "t", "select trade_id, 'test' as exchange, strftime(make_timestamp(trade_time * 1000), '%Y-%m-%d') as date, extract(hour from make_timestamp(trade_time * 1000))::int as hour, symbol, 'trades' as type from trades_v")(
    lambda s, d: files.hour_layout(A.trades(s, d).select("trade_id", F.concat_ws("/", F.lit("file:/data"), "exchange", F.date_format(F.timestamp_millis("trade_time"), "yyyy-MM-dd/HH"), F.concat("symbol", F.lit("_trades.parquet/part-0"))).alias("p")), F.col("p")).drop("p")
)
query("S9_S10_bars_json", "pb", f"select {K}, {_OHLCV} from price_bars_v where timestamp >= {LO} and timestamp < {HI} and (timestamp - 60000) // {H} * {H} between {LO} and {HI}")(lambda s, d: rounded(files.read_bars_json(s, _json_bars(s, d), LO, HI, "timestamp long, open double, high double, low double, close double, volume double, exchange string, symbol string, date date, hour string")))


def _json_bars(s, d) -> str:
    path = new_path(s, "bars")
    files.write_bars_json(A.price_bars(s, d), path)
    return path


query("S15_chain_tables", "tr", "select block_timestamp, transaction_hash::varchar as transaction_hash, token_address, from_address, to_address, value::varchar as value from transfers_v where strftime(make_timestamp(block_timestamp * 1000), '%Y-%m-%d') between '1995-01-01' and '1996-12-31'")(
    lambda s, d: files.read_chain_table(s, _written(s, A.transfers(s, d).withColumn("date", F.date_format(F.timestamp_millis("block_timestamp"), "yyyy-MM-01")).repartition("date"), "chain", "parquet", "date"), "token_transfers", "1995-01-01", "1996-12-31")
)
query("S17_write_dominance", "caps", f"select timestamp, round(dominance, 6) as dominance from ({_DOM})")(lambda s, d: rounded(s.read.parquet(_swapped(s, d))))


def _swapped(s, d) -> str:
    """A series that replaced a shorter one."""
    path, series = new_path(s, "dominance"), flows.dominance(A.caps(s, d), "1-URGENT")
    files.write_dominance(series.limit(5), path)
    files.write_dominance(series, path)
    return path


query("S24_read_listings", "tr", "select lower(from_address) as base, count(*)::int as rank, from_address || 'USDT' as symbol, 'TRADING' as status, 'PERPETUAL' as contract_type, 'USDT' as quote from transfers_v group by from_address")(lambda s, d: _listings(s, d))


def _listings(s, d):
    c = A.transfers(s, d).groupBy("from_address").agg(F.count("*").cast("int").alias("n"))
    name = F.concat("from_address", F.lit("USDT"))
    coins = files.read_coins(s, _written(s, c.select(F.upper("from_address").alias("symbol"), F.lit("x").alias("name"), F.col("n").alias("market_cap_rank"), F.lit(1.0).alias("market_cap")), "coins", "json"))
    inst = files.read_instruments(s, _written(s, c.select(F.array(F.struct(name.alias("symbol"), F.lit("TRADING").alias("status"), F.lit("PERPETUAL").alias("contractType"), F.lit("USDT").alias("quoteAsset"))).alias("symbols")), "instruments", "json"))
    vendor = files.read_vendor_symbols(s, _written(s, c.select(F.array(name).alias("symbols")), "vendor", "json"))
    return coins.join(inst, F.col("base") == F.lower(F.replace(F.col("symbol"), F.lit("USDT"), F.lit("")))).join(vendor, "symbol", "left_semi").select("base", "rank", "symbol", "status", "contract_type", "quote")


# hydration end to end
_HYD = f"""with n as ({_flow_of(_NEW)}), f as (select n.*, f.rate as funding_rate from n asof left join funding_v f on n.symbol = f.symbol and n.timestamp >= f.time), c as (select *, funding_rate - last_value(funding_rate ignore nulls) over (partition by exchange, symbol order by timestamp rows between unbounded preceding and 1 preceding) as funding_rate_change from f),
o as (select *, null::double as funding_rate, null::double as funding_rate_change from ({_flow_of(_OLD)}) where (timestamp - 60000) // {H} % 2 = 0)"""
_HYD_COLS = f"{K}, trade_count::bigint as trade_count, " + _r("buy_volume", "sell_volume", "vwap") + ", round(funding_rate, 10) as funding_rate, round(funding_rate_change, 10) as funding_rate_change"
query("Q5_hydrate_resume", "d fund", f"{_HYD} select {_HYD_COLS} from o union all by name select {_HYD_COLS} from c where (exchange, symbol, (timestamp - 60000) // {H}) not in (select (exchange, symbol, (timestamp - 60000) // {H}) from o)")(lambda s, d: _hydrated(s, d, overwrite=False))
query("Q5_hydrate_overwrite", "d fund", f"{_HYD} select {_HYD_COLS} from c union all by name select {_HYD_COLS} from o anti join c using ({K})")(lambda s, d: _hydrated(s, d, overwrite=True))


def _hydrated(s, d, overwrite: bool):
    """Trades from files to bars, over stored bars of every second hour."""
    k = ["exchange", "symbol", "timestamp", "trade_count", "buy_volume", "sell_volume", "vwap", "avg_spread", "spread_std_dev", "depth_imbalance", "depth_ratio", "funding_rate", "funding_rate_change"]
    t = s.read.parquet(_written(s, A.dense_trades(s, d).where(X.in_hour(F.col("trade_time"), F.expr(f"trade_time div {H} * {H}"))), "ticks"))
    new = history.minute_bars(t)
    null = F.lit(None).cast("double")
    zero = {c: F.lit(0.0) for c in k[7:11]}
    stored = trades.trade_flow(A.old_trades(s, d)).where(f"(timestamp - 60000) div {H} % 2 = 0").withColumns(zero | {"funding_rate": null, "funding_rate_change": null}).select(*k)
    out = history.hydrate(stored, new.withColumns(zero), A.funding(s, d), overwrite=overwrite).select(*k[:7], *k[11:])
    return out.withColumns({c: F.round(c, 10 if c.startswith("funding") else 6) for c in k[4:7] + k[11:]})


# hydration of all sources from files, of which some are missing and some have nothing
_HOUR_ROWS = f"""e as (select 'test' as exchange, symbol, {A.BASE} + trade_id * 3000 as tm, trade_id, price, quantity, is_buyer_maker, trade_id % 6 as k, trade_id % 3 as b, ({A.BASE} + trade_id * 3000) // {H} as h, (({A.BASE} + trade_id * 3000) // 60000 + 1) * 60000 as timestamp,
  row_number() over (partition by symbol, trade_id % 6 >= 4 order by trade_id) as rn from trades_v), kept as (select * from e where not (symbol = 'click' and h % 4 = 1))"""


def _hour_files(s, d) -> str:
    """Files of trades, interest, liquidations and books in the layout of hours."""
    root = new_path(s, "market")
    t = A.trades(s, d).withColumns({"at": A.BASE + F.col("trade_id") * 3000, "k": F.col("trade_id") % 6, "h": F.expr(f"({A.BASE} + trade_id * 3000) div {H}")})
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy("trade_id")).cast("long")
    key = ["exchange", "symbol"]
    tr = t.where("k = 3 and not (symbol = 'click' and h % 4 = 1)").select(*key, F.col("at").alias("trade_time"), "price", "quantity", "is_buyer_maker")
    oi = t.where("k = 0").select(*key, F.col("at").alias("timestamp"), F.when(F.col("trade_id") % 4 == 0, 0.0).otherwise(F.col("quantity")).alias("sum_open_interest"), (F.col("quantity") * 2).alias("sum_open_interest_value"))
    # the file of an hour with h % 3 = 1 is missing, that of one with h % 3 = 2 holds nothing of its own hour
    liq = t.where("k = 2 and h % 3 <> 1").select(*key, "h", F.col("at").alias("file_time"), F.when(F.col("h") % 3 == 2, F.col("at") + DAY).otherwise(F.col("at")).alias("trade_time"), F.col("quantity").alias("last_filled_quantity"), F.when(F.col("trade_id") % 3 == 0, "BUY").otherwise("SELL").alias("side"))
    bk = t.where("k >= 4").withColumn("rn", rn)
    bk = bk.select(
        *key, F.col("at").alias("event_time"), F.when(F.col("rn") % 60 == 7, "snapshot").otherwise("depthUpdate").alias("event_type"), F.when(F.col("trade_id") % 2 == 0, 99 - F.expr("trade_id div 6 % 20")).otherwise(101 + F.expr("trade_id div 6 % 20")).cast("double").alias("price"),
        F.when(F.col("trade_id") % 7 == 0, 0.0).otherwise(F.col("quantity")).alias("quantity"), F.when(F.col("trade_id") % 2 == 0, "bid").otherwise("ask").alias("side"), F.col("rn").alias("final_update_id"), (F.col("rn") - 1).alias("prev_final_update_id"),
    )
    for df, kind, at in ((tr, "trades", "trade_time"), (oi, "open_interest", "timestamp"), (liq, "liquidations", "file_time"), (bk, "orderbook", "event_time")):
        files.write_hours(df, root, kind, at)
    return root


_ALL = (
    "with " + _HOUR_ROWS + """, book_v as (select symbol, rn as seq, tm as event_time, case when rn % 60 = 7 then 'snapshot' else 'depthUpdate' end as event_type, case when trade_id % 2 = 0 then 'bid' else 'ask' end as side, (case when trade_id % 2 = 0 then 99 - trade_id // 6 % 20 else 101 + trade_id // 6 % 20 end)::double as price,
  case when trade_id % 7 = 0 then 0 else quantity end as quantity, rn as final_update_id, rn - 1 as prev_final_update_id from kept where k >= 4),
""" + A.BOOK_STEPS + f""", stats as ({_STATS.replace(', 5)', ', 9)')}), tr_v as (select *, tm as trade_time from kept where k = 3), foot as ({_FOOT.replace('dense_v', 'tr_v')}),
li as (select distinct symbol, h from kept where k = 2 and h % 3 <> 1), trh as (select distinct symbol, h from kept where k = 3),
base as (select exchange, symbol, timestamp, h, count(*) filter (where k = 3)::bigint as trade_count, coalesce(sum(quantity) filter (where k = 3 and not is_buyer_maker), 0) as buy_volume, coalesce(sum(quantity) filter (where k = 3 and is_buyer_maker), 0) as sell_volume, coalesce(sum(price * quantity) filter (where k = 3) / nullif(sum(quantity) filter (where k = 3), 0), 0) as vwap,
  arg_max(case when trade_id % 4 = 0 then quantity * 2 else quantity end, trade_id) filter (where k = 0) as oi, coalesce(sum(quantity) filter (where k = 2 and b = 0 and h % 3 = 0), 0) as s_vol, coalesce(sum(quantity) filter (where k = 2 and b > 0 and h % 3 = 0), 0) as l_vol,
  bool_or(k in (0, 3) or (k = 2 and h % 3 = 0)) as other from kept semi join trh using (symbol, h) group by all),
c as (select base.*, x.* exclude (symbol, timestamp), last_value(oi ignore nulls) over w as open_interest, exists (select 1 from li where li.symbol = base.symbol and li.h = base.h) as cov from base left join stats x on base.symbol = x.symbol and base.timestamp = x.timestamp where other or x.n_samples is not null window w as (partition by base.symbol order by base.timestamp)),
f as (select c.*, v.rate as funding_rate from c asof left join funding_v v on c.symbol = v.symbol and c.timestamp >= v.time)
select f.exchange, f.symbol, f.timestamp, trade_count, round(buy_volume, 6) as buy_volume, round(sell_volume, 6) as sell_volume, round(vwap, 6) as vwap, round(coalesce(avg_spread, 0), 5) as avg_spread, round(coalesce(spread_std_dev, 0), 5) as spread_std_dev, round(coalesce(depth_imbalance, 0), 5) as depth_imbalance, round(coalesce(depth_ratio, 0), 5) as depth_ratio,
  round(open_interest, 6) as open_interest, round(open_interest - lag(open_interest) over w, 6) as open_interest_change, round(funding_rate, 10) as funding_rate, round(funding_rate - last_value(funding_rate ignore nulls) over (w rows between unbounded preceding and 1 preceding), 10) as funding_rate_change,
  case when cov then round(l_vol, 6) end as liq_long_vol, case when cov then round(s_vol, 6) end as liq_short_vol, case when cov then 1 else 0 end as liq_covered, {", ".join("foot." + c for c in trades.FOOTPRINT)}
from f left join foot on foot.symbol = f.symbol and foot.timestamp = f.timestamp window w as (partition by f.symbol order by f.timestamp)"""
)
query("Q5_hydrate_all_sources", "fund", _ALL)(lambda s, d: _whole_rounded(history.hydrate_files(s, _hour_files(s, d), A.funding(s, d), 1000)))


# streams over all there is, to files, and what they folded to
def _events_stream(s, d):
    """The table as a stream of trades."""
    raw = s.readStream.schema(s.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.withColumn("ms", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))"))


def _trades_stream(s, d):
    return _events_stream(s, d).select(F.lit("test").alias("exchange"), F.col("event_type").alias("symbol"), (A.BASE + F.col("event_id") * 1000).alias("trade_time"), (100 + F.col("user_id") % 50).cast("double").alias("price"), F.col("value").alias("quantity"), (F.col("event_id") % 2 == 0).alias("is_buyer_maker"), F.col("event_id").alias("trade_id"))


def _run(s, stream: DataFrame, mode: str = "update") -> DataFrame:
    path = new_path(s, "log")
    live.append_log(stream, path, new_path(s, "progress"), {"availableNow": True}, mode).awaitTermination()
    return s.read.parquet(path)


def _run_append(s, stream: DataFrame) -> DataFrame:
    path = new_path(s, "rows")
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", new_path(s, "progress")).trigger(availableNow=True).start(path).awaitTermination()
    return s.read.schema(stream.schema).parquet(path)


def _live_events(s, d):
    t = _trades_stream(s, d)
    v, k = F.col("quantity"), F.col("trade_id") % 4
    null = lambda kind: F.lit(None).cast(messages.PAYLOADS[kind])
    kind = F.when(k == 0, "open_interest").when(k == 1, "funding_rate").when(k == 2, "liquidation").otherwise("trade")
    side = F.when(F.col("trade_id") % 3 == 0, "BUY").otherwise("SELL")
    pay = {
        "trade": F.struct(F.col("price"), v.alias("quantity"), F.lit("buy").alias("side"), (F.col("trade_id") % 3 == 0).alias("is_buyer_maker"), F.lit(1).alias("trade_count")), "liquidation": F.struct(side.alias("side"), v.alias("quantity"), F.col("price")),
        "funding_rate": F.struct((v / 1e6).alias("rate"), F.lit(0).cast("long").alias("next_time")), "open_interest": F.struct(v.alias("value")),
    }
    return t.select("exchange", "symbol", kind.alias("type"), F.col("trade_time").alias("timestamp"), *[F.when(kind == c, p.cast(messages.PAYLOADS[c])).otherwise(null(c)).alias(c) for c, p in pay.items()])


_LIVE = f"""with g as (select {K}, count(*) filter (where k = 3)::bigint as trade_count, coalesce(sum(quantity) filter (where k = 3 and b > 0), 0) as buy_volume, coalesce(sum(quantity) filter (where k = 3 and b = 0), 0) as sell_volume, coalesce(sum(price * quantity) filter (where k = 3) / nullif(sum(quantity) filter (where k = 3), 0), 0) as vwap,
  arg_max(quantity, trade_time) filter (where k = 0) as open_interest, arg_max(quantity / 1e6, trade_time) filter (where k = 1) as funding_rate, sum(quantity) filter (where k = 2 and b = 0) as liq_short_vol, sum(quantity) filter (where k = 2 and b > 0) as liq_long_vol from (select *, trade_id % 4 as k, trade_id % 3 as b from dense_v) group by all)"""
_LIVE_SUM = "sum(case when {} then quantity end)"
query("R1_R5_R9_live_bars", "d", f"{_LIVE} select {K}, trade_count, {_r('buy_volume', 'sell_volume', 'vwap', 'open_interest')}, round(funding_rate, 10) as funding_rate from g")(lambda s, d: _live_bars(s, d).select("exchange", "symbol", "timestamp", "trade_count", *[F.round(c, 6).alias(c) for c in ("buy_volume", "sell_volume", "vwap", "open_interest")], F.round("funding_rate", 10).alias("funding_rate")))


def _live_bars(s, d):
    zeros = [F.lit(0.0).alias(c) for c in ("avg_spread", "spread_std_dev", "depth_imbalance", "depth_ratio")]
    return live.fold_log(_run(s, live.live_minute_bars(_live_events(s, d), "1 day").select("*", *zeros)))


query("R6_live_carry", "d", f"{_LIVE}, f as (select {K}, last_value(open_interest ignore nulls) over w as open_interest, last_value(funding_rate ignore nulls) over w as funding_rate from g window w as (partition by exchange, symbol order by timestamp)) select {K}, round(open_interest, 6) as open_interest, round(open_interest - lag(open_interest) over w, 6) as open_interest_change, round(funding_rate, 10) as funding_rate, round(funding_rate - lag(funding_rate) over w, 10) as funding_rate_change from f window w as (partition by exchange, symbol order by timestamp)")(
    lambda s, d: live.live_carry(_live_bars(s, d)).select("exchange", "symbol", "timestamp", *[F.round(c, n).alias(c) for c, n in (("open_interest", 6), ("open_interest_change", 6), ("funding_rate", 10), ("funding_rate_change", 10))])
)
query("R2_empty_skipped", "d", f"{_LIVE} select {K} from g where trade_count > 0 or liq_long_vol <> 0 or liq_short_vol <> 0")(lambda s, d: live.empty_skipped(_live_bars(s, d).drop("open_interest", "funding_rate")).select("exchange", "symbol", "timestamp"))
query("R1_live_footprint", "d", _FOOT)(lambda s, d: rounded(live.fold_levels(_run(s, live.live_levels(_trades_stream(s, d), "1 day"))).withColumn("trade_price_std", F.round("trade_price_std", 3))))
query("R8_live_price_bars", "d", _OHLC_OF.format(_NEW))(lambda s, d: rounded(live.fold_latest(_run(s, live.live_price_bars(_trades_stream(s, d), "1 day")))))
query("R13_only_newer_bars", "pb", f"select {K}, {_OHLCV} from price_bars_v")(lambda s, d: rounded(_newer(s, d)))


def _newer(s, d):
    """Polls that overlap: every bar comes twice."""
    b = A.price_bars(s, d)
    path = _written(s, b.unionByName(b), "polls")
    return _run_append(s, live.only_newer_bars(s.readStream.schema(b.schema).parquet(path), "60 days"))


query("R10_funding_on_change", "fund", "select symbol, time as ts, round(rate, 6) as rate from (select *, lag(rate) over (partition by symbol order by time) as last from (select symbol, time, round(rate, 4) as rate from funding_v)) where last is distinct from rate")(lambda s, d: rounded(_rates(s, d)))


def _rates(s, d):
    """Rates to four digits, rounded as doubles: round(x, 4) would take 0.00015, which lies below the half, by its digits."""
    f = A.funding(s, d).select("symbol", F.col("time").alias("ts"), (F.round(F.col("rate") * 10_000) / 10_000).alias("rate"))
    return _run_append(s, live.funding_on_change(s.readStream.schema(f.schema).parquet(_written(s, f, "rates"))))


def _live_book_sql(rows: str) -> str:
    """Bars of book updates: depths by running sums of changes, best prices by the lives of levels, both anew after a reset."""
    return f"""with u as (select *, sum(case when control = 'depth_reset' then 1 else 0 end) over (partition by symbol order by seq) as epoch from ({rows})),
l as (select *, (price * 10000)::bigint as level, quantity - lag(quantity, 1, 0.0) over w as delta, lead(seq) over w as nxt from u where control is null window w as (partition by symbol, epoch, side, price order by seq)),
d as (select *, sum(case when side = 'bid' then delta else 0 end) over w as b, sum(case when side = 'ask' then delta else 0 end) over w as a from l window w as (partition by symbol, epoch order by seq)),
v as (select symbol, epoch, side, level, seq as lo, coalesce(nxt, max(seq) over (partition by symbol, epoch) + 1) as hi, quantity from l),
x as (select d.symbol, d.seq, coalesce(max(case when v.side = 'bid' then v.level end), 0) / 1e4 as bb, coalesce(min(case when v.side = 'ask' then v.level end), 0) / 1e4 as ba from d left join v on v.quantity <> 0 and v.symbol = d.symbol and v.epoch = d.epoch and v.lo <= d.seq and d.seq < v.hi group by all),
book_bars as (select d.symbol, (event_time // 60000 + 1) * 60000 as timestamp, count(*)::bigint as n_samples, coalesce(avg(case when bb > 0 and ba > bb then (ba - bb) / bb * 10000 end), 0) as avg_spread, coalesce(stddev_samp(case when bb > 0 and ba > bb then (ba - bb) / bb * 10000 end), 0) as spread_std_dev,
  case when round(sum(b) + sum(a), 9) > 0 then (sum(b) - sum(a)) / (sum(b) + sum(a)) else 0 end as depth_imbalance, case when round(sum(b) + sum(a), 9) > 0 then sum(a) / (sum(b) + sum(a)) else 0 end as depth_ratio from d join x on d.symbol = x.symbol and d.seq = x.seq group by all)"""


_BOOK_COLS = "round(avg_spread, 5) as avg_spread, round(spread_std_dev, 5) as spread_std_dev, round(depth_imbalance, 5) as depth_imbalance, round(depth_ratio, 5) as depth_ratio"
query("R4_R3_live_book", "book", _live_book_sql("select symbol::varchar as symbol, seq, event_time, null as control, side, price, quantity from book_v") + f" select symbol, timestamp, n_samples, {_BOOK_COLS} from book_bars")(lambda s, d: rounded(_live_book(s, d, None), 5))
_RESETS = "select symbol::varchar as symbol, seq, event_time, case when seq % 400 = 150 then 'depth_reset' end as control, side, price, quantity from book_v"
query("R4_R5_live_book_resets", "book", _live_book_sql(_RESETS) + f" select symbol, timestamp, n_samples, {_BOOK_COLS} from book_bars")(lambda s, d: rounded(_live_book(s, d, F.when(F.col("seq") % 400 == 150, "depth_reset")), 5))


def _live_book(s, d, control):
    """The book as a stream that stops halfway and starts again from its state."""
    control = F.lit(None).cast("string") if control is None else control
    b = A.book(s, d).select(F.col("symbol").cast("string").alias("symbol"), "seq", "event_time", control.alias("control"), "side", "price", "quantity")
    first = F.col("seq") <= 1000
    return live.book_bars(_run_in_steps(s, [b.where(first), b.where(~first)], live.live_book))


def _run_in_steps(s, slices: list[DataFrame], of, log: bool = False) -> DataFrame:
    """What ``of`` makes of a stream whose ``slices`` come one by one, the query ending and starting again between them."""
    path, out, progress = new_path(s, "slices"), new_path(s, "rows"), new_path(s, "progress")
    for x in slices:
        x.write.mode("append").parquet(path)
        stream = of(s.readStream.schema(x.schema).parquet(path))
        if log:
            live.append_log(stream, out, progress, {"availableNow": True}, "append").awaitTermination()
        else:
            stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", progress).trigger(availableNow=True).start(out).awaitTermination()
    return s.read.parquet(out) if log else s.read.schema(stream.schema).parquet(out)


# whole live bars: events of every type, told apart by number and minute, so that some minutes have depth alone
_MIXED = """mixed_v as (select *, case when trade_time // 60000 % 7 = 0 then 4 else trade_id % 6 end as k, trade_id % 3 as b, case when trade_id % 2 = 0 then 'bid' else 'ask' end as book_side, (case when trade_id % 2 = 0 then 99 - trade_id // 2 % 20 else 101 + trade_id // 2 % 20 end)::double as book_price,
  case when trade_id % 7 = 0 then 0 else quantity end as book_quantity, case when trade_id % 500 = 10 then 'depth_reset' end as control from dense_v)"""


def _kind():
    return F.when(F.expr("trade_time div 60000 % 7 = 0"), 4).otherwise(F.col("trade_id") % 6)


def _mixed_events(trades: DataFrame) -> DataFrame:
    """Events of ``trades``' rows."""
    v, b = F.col("quantity"), F.col("trade_id") % 3
    k = {0: "open_interest", 1: "funding_rate", 2: "liquidation", 3: "trade", 4: "orderbook_update", 5: "orderbook_update"}
    kind = F.create_map(*[F.lit(x) for kv in k.items() for x in kv])[_kind().cast("int")]
    pay = {
        "trade": F.struct(F.col("price"), v.alias("quantity"), F.lit("buy").alias("side"), (b == 0).alias("is_buyer_maker"), F.lit(1).alias("trade_count")), "liquidation": F.struct(F.when(b == 0, "BUY").otherwise("SELL").alias("side"), v.alias("quantity"), F.col("price")),
        "funding_rate": F.struct((v / 1e6).alias("rate"), F.lit(0).cast("long").alias("next_time")), "open_interest": F.struct(v.alias("value")),
    }
    return trades.select("exchange", "symbol", kind.alias("type"), F.col("trade_time").alias("timestamp"), *[F.when(kind == c, p.cast(messages.PAYLOADS[c])).otherwise(F.lit(None).cast(messages.PAYLOADS[c])).alias(c) for c, p in pay.items()])


def _book_updates(trades: DataFrame) -> DataFrame:
    """Book updates of ``trades``' rows."""
    n = F.col("trade_id")
    price = F.when(n % 2 == 0, 99 - F.expr("trade_id div 2 % 20")).otherwise(101 + F.expr("trade_id div 2 % 20")).cast("double")
    t = trades.where(_kind() >= 4)
    return t.select("symbol", n.alias("seq"), F.col("trade_time").alias("event_time"), F.when(n % 500 == 10, "depth_reset").alias("control"), F.when(n % 2 == 0, "bid").otherwise("ask").alias("side"), price.alias("price"), F.when(n % 7 == 0, 0.0).otherwise(F.col("quantity")).alias("quantity"))


def _mixed_logs(s, d):
    """The logs of flow, levels and book parts of the mixed stream."""
    t = _trades_stream(s, d)
    flow = _run(s, live.live_minute_bars(_mixed_events(t.where(_kind() < 4)), "1 day"))
    levels = _run(s, live.live_levels(t.where(_kind() == 3), "1 day"))
    return flow, levels, _run_append(s, live.live_book(_book_updates(t)))


def _mixed_status(s, d):
    """The liquidation feed's changes, every twenty minutes of each third."""
    h = A.dense_trades(s, d).select(F.expr("trade_time div 1200000").alias("h")).where("h % 3 = 0").distinct()
    return h.select((F.col("h") * 1_200_000 + 1000).alias("ts"), (F.row_number().over(Window.orderBy("h")) % 2 == 1).alias("connected"))


_WHOLE = (
    f"""with {_MIXED}, st as (select ts, k % 2 = 1 as connected, lead(ts) over (order by ts) as until from (select h * 1200000 + 1000 as ts, row_number() over (order by h) as k from (select distinct trade_time // 1200000 as h from dense_v where trade_time // 1200000 % 3 = 0))),
mt_v as (select * from mixed_v where k = 3), """
    + _live_book_sql("select symbol, trade_id as seq, trade_time as event_time, control, book_side as side, book_price as price, book_quantity as quantity from mixed_v where k >= 4")[5:]
    + f""", foot as ({_FOOT.replace('dense_v', 'mt_v')}),
flow as (select {K}, count(*) filter (where k = 3)::bigint as trade_count, coalesce(sum(quantity) filter (where k = 3 and b > 0), 0) as buy_volume, coalesce(sum(quantity) filter (where k = 3 and b = 0), 0) as sell_volume, coalesce(sum(price * quantity) filter (where k = 3) / nullif(sum(quantity) filter (where k = 3), 0), 0) as vwap,
  arg_max(quantity, trade_time) filter (where k = 0) as oi, arg_max(quantity / 1e6, trade_time) filter (where k = 1) as fr, coalesce(sum(quantity) filter (where k = 2 and b = 0), 0) as s_vol, coalesce(sum(quantity) filter (where k = 2 and b > 0), 0) as l_vol from mixed_v where k < 4 group by all),
j as (select coalesce(f.exchange, 'test') as exchange, coalesce(f.symbol, x.symbol) as symbol, coalesce(f.timestamp, x.timestamp) as timestamp, f.* exclude (exchange, symbol, timestamp), x.* exclude (symbol, timestamp) from flow f full join book_bars x on f.symbol = x.symbol and f.timestamp = x.timestamp),
c as (select *, last_value(oi ignore nulls) over w as open_interest, last_value(fr ignore nulls) over w as funding_rate, exists (select 1 from st where connected and st.ts <= j.timestamp and (until is null or j.timestamp < until)) as cov from j window w as (partition by symbol order by timestamp))
select c.exchange, c.symbol, c.timestamp, coalesce(trade_count, 0)::bigint as trade_count, round(coalesce(buy_volume, 0), 6) as buy_volume, round(coalesce(sell_volume, 0), 6) as sell_volume, round(coalesce(vwap, 0), 6) as vwap, round(coalesce(avg_spread, 0), 5) as avg_spread, round(coalesce(spread_std_dev, 0), 5) as spread_std_dev,
  round(coalesce(depth_imbalance, 0), 5) as depth_imbalance, round(coalesce(depth_ratio, 0), 5) as depth_ratio, round(open_interest, 6) as open_interest, round(open_interest - lag(open_interest) over w, 6) as open_interest_change, round(funding_rate, 10) as funding_rate, round(funding_rate - lag(funding_rate) over w, 10) as funding_rate_change,
  case when cov then round(coalesce(l_vol, 0), 6) end as liq_long_vol, case when cov then round(coalesce(s_vol, 0), 6) end as liq_short_vol, case when cov then 1 else 0 end as liq_covered, {", ".join("foot." + c for c in trades.FOOTPRINT)}
from c left join foot on foot.symbol = c.symbol and foot.timestamp = c.timestamp window w as (partition by c.symbol order by c.timestamp)"""
)
_DIGITS = {"avg_spread": 5, "spread_std_dev": 5, "depth_imbalance": 5, "depth_ratio": 5, "funding_rate": 10, "funding_rate_change": 10, "trade_price_std": 3}


def _whole_rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, _DIGITS.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


query("R1_live_orderbook_bars", "d", _WHOLE)(lambda s, d: _whole_rounded(live.whole_bars(*_mixed_logs(s, d), _mixed_status(s, d), "test")))
_ORDERED = f"""with {_MIXED}, e as (select *, trade_id % 10 = 3 as slow from mixed_v), t as (select max(trade_time) filter (where not slow) as t1, max(trade_time) as t2 from e), x as (select e.*, slow and timestamp <= t1 - 60000 as late, timestamp <= t2 - 60000 as done from e, t),
g as (select {K}, late, count(*) as n, count(*) filter (where k = 3)::bigint as trade_count, coalesce(sum(quantity) filter (where k = 3 and b > 0), 0) as buy_volume, coalesce(sum(quantity) filter (where k = 3 and b = 0), 0) as sell_volume, coalesce(sum(price * quantity) filter (where k = 3) / nullif(sum(quantity) filter (where k = 3), 0), 0) as vwap,
  coalesce(sum(quantity) filter (where k = 2 and b = 0), 0) as liq_short_vol, coalesce(sum(quantity) filter (where k = 2 and b > 0), 0) as liq_long_vol, arg_max(quantity, trade_time) filter (where k = 0) as oi, arg_max(quantity / 1e6, trade_time) filter (where k = 1) as fr from x where done group by all),
c as (select *, last_value(oi ignore nulls) over w as open_interest, last_value(fr ignore nulls) over w as funding_rate from g where not late window w as (partition by symbol order by timestamp)),
o as (select *, open_interest - lag(open_interest) over w as open_interest_change, funding_rate - lag(funding_rate) over w as funding_rate_change from c window w as (partition by symbol order by timestamp)), l as (select * from g where late)
select coalesce(o.exchange, l.exchange) as exchange, coalesce(o.symbol, l.symbol) as symbol, coalesce(o.timestamp, l.timestamp) as timestamp, greatest(coalesce(o.trade_count, 0), coalesce(l.trade_count, 0)) as trade_count,
  {", ".join(f"round(case when o.symbol is null or (l.trade_count >= o.trade_count and l.trade_count > 0) then l.{c} else o.{c} end, 6) as {c}" for c in ("buy_volume", "sell_volume", "vwap"))}, round(coalesce(l.liq_long_vol, o.liq_long_vol), 6) as liq_long_vol, round(coalesce(l.liq_short_vol, o.liq_short_vol), 6) as liq_short_vol,
  round(coalesce(l.oi, o.open_interest), 6) as open_interest, round(o.open_interest_change, 6) as open_interest_change, round(coalesce(l.fr, o.funding_rate), 10) as funding_rate, round(o.funding_rate_change, 10) as funding_rate_change, coalesce(l.n, 0)::bigint as n_late
from o full join l on o.symbol = l.symbol and o.timestamp = l.timestamp"""
query("R2_R3_ordered_minutes", "d", _ORDERED)(lambda s, d: _whole_rounded(_ordered(s, d)))


def _ordered(s, d):
    """A tenth of the rows come when their minutes are long closed; what minutes hold then, and how many rows were late. The
    watermark lies ten years back, so that Spark drops none of them however long the table is."""
    t, slow = A.dense_trades(s, d), F.col("trade_id") % 10 == 3
    events = [_mixed_events(t.where(~slow)), _mixed_events(t.where(slow))]
    log = _run_in_steps(s, events, lambda stream: live.ordered_minutes(stream, watermark=3650 * DAY), log=True)
    zeros = {c: F.lit(0.0) for c in ("avg_spread", "spread_std_dev", "depth_imbalance", "depth_ratio")}
    bars_ = live.fold_log(log.withColumn("seq", 2 * F.col("seq") + F.col("late").cast("int")).withColumns(zeros).drop("late", "n_rows", "depth_samples")).drop(*zeros)
    k = ["exchange", "symbol", "timestamp"]
    return bars_.join(live.late_rows(log), k, "left").withColumn("n_late", F.coalesce("n_late", F.lit(0)))


query("R7_liq_coverage", "pb", f"with st as (select ms as ts, k % 2 = 0 as connected, lead(ms) over (order by ms) as until from (select h * {H} + 1000 as ms, row_number() over (order by h) as k from (select distinct timestamp // {H} as h from price_bars_v where timestamp // {H} % 5 = 0))) select {K}, case when exists (select 1 from st where connected and st.ts <= p.timestamp and (until is null or p.timestamp < until)) then 1 else 0 end as liq_covered from price_bars_v p")(
    lambda s, d: live.liq_coverage(A.price_bars(s, d).select("exchange", "symbol", "timestamp"), _status(s, d))
)


def _status(s, d):
    """The feed's changes at some of the hours with bars."""
    h = A.price_bars(s, d).select(F.expr(f"timestamp div {H}").alias("h")).where("h % 5 = 0").distinct()
    return h.select((F.col("h") * H + 1000).alias("ts"), (F.row_number().over(Window.orderBy("h")) % 2 == 0).alias("connected"))


query("R11_rebuild_previous_hours", "pb", f"select {K}, round(case when timestamp > {LO} and timestamp <= {HI} then close else 0 end, 6) as close from price_bars_v")(lambda s, d: rounded(_rebuilt(s, d)))


def _rebuilt(s, d):
    """Stored bars of no value, rebuilt for some hours."""
    b = A.price_bars(s, d).select("exchange", "symbol", "timestamp", "close")
    path = new_path(s, "stored")
    tables.overwrite_partitions(b.withColumn("close", F.lit(0.0)), path)
    live.rebuild_previous_hours(b, path, LO, HI)
    return s.read.parquet(path).select("exchange", "symbol", "timestamp", "close")


query("R12_sparse_depth", "pb", f"select {K}, volume > 0 and timestamp // 60000 % 3 = 0 as sparse_depth from price_bars_v")(
    lambda s, d: live.sparse_depth(A.price_bars(s, d).selectExpr("exchange", "symbol", "timestamp", "case when volume > 0 then 1 else 0 end as trade_count", "case when timestamp div 60000 % 3 > 0 then 1 end as n_samples")).select("exchange", "symbol", "timestamp", "sparse_depth")
)
