import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlake.functions import timeframe
from barlake.functions import symbols as S
from barlake.operators import bars, book, gaps, joins, tables, trades

NAN = float("nan")
TRADES = "trade_time long, price double, quantity double, is_buyer_maker boolean, trade_id long"


def make(spark, rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], TRADES)
    return df.select(F.lit("x").alias("exchange"), F.lit("s").alias("symbol"), "*")


def foot(spark, rows):
    return {r["timestamp"]: r for r in trades.footprint(make(spark, rows)).collect()}


def test_parity_sequence(spark):
    rows = [(60000, 100.0, 2.0, False), (60001, 101.5, 1.0, True), (60002, 101.5, 4.0, True), (60003, 99.75, 0.25, False), (60004, 0.0, 0.0, False), (60005, NAN, 1.0, True), (60500, 102.0, 3.0, False), (120000, 101.0, 1.5, True), (121000, 100.5, 2.5, True)]
    f = foot(spark, rows)
    a, b = f[120000], f[180000]
    assert (a.trade_open, a.trade_high, a.trade_low, a.trade_close, a.poc_price, a.buy_poc_price, a.sell_poc_price) == (100, 102, 99.75, 102, 101.5, 102, 101.5)
    assert a.poc_volume_share == pytest.approx(5 / 10.25) and a.buy_vwap == pytest.approx(530.9375 / 5.25) and a.sell_vwap == pytest.approx(101.5)
    assert (a.hi_band_buy_vol, a.hi_band_sell_vol, a.lo_band_buy_vol, a.lo_band_sell_vol) == (5, 5, 2.25, 5)
    assert b.buy_vwap is None and b.buy_poc_price is None and b.sell_vwap == pytest.approx(402.75 / 4) and b.poc_volume_share == pytest.approx(0.625)
    flow = {r["timestamp"]: r for r in trades.trade_flow(make(spark, rows)).collect()}
    assert (flow[120000].trade_count, flow[120000].buy_volume, flow[120000].sell_volume) == (7, 5.25, 6.0) and math.isnan(flow[120000].vwap)


def test_poc_ties_and_bands(spark):
    f = foot(spark, [(1, 100.0, 2.0, False), (2, 104.0, 2.0, False), (3, 103.0, 5.0, True)])[60000]
    assert (f.buy_vwap, f.buy_poc_price, f.poc_price) == (102, 100, 103) and f.poc_volume_share == pytest.approx(5 / 9)
    assert foot(spark, [(1, 101.0, 2.0, False), (2, 100.0, 2.0, False)])[60000].poc_price == 100
    f = foot(spark, [(i, 98.0 + i, float(i), False) for i in range(1, 6)] + [(9, 103.0, 10.0, True)])[60000]
    assert (f.lo_band_buy_vol, f.lo_band_sell_vol, f.hi_band_buy_vol, f.hi_band_sell_vol) == (6, 0, 12, 10)


def test_degenerate_trades(spark):
    f = foot(spark, [(1, NAN, 1.0, False), (2, float("inf"), 1.0, False), (3, 0.0, 1.0, False), (4, -1.0, 1.0, False), (5, 100.0, 0.0, False), (6, 100.0, 2.0, True)])[60000]
    assert f.trade_open == 100 and f.hi_band_sell_vol == 2 and f.buy_vwap is None


def minute_bars(spark, n):
    return spark.range(n).select(F.lit("x").alias("exchange"), F.lit("s").alias("symbol"), ((F.col("id") + 1) * 60000).alias("timestamp"), *[(F.col("id") + v).cast("double").alias(c) for c, v in (("open", 100), ("high", 101), ("low", 99), ("close", 100.5), ("volume", 1000))])


def test_resample(spark):
    out = lambda n, tf: [(r["timestamp"], r.volume) for r in bars.resample_ohlcv(minute_bars(spark, n), timeframe.parse(tf).ms).orderBy("timestamp").collect()]
    assert out(9, "3m") == [(180000, 3003), (360000, 3012), (540000, 3021)]
    shifted = minute_bars(spark, 14).withColumn("timestamp", F.col("timestamp") + 6 * 60000)
    assert [r["n"] for r in bars.resample_ohlcv(shifted, 420000).join(shifted.withColumn("b", F.ceil(F.col("timestamp") / 420000) * 420000).groupBy(F.col("b").alias("timestamp")).agg(F.count("*").alias("n")), "timestamp").orderBy("timestamp").collect()] == [1, 7, 6]
    assert bars.resample_ohlcv(minute_bars(spark, 3), 60000).count() == 3


def test_gaps(spark):
    b = minute_bars(spark, 10).where("timestamp not in (180000, 240000)")
    got = {(r.gap_start, r.gap_end) for r in gaps.find_gaps(b, 0, 900000, 60000).collect()}
    assert got == {(180000, 300000), (660000, 900000)}
    empty = gaps.find_gaps(b.where("false"), 0, 900000, 60000, keys=[]).collect()
    assert [(r.gap_start, r.gap_end) for r in empty] == [(0, 900000)]


def test_positional_resample(spark):
    cols = "exchange string, symbol string, timestamp long, vwap double, trade_count long, buy_volume double, sell_volume double, avg_spread double, spread_std_dev double, depth_imbalance double, depth_ratio double, open_interest double, funding_rate double, liq_long_vol double, liq_short_vol double, liq_covered int"
    rows = [("x", "s", 60000, 100.0, 10, 100.0, 80.0, 0.0005, 0.0, 0.2, 0.4, 1e6, 0.0001, 300.0, None, 0), ("x", "s", 120000, 101.0, 5, 50.0, 40.0, 0.0006, 0.1, 0.3, 0.5, 1.1e6, 0.00015, None, 200.0, 1)]
    r = bars.resample_orderbook(spark.createDataFrame(rows, cols), 2).first()
    assert (r["timestamp"], r.trade_count, r.buy_volume, r.sell_volume, r.liq_long_vol, r.liq_short_vol, r.liq_covered) == (120000, 15, 150, 120, 300, 200, 1)
    assert r.vwap == pytest.approx((100 * 180 + 101 * 90) / 270) and r.avg_spread == pytest.approx(0.00055) and r.open_interest_change == pytest.approx(100000) and r.funding_rate_change == pytest.approx(0.00005)


def test_funding_asof_over_days(spark):
    """Against a search of all points: rates carried over days without any, ties, nulls, times before 1970."""
    import random

    rnd, day = random.Random(2), joins.DAY
    pts = [(s, rnd.randrange(-3 * day, 40 * day), rnd.choice([rnd.random(), None])) for s in ("a", "a", "b", None) for _ in range(12)] + [("a", 5 * day, 0.1), ("a", 5 * day, 0.2)]
    bars = [("x", s, t) for s in ("a", "b", "c", None) for t in [rnd.randrange(-4 * day, 45 * day) for _ in range(60)] + [5 * day, 6 * day, 6 * day]]
    got = joins.asof_funding(spark.createDataFrame(bars, "exchange string, symbol string, timestamp long").repartition(4), spark.createDataFrame(pts, "symbol string, time long, rate double"))
    best = lambda s, t: max(((u, r) for z, u, r in pts if z == s and u <= t and r is not None), default=(None, None))[1]
    key = lambda r: (r[1] or "", r[2])
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(e, s, t, best(s, t)) for e, s, t in bars], key=key)


def test_funding_asof(spark):
    h = 3_600_000
    pts = spark.createDataFrame([("s", i * 8 * h, (i + 1) / 1e4) for i in range(4)], "symbol string, time long, rate double")
    b = spark.createDataFrame([("x", "s", t) for t in (-1000, 0, 4 * h, 8 * h, 12 * h, 24 * h, 30 * h)], "exchange string, symbol string, timestamp long")
    got = [r.funding_rate for r in joins.asof_funding(b, pts).orderBy("timestamp").collect()]
    assert got == [None, 1e-4, 1e-4, 2e-4, 2e-4, 4e-4, 4e-4]
    assert [r.funding_rate for r in joins.asof_funding(b, pts.where("false")).collect()] == [None] * 7


BOOK = "symbol long, seq long, event_time long, event_type string, side string, price double, quantity double, final_update_id long, prev_final_update_id long"


def test_book_continuity(spark):
    def epochs(ids):
        df = spark.createDataFrame([(1, i, 1000 + i, "depthUpdate", "bid", 100.0 - i, 1.0, f, p) for i, (f, p) in enumerate(ids)], BOOK)
        return [r.epoch for r in book.continuity(df).orderBy("seq").collect()]

    assert epochs([(100, 0), (100, 0), (200, 100)]) == [0, 0, 0]
    assert epochs([(100, 0), (100, 0), (600, 500)]) == [0, 0, 1]
    assert epochs([(100, 50), (100, 70)]) == [0, 0]


def test_book_replay_over_chunks(spark):
    rnd = random.Random(1)
    rows, levels, want, epoch_ids = [], {}, [], 0
    for i in range(400):
        side = rnd.choice(["bid", "ask"])
        price = float(rnd.randint(90, 99) if side == "bid" else rnd.randint(101, 110))
        qty = float(rnd.choice([0, 1, 2, 5]))
        gap = i == 150
        prev = i - 5 if gap else i
        if gap:
            levels = {}
        levels[side, price] = qty
        rows.append((1, i, 1000 * i, "depthUpdate", side, price, qty, i + 1, prev))
        live = lambda s: [p for (x, p), q in levels.items() if x == s and q]
        want.append((max(live("bid"), default=0.0), min(live("ask"), default=0.0)))
    df = spark.createDataFrame(rows, BOOK)
    for chunk in (1, 37, 10_000):
        got = [(r.best_bid, r.best_ask) for r in book.best_bid_ask(df, chunk).orderBy("seq").collect()]
        assert got == want


def test_book_scan_in_two_levels(spark):
    """Resets, epochs, depths and warmth don't depend on where chunks end, and no window runs over a symbol's rows."""
    rnd = random.Random(4)
    rows, ids = [], 0
    for i in range(600):
        ids += rnd.random() < 0.4
        kind = "snapshot" if rnd.random() < 0.01 else rnd.choice(["depthUpdate", None])
        side = rnd.choice(["bid", "ask"])
        rows.append((i % 2, 7 * i, 400 * i, kind, side, rnd.randint(90, 110) + 0.0, float(rnd.choice([0, 9, 30])), ids, ids - 1 if rnd.random() < 0.97 else ids - 9))
    df = spark.createDataFrame(rows, BOOK).repartition(6)
    names = ["symbol", "seq", "reset", "epoch", "bid_depth", "ask_depth", "warm"]
    want = None
    for chunk in (10**9, 1000, 70, 7):
        got = [tuple(r) for r in book.depth(df, chunk).select(*names).orderBy("symbol", "seq").collect()]
        stats = [tuple(r) for r in book.book_stats(df, chunk).orderBy("symbol", "timestamp").collect()]
        want = want or (got, stats)
        assert got == want[0]
        assert [pytest.approx(x) for x in want[1]] == stats
    assert any(x[2] for x in want[0]) and any(x[6] for x in want[0]) and not all(x[6] for x in want[0])
    assert [r.n for r in book.profile_book(df, 70).where("what = 'id_break'").collect()] == [r.n for r in book.profile_book(df, 10**9).where("what = 'id_break'").collect()]
    assert book.depth(df.where("false")).count() == 0 and book.best_bid_ask(df.where("false")).count() == 0


def test_interval_best():
    rnd = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 100):
        start = rnd.integers(0, n, 40)
        stop = np.minimum(start + rnd.integers(1, n + 1, 40), n)
        value = rnd.integers(1, 50, 40)
        for largest in (True, False):
            want = [(max if largest else min)([v for a, b, v in zip(start, stop, value) if a <= t < b], default=0) for t in range(n)]
            assert book.interval_best(start, stop, value, n, largest).tolist() == want


BAR = "exchange string, symbol string, timestamp long, vwap double, trade_count long, buy_volume double, sell_volume double, avg_spread double, spread_std_dev double, depth_imbalance double, depth_ratio double, open_interest double, liq_long_vol double, liq_covered int, trade_open double, trade_high double"


def test_upsert(spark):
    old = spark.createDataFrame([("x", "s", 60000, 1.0, 10, 5.0, 5.0, 1.0, 0.1, 0.5, 0.5, 7.0, None, 0, 99.0, 100.0)], BAR)
    fuller = spark.createDataFrame([("x", "s", 60000, 2.0, 12, 6.0, 6.0, 0.0, 0.0, 0.0, 0.0, None, 3.0, 1, None, None)], BAR)
    r = tables.upsert_orderbook_bars(old, fuller).first()
    assert (r.vwap, r.trade_count, r.buy_volume, r.avg_spread, r.depth_ratio, r.open_interest, r.liq_long_vol, r.liq_covered, r.trade_open) == (2.0, 12, 6.0, 1.0, 0.5, 7.0, 3.0, 1, 99.0)
    thinner = spark.createDataFrame([("x", "s", 60000, 3.0, 8, 1.0, 1.0, 2.0, 0.2, 0.1, 0.2, 8.0, 4.0, 0, 1.0, 1.0), ("x", "t", 60000, 3.0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None, None, 0, None, None)], BAR)
    got = {x.symbol: x for x in tables.upsert_orderbook_bars(old, thinner).collect()}
    assert (got["s"].vwap, got["s"].trade_count, got["s"].avg_spread, got["s"].open_interest, got["s"].trade_open) == (1.0, 10, 2.0, 8.0, 99.0)
    assert got["t"].trade_count == 0


def test_partition_overwrite(spark, tmp_path):
    d = 86_400_000
    b = spark.createDataFrame([("x", "s", d + 60000, 1.0), ("x", "s", 2 * d + 60000, 2.0)], "exchange string, symbol string, timestamp long, volume double")
    path = str(tmp_path / "bars")
    tables.overwrite_partitions(b, path)
    tables.overwrite_partitions(b.where(F.col("timestamp") < 2 * d).withColumn("volume", F.lit(9.0)), path)
    assert sorted(r.volume for r in spark.read.parquet(path).collect()) == [2.0, 9.0]


def test_timeframes_and_symbols(spark):
    assert timeframe.parse("5m").ms == 300_000 and timeframe.parse("1M").ms == 2_629_746_000 and timeframe.parse("4h").label == "4 hours"
    for bad in ("", "0m", "m", "5x", "-1h", "1.5h"):
        with pytest.raises(ValueError):
            timeframe.parse(bad)
    assert timeframe.parse_or_minute("x").id == "1m"
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first().v
    assert get(S.feed_binance(F.lit("BTCBUSD"))) == "BTCB/USD:PERP"
    assert get(S.canonical_to_exchange(F.lit("btc/usdt:perp"), F.lit("binance"))) == "BTCUSDT"
    assert get(S.canonical_to_exchange(F.lit("BTC/USDT:SPOT"), F.lit("binance"))) == "BTC/USDT"
    assert get(S.exchange_to_canonical(F.lit("binance"), F.lit("BTCUSDT"))) == "BTC/USDT:SPOT" and get(S.exchange_to_canonical(F.lit("dydx"), F.lit("ETH"))) == "ETH/USDT:PERP"
    assert get(S.normalize_canonical(F.lit(" eth usdc "))) == "ETH/USDC:PERP"
