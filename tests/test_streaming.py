import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlake.operators import trades
from barlake.streaming import live

EVENT = "exchange string, type string, symbol string, timestamp long, trade struct<price:double,quantity:double,side:string,is_buyer_maker:boolean,trade_count:int>, liquidation struct<side:string,quantity:double,price:double>, funding_rate struct<rate:double,next_time:bigint>, open_interest struct<value:double>"


def test_live_bars_equal_batch(spark, tmp_path):
    rows = [("x", "trade", "s", 1000 * i, (100.0 + i % 7, 1.0 + i % 3, "buy", i % 2 == 0, 1), None, None, None) for i in range(400)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, EVENT).repartition(4).write.json(src)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 2).json(src)
    log, chk = str(tmp_path / "log"), str(tmp_path / "chk")
    bars = live.live_minute_bars(stream, "10 minutes").select("exchange", "symbol", "timestamp", "vwap", "trade_count", "buy_volume", "sell_volume", *[F.lit(0.0).alias(c) for c in ("avg_spread", "spread_std_dev", "depth_imbalance", "depth_ratio")])
    live.append_log(bars, log, chk, {"availableNow": True}).awaitTermination()
    got = {r["timestamp"]: (r.trade_count, round(r.vwap, 9), r.buy_volume) for r in live.fold_log(spark.read.parquet(log)).collect()}
    t = spark.createDataFrame(rows, EVENT).select("exchange", "symbol", F.col("timestamp").alias("trade_time"), "trade.*")
    want = {r["timestamp"]: (r.trade_count, round(r.vwap, 9), r.buy_volume) for r in trades.trade_flow(t).collect()}
    assert got == want


BOOK = "symbol string, seq long, event_time long, control string, side string, price double, quantity double"


def in_batches(spark, tmp_path, batches, schema, of):
    """Rows that ``of`` makes of batches which come one by one, the query starting anew for each."""
    src, out, chk = (str(tmp_path / x) for x in ("src", "out", "chk"))
    for rows in batches:
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").json(src)
        stream = of(spark.readStream.schema(schema).json(src))
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", chk).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def test_live_book_equals_a_plain_one(spark, tmp_path):
    rnd = random.Random(5)
    rows, levels, want = [], {}, {}
    for i in range(300):
        if i in (60, 61, 200):
            rows.append(("s", i, 400 * i, "depth_reset", None, None, None))
            levels = {}
            continue
        side, qty = rnd.choice(["bid", "ask"]), float(rnd.choice([0, 1, 2, 5]))
        price = float(rnd.randint(90, 99) if side == "bid" else rnd.randint(99, 110))
        levels[side, price] = qty
        rows.append(("s", i, 400 * i, None, side, price, qty))
        live_ = lambda s: [(p, q) for (x, p), q in levels.items() if x == s and q]
        bid, ask = max((p for p, _ in live_("bid")), default=0), min((p for p, _ in live_("ask")), default=0)
        m = want.setdefault((400 * i // 60_000 + 1) * 60_000, [[], [], []])
        m[0] += [(ask - bid) / bid * 10000] if bid > 0 and ask > bid else []
        m[1].append(sum(q for _, q in live_("bid")))
        m[2].append(sum(q for _, q in live_("ask")))
    parts = in_batches(spark, tmp_path, [rows[:40], rows[40:130], rows[130:]], BOOK, live.live_book)
    got = {r["timestamp"]: r for r in live.book_bars(parts).collect()}
    assert got.keys() == want.keys()
    for m, (bps, bids, asks) in want.items():
        r, b, a = got[m], statistics.mean(bids), statistics.mean(asks)
        assert r.n_samples == len(bids) and (r.depth_imbalance, r.depth_ratio) == (pytest.approx((b - a) / (b + a)), pytest.approx(a / (b + a)))
        assert (r.avg_spread, r.spread_std_dev) == (pytest.approx(statistics.mean(bps)), pytest.approx(statistics.stdev(bps)))


def test_moments_dont_cancel(spark):
    """Mean 10^4 and deviation 10^-4, in parts: squares of 10^8 would leave nothing of 10^-8."""
    x = 1e4 + 1e-4 * np.random.default_rng(1).standard_normal(3000)
    parts = [("s", 60_000, len(v), len(v), float(v.mean()), float(((v - v.mean()) ** 2).sum()), 1.0, 1.0) for v in np.split(x, [10, 11, 1500])] + [("s", 60_000, 4, 0, 0.0, 0.0, 1.0, 1.0)]
    r = live.book_bars(spark.createDataFrame(parts, live.BOOK_OUT)).first()
    assert r.n_samples == 3004 and r.avg_spread == pytest.approx(x.mean(), abs=1e-9) and r.spread_std_dev == pytest.approx(x.std(ddof=1), rel=1e-6)


def _event(kind, symbol, ts, **x):
    names = ("trade", "liquidation", "funding_rate", "open_interest")
    return ("x", kind, symbol, ts, *[x.get(n) for n in names])


def test_minutes_close_in_order_and_late_rows_count(spark, tmp_path):
    minute, base = 60_000, 1_704_067_200_000
    event = lambda kind, symbol, ts, **x: _event(kind, symbol, base + ts, **x)
    trade = lambda ts, s="s": event("trade", s, ts, trade=(10.0, 2.0, "buy", False, 1))
    one = [trade(5000), trade(6000), event("orderbook_update", "s", 2 * minute + 5), event("open_interest", "s", minute + 5, open_interest=(7.0,)), event("liquidation", "s", 3 * minute + 5, liquidation=("BUY", 0.0, 1.0)), trade(5 * minute), trade(5 * minute, "other")]
    two = [trade(7000), trade(8000), trade(5 * minute + 1), trade(5 * minute + 2, "other"), event("open_interest", "s", 5 * minute + 9, open_interest=(9.0,)), trade(20 * minute, "other")]
    out = in_batches(spark, tmp_path, [one, two], EVENT, live.ordered_minutes)
    rows = out.orderBy("symbol", "timestamp", "late").collect()
    got = [(r.symbol, (r["timestamp"] - base) // minute, r.late, r.n_rows, r.trade_count, r.open_interest, r.open_interest_change, r.depth_samples) for r in rows]
    # minute 4 has a liquidation of nothing and is skipped, minute 3 depth alone; two rows come 4 minutes late
    assert got == [("other", 6, False, 2, 2, None, None, 0), ("s", 1, False, 2, 2, None, None, 0), ("s", 1, True, 2, 2, None, None, 0), ("s", 2, False, 1, 0, 7.0, None, 0), ("s", 3, False, 1, 0, 7.0, 0.0, 1), ("s", 6, False, 3, 2, 9.0, 2.0, 0)]
    assert [tuple(r) for r in live.late_rows(out).collect()] == [("x", "s", base + minute, 2)]


class Handle:
    """A state handle that counts what is read and written."""

    def __init__(self):
        self.calls, self.timers = 0, []

    def getListState(self, name, schema):
        return State(self, [])

    def getValueState(self, name, schema):
        return State(self, None)

    def registerTimer(self, at):
        self.timers.append(at)


class State:
    def __init__(self, handle, value):
        self.handle, self.value = handle, value

    def exists(self):
        return bool(self.value)

    def get(self):
        self.handle.calls += 1
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = []

    def appendList(self, rows):
        self.handle.calls += 1
        self.value = self.value + rows


class Timers:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_minutes_of_a_long_batch_close_by_one_timer():
    n, minute = 5000, 60_000
    f = pd.DataFrame({"type": "open_interest", "timestamp": np.arange(n) * minute + minute, "n": 1.0, "price": 0.0, "quantity": 0.0, "sell": False, "value": np.arange(n, dtype=float) ** 2})
    s, h = live.MinuteState(0), Handle()
    s.init(h)
    assert sum(len(x) for x in s.handleInputRows(("x", "s"), iter([f[2500:], f[:2500]]), Timers(0))) == 0
    assert h.timers == [2 * minute]
    out = pd.concat(s.handleExpiredTimer(("x", "s"), Timers((n - 10) * minute), Timers(2 * minute)))
    assert len(out) == n - 11 and out["open_interest_change"].iloc[1:].tolist() == [2.0 * i - 1 for i in range(1, n - 11)]
    assert h.timers == [2 * minute, (n - 9) * minute] and h.calls < 10
    out = pd.concat(s.handleExpiredTimer(("x", "s"), Timers(2 * n * minute), Timers((n - 9) * minute)))
    assert len(out) == 11 and out["open_interest_change"].iloc[0] == 2.0 * (n - 11) - 1


def test_book_rows_are_packed_and_scanned_by_steps(spark):
    n = 4000
    side = ["bid" if i % 2 else "ask" for i in range(n)]
    f = pd.DataFrame({"seq": np.arange(n), "event_time": np.arange(n) * 500, "control": [None if i % 900 != 5 else "depth_reset" for i in range(n)], "side": side, "price": [95.0 + (7 * i) % 4 if i % 2 else 101.0 + (5 * i) % 6 for i in range(n)], "quantity": [float(i % 5) for i in range(n)]})
    assert sum(c.itemsize for c in live.packed(iter([f]))) <= 40

    def bars(step):
        left, out = {}, []
        _, *columns = live.packed(iter([f[:1500], f[1500:]]))
        for at in range(0, n, step):
            part, left = live.BookState().step("s", left, *[c[at : at + step] for c in columns])
            out.append(part)
        return live.book_bars(spark.createDataFrame(pd.concat(out), live.BOOK_OUT)).orderBy("timestamp").collect()

    once, steps = bars(n), bars(170)
    assert len(once) == len(steps) > 30
    for a, b in zip(once, steps):
        assert tuple(a) == pytest.approx(tuple(b))


def test_whole_bars_step_by_step(spark):
    key = "exchange string, symbol string, timestamp long"
    m = 60_000
    flow = spark.createDataFrame([("x", "s", m, 2, 1.0, 1.0, 10.0, 5.0, None, 0.0, 0.0, 0), ("x", "s", m, 3, 2.0, 1.0, 10.5, 6.0, 0.1, 1.0, 0.0, 1), ("x", "s", 3 * m, 1, 1.0, 0.0, 11.0, None, None, 4.0, 5.0, 1), ("x", "s", 4 * m, 1, 1.0, 0.0, 11.0, 8.0, 0.3, 4.0, 5.0, 2)], f"{key}, trade_count long, buy_volume double, sell_volume double, vwap double, open_interest double, funding_rate double, liq_long_vol double, liq_short_vol double, seq long")
    tr = spark.createDataFrame([("x", "s", t, 10.0 + i, 1.0, i % 2 == 0, i) for i, t in enumerate([1000, 2000, 121_000])], "exchange string, symbol string, trade_time long, price double, quantity double, is_buyer_maker boolean, trade_id long")
    levels = trades.level_histogram(tr).withColumn("seq", F.lit(0))
    parts = spark.createDataFrame([("s", 2 * m, 3, 2, 4.0, 2.0, 9.0, 3.0), ("s", 2 * m, 1, 1, 7.0, 0.0, 3.0, 1.0)], live.BOOK_OUT)
    status = spark.createDataFrame([(1000, True), (3 * m + 1, False)], "ts long, connected boolean")
    whole = live.whole_bars(flow, levels, parts, status, "x")
    assert whole.columns == live.WHOLE and len(live.WHOLE) == 33
    want = [tuple(r) for r in whole.orderBy("timestamp").collect()]
    r = whole.where(F.col("timestamp") == 2 * m).first()  # depth alone
    assert (r.trade_count, r.trade_open, r.open_interest, r.open_interest_change, r.liq_long_vol, r.liq_covered) == (0, None, 6.0, 0.0, 0.0, 1) and (r.avg_spread, r.spread_std_dev) == (5.0, pytest.approx(2.0))
    r = whole.where(F.col("timestamp") == 4 * m).first()
    assert (r.liq_long_vol, r.liq_covered, r.open_interest_change, r.funding_rate_change) == (None, 0, 2.0, pytest.approx(0.2))
    carried, got = None, []
    for since, until in ((0, m), (m, 3 * m), (3 * m, 9 * m)):
        step = live.whole_bars(flow, levels, parts, status, "x", since, until, carried).cache()
        got += [tuple(r) for r in step.orderBy("timestamp").collect()]
        carried = live.carry_of(step)
    assert got == want


def test_funding_on_change(spark, tmp_path):
    schema = "symbol string, ts long, rate double"
    got = in_batches(spark, tmp_path, [[("s", 2, 0.1), ("s", 1, 0.1)], [("s", 3, 0.2)]], schema, live.funding_on_change)
    assert sorted(r.ts for r in got.collect()) == [1, 3]


def test_live_carry(spark):
    rows = [("x", "s", 60000, None, 0.1), ("x", "s", 120000, 5.0, None), ("x", "s", 180000, None, None), ("x", "s", 240000, 7.0, 0.2), ("x", "t", 240000, None, None)]
    got = live.live_carry(spark.createDataFrame(rows, "exchange string, symbol string, timestamp long, open_interest double, funding_rate double")).collect()
    assert sorted((r.symbol, r.timestamp, r.open_interest, r.funding_rate) for r in got if r.symbol == "s") == [("s", 60000, None, 0.1), ("s", 120000, 5.0, 0.1), ("s", 180000, 5.0, 0.1), ("s", 240000, 7.0, 0.2)]
    assert [(r.open_interest, r.funding_rate) for r in got if r.symbol == "t"] == [(None, None)]
