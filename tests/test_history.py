"""Histories, hydration, changes of stored bars and publishing on small tables."""

import os

import pytest
from pyspark.sql import functions as F

from barlake.operators import bars, history, joins, tables
from barlake.sources import files, messages

M, H, DAY = 60_000, 3_600_000, 86_400_000
BASE = 1_704_067_200_000
PRICE = "exchange string, symbol string, timestamp long, open double, high double, low double, close double, volume double"


def price(spark, minutes, symbol="X", volume=1.0):
    return spark.createDataFrame([("x", symbol, BASE + m * M, 1.0, 1.0, 1.0, 1.0, volume) for m in minutes], PRICE)


def minutes_of(df):
    return sorted(((r["timestamp"] - BASE) // M, r.volume) for r in df.collect())


def test_history_of_minutes(spark):
    raw = price(spark, range(1, 2000), volume=2.0)
    nearly = price(spark, [m for m in range(1, 1001) if m != 500])
    got = minutes_of(history.get_history(nearly, "x", "x", "1m", BASE, BASE + 1000 * M, raw=raw))
    assert len(got) == 999 and all(v == 1.0 for _, v in got)  # complete enough: stored bars alone
    day = 1440
    stored = price(spark, [day + 5, 3 * day + 7])
    got = minutes_of(history.get_history(stored, "x", "x", "1m", BASE, BASE + 4 * DAY, raw=price(spark, range(1, 5 * day), volume=2.0)))
    own = [m for m, v in got if v == 1.0]
    # days 0 and 2 are missing; the day that ends an island is filled with it
    assert own == [day + 5, 3 * day + 7] and {m for m, v in got if v == 2.0} == set(range(1, 4 * day + 1)) - set(own)
    assert minutes_of(history.get_history(stored, "x", "x", "1m", BASE, BASE + 10 * M, raw=price(spark, [3], volume=2.0), overwrite=True)) == [(3, 2.0)]
    assert minutes_of(history.get_history(price(spark, []), "x", "x", "1m", BASE, BASE + 10 * M, raw=price(spark, [3], volume=2.0))) == [(3, 2.0)]


def test_history_reads_the_folders_of_its_gaps(spark, tmp_path):
    path = str(tmp_path / "raw")
    tables.overwrite_partitions(price(spark, [d * 1440 + 3 for d in range(30)], volume=2.0), path)
    raw = spark.read.parquet(path).withColumn("date", F.col("date").cast("string"))
    stored = price(spark, [d * 1440 + 5 for d in range(30) if d not in (11, 12)])
    q = history.of_missing_days(raw.where(F.col("timestamp") < BASE + 30 * DAY), stored, "x", "x", BASE, BASE + 30 * DAY)
    assert sorted((t - BASE) // DAY for (t,) in q.select("timestamp").collect()) == [11, 12, 13]
    plan = q._jdf.queryExecution().executedPlan()
    q.count()
    q.write.format("noop").mode("overwrite").save()
    text = q._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in text.lower(), plan


def test_mutations_of_one_symbol(spark):
    both = price(spark, range(10)).unionByName(price(spark, range(10), "Y"))
    left = tables.delete_range(both, "x", "X", BASE + 2 * M, BASE + 5 * M)
    assert [left.where(F.col("symbol") == s).count() for s in ("X", "Y")] == [7, 10]
    assert tables.deleted_count(both, "x", "Y", None, BASE + 4 * M).first().deleted == 4
    liq = both.select("exchange", "symbol", "timestamp", F.lit(1.0).alias("liq_long_vol"), F.lit(1.0).alias("liq_short_vol"), F.lit(1).alias("liq_covered"))
    out = tables.set_liq_unknown(liq, "x", "X", BASE, BASE + 3 * M)
    assert sorted((r.symbol, (r["timestamp"] - BASE) // M) for r in out.where("liq_covered = 0 and liq_long_vol is null").collect()) == [("X", 0), ("X", 1), ("X", 2)]


def test_backfills_set_changes(spark):
    rows = [("x", "X", BASE + m * M, r, c) for m, (r, c) in enumerate([(0.5, 0.1), (None, 0.3), (None, None), (0.7, None), (None, None)])]
    b = spark.createDataFrame(rows, "exchange string, symbol string, timestamp long, funding_rate double, funding_rate_change double")
    points = spark.createDataFrame([("X", BASE, 1.0), ("X", BASE + 2 * M, 4.0)], "symbol string, time long, rate double")
    got = joins.backfill_funding(b, points, BASE, BASE + 9 * M).orderBy("timestamp").collect()
    assert [(r.funding_rate, r.funding_rate_change) for r in got] == [(0.5, 0.1), (1.0, None), (4.0, 3.0), (0.7, None), (4.0, 0.0)]
    rows = [("x", "X", BASE + m * M, v, c) for m, (v, c) in enumerate([(1.0, None), (5.0, 2.0), (4.0, None), (None, None), (9.0, None)])]
    b = spark.createDataFrame(rows, "exchange string, symbol string, timestamp long, open_interest double, open_interest_change double")
    got = tables.backfill_oi_change(b, BASE, BASE + 9 * M).orderBy("timestamp").collect()
    assert [r.open_interest_change for r in got] == [None, 2.0, 3.0, None, 5.0]


def test_change_feed_keeps_rollups(spark):
    now, hours = price(spark, range(1, 200, 3)), None
    hours = bars.resample_ohlcv(now, H)
    for k, new in enumerate([price(spark, range(1, 130, 2), volume=5.0), price(spark, [], volume=1.0), price(spark, [500, 1], volume=5.0)]):
        feed = tables.upsert_feed(now, new, lambda old, x: tables.replace_rows(old, x, bars.KEY))
        kinds = {r.kind: r.n for r in feed.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        assert kinds == [{"insert": 43, "update": 22}, {}, {"insert": 1}][k]
        now = tables.apply_feed(now, feed).cache()
        hours = tables.refresh_rollup(hours, now, feed, H)
    assert sorted(map(tuple, hours.collect())) == sorted(map(tuple, bars.resample_ohlcv(now, H).collect()))


def test_publishing_twice_leaves_one(spark, tmp_path):
    src, path, chk = (str(tmp_path / x) for x in ("src", "topics", "chk"))
    price(spark, [1, 2]).write.parquet(src)

    def run():
        stream = spark.readStream.schema(PRICE).parquet(src)
        messages.publish(messages.bars_to_topics(stream), path, chk, {"availableNow": True}).awaitTermination()

    run()
    price(spark, [3], "Y").write.mode("append").parquet(src)
    run()
    for name in ("1", ".1.crc"):  # the second batch isn't known to be done, and is repeated
        os.remove(f"{chk}/commits/{name}")
    run()
    got = sorted((r.topic, r.value) for r in spark.read.parquet(path).collect())
    assert [t for t, _ in got] == ["market.binance.X.bars.1m"] * 2 + ["market.binance.Y.bars.1m"]
    assert f'"timestamp":{BASE + 2 * M}' in got[2][1]


def test_hydration_of_files(spark, tmp_path):
    root = str(tmp_path / "market")
    key = "exchange string, symbol string, "
    hour = lambda h: BASE + h * H
    tr = [("x", "X", hour(h) + 1000, 10.0 + h, 2.0, False) for h in (0, 1, 3)] + [("x", "Y", hour(0) + 1000, 5.0, 1.0, True)]
    files.write_hours(spark.createDataFrame(tr, key + "trade_time long, price double, quantity double, is_buyer_maker boolean"), root, "trades", "trade_time")
    oi = [("x", "X", hour(0) + 5, 0.0, 70.0), ("x", "X", hour(2) + 5, 90.0, 0.0), ("x", "X", hour(3) + 5, 80.0, 0.0)]
    files.write_hours(spark.createDataFrame(oi, key + "timestamp long, sum_open_interest double, sum_open_interest_value double"), root, "open_interest", "timestamp")
    liq = [("x", "X", hour(0) + 61_000, hour(0) + 61_000, 3.0, "BUY"), ("x", "X", hour(1) + 1, hour(9), 4.0, "SELL")]  # the second is of another hour than its file
    files.write_hours(spark.createDataFrame(liq, key + "at long, trade_time long, last_filled_quantity double, side string"), root, "liquidations", "at")
    bk = [("x", "X", hour(h) + 2000 + i, "snapshot" if h == 0 else "depthUpdate", p, 5.0, s, 1 + h, h) for h in (0, 1, 3) for i, (p, s) in enumerate([(99.0 - h, "bid"), (101.0 + h, "ask")])]
    files.write_hours(spark.createDataFrame(bk, key + "event_time long, event_type string, price double, quantity double, side string, final_update_id long, prev_final_update_id long"), root, "orderbook", "event_time")
    assert files.list_hours(spark, root).groupBy("type").count().orderBy("type").collect() == [("liquidations", 2), ("open_interest", 3), ("orderbook", 3), ("trades", 4)]
    funding = spark.createDataFrame([("X", hour(0) - 1, 0.1), ("X", hour(1), 0.3)], "symbol string, time long, rate double")
    got = {(r.symbol, (r["timestamp"] - BASE) // M): r for r in history.hydrate_files(spark, root, funding).collect()}
    assert set(got) == {("X", 1), ("X", 2), ("X", 61), ("X", 181), ("Y", 1)}  # hour 2 has no trades and is left out
    r = got["X", 1]
    assert (r.trade_count, r.open_interest, r.liq_long_vol, r.liq_covered, r.funding_rate) == (1, 70.0, 0.0, 1, 0.1) and r.avg_spread == pytest.approx(2 / 99 * 1e4)
    assert (got["X", 2].trade_count, got["X", 2].liq_short_vol, got["X", 2].open_interest_change) == (0, 3.0, 0.0)
    assert (got["X", 61].liq_long_vol, got["X", 61].liq_covered, got["X", 61].funding_rate_change) == (0.0, 1, pytest.approx(0.2))  # a file without rows of its hour: zeros
    assert got["X", 61].depth_ratio == pytest.approx(7.5 / 17.5) and got["X", 61].avg_spread == pytest.approx(2 / 99 * 1e4)  # the book is carried over the hour
    assert (got["X", 181].liq_long_vol, got["X", 181].liq_covered, got["X", 181].open_interest_change) == (None, 0, 10.0)
    assert (got["Y", 1].liq_covered, got["Y", 1].open_interest, got["Y", 1].avg_spread) == (0, None, 0.0)
    assert len(history.WHOLE) == 33


def test_hour_files_are_single_files_of_their_rows(spark, tmp_path):
    """A file for each hour and symbol, under the names that Spark's folders have, however few bytes there are; as many rows as by Spark's writer."""
    rows = [("x", s, BASE + h * H + i * M, 1.0, float(i), i % 2 == 0) for h in range(30) for s in ("A", "B:C") for i in range(7)]
    df = spark.createDataFrame(rows, "exchange string, symbol string, trade_time long, price double, quantity double, is_buyer_maker boolean")
    root, other = str(tmp_path / "direct"), str(tmp_path / "spark")
    files.write_hours(df, "file:" + root, "trades", "trade_time")
    found = [os.path.join(d, n) for d, _, names in os.walk(root) for n in names]
    assert len(found) == 60 and all(f.endswith("_trades.parquet") for f in found) and f"{root}/x/2024-01-02/05/B%3AC_trades.parquet" in found
    t = F.timestamp_millis("trade_time")
    files.write_hour_folders(df.withColumns({"date": F.date_format(t, "yyyy-MM-dd"), "hour": F.date_format(t, "HH")}).repartition(1), other, "trades")
    every = lambda d: sorted(map(tuple, files.read_hours(spark, d, "trades").drop("row").collect()))
    assert len(every(root)) == len(rows) and every(root) == every(other)
    assert files.list_hours(spark, root).count() == files.list_hours(spark, other).count() == 60
    one = files.read_hours(spark, root, "trades").where(F.col("symbol") == "A").orderBy("row").collect()
    assert [r.trade_time for r in one] == sorted(r[2] for r in rows if r[1] == "A")


def test_paths_are_parsed_once_for_their_files():
    p = ["file:///r/x/2024-01-02/05/B%253AC_trades.parquet", "file:///r/x/2024-01-02/5/A_orderbook.parquet/part-0.parquet", "file:///r/other.parquet"]
    got = files.hours_of_paths(files.pd.Series([*p, p[0]]))
    hour = BASE + DAY + 5 * H
    assert got.hour.tolist()[:2] == [hour, hour] and got.hour.isna().tolist() == [False, False, True, False]
    assert got.symbol.tolist() == ["B%253AC", "A", None, "B%253AC"] and got.exchange.tolist() == ["x", "x", None, "x"]
