from barlake.sources import files, messages


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_binance(spark):
    df = lines(
        spark, '{"stream":"btcusdt@aggTrade","data":{"s":"BTCUSDT","p":"100.5","q":"2","f":5,"l":9,"T":1000,"m":true}}', '{"stream":"btcusdt@bookTicker","data":{"s":"BTCUSDT","E":2000,"b":"99","B":"0","a":"101","A":"3"}}',
        '{"stream":"btcusdt@depth@100ms","data":{"s":"BTCUSDT","E":3000,"b":[["99","1"],["98","2"]],"a":[["101","4"]]}}', '{"stream":"btcusdt@markPrice@1s","data":{"s":"BTCUSDT","E":4000,"r":"0.0001","T":9000}}',
        '{"stream":"btcusdt@forceOrder","data":{"E":1,"o":{"s":"BTCUSDT","S":"SELL","l":"0.5","q":"1","ap":"99.5","T":5000}}}', '{"stream":"btcusdt@kline_1m","data":{}}', "not json",
    )
    e = {t: [r for r in messages.parse_binance(df).collect() if r.type == t] for t in ("trade", "orderbook_update", "funding_rate", "liquidation")}
    assert e["trade"][0].trade.trade_count == 5 and e["trade"][0].trade.side == "sell" and e["trade"][0].symbol == "BTC/USDT:PERP"
    assert [(r.orderbook_update.side, r.orderbook_update.price) for r in e["orderbook_update"] if r.timestamp == 3000] == [("bid", 99.0), ("bid", 98.0), ("ask", 101.0)]
    assert [(r.orderbook_update.side, r.orderbook_update.quantity) for r in e["orderbook_update"] if r.timestamp == 2000] == [("ask", 3.0)]
    assert e["funding_rate"][0].funding_rate.rate == 0.0001 and e["funding_rate"][0].funding_rate.next_time == 9000
    assert e["liquidation"][0].liquidation.quantity == 0.5 and e["liquidation"][0].timestamp == 5000
    assert messages.rejects(df).count() == 1


def test_bybit_and_hyperliquid(spark):
    b = messages.parse_bybit(lines(spark, '{"topic":"publicTrade.X","ts":1,"data":[{"s":"ETHUSDT","S":"Sell","p":"10","v":"1","T":7}]}', '{"topic":"orderbook.50.X","ts":8,"data":{"s":"ETHUSDT","b":[["9","1"]],"a":[]}}', '{"topic":"kline.1.X","ts":1,"data":[]}')).collect()
    assert sorted((r.type, r.timestamp) for r in b) == [("orderbook_update", 8), ("trade", 7)]
    h = messages.parse_hyperliquid(lines(spark, '{"channel":"trades","data":[{"coin":"BTC","side":"S","px":"1","sz":"2","time":3},{"coin":"ETH","side":"B","px":"1","sz":"2","time":4}]}', '{"channel":"l2Book","data":{"coin":"BTC","time":5,"levels":[[{"px":"1","sz":"2"}],[{"px":"3","sz":"4"}]]}}', '{"channel":"bbo","data":{"coin":"BTC","time":6,"bbo":[{"px":"1","sz":"2"},null]}}', '{"channel":"candle","data":{}}')).collect()
    assert [r.symbol for r in h if r.type == "trade"] == ["BTC/USDC:PERP"] * 2
    assert [(r.timestamp, r.orderbook_update.side) for r in h if r.type == "orderbook_update"] == [(5, "bid"), (5, "ask"), (6, "bid")]  # in the order of the messages


def test_klines_and_observations(spark):
    k = messages.parse_kline_json(lines(spark, '[[0,"1","3","0.5","2","7","x"]]'), 60000).first()
    assert (k["timestamp"], k.open, k.volume) == (60000, 1.0, 7.0)
    n = messages.parse_kline_json(lines(spark, '{"result":{"list":[["60000","1","3","0.5","2","7"]]}}'), 60000, nested=True).first()
    assert n["timestamp"] == 120000
    o = spark.createDataFrame([("S", '{"observations":[{"date":"2024-01-01","value":"1.5"},{"date":"2024-01-02","value":"."}]}')], "series_id string, value string")
    assert [(r["timestamp"], r.value) for r in messages.parse_observations(o).collect()] == [(1_704_067_200_000, 1.5)]
    csv = files.parse_kline_lines(lines(spark, "open_time,o,h,l,c,v", "", "1,2", "0,1,2,0.5,1.5,9,x")).collect()
    assert [(r["timestamp"], r.volume) for r in csv] == [(60000, 9.0)]


def test_read_files(spark, tmp_path):
    p = str(tmp_path / "binance/2024-01-01/05/BTCUSDT_trades.parquet")
    spark.createDataFrame([(1, "2.5", "x")], "trade_time long, price string, odd string").coalesce(1).write.parquet(p)
    r = files.read_trades(spark, p).first()
    assert (r.trade_time, r.price, r.quantity, r.is_buyer_maker) == (1, 2.5, 0.0, False)
    q = str(tmp_path / "book")
    spark.createDataFrame([(1, "", 100.0, 1.0, "b", 5, 0), (1, "update", 99.0, 1.0, "sell", 5, 4), (2, "update", 1.0, 1.0, "1", 4, 3)], "event_time long, event_type string, price double, quantity double, side string, final_update_id long, prev_final_update_id long").coalesce(1).write.parquet(q)
    b = files.read_book(spark, q).orderBy("row_index").collect()
    assert [(r.grp, r.side, r.event_type, r.back) for r in b] == [(1, "bid", "snapshot", False), (1, "ask", "depthUpdate", False), (2, "bid", "depthUpdate", True)]
