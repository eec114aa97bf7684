"""Exchange messages as JSON text, parsed to events and back; the same for batches and streams.

Event columns: type, symbol, timestamp and one of the structs trade, orderbook_update, liquidation,
funding_rate, open_interest; the others are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.functions import symbols as S
from barlake.functions.scalars import number

PAYLOADS = {
    "trade": "struct<price:double,quantity:double,side:string,is_buyer_maker:boolean,trade_count:int>",
    "orderbook_update": "struct<side:string,price:double,quantity:double>",
    "liquidation": "struct<side:string,quantity:double,price:double>",
    "funding_rate": "struct<rate:double,next_time:bigint>",
    "open_interest": "struct<value:double>",
}
EVENT = "type string, symbol string, timestamp bigint, " + ", ".join(f"{k} {v}" for k, v in PAYLOADS.items())


def _row(kind: str, symbol: Column, ts: Column, payload: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), symbol.alias("symbol"), ts.cast("long").alias("timestamp"), *[(payload.cast(t) if k == kind else F.lit(None).cast(t)).alias(k) for k, t in PAYLOADS.items()])


def _levels(symbol: Column, ts: Column, bids: Column, asks: Column, price, qty, kind: str = "array<array<string>>") -> Column:
    """A row for each level, bids first."""

    def of(levels: Column, side: str) -> Column:
        update = lambda x: F.struct(F.lit(side).alias("side"), number(price(x)).alias("price"), number(qty(x)).alias("quantity"))
        return F.transform(F.coalesce(levels, F.array().cast(kind)), lambda x: _row("orderbook_update", symbol, ts, update(x)))

    return F.concat(of(bids, "bid"), of(asks, "ask"))


_FIRST, _SECOND = (lambda x: F.get(x, F.lit(0))), (lambda x: F.get(x, F.lit(1)))


def parse_kline_json(df: DataFrame, ms: int, nested: bool = False) -> DataFrame:
    """Bars of ``value``: an array of [open time, o, h, l, c, v, …], or nested in result.list, newest first."""
    if nested:
        rows = F.from_json("value", "result struct<list:array<array<string>>>")["result"]["list"]
    else:
        rows = F.from_json("value", "array<array<string>>")
    k = df.select(F.explode(rows).alias("k"))
    at = lambda i: F.get("k", F.lit(i))
    return k.select((at(0).cast("long") + ms).alias("timestamp"), *[number(at(i)).alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)])


def parse_funding_json(df: DataFrame) -> DataFrame:
    rows = F.from_json("value", "array<struct<symbol:string,fundingRate:string,fundingTime:bigint>>")
    return df.select(F.inline(rows)).select("symbol", F.col("fundingTime").alias("time"), number(F.col("fundingRate")).alias("rate"))


def parse_observations(df: DataFrame) -> DataFrame:
    """(series_id, timestamp ms, value) of rows (series_id, value JSON); what isn't a number is left out."""
    rows = F.from_json("value", "observations array<struct<date:string,value:string>>")["observations"]
    o = df.select("series_id", F.inline(rows))
    ts = F.unix_millis(F.to_timestamp_ltz(F.concat("date", F.lit(" 00:00:00")), F.lit("yyyy-MM-dd HH:mm:ss")))
    return o.select("series_id", ts.alias("timestamp"), F.col("value").try_cast("double").alias("value")).where("value is not null and not isnan(value)")


def parse_binance(df: DataFrame) -> DataFrame:
    """Events of combined-stream messages (value), each read once. Streams it doesn't know give none; a message without
    one fails in rejects()."""
    m = df.select(F.from_json("value", "stream string, data string").alias("m")).select("m.*")
    m = m.select(F.get(F.split("stream", "@"), F.lit(1)).alias("kind"), "data")
    kind, data = F.col("kind"), F.col("data")
    at = lambda path: F.get_json_object(data, f"$.{path}")  # noqa: E731  names that differ in case only are told apart so
    t = F.from_json(data, "s string, p string, q string, f bigint, l bigint, T bigint, m boolean")
    m = m.withColumn("t", F.when(kind.startswith("aggTrade"), t)).withColumn("s", S.feed_binance(F.coalesce(F.col("t.s"), at("s"))))
    t, s = F.col("t"), F.col("s")
    count = F.greatest(t["l"] - t["f"] + 1, F.lit(1)).cast("int")
    trade = F.struct(number(t["p"]).alias("price"), number(t["q"]).alias("quantity"), F.when(t["m"], "sell").otherwise("buy").alias("side"), t["m"].alias("is_buyer_maker"), count.alias("trade_count"))
    top = lambda side, p, q: _row("orderbook_update", s, at("E"), F.struct(F.lit(side).alias("side"), number(at(p)).alias("price"), number(at(q)).alias("quantity")))
    level = lambda c: F.from_json(at(c), "array<array<string>>")
    rate = F.struct(number(at("r")).alias("rate"), at("T").cast("long").alias("next_time"))
    liq = F.struct(at("o.S").alias("side"), number(at("o.l")).alias("quantity"), number(at("o.ap")).alias("price"))
    rows = (
        F.when(kind.startswith("aggTrade"), F.array(_row("trade", s, t["T"], trade))).when(kind == "bookTicker", F.filter(F.array(top("bid", "b", "B"), top("ask", "a", "A")), lambda x: x["orderbook_update"]["quantity"] > 0))
        .when(kind.startswith("depth"), _levels(s, at("E"), level("b"), level("a"), _FIRST, _SECOND)).when(kind.startswith("markPrice"), F.array(_row("funding_rate", s, at("E"), rate)))
        .when(kind == "forceOrder", F.array(_row("liquidation", S.feed_binance(at("o.s")), at("o.T"), liq)))
    )
    return m.select(F.inline(rows))


def rejects(df: DataFrame) -> DataFrame:
    """Messages (value) that are no JSON or whose stream names no kind."""
    m = F.from_json("value", "stream string, data string")
    return df.where(m["stream"].isNull() | (F.size(F.split(m["stream"], "@")) < 2))


def parse_bybit(df: DataFrame) -> DataFrame:
    """Events of publicTrade and orderbook topics, each message read once; klines and others give none. A sell is the
    maker's buy."""
    m = df.select(F.from_json("value", "topic string, ts bigint, data string").alias("m")).select("m.*")
    topic = F.col("topic")
    m = m.withColumn("trades", F.when(topic.startswith("publicTrade."), F.from_json("data", "array<map<string,string>>")))
    m = m.withColumn("book", F.when(topic.startswith("orderbook."), F.from_json("data", "s string, b array<array<string>>, a array<array<string>>")))
    sell = lambda d: F.lower(d["S"]) == "sell"
    trade = lambda d: F.struct(number(d["p"]).alias("price"), number(d["v"]).alias("quantity"), F.when(sell(d), "sell").otherwise("buy").alias("side"), sell(d).alias("is_buyer_maker"), F.lit(1).alias("trade_count"))
    rows = F.when(F.col("trades").isNotNull(), F.transform("trades", lambda d: _row("trade", S.feed_bybit(d["s"]), d["T"], trade(d))))
    rows = rows.when(F.col("book").isNotNull(), _levels(S.feed_bybit(F.col("book.s")), F.col("ts"), F.col("book.b"), F.col("book.a"), _FIRST, _SECOND))
    return m.select(F.inline(rows))


def parse_hyperliquid(df: DataFrame) -> DataFrame:
    """Events of trades (each takes the first one's coin), bbo and l2Book (bids, then asks), each message read once;
    candles give none."""
    level = "struct<px:string,sz:string>"
    m = df.select(F.from_json("value", "channel string, data string").alias("m")).select("m.*")
    of = lambda channel, schema: F.when(F.col("channel") == channel, F.from_json("data", schema))
    m = m.withColumns({"trades": of("trades", "array<struct<coin:string,side:string,px:string,sz:string,time:bigint>>"), "bbo": of("bbo", f"coin string, time bigint, bbo array<{level}>"), "book": of("l2Book", f"coin string, time bigint, levels array<array<{level}>>")})
    sell = lambda d: F.upper(d["side"]) == "S"
    trade = lambda d: F.struct(number(d["px"]).alias("price"), number(d["sz"]).alias("quantity"), F.when(sell(d), "sell").otherwise("buy").alias("side"), sell(d).alias("is_buyer_maker"), F.lit(1).alias("trade_count"))
    first = S.feed_hyperliquid(F.get("trades", F.lit(0))["coin"])
    px, sz = (lambda x: x["px"]), (lambda x: x["sz"])
    tops = F.col("bbo.bbo")
    only = lambda i: F.filter(F.slice(tops, i, 1), lambda x: x.isNotNull())
    rows = (
        F.when(F.col("trades").isNotNull(), F.transform("trades", lambda d: _row("trade", first, d["time"], trade(d))))
        .when(F.col("bbo").isNotNull(), _levels(S.feed_hyperliquid(F.col("bbo.coin")), F.col("bbo.time"), only(1), only(2), px, sz, f"array<{level}>"))
        .when(F.col("book").isNotNull(), _levels(S.feed_hyperliquid(F.col("book.coin")), F.col("book.time"), F.get("book.levels", F.lit(0)), F.get("book.levels", F.lit(1)), px, sz, f"array<{level}>"))
    )
    return m.select(F.inline(rows))


def events_to_json(events: DataFrame) -> DataFrame:
    return events.select("symbol", F.to_json(F.struct(*[c for c in events.columns])).alias("value"))


def events_from_json(df: DataFrame) -> DataFrame:
    return df.select(F.from_json("value", EVENT).alias("e")).select("e.*")


TOPICS = {"trade": "trades", "orderbook_update": "ob", "liquidation": "liquidations", "funding_rate": "funding", "open_interest": "oi"}


def to_topics(events: DataFrame) -> DataFrame:
    """(topic, value) as a sink with topics takes them."""
    name = F.create_map(*[F.lit(x) for kv in TOPICS.items() for x in kv])[F.col("type")]
    return events.select(F.concat_ws(".", F.lit("market"), "symbol", name).alias("topic"), F.to_json(F.struct(*events.columns)).alias("value"))


def bars_to_topics(bars: DataFrame, exchange: str = "binance") -> DataFrame:
    """(topic, value) of closed minute bars; messages carry the open time."""
    row = F.struct((F.col("timestamp") - 60_000).alias("timestamp"), "open", "high", "low", "close", "volume")
    return bars.select(F.concat_ws(".", F.lit("market"), F.lit(exchange), "symbol", F.lit("bars"), F.lit("1m")).alias("topic"), F.to_json(row).alias("value"))


def publish(messages: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, mode: str = "append"):
    """Start the query that publishes (topic, value) to the table of messages at ``path``, by batch and topic, each once.

    A batch writes under its own number in place of what an attempt before a failure left there, so that a batch which
    is repeated when the query starts again publishes nothing twice; readers of a topic read only its folders."""

    def put(batch: DataFrame, n: int) -> None:
        batch.repartition("topic").write.mode("overwrite").partitionBy("topic").parquet(f"{path}/batch={n}")

    return messages.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def bars_to_response(bars: DataFrame) -> DataFrame:
    """(exchange, symbol, value): a reply per symbol with its bars in order; bounded by the request's range."""
    row = F.struct("timestamp", "open", "high", "low", "close", "volume")
    return bars.groupBy("exchange", "symbol").agg(F.to_json(F.struct(F.sort_array(F.collect_list(row)).alias("bars"))).alias("value"))
