"""Live bars with Structured Streaming: windowed parts, the stateful book, and their writer.

Each query appends partial bars to a log keyed by (exchange, symbol, timestamp, seq); the bars are the
fold of that log, so two queries never rewrite one table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from barlake.functions import scalars as X
from barlake.operators import bars as B
from barlake.operators import tables
from barlake.operators import trades as T
from barlake.operators.history import WHOLE
from barlake.operators.book import best_of_chunk, depths_of_chunk, level_runs
from barlake.scratch import new_path

WATERMARK = "1 minute"


def _timed(events: DataFrame, watermark: str) -> DataFrame:
    return events.withColumn("at", F.timestamp_millis("timestamp")).withWatermark("at", watermark)


def _close(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", F.unix_millis(F.col("w.end"))).drop("w")


def live_minute_bars(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Per (exchange, symbol, minute close): trade flow, liquidations, last interest and rate. In append mode a bar
    comes out once its minute passed the watermark; update mode gives partial bars as events come."""
    e = _timed(events, watermark)
    t, liq = F.col("trade"), F.col("liquidation")
    n, q, sell = F.greatest(F.coalesce(t["trade_count"], F.lit(1)), F.lit(1)), t["quantity"], t["is_buyer_maker"]
    has = F.col("type") == "trade"
    g = e.groupBy("exchange", "symbol", F.window("at", "1 minute").alias("w")).agg(
        F.sum(F.when(has, n).otherwise(0)).cast("long").alias("trade_count"), F.sum(F.when(has & ~sell, q).otherwise(0.0)).alias("buy_volume"), F.sum(F.when(has & sell, q).otherwise(0.0)).alias("sell_volume"),
        F.sum(F.when(has, t["price"] * q)).alias("pq"), F.sum(F.when(has, q)).alias("q"),
        F.max_by(F.col("open_interest")["value"], F.when(F.col("type") == "open_interest", F.col("timestamp"))).alias("open_interest"), F.max_by(F.col("funding_rate")["rate"], F.when(F.col("type") == "funding_rate", F.col("timestamp"))).alias("funding_rate"),
        F.sum(F.when((F.col("type") == "liquidation") & (liq["side"] == "BUY"), liq["quantity"])).alias("liq_short_vol"), F.sum(F.when((F.col("type") == "liquidation") & (liq["side"] != "BUY"), liq["quantity"])).alias("liq_long_vol"),
    )
    vwap = F.when(F.col("q") != 0, F.try_divide("pq", "q")).otherwise(0.0)
    return _close(g.withColumn("vwap", F.coalesce(vwap, F.lit(0.0))).drop("pq", "q"))


def live_price_bars(trades: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """OHLCV per minute of event time; a late trade goes to its own minute while the watermark allows."""
    t = trades.withColumn("at", F.timestamp_millis("trade_time")).withWatermark("at", watermark)
    order = F.struct("trade_time", "trade_id")
    g = t.groupBy("exchange", "symbol", F.window("at", "1 minute").alias("w")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("quantity").alias("volume"))
    return _close(g)


def live_levels(trades: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Volumes by price level and minute of a stream of trades, for append_log(); fold_levels() gives their footprint."""
    t = trades.withColumn("at", F.timestamp_millis("trade_time")).withWatermark("at", watermark).withColumn("w", F.window("at", "1 minute"))
    return _close(T.level_histogram(t, ["exchange", "symbol", "w"]))


def fold_levels(log: DataFrame) -> DataFrame:
    """The footprint of each minute of live_levels()' log: of each level its last version counts."""
    names = [c for c in log.columns if c not in (*T.KEY, "key", "seq", "batch")]
    last = log.groupBy(*T.KEY, "key").agg(F.max_by(F.struct(*names), "seq").alias("v")).select(*T.KEY, "key", "v.*")
    return T.footprint_of(last)


def fold_latest(log: DataFrame) -> DataFrame:
    """Of each key's versions in a log the last."""
    names = [c for c in log.columns if c not in (*T.KEY, "seq", "batch")]
    return log.groupBy(*T.KEY).agg(F.max_by(F.struct(*names), "seq").alias("v")).select(*T.KEY, "v.*")


def state_store(spark: SparkSession) -> None:
    """State by key and timers need the RocksDB store; another one that the caller has set stays."""
    name, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state."
    if spark.conf.get(name) == kind + "HDFSBackedStateStoreProvider":  # Spark's own
        spark.conf.set(name, kind + "RocksDBStateStoreProvider")


#: Book rows that are scanned at once; the others wait as plain numbers.
STEP = 100_000
BOOK_OUT = "symbol string, timestamp long, n long, spread_n long, spread_mean double, spread_m2 double, bid_sum double, ask_sum double"


def joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The columns of ``parts`` end to end, each part's column let go as it is copied."""
    out = []
    for i in range(len(parts[0])):
        out.append(np.concatenate([p[i] for p in parts]))
        for p in parts:
            p[i] = None
    return out


def packed(rows: Iterator[pd.DataFrame]) -> list[np.ndarray]:
    """(seq, event_time, reset, bid, level, quantity) of book rows, 34 bytes a row, each frame packed as it comes."""
    blocks, parts = [], []
    for f in rows:
        reset = (f["control"] == "depth_reset").to_numpy(bool)
        level = (np.where(reset, 0.0, f["price"].to_numpy(float)) * 10000).astype(np.int64)
        parts.append([f["seq"].to_numpy(np.int64, copy=True), f["event_time"].to_numpy(np.int64, copy=True), reset, (f["side"] == "bid").to_numpy(bool), level, f["quantity"].to_numpy(float, copy=True)])
        if sum(len(p[0]) for p in parts) >= 5 * STEP:  # large blocks go back to the system when they are let go
            blocks.append(joined(parts))
            parts = []
    return joined(blocks + parts)


class BookState(StatefulProcessor):
    """The live levels of a symbol, each a state entry of its own: a batch reads them once and writes those it changed. Its rows
    are held as numbers until they are in order, and scanned STEP at a time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "side string, level bigint", "quantity double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        old = {(int(k[0] == "bid"), k[1]): q[0] for k, q in self.levels.iterator()} if self.levels.exists() else {}
        live, cleared = dict(old), False
        seq, *columns = packed(rows)
        order = np.argsort(seq, kind="stable")
        del seq
        for lo in range(0, len(order), STEP):
            at, reset, bid, level, quantity = (c[order[lo : lo + STEP]] for c in columns)
            cleared |= bool(reset.any())
            part, live = self.step(key[0], live, at, reset, bid, level, quantity)
            if part is not None:
                yield part
        if cleared:
            self.levels.clear()
            old = {}
        for k in old.keys() - live.keys():
            self.levels.removeKey(("bid" if k[0] else "ask", k[1]))
        for k, q in live.items():
            if old.get(k) != q:
                self.levels.updateValue(("bid" if k[0] else "ask", k[1]), (q,))

    def step(self, symbol: str, live: dict, at: np.ndarray, reset: np.ndarray, bid: np.ndarray, level: np.ndarray, quantity: np.ndarray) -> tuple[pd.DataFrame | None, dict]:
        """The parts of some rows, before which the levels ``live`` hold, and the levels after them."""
        epoch = np.cumsum(reset)[~reset]
        at = at[~reset]
        held = len(live)
        bid = np.concatenate([np.array([b for b, _ in live], np.int64), bid[~reset]]).astype(np.int64)
        level = np.concatenate([np.array([v for _, v in live], np.int64), level[~reset]])
        quantity = np.concatenate([np.array(list(live.values()), float), quantity[~reset]])
        epoch = np.concatenate([np.zeros(held, np.int64), epoch]).astype(np.int64)
        order, same = level_runs(epoch, bid, level)
        now = order[np.append(~same, True)] if len(order) else order
        now = now[(epoch[now] == reset.sum()) & ~(quantity[now] == 0)]
        after = dict(zip(zip(bid[now].tolist(), level[now].tolist()), quantity[now].tolist()))
        return self.parts(symbol, at, held, epoch, bid, level, quantity) if len(at) else None, after

    def parts(self, symbol: str, at: np.ndarray, held: int, epoch: np.ndarray, bid: np.ndarray, level: np.ndarray, quantity: np.ndarray) -> pd.DataFrame:
        """Counts, depth sums and the moments of the spread per minute of the rows after the first ``held``."""
        x, y = best_of_chunk(epoch, bid, level, quantity)
        b, a = depths_of_chunk(epoch, bid, level, quantity)
        x, y, b, a = x[held:], y[held:], b[held:], a[held:]
        good = (x > 0) & (y > x)
        bps = np.where(good, (y - x) / np.where(good, x, 1.0) * 10000, np.nan)
        g = pd.DataFrame({"timestamp": (at // 60_000 + 1) * 60_000, "bps": bps, "bid": b, "ask": a}).groupby("timestamp")
        out = g.agg(n=("bid", "size"), spread_n=("bps", "count"), spread_mean=("bps", "mean"), bid_sum=("bid", "sum"), ask_sum=("ask", "sum"))
        out["spread_m2"] = g["bps"].agg(lambda v: ((v - v.mean()) ** 2).sum())
        out = out.fillna({"spread_mean": 0.0}).reset_index()
        out["symbol"] = symbol
        return out[[c.split()[0] for c in BOOK_OUT.split(", ")]]


def live_book(updates: DataFrame) -> DataFrame:
    """Partial depth sums and spread moments per (symbol, minute close) of rows (symbol, seq, event_time, control, side, price,
    quantity). A symbol's levels are state kept over minutes and restarts; a row with control ``depth_reset``
    empties them. Rows of a batch go by seq, however they are split. Parts of a minute from several batches merge."""
    state_store(updates.sparkSession)
    return updates.groupBy("symbol").transformWithStateInPandas(BookState(), BOOK_OUT, "append", "None")


def book_bars(parts: DataFrame) -> DataFrame:
    """Bars of live_book()'s parts, of which a minute has one per batch."""
    moments = F.struct(F.col("spread_n").alias("n"), F.col("spread_mean").alias("mean"), F.col("spread_m2").alias("m2"))
    g = parts.groupBy("symbol", "timestamp").agg(*[F.sum(c).alias(c) for c in ("n", "bid_sum", "ask_sum")], F.collect_list(moments).alias("parts"))
    g = g.withColumn("m", X.merged_moments(F.col("parts")))
    total = F.col("bid_sum") + F.col("ask_sum")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    std = F.when(F.col("m.n") > 1, F.sqrt(F.try_divide(F.col("m.m2"), F.col("m.n") - 1)))
    real = F.round(total, 9) > 0
    share = lambda c: z(F.when(real, F.try_divide(c, total)))
    return g.select("symbol", "timestamp", F.col("n").alias("n_samples"), F.col("m.mean").alias("avg_spread"), z(std).alias("spread_std_dev"), share(F.col("bid_sum") - F.col("ask_sum")).alias("depth_imbalance"), share(F.col("ask_sum")).alias("depth_ratio"))


def liq_coverage(bars: DataFrame, status: DataFrame) -> DataFrame:
    """``bars`` with liq_covered: 1 if the feed was connected at the close; ``status`` (ts, connected) are its changes, one
    feed's few rows. Connected spans become their minutes, so bars are joined by time, whatever their symbols."""
    last = bars.agg(F.max("timestamp").alias("last_"))
    nxt = F.lead("ts").over(Window.orderBy("ts"))
    spans = status.withColumn("until", nxt).where("connected").join(F.broadcast(last)).select(F.ceil(F.col("ts") / 60_000).cast("long").alias("a"), F.floor((F.coalesce(F.col("until"), F.col("last_") + 1) - 1) / 60_000).cast("long").alias("b"))
    minutes = spans.where("a <= b").select(F.explode(F.sequence("a", "b")).alias("m")).select((F.col("m") * 60_000).alias("timestamp"), F.lit(1).alias("liq_covered")).distinct()
    return bars.join(minutes, "timestamp", "left").select(*bars.columns, F.coalesce("liq_covered", F.lit(0)).alias("liq_covered"))


def append_log(bars: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, mode: str = "update"):
    """Start the micro-batch writer: each batch's partial bars go to the log at ``path`` under seq = batch id. A batch that
    is repeated after a failure overwrites its own part."""

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("seq", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return bars.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start()


def fold_log(log: DataFrame) -> DataFrame:
    """Bars from the log of partial ones; a late partial bar never replaces a fuller one."""
    return tables.fold_versions(log.drop("batch"))


def live_carry(bars: DataFrame) -> DataFrame:
    """fold_log()'s bars, with open interest and funding rate kept from the bar before where a minute had none, and their changes."""
    return B.funding_carry(B.oi_carry(bars))


def funding_on_change(samples: DataFrame) -> DataFrame:
    """Samples (symbol, ts, rate) of a stream whose rate differs from the symbol's one before."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        parts = list(frames)
        for r in pd.concat(parts).sort_values("ts").itertuples(index=False) if parts else []:
            if r.rate != last:
                out.append((key[0], r.ts, r.rate))
                last = r.rate
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["symbol", "ts", "rate"])

    return samples.groupBy("symbol").applyInPandasWithState(run, "symbol string, ts long, rate double", "rate double", "append", GroupStateTimeout.NoTimeout)


MINUTE = 60_000
MINUTE_OUT = (
    "exchange string, symbol string, timestamp long, late boolean, n_rows long, trade_count long, buy_volume double, sell_volume double, vwap double, liq_long_vol double, liq_short_vol double, "
    "open_interest double, open_interest_change double, funding_rate double, funding_rate_change double, depth_samples long"
)
_SUMS = ["n_rows", "trades", "buy", "sell", "pq", "q", "liq_long", "liq_short", "depths"]
_LAST = ["oi", "oi_at", "rate", "rate_at"]


class MinuteState(StatefulProcessor):
    """The open minutes of one symbol, a list that a batch reads and writes once. One timer stands at the first of them; it
    emits all that the watermark closes in order, with interest and rate kept from the minute before. Rows of minutes
    that are closed come out at once as late ones."""

    def __init__(self, slack: int) -> None:
        self.slack = slack

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.minutes = handle.getListState("open", "minute bigint, " + ", ".join(f"{c} double" for c in _SUMS + _LAST))
        self.carried = handle.getValueState("carried", "oi double, rate double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        parts, n = [], 0
        for f in rows:
            parts.append(minute_sums(f))
            n += len(parts[-1])
            if n > 2 * len(parts[0]) + STEP:  # no more than a few times the batch's minutes are held
                parts = [merged_sums(parts)]
                n = len(parts[0])
        new = merged_sums(parts)
        watermark = timerValues.getCurrentWatermarkInMs()  # 0 before any row was seen
        is_late = (new.index + 1) * MINUTE <= (watermark + self.slack if watermark else 0)
        late, new = new[is_late], new[~is_late]
        if len(new):
            old = self.held()
            if not len(old) or new.index[0] < old.index[0]:
                self.wake_for(new)
            self.hold(merged_sums([old, new]))
        yield self.frame(key, late, True, late["oi"], None, late["rate"], None)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) + self.slack
        held = self.held()
        closed = (held.index + 1) * MINUTE <= until
        ready, held = held[closed], held[~closed]
        if not len(ready):
            return
        self.hold(held)
        if len(held):
            self.wake_for(held)
        some = (ready[["trades", "depths", "liq_long", "liq_short"]] > 0).any(axis=1) | ready["oi"].notna() | ready["rate"].notna()
        x = ready[some]
        before = self.carried.get() if self.carried.exists() else (None, None)
        columns = []
        for name, last in zip(("oi", "rate"), before):
            v = pd.concat([pd.Series([last], dtype=float), x[name]]).ffill()
            columns += [v.iloc[1:], v.diff().iloc[1:]]
            last = v.iloc[-1]
            before = (*before[1:], None if pd.isna(last) else float(last))
        self.carried.update(before)
        yield self.frame(key, x, False, *columns)

    def held(self) -> pd.DataFrame:
        rows = [tuple(r) for r in self.minutes.get()] if self.minutes.exists() else []
        return pd.DataFrame(rows, columns=["minute", *_SUMS, *_LAST]).astype({"minute": "int64", **{c: "float64" for c in _SUMS + _LAST}}).set_index("minute")

    def hold(self, t: pd.DataFrame) -> None:
        self.minutes.clear()
        rows = list(zip(t.index.tolist(), *[t[c].tolist() for c in _SUMS + _LAST]))
        for lo in range(0, len(rows), 10_000):
            self.minutes.appendList(rows[lo : lo + 10_000])

    def wake_for(self, t: pd.DataFrame) -> None:
        self.handle.registerTimer((int(t.index[0]) + 1) * MINUTE - self.slack)

    @staticmethod
    def frame(key: tuple, t: pd.DataFrame, late: bool, *carried: pd.Series | None) -> pd.DataFrame:
        oi, oi_change, rate, rate_change = (np.full(len(t), np.nan) if c is None else c.to_numpy(float) for c in carried)
        q = t["q"].to_numpy()
        vwap = np.where(q != 0, t["pq"].to_numpy() / np.where(q != 0, q, 1.0), 0.0)
        values = (key[0], key[1], (t.index.to_numpy() + 1) * MINUTE, late, t["n_rows"].astype("int64"), t["trades"].astype("int64"), t["buy"], t["sell"], vwap, t["liq_long"], t["liq_short"], oi, oi_change, rate, rate_change, t["depths"].astype("int64"))
        return pd.DataFrame({c.split()[0]: v for c, v in zip(MINUTE_OUT.split(", "), values)}, index=t.index).reset_index(drop=True)


def minute_sums(f: pd.DataFrame) -> pd.DataFrame:
    """Sums of each minute of flat events, and its last interest and rate with their times; of equal times the last row's."""
    kind = f["type"]
    trade, liq = kind == "trade", kind == "liquidation"
    part = pd.DataFrame({"minute": f["timestamp"] // MINUTE, "n_rows": 1.0})
    part["trades"] = f["n"].where(trade, 0.0)
    for name, on in (("buy", trade & ~f["sell"]), ("sell", trade & f["sell"]), ("q", trade), ("liq_long", liq & f["sell"]), ("liq_short", liq & ~f["sell"])):
        part[name] = f["quantity"].where(on, 0.0)
    part["pq"] = (f["price"] * f["quantity"]).where(trade, 0.0)
    part["depths"] = (kind == "orderbook_update").astype(float)
    for name, on in (("oi", kind == "open_interest"), ("rate", kind == "funding_rate")):
        part[name] = f["value"].astype(float).where(on)
        part[f"{name}_at"] = f["timestamp"].astype(float).where(part[name].notna())
    return merged_sums([part.set_index("minute")])


def merged_sums(parts: list[pd.DataFrame]) -> pd.DataFrame:
    """Parts of minutes, which come in their order, as one row a minute, by minute."""
    t = pd.concat(parts)
    out = t.groupby(level=0)[_SUMS].sum()
    for name in ("oi", "rate"):
        known = t[[name, f"{name}_at"]].dropna().sort_values(f"{name}_at", kind="stable")
        out[[name, f"{name}_at"]] = known.groupby(level=0).last().reindex(out.index)
    return out


def ordered_minutes(events: DataFrame, lateness: int = MINUTE, watermark: int = 86_400_000) -> DataFrame:
    """Bars of each symbol's minutes in their order, by timers of event time: a minute closes ``lateness`` ms after its end, as
    the newest event of all tells. Minutes without a trade, depth sample, interest, rate or liquidation are skipped.
    Rows of closed minutes come out as partial bars with ``late`` set and n_rows saying how many they were; only those
    ``watermark`` ms behind the newest event are dropped by Spark, which counts them itself. What is open when the
    stream stops stays in its state. A symbol's open minutes are one task's; its events arrive there as flat rows."""
    state_store(events.sparkSession)
    t, liq, book = F.col("trade"), F.col("liquidation"), F.col("type")
    pick = lambda a, b: F.when(book == "trade", a).when(book == "liquidation", b)
    flat = events.select(
        "exchange", "symbol", "type", "timestamp", F.timestamp_millis("timestamp").alias("at"), F.greatest(F.coalesce(t["trade_count"], F.lit(1)), F.lit(1)).cast("double").alias("n"), F.coalesce(t["price"], F.lit(0.0)).alias("price"),
        F.coalesce(pick(t["quantity"], liq["quantity"]), F.lit(0.0)).alias("quantity"), F.coalesce(pick(t["is_buyer_maker"], liq["side"] != "BUY"), F.lit(False)).alias("sell"), F.coalesce(F.col("open_interest")["value"], F.col("funding_rate")["rate"]).alias("value"),
    )
    return flat.withWatermark("at", f"{watermark} milliseconds").groupBy("exchange", "symbol").transformWithStateInPandas(MinuteState(watermark - lateness), MINUTE_OUT, "append", "eventTime")


def late_rows(log: DataFrame) -> DataFrame:
    """(exchange, symbol, timestamp, n_late): how many rows came after their minute was closed."""
    return log.where("late").groupBy(*T.KEY).agg(F.sum("n_rows").alias("n_late"))


def whole_bars(flow: DataFrame, levels: DataFrame, parts: DataFrame, status: DataFrame, exchange: str, since: int | None = None, until: int | None = None, carried: DataFrame | None = None) -> DataFrame:
    """Whole bars (WHOLE) of the minutes that closed after ``since`` and up to ``until`` from the logs of live_minute_bars(),
    live_levels() and live_book() and the feed's changes ``status``.

    A minute is whole if any log has it, so one with depth alone is there. Liquidations are null where their feed was
    down. ``carried`` (exchange, symbol, open_interest, funding_rate) is what earlier minutes leave behind, see
    carry_of(): minutes that are closed step by step so give the same bars as all at once, and each step reads its own."""
    mine = tables.in_range(None if since is None else since + 1, None if until is None else until + 1)
    first = fold_latest(flow.where(mine)).select(*T.KEY, "trade_count", "buy_volume", "sell_volume", "vwap", "open_interest", "funding_rate", *[F.col(c).alias(c) for c in ("liq_long_vol", "liq_short_vol")])
    second = fold_levels(levels.where(mine))
    third = book_bars(parts.where(mine)).select(F.lit(exchange).alias("exchange"), "symbol", "timestamp", "avg_spread", "spread_std_dev", "depth_imbalance", "depth_ratio")
    b = liq_coverage(B.assemble(first, second, third), status)
    vol = lambda c: F.when(F.col("liq_covered") == 1, F.coalesce(c, F.lit(0.0))).alias(c)
    b = b.select(*[vol(c) if c.startswith("liq_") and c != "liq_covered" else F.col(c) for c in b.columns])
    if carried is not None:
        b = b.unionByName(carried.withColumn("timestamp", F.lit(since).cast("long")), allowMissingColumns=True)
    b = B.funding_carry(B.oi_carry(b)).select(*WHOLE)
    return b if since is None else b.where(F.col("timestamp") > since)


def carry_of(bars: DataFrame) -> DataFrame:
    """(exchange, symbol, open_interest, funding_rate) of each symbol's last bar, for the next whole_bars()."""
    return bars.groupBy("exchange", "symbol").agg(F.max_by(F.struct("open_interest", "funding_rate"), "timestamp").alias("v")).select("exchange", "symbol", "v.*")


def only_newer_bars(polls: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Bars of overlapping polls, each once."""
    t = polls.withColumn("at", F.timestamp_millis("timestamp")).withWatermark("at", watermark)
    return t.dropDuplicatesWithinWatermark(["exchange", "symbol", "timestamp"]).drop("at")


def rebuild_previous_hours(history: DataFrame, path: str, start: int, end: int) -> None:
    """Replace the bars of (start, end] in the table at ``path`` (by exchange and date) by those of ``history``; what else the
    touched days hold is written aside first and stays, and other days aren't touched."""
    spark = history.sparkSession
    mine = (F.col("timestamp") > start) & (F.col("timestamp") <= end)
    day = lambda ts: F.date_format(F.timestamp_millis(F.lit(ts - 60_000)), "yyyy-MM-dd")
    aside = new_path(spark, "aside")
    spark.read.parquet(path).where(F.col("date").cast("string").between(day(start), day(end)) & ~mine).select(*history.columns).write.parquet(aside)
    tables.overwrite_partitions(spark.read.schema(history.schema).parquet(aside).unionByName(history.where(mine)), path)


def sparse_depth(bars: DataFrame) -> DataFrame:
    """``bars`` with sparse_depth: trades but no depth sample."""
    return bars.withColumn("sparse_depth", (F.col("trade_count") > 0) & (F.coalesce("n_samples", F.lit(0)) == 0))


def empty_skipped(bars: DataFrame) -> DataFrame:
    """Bars with trades, depth, interest, rate or liquidations."""
    some = [F.coalesce(F.col(c), F.lit(0)) != 0 for c in ("trade_count", "liq_long_vol", "liq_short_vol") if c in bars.columns] + [F.col(c).isNotNull() for c in ("open_interest", "funding_rate") if c in bars.columns]
    cond = some[0]
    for s in some[1:]:
        cond = cond | s
    return bars.where(cond)


