"""Order-book replay: continuity, depth, best prices and their minute statistics.

Book rows have symbol, seq (replay order), event_time, event_type, side, price, quantity (the level's new
total), final_update_id and prev_final_update_id.

A symbol's rows are scanned in two levels: in chunks of CHUNK numbers of seq side by side, and over one row of totals per
chunk, which says what each chunk starts with: the ids before it, the epoch that is open and its live levels. So no
task sorts a whole symbol, and one that holds all rows spreads over all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions import scalars as X
from barlake.scratch import spool

#: Numbers of seq that a task scans at once.
CHUNK = 20_000
PART = ["symbol", "chunk_"]


def _in_order():
    """The chunks of a symbol before this one, over a table with a row per chunk."""
    return Window.partitionBy("symbol").orderBy("chunk_").rowsBetween(Window.unboundedPreceding, -1)


def _with_ids_before(book: DataFrame, chunk: int) -> DataFrame:
    """``book`` with snap, its chunk, and the ids of the update and the snapshot last seen before the chunk (null for none)."""
    b = book.withColumn("chunk_", F.floor(F.col("seq") / chunk).cast("long")).withColumn("snap", F.coalesce(F.col("event_type") == "snapshot", F.lit(False)))
    ends = b.groupBy(*PART).agg(F.max_by("final_update_id", "seq").alias("id_"), F.max_by("final_update_id", F.when(F.col("snap"), F.col("seq"))).alias("snap_"))
    before = ends.select(*PART, F.last("id_").over(_in_order()).alias("id_before_"), F.last("snap_", True).over(_in_order()).alias("snap_before_"), (F.count("*").over(_in_order())).alias("nth_"))
    return b.join(before, PART)


def _id_before():
    """The final id of the row before, in whichever chunk it lies."""
    w = Window.partitionBy(*PART).orderBy("seq")
    return F.coalesce(F.lag(F.struct(F.col("final_update_id").alias("id_before_"))).over(w), F.struct("id_before_"))["id_before_"]


def _with_resets(book: DataFrame, chunk: int) -> DataFrame:
    """_with_ids_before() with reset and local_, the resets of the chunk so far."""
    w = Window.partitionBy(*PART).orderBy("seq")
    b = _with_ids_before(book, chunk).withColumn("pf_", F.coalesce(_id_before(), F.lit(0)))
    last_snap = F.coalesce(F.last(F.when(F.col("snap"), F.col("final_update_id")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("snap_before_"), F.lit(0))
    gap = ~F.col("snap") & (F.col("pf_") != 0) & (F.col("final_update_id") != F.col("pf_")) & (F.col("prev_final_update_id") != F.col("pf_"))
    b = b.withColumn("reset", F.coalesce((F.col("snap") & (F.col("final_update_id") != last_snap)) | gap, F.lit(False)))
    return b.withColumn("local_", F.sum(F.col("reset").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("pf_", "id_before_", "snap_before_")


def _starts(book: DataFrame, chunk: int) -> DataFrame:
    """(symbol, chunk_, nth_, open_): of each chunk its number among the symbol's and the epoch that is open before it; a
    written table, a row for each chunk."""
    n = _with_resets(book, chunk).groupBy(*PART, "nth_").agg(F.sum(F.col("reset").cast("int")).alias("n_"))
    return spool(n.select(*PART, "nth_", F.coalesce(F.sum("n_").over(_in_order()), F.lit(0)).alias("open_")), "chunks")


def _in_epochs(book: DataFrame, starts: DataFrame, chunk: int) -> DataFrame:
    b = _with_resets(book, chunk).join(starts.drop("nth_"), PART)
    return b.withColumn("epoch", F.col("open_") + F.col("local_")).drop("open_")


def continuity(book: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``book`` with snap, reset and epoch: a gap of update ids or a new snapshot begins an epoch with an empty book."""
    return _in_epochs(book, _starts(book, chunk), chunk).drop("chunk_", "nth_", "local_")


def _with_carried(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """``rows`` of _in_epochs() with level, and before each chunk's own ones a row without seq for each live level of the epoch
    that is open there.

    A level's last quantity in a chunk holds in the chunks after it, up to the one that sets it next or the epoch's last."""
    rows = rows.withColumn("level", X.snap_price(F.col("price")))
    level = ["symbol", "epoch", "side", "level"]
    last = rows.groupBy(*level, "nth_").agg(F.max_by("quantity", "seq").alias("quantity"))
    until = starts.groupBy("symbol", F.col("open_").alias("epoch")).agg(F.max("nth_").alias("until_"))
    nxt = F.lead("nth_").over(Window.partitionBy(*level).orderBy("nth_"))
    held = last.withColumn("next_", nxt).where("quantity <> 0 or quantity is null").join(until, ["symbol", "epoch"]).withColumn("next_", F.coalesce("next_", "until_")).where("next_ > nth_")
    carried = held.select(*level, "quantity", F.explode(F.sequence(F.col("nth_") + 1, F.col("next_"))).alias("nth_"), F.lit(0).cast("long").alias("local_"))
    return rows.unionByName(carried, allowMissingColumns=True)


def _with_depths(rows: DataFrame) -> DataFrame:
    """_with_carried() with both depths and ripe_: a snapshot, or both depths of at least 100, so far in the chunk and epoch."""
    at = Window.partitionBy("symbol", "nth_", "epoch", "side", "level").orderBy("seq")
    b = rows.withColumn("delta_", F.col("quantity") - F.lag("quantity", 1, 0.0).over(at))
    run = Window.partitionBy("symbol", "nth_", "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    for side in ("bid", "ask"):
        b = b.withColumn(f"{side}_depth", F.sum(F.when(F.col("side") == side, F.col("delta_")).otherwise(0.0)).over(run))
    ripe = F.col("seq").isNotNull() & (F.col("snap") | ((F.round("bid_depth", 9) >= 100) & (F.round("ask_depth", 9) >= 100)))
    return b.withColumn("ripe_", F.coalesce(F.max(ripe).over(run), F.lit(False))).drop("delta_")


def _replayed(book: DataFrame, chunk: int) -> DataFrame:
    """``book`` with level, both depths, ripe_, and the carried levels, which have no seq."""
    starts = _starts(book, chunk)
    return _with_depths(_with_carried(_in_epochs(book, starts, chunk), starts))


def depth(book: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """continuity() with level, bid_depth and ask_depth after each row, and warm: the epoch had a snapshot or both depths reached 100.

    Whether an earlier chunk was warm is told by a second look at the rows, which are written to the shared folder once."""
    b = spool(_replayed(book, chunk).where("seq is not null"), "depth")
    ripe = b.where("ripe_").groupBy("symbol", "epoch").agg(F.min("nth_").alias("first_"))
    open_ = b.where("local_ = 0").select("symbol", "nth_", "epoch").distinct()
    before = open_.join(ripe, ["symbol", "epoch"]).where("first_ < nth_").select("symbol", "nth_", F.lit(True).alias("was_warm_"))
    b = b.join(before, ["symbol", "nth_"], "left")
    return b.withColumn("warm", F.col("ripe_") | ((F.col("local_") == 0) & F.coalesce("was_warm_", F.lit(False)))).drop("was_warm_", "ripe_", "chunk_", "nth_", "local_")


def interval_best(start: np.ndarray, stop: np.ndarray, value: np.ndarray, n: int, largest: bool) -> np.ndarray:
    """At each time of [0, n) the largest (or smallest) value whose interval [start, stop) holds it; 0 where none does.

    Each interval is cut into the few nodes of a binary tree over time that it covers, a node keeps the best of its
    intervals, and the best of all ancestors is handed down to each time."""
    size = 1 << max(n - 1, 1).bit_length()
    none = np.iinfo(np.int64).min if largest else np.iinfo(np.int64).max
    better = np.maximum if largest else np.minimum
    tree = np.full(2 * size, none)
    a, b = start + size, stop + size
    while len(a):
        for end, odd in ((a, a & 1 == 1), (b - 1, b & 1 == 1)):
            better.at(tree, end[odd], value[odd])
        a, b = (a + 1) >> 1, b >> 1
        on = a < b
        a, b, value = a[on], b[on], value[on]
    at = 1
    while at < size:
        tree[2 * at : 4 * at] = better(tree[2 * at : 4 * at], np.repeat(tree[at : 2 * at], 2))
        at *= 2
    best = tree[size : size + n]
    return np.where(best == none, 0, best)


def level_runs(epoch: np.ndarray, side: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a chunk by epoch, side and level, each level's in their order, and where the next row is of the same level."""
    order = np.lexsort((np.arange(len(epoch)), level, side, epoch))
    e, s, v = epoch[order], side[order], level[order]
    return order, (e[1:] == e[:-1]) & (s[1:] == s[:-1]) & (v[1:] == v[:-1])


def best_of_chunk(epoch: np.ndarray, side: np.ndarray, level: np.ndarray, quantity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best bid, best ask) after each row of a chunk in its order; ``side`` is 1 for bids. A row's level lives until the next
    row of its epoch, side and level, or the epoch's end."""
    order, same = level_runs(epoch, side, level)
    stop = np.searchsorted(epoch, epoch, "right")
    stop[order[:-1][same]] = order[1:][same]
    live, found = ~(quantity == 0), []
    for is_bid in (1, 0):
        at = np.flatnonzero(live & (side == is_bid))
        found.append(interval_best(at, stop[at], level[at], len(epoch), is_bid == 1) / 1e4)
    return found[0], found[1]


def depths_of_chunk(epoch: np.ndarray, side: np.ndarray, level: np.ndarray, quantity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bid depth, ask depth) after each row of a chunk in its order; an epoch begins with an empty book."""
    order, same = level_runs(epoch, side, level)
    delta = quantity.astype(float)
    delta[order[1:][same]] -= quantity[order[:-1][same]]
    first = np.searchsorted(epoch, epoch, "left")
    found = []
    for is_bid in (1, 0):
        total = np.cumsum(np.where(side == is_bid, delta, 0.0))
        found.append(total - np.where(first > 0, total[first - 1], 0.0))
    return found[0], found[1]


def _with_best(rows: DataFrame, *names: str) -> DataFrame:
    """(symbol, seq, names, best_bid, best_ask) of _with_carried()'s rows, each chunk by itself."""
    kinds = dict(rows.dtypes)
    out = ["symbol", "seq", *names]

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        own = t.column("seq").is_valid().to_numpy(zero_copy_only=False)
        order = np.lexsort((t.column("seq").fill_null(0).to_numpy(), own))
        t, own = t.take(pa.array(order)), own[order]
        side = (t.column("side").to_numpy(zero_copy_only=False) == "bid").astype(np.int64)
        bid, ask = best_of_chunk(t.column("epoch").to_numpy(), side, t.column("level").to_numpy(), t.column("quantity").to_numpy())
        t = t.select(out).append_column("best_bid", pa.array(bid)).append_column("best_ask", pa.array(ask))
        return t.filter(pa.array(own))

    schema = ", ".join(f"{c} {kinds[c]}" for c in out) + ", best_bid double, best_ask double"
    return rows.select(*dict.fromkeys([*out, "nth_", "epoch", "side", "level", "quantity"])).groupBy("symbol", "nth_").applyInArrow(run, schema)


def best_bid_ask(book: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(symbol, seq, best_bid, best_ask) after each row of ``book``; 0 for an empty side."""
    starts = _starts(book, chunk)
    return _with_best(_with_carried(_in_epochs(book, starts, chunk), starts))


def book_stats(book: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per (symbol, timestamp): n_samples, avg_spread and spread_std_dev in basis points over warm rows with a
    true spread, depth_imbalance and depth_ratio of the average depths of warm rows."""
    b = _with_best(_replayed(book, chunk), "event_time", "nth_", "epoch", "local_", "ripe_", "bid_depth", "ask_depth").withColumn("timestamp", X.close_ts(F.col("event_time")))
    good = (F.col("best_bid") > 0) & (F.col("best_ask") > F.col("best_bid"))
    bps = F.when(good, (F.col("best_ask") - F.col("best_bid")) / F.col("best_bid") * 10000)
    # parts of a minute by chunk and epoch, ripe or not; only then is it known which were warm
    moments = F.struct(F.count(bps).alias("n"), F.coalesce(F.avg(bps), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(bps) * F.count(bps), F.lit(0.0)).alias("m2"))
    parts = b.groupBy("symbol", "timestamp", "epoch", "nth_", (F.col("local_") == 0).alias("open_"), "ripe_").agg(F.count("*").alias("n"), F.sum("bid_depth").alias("bd"), F.sum("ask_depth").alias("ad"), moments.alias("m"))
    first = F.min(F.when(F.col("ripe_"), F.col("nth_"))).over(Window.partitionBy("symbol", "epoch"))
    warm = parts.withColumn("first_", first).where("ripe_ or (open_ and first_ < nth_)")
    a = warm.groupBy("symbol", "timestamp").agg(F.sum("n").alias("n_samples"), F.sum("bd").alias("bd"), F.sum("ad").alias("ad"), F.collect_list("m").alias("m")).withColumn("m", X.merged_moments(F.col("m")))
    total = F.col("bd") + F.col("ad")
    zero = lambda c: F.when(F.round(total / F.col("n_samples"), 9) > 0, c).otherwise(0.0)
    std = F.when(F.col("m.n") > 1, F.sqrt(F.try_divide(F.col("m.m2"), F.col("m.n") - 1))).otherwise(0.0)
    return a.select("symbol", "timestamp", "n_samples", F.col("m.mean").alias("avg_spread"), std.alias("spread_std_dev"), zero(F.try_divide(F.col("bd") - F.col("ad"), total)).alias("depth_imbalance"), zero(F.try_divide(F.col("ad"), total)).alias("depth_ratio"))


def profile_book(book: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(what, value, n): rows per event type and side, and those whose earlier id isn't the row before's."""
    b = _with_ids_before(book, chunk).withColumn("breaks", _id_before() != F.col("prev_final_update_id"))
    kinds = book.groupBy(F.lit("event_type").alias("what"), F.col("event_type").alias("value")).agg(F.count("*").alias("n"))
    sides = book.groupBy(F.lit("side").alias("what"), F.col("side").alias("value")).agg(F.count("*").alias("n"))
    return kinds.unionByName(sides).unionByName(b.agg(F.lit("id_break").alias("what"), F.lit("rows").alias("value"), F.count_if("breaks").alias("n")))
