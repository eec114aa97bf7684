"""On-chain exchange flows, market-cap dominance and macro series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR = 3_600_000
#: Units of a coin in chain values.
BTC_UNITS, ETH_UNITS = 10**8, 10**18


def hour_of(ts: Column, close_time: bool = False) -> Column:
    """Hour start in ms, or the close with ``close_time``."""
    return (F.floor(ts / HOUR) + (1 if close_time else 0)) * HOUR


def labelled(tx: DataFrame, address: str, labels: DataFrame) -> DataFrame:
    """Rows of ``tx`` whose address has a label, once for each; labels are joined as Spark sees fit by their size."""
    return tx.join(labels.select(F.col("address").alias(address), F.col("exchange").alias("label_exchange")), address)


def value_of(c: Column) -> Column:
    return F.coalesce(c.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))


def btc_flow(tx: DataFrame, labels: DataFrame, units: int = BTC_UNITS, close_time: bool = False) -> DataFrame:
    """(exchange, hour, value, n) of rows (block_timestamp ms, transaction_hash, value, addresses): a row counts once for
    each labelled address, transactions once."""
    t = tx.select("block_timestamp", "transaction_hash", "value", F.explode("addresses").alias("address"))
    g = labelled(t, "address", labels).groupBy(F.col("label_exchange").alias("exchange"), hour_of(F.col("block_timestamp"), close_time).alias("hour"))
    return g.agg((F.sum(value_of(F.col("value"))).cast("double") / units).alias("value"), F.count_distinct("transaction_hash").alias("n"))


def account_flow(tx: DataFrame, column: str, labels: DataFrame, units: int = ETH_UNITS, token: str | None = None, close_time: bool = False) -> DataFrame:
    """(exchange, hour, value, n) by from_address or to_address; with ``token`` of that token's transfers, else of values above 0."""
    t = tx.where(F.col("token_address") == token) if token is not None else tx.where(value_of(F.col("value")) > 0)
    g = labelled(t, column, labels).groupBy(F.col("label_exchange").alias("exchange"), hour_of(F.col("block_timestamp"), close_time).alias("hour"))
    return g.agg((F.sum(value_of(F.col("value"))).cast("double") / units).alias("value"), F.count("*").alias("n"))


def exclude_stablecoins(coins: DataFrame, stables: list[str], target: str) -> DataFrame:
    return coins.where(~F.col("coin").isin([s for s in stables if s != target]))


def top_coins(coins: DataFrame, n: int) -> DataFrame:
    return coins.orderBy(F.desc("cap"), "coin").limit(n)


def dominance(caps: DataFrame, target: str, least_share: float = 0.8, below: float | None = None) -> DataFrame:
    """(timestamp, dominance): the target's share of all caps in percent at times with at least ``least_share`` of the
    coins; ``below`` leaves out larger ones. Caps (coin, ts, cap) stay in long form."""
    coins = caps.select("coin").distinct().agg(F.count("*").alias("coins"))
    g = caps.where("cap > 0").groupBy("ts").agg(F.sum(F.when(F.col("coin") == target, F.col("cap"))).alias("t"), F.sum("cap").alias("all_"), F.count_distinct("coin").alias("n"))
    d = g.join(F.broadcast(coins)).where((F.col("t") > 0) & (F.col("all_") > 0) & (F.col("n") >= least_share * F.col("coins")))
    d = d.select(F.col("ts").alias("timestamp"), (F.col("t") / F.col("all_") * 100).alias("dominance"))
    return d.where(F.col("dominance") < below) if below is not None else d


def append_newer(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` and the rows of ``new`` later than its last, one of each time."""
    top = stored.agg(F.max("timestamp").alias("top"))
    late = new.join(F.broadcast(top)).where(F.col("top").isNull() | (F.col("timestamp") > F.col("top"))).drop("top")
    return stored.unionByName(late.dropDuplicates(["timestamp"]))


def dominance_summary(d: DataFrame) -> DataFrame:
    return d.agg(F.count("*").alias("n"), F.min("dominance").alias("low"), F.max("dominance").alias("high"), F.max_by("dominance", "timestamp").alias("latest"))


def macro_coverage(obs: DataFrame) -> DataFrame:
    return obs.groupBy("series_id").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"), F.max_by("value", "timestamp").alias("last_value"))
