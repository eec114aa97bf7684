"""Readers and writers of market files. Missing columns read as zero, numbers in text are parsed."""

from __future__ import annotations

import datetime as dt
import functools
import os
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.functions import scalars as X


def _named(df: DataFrame, wanted: dict[str, str], *extra: str) -> DataFrame:
    zero = {"double": F.lit(0.0), "long": F.lit(0).cast("long"), "boolean": F.lit(False), "string": F.lit("")}

    def col(name: str, kind: str) -> Column:
        if name not in df.columns:
            return zero[kind].alias(name)
        c = F.col(name)
        return (c.cast("string") if kind == "string" else F.coalesce(c.try_cast(kind), zero[kind])).alias(name)

    return df.select(*[col(n, k) for n, k in wanted.items()], *extra)


TRADES = {"trade_time": "long", "price": "double", "quantity": "double", "is_buyer_maker": "boolean"}
OPEN_INTEREST = {"timestamp": "long", "sum_open_interest": "double", "sum_open_interest_value": "double"}
LIQUIDATIONS = {"trade_time": "long", "last_filled_quantity": "double", "side": "string"}
BOOK = {"event_time": "long", "event_type": "string", "price": "double", "quantity": "double", "side": "string", "final_update_id": "long", "prev_final_update_id": "long", "last_update_id": "long"}
KINDS = ("trades", "orderbook", "open_interest", "liquidations")
PATH = rf"([^/]+)/(\d{{4}}-\d{{2}}-\d{{2}})/(\d{{1,2}})/([^/]+)_({'|'.join(KINDS)})\.parquet"


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    return _named(spark.read.parquet(path), TRADES)


def read_open_interest(spark: SparkSession, path: str) -> DataFrame:
    return _named(spark.read.parquet(path), OPEN_INTEREST)


def read_liquidations(spark: SparkSession, path: str) -> DataFrame:
    return _named(spark.read.parquet(path), LIQUIDATIONS)


def normalize_book_row(df: DataFrame) -> DataFrame:
    """Update ids and types made plain: no final id falls back to the last one; no type and no earlier id is a snapshot."""
    final = F.when(F.col("final_update_id") == 0, F.col("last_update_id")).otherwise(F.col("final_update_id"))
    kind = F.when(F.col("event_type") == "update", "depthUpdate").when((F.coalesce(F.col("event_type"), F.lit("")) == "") & (F.col("prev_final_update_id") == 0), "snapshot").otherwise(F.col("event_type"))
    return df.withColumn("final_update_id", final).withColumn("event_type", kind).withColumn("side", X.normalize_side(F.col("side")))


def read_book(spark: SparkSession, path: str) -> DataFrame:
    """Book rows with ``file``, ``grp``, ``row_index`` and ``back``: replay order is (file, grp, price, side, row_index);
    grp counts runs of one final id in file order, back marks ids smaller than the run's before."""
    df = spark.read.parquet(path)
    meta = df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))
    b = normalize_book_row(_named(meta, BOOK, "file", "row_index"))
    w = Window.partitionBy("file").orderBy("row_index")
    last = F.lag("final_update_id").over(w)
    b = b.withColumn("back", F.coalesce(F.col("final_update_id") < last, F.lit(False))).withColumn("new", F.coalesce((F.col("final_update_id") != last).cast("int"), F.lit(1)))
    return b.withColumn("grp", F.sum("new").over(w)).drop("new")


def hour_layout(df: DataFrame, path: Column | None = None) -> DataFrame:
    """``df`` with exchange, date, hour, symbol and type from its files' paths."""
    p = F.col("_metadata.file_path") if path is None else path
    out = df.select("*", p.alias("path_"))
    for i, name in enumerate(("exchange", "date", "hour", "symbol", "type"), 1):
        c = F.regexp_extract("path_", PATH, i)
        out = out.withColumn(name, c.try_cast("int") if name == "hour" else c)
    return out.drop("path_")


def _hour_start() -> Column:
    return F.unix_millis(F.to_timestamp_ltz(F.concat_ws(" ", "date", F.format_string("%02d", "hour")), F.lit("yyyy-MM-dd HH"))) - _offset()


def _offset() -> Column:
    """Milliseconds that the session's zone reads a time of day off from UTC, at the epoch of the date."""
    utc = F.unix_millis(F.to_timestamp_ltz(F.concat("date", F.lit(" 00")), F.lit("yyyy-MM-dd HH")))
    return utc - F.unix_date(F.to_date("date")).cast("long") * 86_400_000


def list_hours(spark: SparkSession, root: str) -> DataFrame:
    """(exchange, symbol, hour in ms, type) of each file of the hour layout under ``root``, whether it has rows or not; no
    file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    return hour_layout(found.select("path"), F.col("path")).where("type <> ''").select("exchange", "symbol", _hour_start().alias("hour"), "type").distinct()


def hours_of_paths(paths: pd.Series) -> pd.DataFrame:
    """(exchange, hour in ms, symbol) by the paths of the hour layout, each different path parsed once; nulls for other paths."""
    at, names = pd.factorize(paths)
    parts = [m.groups() if (m := re.search(PATH, p)) else None for p in names]
    hours = [None if p is None else int(dt.datetime.fromisoformat(p[1]).replace(hour=int(p[2]), tzinfo=dt.timezone.utc).timestamp()) * 1000 for p in parts]
    each = pd.DataFrame({"exchange": [p and p[0] for p in parts], "hour": pd.array(hours, "Int64"), "symbol": [p and p[3] for p in parts]})
    return each.take(at).reset_index(drop=True)


@functools.cache
def _hour_of_file_udf():
    # not deterministic for the optimizer: it would repeat the parsing in each filter and join key of a row
    return F.pandas_udf(hours_of_paths, "exchange string, hour long, symbol string").asNondeterministic()


def _hour_of_file(path: Column) -> Column:
    return _hour_of_file_udf()(path)


def read_hours(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Rows of the files of ``kind`` under ``root`` with exchange, symbol, hour in ms, and row: a number by which a symbol's
    rows are in their order (by hour, then the file's own; book rows in replay order)."""
    names = {"trades": TRADES, "open_interest": OPEN_INTEREST, "liquidations": LIQUIDATIONS, "orderbook": BOOK}[kind]
    raw = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/*/*/*/*_{kind}.parquet")
    meta = raw.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))
    rows = _named(meta, names, "file", "row_index")
    if kind == "orderbook":
        rows = _in_replay_order(normalize_book_row(rows))
    else:
        rows = rows.withColumn("nth", F.col("row_index"))
    rows = rows.withColumn("of_", _hour_of_file(F.col("file"))).select("*", "of_.*").where("hour is not null")
    return rows.withColumn("row", F.expr("hour div 3600000") * FILE_ROWS + F.col("nth")).drop("file", "of_", "nth", "row_index")


#: More rows than a file of an hour has: rows of hours are numbered that far apart.
FILE_ROWS = 1_000_000_000


def _in_replay_order(rows: DataFrame) -> DataFrame:
    """Book rows with nth: their number in their file's replay order, which is by update, price and side."""
    w = Window.partitionBy("file").orderBy("row_index")
    new = F.coalesce((F.col("final_update_id") != F.lag("final_update_id").over(w)).cast("int"), F.lit(1))
    rows = rows.withColumn("new", new).withColumn("grp", F.sum("new").over(w))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("grp", "price", "side", "row_index")).cast("long")).drop("new", "grp")


def write_hours(df: DataFrame, root: str, kind: str, at: str, order: str | None = None) -> None:
    """Write rows (exchange, symbol, their columns) to the hour layout under ``root`` by the time ``at``, sorted by ``order`` in a
    file. In a shared local folder tasks write the files themselves, as Spark's writer takes several processes and
    renames for each; elsewhere Spark writes them."""
    spark = df.sparkSession
    t = F.timestamp_millis(at)
    parts = ["exchange", "date", "hour", "symbol"]
    named = df.withColumns({"date": F.date_format(t, "yyyy-MM-dd"), "hour": F.date_format(t, "HH")})
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() != "file":
        return write_hour_folders(named.repartition(*parts).sortWithinPartitions(*parts, order or at), root, kind)
    folder, columns = path.toUri().getPath(), [c for c in named.columns if c not in parts]
    name = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__")).alias(c + "_")
    # a given number of partitions: by their few bytes Spark would put all files into one
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    mine = named.repartition(n, *parts).sortWithinPartitions(*parts, order or at).select(*map(name, parts), *columns)
    mine.mapInArrow(lambda batches: _to_files(batches, folder, kind), "rows long").write.format("noop").mode("overwrite").save()


def _to_files(batches: Iterator[pa.RecordBatch], root: str, kind: str) -> Iterator[pa.RecordBatch]:
    """Write rows sorted by exchange, date, hour and symbol (the first columns) to a file for each, which gets its name when it
    is whole; gives its number of rows."""
    now, held, tmp, target, rows = None, None, "", "", 0

    def close() -> pa.RecordBatch:
        held.close()
        os.replace(tmp, target)
        return pa.RecordBatch.from_arrays([pa.array([rows])], names=["rows"])

    try:
        for b in batches:
            if not b.num_rows:
                continue
            keys, data = b.columns[:4], pa.Table.from_batches([b]).select(b.schema.names[4:])
            new = reduce(pc.or_, (pc.not_equal(k.slice(1), k.slice(0, len(k) - 1)) for k in keys))
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                key = [k[lo].as_py() for k in keys]
                if key != now:
                    if held:
                        yield close()
                    exchange, date, hour, symbol = map(_escaped, key)
                    target = f"{root}/{exchange}/{date}/{hour}/{symbol}_{kind}.parquet"
                    tmp = f"{os.path.dirname(target)}/.{symbol}_{kind}-{uuid.uuid4().hex}"
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    now, held, rows = key, pq.ParquetWriter(tmp, data.schema), 0
                held.write_table(data.slice(lo, hi - lo))
                rows += hi - lo
        if held:
            yield close()
    finally:
        if os.path.exists(tmp):  # of a task that failed
            os.remove(tmp)


def _escaped(name: str) -> str:
    """``name`` as Spark writes it in a folder's name."""
    return "".join(f"%{ord(c):02X}" if c < " " or c in "\"#%'*/:=?\\\x7f{[]^" else c for c in name)


def write_hour_folders(named: DataFrame, root: str, kind: str) -> None:
    """Spark writes folders by partition (exchange, date, hour, symbol), which then get the hour layout's names."""
    spark = named.sparkSession
    tmp = f"{root}/_{kind}"
    named.write.partitionBy("exchange", "date", "hour", "symbol").parquet(tmp)
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(root).getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.globStatus(jpath(f"{tmp}/*/*/*/*")):
        folder = s.getPath()
        exchange, date, hour, symbol = (p.getName().partition("=")[2] for p in (folder.getParent().getParent().getParent(), folder.getParent().getParent(), folder.getParent(), folder))
        target = jpath(f"{root}/{exchange}/{date}/{hour}/{symbol}_{kind}.parquet")
        fs.mkdirs(target.getParent())
        fs.rename(folder, target)
    fs.delete(jpath(tmp), True)


def parse_kline_lines(lines: DataFrame) -> DataFrame:
    """Bars of CSV lines (value): blank, header, short and unreadable ones are left out; closes are opens + 1 min."""
    p = F.split("value", ",")
    nums = [F.get(p, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"), 1)]
    out = lines.where(F.size(p) >= 6).select((F.get(p, F.lit(0)).try_cast("long") + 60_000).alias("timestamp"), *nums)
    return out.dropna()


def read_kline_csv(spark: SparkSession, path: str) -> DataFrame:
    return parse_kline_lines(spark.read.text(path))


def read_bars_json(spark: SparkSession, path: str, start: int, end: int, schema: str | None = None) -> DataFrame:
    """Bars with times in [start, end) of hourly files named by date and hour (or in folders of both) whose hours lie from
    start to end; of an exchange's, symbol's and time's bars that of the latest file. With a ``schema`` no file is read for one."""
    raw = (spark.read.schema(schema) if schema else spark.read).json(path)
    if "date" in raw.columns:  # folders of other days aren't listed as input
        day = lambda ts: F.to_date(F.timestamp_millis(F.lit(ts)))
        raw = raw.where(F.col("date").cast("date").between(day(start), day(end)))
    p = F.col("_metadata.file_path")
    part = lambda name, i: F.coalesce(F.nullif(F.regexp_extract(p, r"(\d{4}-\d{2}-\d{2})_(\d{2})[^/]*$", i), F.lit("")), F.regexp_extract(p, rf"{name}=([0-9-]+)/", 1))
    names = [c for c in raw.columns if c not in ("date", "hour")]
    raw = raw.select(*names, F.concat_ws(" ", part("date", 1), F.lpad(part("hour", 2), 2, "0")).alias("file_hour"))
    at = F.unix_millis(F.to_timestamp("file_hour", "yyyy-MM-dd HH"))
    raw = raw.where((at >= start) & (at <= end) & (F.col("timestamp") >= start) & (F.col("timestamp") < end))
    best = raw.groupBy(*[c for c in ("exchange", "symbol", "timestamp") if c in names]).agg(F.max_by(F.struct(*names), "file_hour").alias("b"))
    return best.select("b.*")


def write_bars_json(df: DataFrame, path: str) -> None:
    t = F.timestamp_millis(F.col("timestamp") - 60_000)
    df.withColumn("date", F.date_format(t, "yyyy-MM-dd")).withColumn("hour", F.date_format(t, "HH")).repartition("exchange", "symbol", "date", "hour").write.partitionBy("exchange", "symbol", "date", "hour").mode("overwrite").json(path)


def read_price_bars(bars: DataFrame, exchange: str, symbol: str, start: int, end: int) -> DataFrame:
    return bars.where((F.col("exchange") == exchange) & (F.col("symbol") == symbol) & (F.col("timestamp") >= start) & (F.col("timestamp") < end)).orderBy("timestamp")


read_orderbook_bars = read_price_bars


def read_market_caps(raw: DataFrame) -> DataFrame:
    """(coin, ts, cap) of rows (coin, market_caps array of [ts, cap])."""
    return raw.select("coin", F.explode("market_caps").alias("x")).select("coin", F.get("x", F.lit(0)).cast("long").alias("ts"), F.get("x", F.lit(1)).alias("cap"))


def read_labels(raw: DataFrame) -> DataFrame:
    """(chain, address, exchange, kind, source) of label rows with ``seq``: blanks and placeholders go, kind and source have
    defaults, ethereum's exchange addresses are lower-cased, and the first row of an address stays."""
    a = F.trim("address")
    kind = F.coalesce(F.nullif(F.trim("kind"), F.lit("")), F.lit("exchange"))
    addr = F.when((F.col("chain") == "ethereum") & (kind == "exchange"), F.lower(a)).otherwise(a)
    df = raw.where(a.isNotNull() & (a != "") & ~a.startswith("PASTE_")).select("seq", "chain", addr.alias("address"), "exchange", kind.alias("kind"), F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("manual")).alias("source"))
    best = df.groupBy("address").agg(F.min_by(F.struct("chain", "exchange", "kind", "source"), "seq").alias("b"))
    return best.select("b.chain", "address", "b.exchange", "b.kind", "b.source")


#: Columns of the tables of chains.
CHAIN = {
    "btc_inputs": ["block_timestamp", "transaction_hash", "addresses", "value"],
    "btc_outputs": ["block_timestamp", "transaction_hash", "addresses", "value"],
    "eth_transactions": ["block_timestamp", "transaction_hash", "from_address", "to_address", "value"],
    "token_transfers": ["block_timestamp", "transaction_hash", "token_address", "from_address", "to_address", "value"],
}


def read_chain_table(spark: SparkSession, path: str, kind: str, first: str, last: str) -> DataFrame:
    """The columns of ``kind`` on the days from ``first`` to ``last``; the files lie in folders by date."""
    return spark.read.parquet(path).where(F.col("date").between(first, last)).select(*CHAIN[kind])


def write_dominance(df: DataFrame, path: str) -> None:
    """One series sorted by time in place of the one at ``path``: written beside it, then swapped."""
    spark = df.sparkSession
    new, old = f"{path}.new", f"{path}.old"
    df.repartitionByRange("timestamp").sortWithinPartitions("timestamp").write.mode("overwrite").parquet(new)
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(jpath(old), True)
    if fs.exists(jpath(path)):
        fs.rename(jpath(path), jpath(old))
    fs.rename(jpath(new), jpath(path))
    fs.delete(jpath(old), True)


def read_coins(spark: SparkSession, path: str) -> DataFrame:
    """(base, name, rank, cap) of a ranking of coins."""
    raw = spark.read.schema("symbol string, name string, market_cap_rank int, market_cap double").json(path)
    return raw.select(F.lower("symbol").alias("base"), "name", F.col("market_cap_rank").alias("rank"), F.coalesce("market_cap", F.lit(0.0)).alias("cap"))


def read_instruments(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, status, contract_type, quote) of an exchange's information."""
    raw = spark.read.schema("symbols array<struct<symbol:string,status:string,contractType:string,quoteAsset:string>>").json(path)
    return raw.select(F.inline("symbols")).select("symbol", "status", F.col("contractType").alias("contract_type"), F.col("quoteAsset").alias("quote"))


def read_vendor_symbols(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("symbols array<string>").json(path).select(F.explode("symbols").alias("symbol"))
