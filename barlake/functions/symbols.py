"""Canonical symbols (``BASE/QUOTE:PERP``) and exchanges' own, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_to_exchange(symbol: Column, exchange: Column) -> Column:
    """The exchange's name of a canonical symbol; spot markets keep the slash, and so do those of unknown exchanges but
    for perpetuals. Without a slash there is no quote, without a colon either no base."""
    s = F.upper(symbol)
    slash, colon = s.contains("/"), s.contains(":")
    legs, ends = F.split(s, "/"), F.split(s, ":")
    tail = F.split(F.get(legs, F.lit(1)), ":")
    base = F.when(slash, F.get(legs, F.lit(0))).when(colon, F.get(ends, F.lit(0))).otherwise("")
    quote = F.when(slash, F.get(tail, F.lit(0))).otherwise("")
    kind = F.when(slash, F.get(tail, F.lit(1))).when(colon, F.get(ends, F.lit(1)))
    joined, apart = F.concat(base, quote), F.concat(base, F.lit("/"), quote)
    return (
        F.when(exchange.isin("binance_futures", "bybit_perpetual", "dydx"), joined).when(exchange == "hyperliquid", base)
        .when(exchange == "binance", F.when(kind == "SPOT", apart).otherwise(joined)).otherwise(F.when(kind == "PERP", joined).otherwise(apart))
    )


def _suffix(s: Column, suffixes: tuple[str, ...], last: Column, kind: str = "PERP") -> Column:
    out = last
    for x in reversed(suffixes):
        out = F.when(s.endswith(x), F.concat(F.substring(s, F.lit(1), F.length(s) - len(x)), F.lit(f"/{x}:{kind}"))).otherwise(out)
    return out


def exchange_to_canonical(exchange: Column, symbol: Column) -> Column:
    """The canonical symbol of an exchange's own; one of unknown form is a perpetual of its own name."""
    plain = F.concat(symbol, F.lit(":PERP"))
    spot = F.when(symbol.contains("/"), F.concat(symbol, F.lit(":SPOT"))).otherwise(_suffix(symbol, ("USDT",), plain, "SPOT"))
    return (
        F.when(exchange.isin("binance_futures", "bybit", "bybit_perpetual"), _suffix(symbol, ("USDT", "USDC"), plain)).when(exchange == "binance", spot)
        .when(exchange == "hyperliquid", F.concat(symbol, F.lit("/USDC:PERP"))).when(exchange == "dydx", F.concat(symbol, F.lit("/USDT:PERP"))).otherwise(plain)
    )


def map_exchange_name(exchange: Column) -> Column:
    return F.when(exchange == "binance", "binance_futures").when(exchange == "bybit", "bybit_perpetual").otherwise(exchange)


def map_exchange_to_db(exchange: Column) -> Column:
    return F.regexp_replace(exchange, "_futures$", "")


def normalize_canonical(symbol: Column) -> Column:
    s = F.regexp_replace(F.upper(F.trim(symbol)), " ", "")
    return F.when(s.contains("/"), s).otherwise(_suffix(s, ("USDT", "USDC"), s))


def feed_binance(symbol: Column) -> Column:
    """USD is tried before BUSD, so that BTCBUSD gives BTCB/USD."""
    s = F.upper(symbol)
    return _suffix(s, ("USDT", "USD", "BUSD"), F.concat(s, F.lit(":PERP")))


def feed_bybit(symbol: Column) -> Column:
    return _suffix(symbol, ("USDT", "USDC", "USD"), F.concat(symbol, F.lit(":PERP")))


def feed_hyperliquid(symbol: Column) -> Column:
    return F.concat(F.upper(symbol), F.lit("/USDC:PERP"))
