"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each metric is a whole number. Its quantile sketch per language and source is a table of counts by
bucket, the value with all but its six leading bits cleared: sketches merge by adding counts, a
bucket is at most 1/32 of its value wide, and the result doesn't depend on the order of merging.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.llm import common
from barlake.llm.common import SPACES, free, spool

#: (metric, least distance of a fence from the median, checked below too).
METRICS = (("symbol_permille", 100, False), ("dup_line_permille", 200, False), ("repeat_permille", 200, False), ("word_len_centi", 250, True))
#: Documents a group needs for thresholds of its own; else its language's are taken, else those of all.
LEAST_GROUP = 200
#: How many times the distance from the median to the 90th (10th) percentile a fence lies beyond that percentile.
SPREAD = 3
#: A table of thresholds of so many rows at most is broadcast.
BROADCAST_ROWS = 20_000
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_features(text: Column) -> list[tuple[str, Column]]:
    """Steps (name, column) that give the base features of ``text`` in order; each may use those before."""
    c = F.col
    windows = F.when(F.size("q_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("q_words") - 3), lambda i: F.struct(F.xxhash64(F.get("q_words", i), F.get("q_words", i + 1), F.get("q_words", i + 2)).alias("h"), i.alias("i"))))
    twice = F.filter("q_sorted", lambda x, j: (F.get("q_sorted", j - 1)["h"] == x["h"]) | (F.get("q_sorted", j + 1)["h"] == x["h"]))
    # a window at p covers the words up to the next window found twice, three at most
    covered = F.aggregate(F.transform("q_at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("q_at", j + 1) - p, F.lit(3)))), F.lit(0), lambda s, x: s + x)
    return [
        ("q_text", F.coalesce(text, F.lit(""))),
        ("q_words", F.array_remove(F.split("q_text", SPACES + "+"), "")),
        ("n_words", F.size("q_words").cast("long")),
        ("q_sorted", F.sort_array(windows)),
        ("q_at", F.sort_array(F.transform(twice, lambda x: x["i"]))),
        ("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")),
        ("word_chars", F.char_length(F.regexp_replace("q_text", SPACES + "+", "")).cast("long")),
        ("n_symbols", F.char_length(F.regexp_replace("q_text", "[^#*$%&|<>]+", "")).cast("long")),
        ("q_lines", F.filter(F.split("q_text", "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]"))),
        ("n_lines", F.size("q_lines").cast("long")),
        ("n_dup_lines", c("n_lines") - F.size(F.array_distinct("q_lines"))),
    ]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, the base features, base_failed, the metrics) of each row."""
    out = docs.select("doc_id", "text", "lang", "source")
    for name, col in base_features(F.col("text")):
        out = out.withColumn(name, col)
    return out.select(
        "doc_id", "lang", "source", *FEATURES,
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.expr("n_symbols * 1000 div greatest(word_chars, 1)").alias("symbol_permille"),
        F.expr("n_dup_lines * 1000 div greatest(n_lines, 1)").alias("dup_line_permille"),
        F.expr("n_repeat_words * 1000 div greatest(n_words, 1)").alias("repeat_permille"),
        F.expr("word_chars * 100 div greatest(n_words, 1)").alias("word_len_centi"),
    )


def sketch(feats: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): the mergeable sketches of documents that pass the base rules."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m, _, _ in METRICS]))
    long = feats.where("not base_failed").select("lang", "source", values.alias("x")).select("lang", "source", "x.metric", "x.v")
    bucket = F.expr("shiftleft(shiftright(v, greatest(0, length(bin(v)) - 6)), greatest(0, length(bin(v)) - 6))")
    return long.groupBy("lang", "source", "metric", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(sk: DataFrame, *keys: str) -> DataFrame:
    return sk.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def fences(sk: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_docs, <metric>_low, <metric>_high): one row for each sketch."""
    by = Window.partitionBy(*keys, "metric")
    up = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    r = sk.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(by))

    def q(pct: int):
        return F.min(F.when(100 * F.col("upto") >= pct * F.col("total"), F.col("bucket")))

    r = r.groupBy(*keys, "metric").agg(F.max("total").alias("n_docs"), q(10).alias("q10"), q(50).alias("q50"), q(90).alias("q90"))
    cols = []
    for m, least, below in METRICS:
        high = F.greatest(F.col("q90") + SPREAD * (F.col("q90") - F.col("q50")), F.col("q50") + least)
        low = F.least(F.col("q10") - SPREAD * (F.col("q50") - F.col("q10")), F.col("q50") - least) if below else F.lit(-1)
        cols += [F.max(F.when(F.col("metric") == m, high)).alias(f"{m}_high"), F.max(F.when(F.col("metric") == m, low)).alias(f"{m}_low")]
    return r.groupBy(*keys).agg(F.max("n_docs").alias("n_docs"), *cols)


def thresholds(sk: DataFrame) -> DataFrame:
    """(lang, source, fences) of each pair: its own sketch if it has LEAST_GROUP documents, else its
    language's if that has, else that of all."""
    names = [f"{m}_{s}" for m, _, _ in METRICS for s in ("high", "low")]
    own = fences(sk, "lang", "source")
    lang = fences(merged(sk, "lang"), "lang").select(F.col("lang").alias("l"), F.col("n_docs").alias("l_docs"), *[F.col(c).alias(f"l_{c}") for c in names])
    every = fences(merged(sk)).first()
    j = own.join(lang, F.col("lang").eqNullSafe(F.col("l")), "left")
    pick = [F.when(F.col("n_docs") >= LEAST_GROUP, F.col(c)).when(F.col("l_docs") >= LEAST_GROUP, F.col(f"l_{c}")).otherwise(F.lit(every[c] if every else None).cast("long")).alias(c) for c in names]
    return j.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *pick)


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, base features, base_failed, kept, failed_rules) for each row of ``docs``.

    Null texts are empty and fail the base rules; null languages and sources form groups of their
    own; repeated rows are judged and counted each. Features are written once: one pass over the
    texts; thresholds come from an aggregate of counts, so a hot source costs no more than others. Very
    long texts are read whole; values at a threshold pass; an empty table gives no rows; other columns
    aren't looked at, whatever their names."""
    feats = spool(features(docs))
    sk = spool(sketch(feats))
    limits = spool(thresholds(sk))
    if limits.count() <= BROADCAST_ROWS:
        limits = F.broadcast(limits)
    j = feats.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    free(sk)
    broken = F.array_compact(F.array(*[F.when((F.col(m) > F.col(f"{m}_high")) | (F.col(m) < F.col(f"{m}_low")), F.lit(m)) for m, _, _ in METRICS]))
    return j.select("doc_id", *FEATURES, "base_failed", (~F.col("base_failed") & (F.size(broken) == 0)).alias("kept"), F.when(~F.col("base_failed"), broken).otherwise(F.array().cast("array<string>")).alias("failed_rules"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")).select("doc_id", *FEATURES, "base_failed", "kept")


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, by doc_id (rows that share an id go only if all of them
    fail; rows without an id are kept). Null, empty and very long texts are judged as judge() does; an
    empty table stays empty, and other columns stay as they are."""
    verdict = judge(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"))
    return docs.join(spool(verdict.where("not kept").select("doc_id")), "doc_id", "left_anti")
