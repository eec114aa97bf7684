"""Personal data by patterns, widened by bootstrapped contexts, in DataFrame functions only.

Seeds (the base entities) mark the tokens that hold them; the word before a token is its lexical
pattern. Patterns and instances form a graph of counts. In rounds, a pattern scores the share of
its occurrences that are believed instances, and an instance is believed as its patterns allow.
Patterns that end above CONFIDENCE mark tokens no base pattern finds, as kind ``other``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import common
from barlake.llm.common import free, spool

KINDS = ("email", "ip", "card", "phone")
#: The base patterns; runs are matched without giving back, and a run that failed isn't tried from its middle.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
NOT_SPACE, SPACE = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
#: A token that may be an identifier: of four digits or more, or with an at sign.
TOKEN = rf"(?<!{NOT_SPACE})(?:[^\x20\x09-\x0D0-9@]*+[0-9]){{4}}{NOT_SPACE}*+|(?<!{NOT_SPACE})[^\x20\x09-\x0D@]*+@{NOT_SPACE}*+"
CONFIDENCE, LEAST_INSTANCES = 0.9, 5
#: Rounds end when no pattern's score moves by more than SETTLED (they can only rise), ROUNDS at most.
SETTLED, ROUNDS = 0.001, 20


def running_max(a: Column) -> Column:
    return scan(a, lambda x, y: F.greatest(x, y))


def scan(a: Column, op) -> Column:
    """Inclusive running ``op`` of a number array, in log2(size) whole-array steps."""
    steps = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.size(a), F.lit(1)).cast("double"))).cast("int"))), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.reduce(steps, a, lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, op(x, F.get(acc, i - d))).otherwise(x)))


def matches(df: DataFrame, name: str, pattern: str, quick: str, valid=None) -> DataFrame:
    """``df`` with ``name``: the array of (start, end, match, before) of the matches of ``pattern`` in
    pii_text that ``valid`` keeps; before: the text between the match and the one before it."""
    has = F.col("pii_text").rlike(quick)
    none = F.array().cast("array<string>")
    df = df.withColumn("pii_m", F.when(has, F.regexp_extract_all("pii_text", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("pii_gap", F.when(F.size("pii_m") > 0, F.split("pii_text", pattern, -1)).otherwise(none))
    df = df.withColumn("pii_len", F.transform("pii_m", lambda m, i: F.char_length(F.get("pii_gap", i)) + F.char_length(m)))
    df = df.withColumn("pii_end", scan(F.col("pii_len"), lambda x, y: x + y))
    spans = F.transform("pii_m", lambda m, i: F.struct((F.get("pii_end", i) - F.char_length(m)).alias("start"), F.get("pii_end", i).alias("end"), m.alias("match"), F.get("pii_gap", i).alias("before")))
    df = df.withColumn("pii_all", spans)
    out = F.filter("pii_all", valid) if valid else F.col("pii_all")
    return df.withColumn(name, out).drop("pii_m", "pii_gap", "pii_len", "pii_end", "pii_all")


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = F.reverse(digits(m))
    ok = F.aggregate(
        F.sequence(F.lit(1), F.char_length(d)), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, F.substring(d, i, F.lit(1)).cast("int")).otherwise(F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(d, i, F.lit(1)).cast("int")))
    )
    return F.when(F.char_length(d).between(13, 19), ok % 10 == 0).otherwise(False)


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (with pii_text) and an array of spans for each kind."""
    docs = matches(docs, "email", EMAIL, "@")
    docs = matches(docs, "ip", IP, r"[0-9]\.[0-9]", lambda x: x["match"].rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
    docs = matches(docs, "card", CARD, "[0-9][0-9 -]{11}", lambda x: luhn(x["match"]))
    return matches(docs, "phone", PHONE, r"\+[0-9]", lambda x: F.char_length(digits(x["match"])).between(9, 15))


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, pii_text?, email … phone, tokens): tokens are those that may be identifiers, each with
    its pattern (the word before, lower-cased, its digits 0; null at the start or after a token)
    and whether it holds a base entity."""
    df = matches(base_spans(docs), "pii_tokens", TOKEN, "[0-9][^ ]*[0-9][^ ]*[0-9][^ ]*[0-9]|@")
    spans = F.concat(*[F.col(k) for k in KINDS])
    # read backwards, so that the match starts at the text's beginning, however long the text before is
    last = lambda x: F.reverse(F.regexp_extract(F.reverse(x["before"]), rf"^{SPACE}+({NOT_SPACE}+)", 1))
    before = lambda x: F.nullif(F.regexp_replace(F.lower(last(x)), "[0-9]", "0"), F.lit(""))
    df = df.withColumn("pii_spans", spans)
    tokens = F.transform("pii_tokens", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"), before(x).alias("pattern"), F.exists("pii_spans", lambda s: (s["start"] < x["end"]) & (s["end"] > x["start"])).alias("seed")))
    short = [F.transform(k, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias(k) for k in KINDS]
    return df.select("doc_id", F.xxhash64("pii_text").alias("text_hash"), *short, tokens.alias("tokens"))


def patterns(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(pattern, score, instances) of the confident patterns. Rounds of message passing over the graph of
    pattern and instance counts; each side is summed before it is joined, and written each round."""
    edges = marks.select(F.explode("tokens").alias("t")).where("t.pattern is not null")
    edges = edges.groupBy(F.col("t.pattern").alias("pattern"), F.xxhash64("t.match").alias("instance")).agg(F.count("*").alias("n"), F.max("t.seed").alias("seed"))
    edges = spool(edges)
    known = spool(edges.where("seed").groupBy("pattern").agg(F.count("*").alias("k")).where(F.col("k") >= LEAST_INSTANCES).select("pattern"))
    words = docs.select(F.explode(F.split("pii_text", f"{SPACE}+")).alias("w")).select(F.regexp_replace(F.lower("w"), "[0-9]", "0").alias("pattern"))
    total = spool(words.join(known, "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("total")))
    graph = spool(edges.join(total, "pattern"))
    belief = spool(graph.groupBy("instance").agg(F.max("seed").cast("double").alias("belief")))
    free(edges, known, total)
    last = None
    for turn in range(ROUNDS):
        score = spool(graph.join(belief, "instance").groupBy("pattern").agg((F.sum(F.col("n") * F.col("belief")) / F.max("total")).alias("score"), F.count_if(F.col("belief") > 0.5).alias("instances")))
        moved = last is None or score.join(last, "pattern").where(F.col("score") - F.col("was") > SETTLED).take(1)
        if last is not None:
            free(before)
        before, last = score, score.select("pattern", F.col("score").alias("was"))
        free(belief)
        if not moved or turn == ROUNDS - 1:
            break
        doubt = F.sum(F.log(1 - F.least(F.col("score"), F.lit(0.999))))
        belief = spool(graph.join(score, "pattern").groupBy("instance").agg(F.greatest(F.max("seed").cast("double"), 1 - F.exp(doubt)).alias("belief")))
    free(graph)
    return spool(score.where((F.col("score") >= CONFIDENCE) & (F.col("instances") >= LEAST_INSTANCES)))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, email, ip, card, phone, other) of each row: arrays of (start, end) in code points.

    A null text is empty. Rows are apart from each other, so repeated ones give repeated results;
    without seeds there are no patterns and no ``other`` spans. Spans of different kinds may overlap;
    an ``other`` span overlaps no base one. Very long texts are searched whole; scores at the threshold
    count as reached; an empty table gives no rows; columns of other names aren't looked at."""
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("pii_text"))
    marks = spool(found(text))
    good = patterns(text, marks)
    some = good.select("pattern").limit(1).count()
    rest = lambda t: t.where("not t.seed and t.pattern is not null")
    if not some:
        return marks.drop("tokens").withColumn("other", F.array().cast("array<struct<start:int,end:int>>"))
    hits = rest(marks.select("doc_id", "text_hash", F.explode(F.array_distinct("tokens")).alias("t"))).select("doc_id", "text_hash", "t.start", "t.end", F.col("t.pattern").alias("pattern"))
    hits = hits.join(good.select("pattern"), "pattern", "left_semi").distinct()
    hits = spool(hits.groupBy(F.col("doc_id").alias("h_id"), F.col("text_hash").alias("h_hash")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("other")))
    j = marks.drop("tokens").join(hits, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("text_hash") == F.col("h_hash")), "left").drop("h_id", "h_hash")
    return j.withColumn("other", F.coalesce("other", F.array().cast("array<struct<start:int,end:int>>")))


def listed(kinds: tuple[str, ...]) -> Column:
    def named(kind: str) -> Column:
        return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))

    return F.array_join(F.concat(*[named(k) for k in kinds]), ",")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detect(common.table(spark, sf_dir, "documents", "doc_id", "text"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return d.select("doc_id", *counts, F.sha2(listed(KINDS), 256).alias("base_sha256"), listed((*KINDS, "other")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span in the text replaced by its kind in brackets; of overlapping spans the
    earliest (then the longest) names the place, and what others add to it goes too. Null texts stay, and so do
    all other columns whatever their names; repeated rows are redacted each; an empty table stays empty."""
    d = detect(docs, id_col, text_col)
    def named(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("minus_end"), F.lit(kind.upper()).alias("kind")))

    spans = F.concat(*[named(k) for k in (*KINDS, "other")])
    d = d.select(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash"), F.sort_array(spans).alias("r_spans")).where(F.size("r_spans") > 0)
    d = spool(d.dropDuplicates(["r_id", "r_hash"]))
    rows = docs.select(F.struct("*").alias("r_row"))  # whatever its columns are called
    text = F.col("r_row").getField(text_col)
    j = rows.join(d, F.col("r_row").getField(id_col).eqNullSafe(F.col("r_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("r_hash")), "left")
    j = j.withColumn("r_text", text).withColumn("r_ends", running_max(F.transform("r_spans", lambda x: -x["minus_end"])))
    done = lambda i: F.when(i > 0, F.get("r_ends", i - 1)).otherwise(F.lit(0))
    part = F.transform("r_spans", lambda x, i: F.when(x["start"] >= done(i), F.concat(F.substring("r_text", done(i) + 1, x["start"] - done(i)), F.lit("["), x["kind"], F.lit("]"))).otherwise(F.lit("")))
    tail = F.expr("substring(r_text, element_at(r_ends, -1) + 1)")
    new = F.when(F.col("r_spans").isNotNull(), F.concat(F.array_join(part, ""), tail)).otherwise(F.col("r_text"))
    return j.select(*[new.alias(c) if c == text_col else F.col("r_row").getField(c).alias(c) for c in docs.columns])
