"""WARC archives written and read through Spark's text files, with boundary-chain verification.

A record ends with two line ends, which the text writer puts after each row. The reader splits at
line ends followed by the version line, wherever they stand, also inside a payload; each piece is a
candidate record with the offset of its successor. Pointer jumping from the start of each file keeps
the candidates that the chain of records reaches.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.llm import common
from barlake.llm.common import by_arrow, free, shared_dir, spool

VERSION, TAIL = "WARC/1.1\r\n", "\r\n\r\n"
#: Payloads below it are never revisits.
LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
#: What a response's block has before the payload, and the profile of a revisit; fixed values of the WARC and HTTP formats.
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(value): a record for each row of ``pages`` (page_id, url, html). Of equal payloads of at least
    ``least`` bytes, the rows with the smallest page_id are responses and the others revisit it; a
    group without any id has only responses. A response's block is an HTTP response with the payload as its
    body; a revisit has none and names the response's record. A null html is empty, a null url or id is left
    out, other columns aren't looked at. Rows that repeat an id and a payload share a record id. A very long html
    is one record like others; an empty table gives no records."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    first = p.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = spool(first.select(F.col("digest").alias("f_digest"), "first"))
    p = p.join(first, F.col("digest") == F.col("f_digest"), "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)) & F.col("first").isNotNull()
    kind = F.when(revisit, "revisit").otherwise("response")

    def line(name: str, value):
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    def name(page: str):
        m = F.md5(F.concat_ws(":", F.coalesce(F.col(page).cast("string"), F.lit("")), "digest"))
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.substring(m, 13, 4), F.substring(m, 17, 4), F.substring(m, 21, 12)), F.lit(">"))

    body = F.when(revisit, F.lit("")).otherwise(F.concat(F.lit(HTTP), F.col("size").cast("string"), F.lit(TAIL), F.col("payload")))
    of_first = F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name("first")), line("WARC-Refers-To-Page", F.col("first").cast("string")))
    head = [
        line("WARC-Type", kind), line("WARC-Date", F.lit(DATE)), line("WARC-Record-ID", name("page_id")), line("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]", "")),
        line("WARC-Page-ID", F.col("page_id").cast("string")), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), line("WARC-Payload-Length", F.col("size").cast("string")),
        F.when(revisit, of_first).otherwise(line("Content-Type", F.lit("application/http;msgtype=response"))), line("Content-Length", F.octet_length(body).cast("string")),
    ]
    return p.select(F.concat(F.lit(VERSION), *head, F.lit("\r\n"), body).alias("value"))


def write(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    records(pages, least).write.option("lineSep", TAIL).text(path)


def fields(head: str) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in head.split("\r\n")) if colon}


def payload_of(block: bytes, kind: str | None) -> bytes:
    """What follows the HTTP head in the block of a response."""
    return block.partition(b"\r\n\r\n")[2] if (kind or "").startswith("application/http") else block


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, place, span, step, page_id, size, digest, type, refers_to, whole): pieces of the
    files in ``path``. place: bytes from the start of the split; step: bytes from the record's
    place to its successor, null if it names no length; whole: the block is in this piece; size and
    digest: the payload's."""
    raw = spark.read.option("lineSep", TAIL + VERSION).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")

    def run(batches):
        at, place = None, 0
        for b in batches:
            rows = []
            for file, split, value in zip(*(c.to_pylist() for c in b.columns)):
                if (file, split) != at:
                    at, place = (file, split), 0
                if split == 0 and place == 0:
                    value = value.removeprefix(VERSION)
                body = value.encode("utf-8")
                span = len(VERSION) + len(body) + len(TAIL)
                head, _, payload = body.partition(b"\r\n\r\n")
                h = fields(head.decode("utf-8", "replace"))  # without a cut, the payload begins with the version line
                size = int(h["content-length"]) if h.get("content-length", "").isdigit() else None
                step = None if size is None else len(VERSION) + len(head) + 4 + size + len(TAIL)
                got = payload.removesuffix(TAIL.encode()) if size is not None and len(payload) == size + 4 else payload
                whole = size is not None and len(got) >= size
                num = lambda k: int(h[k]) if h.get(k, "").lstrip("-").isdigit() else None
                sha, full = h.get("warc-payload-digest", "").removeprefix("sha256:"), num("warc-payload-length")
                if whole and h.get("warc-type") != "revisit":
                    got = payload_of(got[:size], h.get("content-type"))
                    sha, full = hashlib.sha256(got).hexdigest(), len(got)
                rows.append((file, split, place, span, step, num("warc-page-id"), full, sha, h.get("warc-type"), num("warc-refers-to-page"), whole))
                place += span
            kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string(), pa.int64(), pa.bool_()]
            names = ["file", "split", "place", "span", "step", "page_id", "size", "digest", "type", "refers_to", "whole"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    return by_arrow(raw, run, "file string, split long, place long, span long, step long, page_id long, size long, digest string, type string, refers_to long, whole boolean")


def reachable(pointers: DataFrame) -> DataFrame:
    """(file, at) that the chain from place 0 of each file reaches; ``pointers`` (file, at, to). Each round
    doubles the jumps, so rounds follow the logarithm of a file's records."""
    reach = spool(pointers.where("at = 0").select("file", "at"))
    jump = spool(pointers.where("to is not null"))
    while True:
        new = spool(reach.join(jump, ["file", "at"]).select("file", F.col("to").alias("at")))
        if not new.take(1):
            free(new)
            break
        both = spool(reach.unionByName(new).distinct())
        far = jump.alias("a").join(jump.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.at")))
        double = spool(far.select("a.file", "a.at", "b.to"))
        free(reach, new, jump)
        reach, jump = both, double
    free(jump)
    return reach


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records in ``path``; a
    payload that holds the version line is put together again before it is digested. Page ids that are no whole
    numbers come back null; files without records give no rows."""
    cand = spool(candidates(spark, path))
    splits = cand.groupBy("file", "split").agg(F.sum("span").alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    base = splits.select(F.col("file").alias("b_file"), F.col("split").alias("b_split"), F.coalesce(before, F.lit(0)).alias("base"))
    at = cand.join(base, (F.col("file") == F.col("b_file")) & (F.col("split") == F.col("b_split"))).withColumn("at", F.col("base") + F.col("place")).drop("b_file", "b_split", "base")
    at = spool(at.withColumn("file_name", F.col("file")).withColumn("file", F.xxhash64("file")).withColumn("to", F.col("at") + F.col("step")))
    known = at.select("file", F.col("at").alias("to"))
    reach = reachable(spool(at.select("file", "at", "to").join(known, ["file", "to"], "left_semi").unionByName(at.where("at = 0").select("file", "at", "to"))).distinct())
    good = spool(at.join(reach, ["file", "at"], "left_semi"))
    out = good.where("whole").select("page_id", "size", "digest", "type", "refers_to")
    broken = good.where("not whole")
    if broken.take(1):
        out = out.unionByName(joined(spark, path, at, broken))
    free(cand, at)
    return out.select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def joined(spark: SparkSession, path: str, at: DataFrame, broken: DataFrame) -> DataFrame:
    """The rows of ``broken`` records with their payloads' own digests, from the pieces they cover. Records that
    the chain reaches don't overlap, so that a piece belongs to the last broken one at or before it, or to none."""
    own = broken.select("file", "at", F.struct(F.col("at").alias("from"), F.col("to").alias("until"), "page_id", "type", "refers_to").alias("own"))
    carried = F.last("own", True).over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    some = at.join(broken.select("file").distinct(), "file", "left_semi")  # only files with a broken record are sorted
    part = some.select("file", "file_name", "split", "place", "at").join(own, ["file", "at"], "left").withColumn("own", carried)
    part = spool(part.where("at < own.until").select("file", "file_name", "split", "place", "at", "own.*"))
    raw = spark.read.option("lineSep", TAIL + VERSION).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")

    def run(batches):
        key, place = None, 0
        for b in batches:
            out = []
            for file, split, value in zip(*(c.to_pylist() for c in b.columns)):
                if (file, split) != key:
                    key, place = (file, split), 0
                if split == 0 and place == 0:
                    value = value.removeprefix(VERSION)
                out.append((file, split, place, value))
                place += len(VERSION) + len(value.encode("utf-8")) + len(TAIL)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["file_name", "split", "place", "value"])

    text = by_arrow(raw, run, "file_name string, split long, place long, value string").join(part, ["file_name", "split", "place"])
    whole = text.groupBy("file", "from", "until", "page_id", "type", "refers_to").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), TAIL + VERSION).alias("body"))
    http = F.lower(F.substring_index("body", TAIL, 1)).contains("\r\ncontent-type: application/http")
    start = F.octet_length(F.when(http, F.substring_index("body", TAIL, 2)).otherwise(F.substring_index("body", TAIL, 1))) + len(TAIL)
    # from the record's place to its successor: version line, heads, payload, end
    size = F.col("until") - F.col("from") - len(VERSION) - start - len(TAIL)
    payload = F.substring(F.encode("body", "UTF-8"), start + 1, size.cast("int"))
    return whole.select("page_id", size.alias("size"), F.sha2(payload, 256).alias("digest"), "type", "refers_to")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(common.table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return read(spark, path)
