"""Repeated byte strings over whole corpora, by suffix order and earlier matches.

Each string of LENGTH bytes belongs to the anchor with the least hash among its GRAM-byte pieces,
so equal strings share an anchor, whatever their documents. The strings of one anchor in one
text form a segment. Segments that are equal as a whole are settled by counting; the different
segments of an anchor are put in suffix order, and the longest previous factor of each string (from
the previous and the next smaller place in that order) tells whether it has an earlier copy. Anchors
with very many different segments are split by ever smaller ranges of their strings and counted
instead, so that no task holds a hot passage.

Different texts are laid out once, by their hashes; what is found about them is brought to them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import common
from barlake.llm.common import by_arrow, free, laid_out, spool, whole_groups

LENGTH, GRAM = 200, 32
#: Different segments of an anchor that one task compares; more are split.
GROUP = 256
#: Strings in a range, from one round of splitting to the next.
RANGES = (43, 11, 3, 1)

_BYTE = np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def suffix_ranks(text: np.ndarray, depth: int, levels: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Rank of each suffix of ``text`` by its first ``depth`` bytes (a multiple of 8); equal prefixes share
    a rank. Prefix doubling: ranks of 8 bytes, then of 16, and so on, joined at the end; ``levels``
    receives them by their numbers of bytes."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(depth, np.uint64)])
    key = np.zeros(n + depth - 8, np.uint64)
    for i in range(7):
        key = key * np.uint64(257) + padded[i : i + len(key)]
    first = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    eighth = padded[7 : 7 + len(first)]
    ranks = {} if levels is None else levels
    ranks[8] = np.unique(first * np.uint64(257) + eighth, return_inverse=True)[1].astype(np.uint64)
    span, done, out = 8, 0, None
    while True:
        if depth & span:
            part = np.concatenate([ranks[span], np.zeros(depth, np.uint64)])[done : done + n]
            out = part if out is None else np.unique((out << np.uint64(32)) | part, return_inverse=True)[1].astype(np.uint64)
            done += span
        if 2 * span > depth:
            return out
        r = ranks[span]
        ranks[2 * span] = np.unique((r << np.uint64(32)) | np.concatenate([r[span:], np.zeros(min(span, len(r)), np.uint64)]), return_inverse=True)[1].astype(np.uint64)
        span *= 2


def common_prefixes(text: np.ndarray, levels: dict[int, np.ndarray], depth: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes, ``depth`` at most, in which the suffixes at ``a`` and ``b`` agree, from suffix_ranks()' levels."""
    got, padded = np.zeros(len(a), np.int64), np.concatenate([text.astype(np.int16), np.full(depth + 8, -1, np.int16)])
    for span in sorted(levels, reverse=True):
        r = levels[span]
        for _ in range(1 if 2 * span in levels else depth // span):
            x, y = a + got, b + got
            inside = np.maximum(x, y) < len(r)
            got += span * (inside & (r[np.minimum(x, len(r) - 1)] == r[np.minimum(y, len(r) - 1)]))
    open_ = np.ones(len(a), bool)
    for _ in range(7):
        x, y = padded[np.minimum(a + got, len(padded) - 1)], padded[np.minimum(b + got, len(padded) - 1)]
        open_ &= (x == y) & (x >= 0)
        got += open_
    return np.minimum(got, depth)


def smaller_before(place: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at, least): of each entry the nearest one before it with a smaller place (-1: none), and the least of
    ``prefix`` from there on, which is the prefix they share. Pointers that found a larger place
    jump on by that entry's own pointer."""
    at, least = np.arange(len(place)) - 1, prefix.copy()
    todo = np.arange(1, len(place))
    todo = todo[place[at[todo]] > place[todo]]
    while len(todo):
        j = at[todo]
        least[todo] = np.minimum(least[todo], least[j])
        at[todo] = at[j]
        todo = todo[at[todo] >= 0]
        todo = todo[place[at[todo]] > place[todo]]
    return at, np.where(at < 0, 0, least)


def previous_factors(text: np.ndarray, depth: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(longest previous factor, longest following factor) of the suffixes of ``text`` at the ascending places
    ``starts``, compared with each other and counted up to ``depth``. The longest previous factor is the
    longer of the prefixes shared with the previous and with the next smaller place in suffix order, the
    longest following one that of the previous and next larger places."""
    levels: dict[int, np.ndarray] = {}
    rank = suffix_ranks(text, depth, levels)[starts]
    order = np.argsort(rank, kind="stable")
    by = starts[order]
    prefix = np.zeros(len(by) + 1, np.int64)  # shared with the neighbour before; none before the first and after the last
    prefix[1:-1] = common_prefixes(text, levels, depth, by[:-1], by[1:])
    found = []
    for place in (by, -by):
        before = smaller_before(place, prefix[:-1])[1]
        after = smaller_before(place[::-1], prefix[:0:-1])[1][::-1]
        factor = np.zeros(len(by), np.int64)
        factor[order] = np.maximum(before, after)
        found.append(factor)
    return found[0], found[1]


def segments(data: bytes) -> tuple[np.ndarray, ...]:
    """(anchor hash, segment hash, anchor place, first string, last string) of the segments of a text."""
    b, out = np.frombuffer(data, np.uint8), []
    width, total = LENGTH - GRAM + 1, len(data) - LENGTH + 1
    step = 1 << 22
    for begin in range(0, max(total, 0), step):
        part = b[begin : begin + step + LENGTH - 1]
        h = _BYTE[part]
        size = 1
        while size < GRAM:
            h = h[:-size] * (_ODD ^ np.uint64(size * 2)) + h[size:]
            h ^= h >> np.uint64(31)
            size *= 2
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        least = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        least = np.minimum(least[: len(h) - width + 1], least[width - size :][: len(h) - width + 1])
        p = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        s0 = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        s1 = np.r_[s0[1:], len(p)] - 1
        out.append((h[p[s0]].view(np.int64), p[s0] + begin, s0 + begin, s1 + begin))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h, p, s0, s1 = (np.concatenate(x) for x in zip(*out))
    hashed = [xxhash.xxh3_64_intdigest(data[x : y + LENGTH], z - x) for x, y, z in zip(s0.tolist(), s1.tolist(), p.tolist())]
    return h, np.array(hashed, np.uint64).view(np.int64), p, s0, s1


SEGMENT = "h long, seg long, p int, s0 int, s1 int"


def anchored(texts: DataFrame) -> DataFrame:
    """(doc_id, tag, segs) of ``texts`` (doc_id, tag, text)."""
    kind = pa.list_(pa.struct([("h", pa.int64()), ("seg", pa.int64()), ("p", pa.int32()), ("s0", pa.int32()), ("s1", pa.int32())]))

    def run(batches):
        for b in batches:
            found = [segments((t or "").encode("utf-8")) for t in b.column(2).to_pylist()]
            ends = np.cumsum([0, *[len(f[0]) for f in found]]).astype(np.int32)
            cols = [np.concatenate([f[i] for f in found]) for i in range(5)]
            flat = pa.StructArray.from_arrays([pa.array(c if i < 2 else c.astype(np.int32)) for i, c in enumerate(cols)], ["h", "seg", "p", "s0", "s1"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), flat).cast(kind)], names=["doc_id", "tag", "segs"])

    return by_arrow(texts, run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, tag long, segs array<struct<{SEGMENT.replace(' long', ':long').replace(' int', ':int')}>>")


def tag_of(text) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def different_texts(docs: DataFrame) -> DataFrame:
    """(tag, first_id, copies, text) of each different text of ``docs`` (doc_id, text), laid out by tag, the
    64-bit hash that stands for a text: the one time that whole texts are shuffled. Copies meet in the
    tasks that read them, so a group of any size sends a row from each."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), tag_of(F.col("text")).alias("tag"))
    return laid_out(texts.groupBy("tag").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("text").alias("text")), "tag")


def repeats(texts: DataFrame) -> DataFrame:
    """(tag, start, end, kind) for ``texts`` of different_texts(): strings repeated in other texts or places
    (kind 0) and strings that occur earlier, by first_id, text and place (kind 1); kind 2 is both."""
    marked = spool(anchored(texts.where(F.octet_length("text") >= LENGTH).select(F.col("first_id").alias("doc_id"), "tag", "text")))
    every = marked.select("doc_id", "tag", F.explode("segs").alias("x")).select("doc_id", "tag", "x.*")
    often = spool(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    cand = spool(every.join(often, "h"))
    free(marked, often)
    place = F.struct("doc_id", "tag", "s0")
    kinds = spool(cand.groupBy("h", "seg").agg(F.count("*").alias("c"), F.min(place).alias("least")))
    wide = spool(kinds.groupBy("h").agg(F.count("*").alias("d")))
    kinds2 = spool(kinds.join(wide, "h").where("c > 1 or d > 1"))
    free(kinds, wide)
    known = spool(cand.join(kinds2, ["h", "seg"]).withColumn("is_least", place.eqNullSafe(F.col("least"))).drop("seg", "least"))
    free(cand, kinds2)
    settled = known.where("c > 1").select("tag", F.col("s0").alias("start"), (F.col("s1") + LENGTH).alias("end"), F.when(F.col("is_least"), 0).otherwise(2).alias("kind"))
    open_ = known.where("d > 1 and is_least")
    lists = open_.groupBy(F.col("tag").alias("l_tag")).agg(F.collect_list(F.struct("h", "p", "s0", "s1", "d")).alias("segs"))
    cut = texts.join(lists, F.col("tag") == F.col("l_tag")).select(F.col("first_id").alias("doc_id"), "tag", "text", "segs")
    parts = spool(segment_bytes(cut))
    spans = [spool(settled), spool(compared(parts.where(F.col("d") <= GROUP)))]
    hot = parts.where(F.col("d") > GROUP)
    if hot.take(1):
        spans.append(split_hot(hot))
    free(known, parts)
    out = spans[0]
    for x in spans[1:]:
        out = out.unionByName(x)
    return out


def segment_bytes(cut: DataFrame) -> DataFrame:
    """(doc_id, tag, h, p, s0, s1, d, body) of rows (doc_id, tag, text, segs)."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                data, segs = (b.column(2)[k].as_py() or "").encode("utf-8"), b.column(3)[k].as_py()
                n = len(segs)
                cols = [pa.array([x[c] for x in segs], t) for c, t in (("h", pa.int64()), ("p", pa.int32()), ("s0", pa.int32()), ("s1", pa.int32()), ("d", pa.int64()))]
                at = pa.array(np.full(n, k))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *cols, pa.array([data[x["s0"] : x["s1"] + LENGTH] for x in segs], pa.binary())], names=["doc_id", "tag", "h", "p", "s0", "s1", "d", "body"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    return by_arrow(cut, run, f"doc_id {kind}, tag long, h long, p int, s0 int, s1 int, d long, body binary")


def runs(flag: np.ndarray, place: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(of, first, last) of the runs of flagged neighbouring places."""
    at = np.flatnonzero(flag)
    new = np.r_[True, (np.diff(at) > 1) | (of[at[1:]] != of[at[:-1]])] if len(at) else np.zeros(0, bool)
    first = at[new]
    last = np.r_[at[np.flatnonzero(new)[1:] - 1], at[-1:]] if len(at) else at
    return of[first], place[first], place[last]


def compared(parts: DataFrame) -> DataFrame:
    """Spans of the strings that different segments of an anchor share."""
    def run(batches):
        for t in whole_groups(batches, "h", rows=2500):
            bodies = t.column("body").to_pylist()
            tag, s0 = np.asarray(t.column("tag")), np.asarray(t.column("s0")).astype(np.int64)
            size = np.array([len(x) for x in bodies])

            def strings(use: np.ndarray):
                """The used bodies end to end, and of each string: its place there, its segment, its place in the document."""
                flat = np.frombuffer(b"".join([bodies[i] for i in use]), np.uint8)
                m = size[use] - LENGTH + 1
                begin = np.cumsum(size[use]) - size[use]
                of = np.repeat(use, m)
                inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                return flat, np.repeat(begin, m) + inner, of, s0[of] + inner

            # strings whose rolling hash is alone can't repeat; suffix order decides the others
            use = np.arange(len(bodies))
            flat, at, of, _ = strings(use)
            back = np.cumsum(np.r_[np.uint64(0), _BYTE[flat] * np.cumprod(np.r_[np.uint64(1), np.full(len(flat) - 1, _ODD)])])
            hashed = (back[at + LENGTH] - back[at]) * np.cumprod(np.r_[np.uint64(1), np.full(len(flat) - 1, np.uint64(pow(int(_ODD), -1, 1 << 64)))])[at]
            order = np.argsort(hashed, kind="stable")
            same = hashed[order][1:] == hashed[order][:-1]
            twin = np.zeros(len(at), bool)
            twin[order[1:]] |= same
            twin[order[:-1]] |= same
            use = np.unique(of[twin])
            if not len(use):
                continue
            flat, at, of, place = strings(use)
            earlier, later = previous_factors(flat, LENGTH, at)
            for flag, kind in ((np.maximum(earlier, later) >= LENGTH, 0), (earlier >= LENGTH, 1)):
                seg, first, last = runs(flag, place, of)
                yield pa.RecordBatch.from_arrays([pa.array(tag[seg]), pa.array(first.astype(np.int32)), pa.array((last + LENGTH).astype(np.int32)), pa.array(np.full(len(seg), kind, np.int32))], names=["tag", "start", "end", "kind"])

    rows = parts.repartition("h").sortWithinPartitions("h", "doc_id", "tag", "s0")
    return by_arrow(rows.select("h", "doc_id", "tag", "s0", "body"), run, "tag long, start int, end int, kind int")


def split_hot(hot: DataFrame) -> DataFrame:
    """As compared(), for anchors with many different segments: each round cuts ranges of strings into
    smaller ones. A range whose strings' common bytes occur once has no repeats; one that occurs
    as a whole elsewhere is settled but for its first copy, which goes on."""

    def cutter(width: int):
        def run(batches):
            for b in batches:
                out = []
                for k, (p, s0, lo, hi, body) in enumerate(zip(*(b.column(c).to_pylist() for c in ("p", "s0", "lo", "hi", "body")))):
                    # r: bytes from the start of a string to the anchor; ranges lie at multiples of width
                    for c in range(lo // width, hi // width + 1):
                        a, z = max(lo, c * width), min(hi, c * width + width - 1)
                        first, last = p - z - s0, p - a - s0
                        core = body[p - c * width - s0 : p - (c * width + width - 1) - s0 + LENGTH] if width > 1 else body[first : first + LENGTH]
                        out.append((k, c, a, z, xxhash.xxh3_64_intdigest(core) - (1 << 63), xxhash.xxh3_64_intdigest(body[first : last + LENGTH], a * 512 + z) - (1 << 63)))
                cols = list(zip(*out)) if out else [[]] * 6
                at = pa.array(cols[0], pa.int64())
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in ("doc_id", "tag", "h", "p", "s0", "body")], *[pa.array(x, pa.int32()) for x in cols[1:4]], *[pa.array(x, pa.int64()) for x in cols[4:]]], names=["doc_id", "tag", "h", "p", "s0", "body", "c", "lo", "hi", "core", "whole"])

        return run

    kind = hot.schema["doc_id"].dataType.simpleString()
    now = hot.select("doc_id", "tag", "h", "p", "s0", "body", (F.col("p") - F.col("s1")).alias("lo"), (F.col("p") - F.col("s0")).alias("hi"))
    out = []
    for width in RANGES:
        rows = spool(by_arrow(now, cutter(width), f"doc_id {kind}, tag long, h long, p int, s0 int, body binary, c int, lo int, hi int, core long, whole long"))
        cores = spool(rows.groupBy("h", "c", "core").agg(F.count("*").alias("n")).where("n > 1").select("h", "c", "core"))
        place = F.struct("doc_id", "tag", "p")
        wholes = spool(rows.groupBy("h", "c", "whole").agg(F.count("*").alias("n"), F.min(place).alias("least")))
        near = rows.join(cores, ["h", "c", "core"], "left_semi").join(wholes, ["h", "c", "whole"]).withColumn("first", place.eqNullSafe(F.col("least")))
        near = spool(near.drop("least", "core", "whole", "c"))
        out.append(near.where("n > 1").select("tag", (F.col("p") - F.col("hi")).alias("start"), (F.col("p") - F.col("lo") + LENGTH).alias("end"), F.when(F.col("first"), 0).otherwise(2).alias("kind")))
        now = near.where("first").drop("n", "first")
        free(rows, cores, wholes)
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res


def without(texts: DataFrame, spans: DataFrame, form: str) -> DataFrame:
    """(c_tag, n_removed, n_spans, new) of the ``texts`` that have ``spans``: what is left of them as binary, as text
    (cut characters go) or as the digest of the bytes, by ``form``."""
    lists = spans.groupBy(F.col("tag").alias("l_tag")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("cut_spans"))

    def run(batches):
        for b in batches:
            rows = []
            for text, cuts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = text.encode("utf-8")
                kept, end, gone, n = [], 0, 0, 0
                for x in cuts:
                    if x["end"] <= end:
                        continue
                    if x["start"] > end or n == 0:
                        kept.append(data[end : x["start"]])
                        n += 1
                    gone += x["end"] - max(end, x["start"])
                    end = x["end"]
                kept.append(data[end:])
                new = b"".join(kept)
                rows.append((gone, n, hashlib.sha256(new).hexdigest() if form == "digest" else new.decode("utf-8", "ignore") if form == "text" else new))
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:2]], pa.array(cols[2], pa.binary() if form == "binary" else pa.string())], names=["c_tag", "n_removed", "n_spans", "new"])

    j = texts.join(lists, F.col("tag") == F.col("l_tag")).select("tag", "text", "cut_spans")
    return by_arrow(j, run, f"c_tag long, n_removed long, n_spans long, new {'binary' if form == 'binary' else 'string'}")


def useful(spans: DataFrame, keep_first: bool) -> DataFrame:
    return spans.where("kind > 0") if keep_first else spans.where("kind <> 1")


def cut_repeats(docs: DataFrame, keep_first: bool) -> DataFrame:
    """(all columns of ``docs`` but text, n_bytes, n_removed, n_spans, kept binary) for each row.

    Removes each byte of a string of LENGTH bytes that occurs anywhere else in the corpus or, with
    ``keep_first``, that occurs earlier: in a text with a smaller doc_id, or before in its own. Of
    equal texts the rows with the smallest id are the first. Null texts are empty, ties between
    different texts of one id go by the texts' hashes, very long texts are cut up like others,
    columns of ``docs`` may have any names, and empty tables give no rows."""
    out = _cut(docs, keep_first, "binary")
    return out.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(docs.columns) if c != "text"], "n_bytes", "n_removed", "n_spans", F.col("new").alias("kept"))


def _cut(docs: DataFrame, keep_first: bool, form: str) -> DataFrame:
    """(the columns of ``docs`` but text as d0, d1 and so on, n_bytes, n_removed, n_spans, new). Rows meet the texts, laid out by
    hash, without texts of their own; copies that go as a whole don't meet them at all."""
    texts = different_texts(docs.select("doc_id", "text"))
    changed = spool(without(texts, useful(repeats(texts), keep_first), form))
    at = docs.columns.index("text")
    rows = docs.toDF(*[f"d{i}" for i in range(len(docs.columns))])
    text, doc_id = F.col(f"d{at}"), F.col(f"d{docs.columns.index('doc_id')}")
    rows = rows.withColumns({"tag": tag_of(text), "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "empty": text.isNull()})
    rows = rows.withColumn(f"d{at}", F.when(F.col("n_bytes") < LENGTH, text))  # short ones have no repeats and come along
    more = texts.where("copies > 1").select(F.col("tag").alias("m_tag"), F.col("first_id").alias("m_first"))
    rows = spool(rows.join(more, F.col("tag") == F.col("m_tag"), "left").withColumn("again", F.col("m_tag").isNotNull() & (~doc_id.eqNullSafe(F.col("m_first")) if keep_first else F.lit(True))))
    own, none = F.col(f"d{at}") if form == "text" else F.encode(F.coalesce(F.col(f"d{at}"), F.lit("")), "UTF-8"), F.lit("") if form == "text" else F.encode(F.lit(""), "UTF-8")
    gone = F.col("n_bytes") >= LENGTH
    zero = F.lit(0).cast("long")
    still = (F.col("n_bytes") < LENGTH) | F.col("again")
    out = [f"d{i}" for i in range(len(docs.columns)) if i != at]
    a = rows.where(still).select(*out, "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(zero).alias("n_removed"), F.when(gone, 1).otherwise(0).cast("long").alias("n_spans"), F.when(gone, none).otherwise(own).alias("new"))
    full = texts.where(F.octet_length("text") >= LENGTH).join(changed, F.col("tag") == F.col("c_tag"), "left").select(F.col("tag").alias("f_tag"), F.col("text").alias("f_text"), "n_removed", "n_spans", "new")
    whole = F.col("f_text") if form == "text" else F.encode("f_text", "UTF-8")
    b = rows.where(~still).join(full, F.col("tag") == F.col("f_tag"))
    b = b.select(*out, "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("new", whole).alias("new"))
    return a.unionByName(b)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is left of each document; rows carry their own digests, and only those of changed texts are looked up."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    texts = different_texts(docs)
    changed = without(texts, useful(repeats(texts), False), "digest")
    info = spool(texts.select("tag", "copies").join(changed, F.col("tag") == F.col("c_tag"), "left").where("copies > 1 or c_tag is not null").select(F.col("tag").alias("i_tag"), (F.col("copies") > 1).alias("again"), F.col("n_removed").alias("i_removed"), F.col("n_spans").alias("i_spans"), "new"))
    free(texts)
    t = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(t).alias("tag"), F.octet_length(t).cast("long").alias("n_bytes"), F.sha2(t, 256).alias("own"))
    j = rows.join(info, F.col("tag") == F.col("i_tag"), "left")
    gone = F.coalesce(F.col("again"), F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    zero = F.lit(0).cast("long")
    return j.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("i_removed", zero)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("i_spans", zero)).alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("new", "own")).alias("kept_sha256"),
    )


def drop_later_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with every repeated string but its first copy cut from the texts, at whole characters;
    a text of which nothing is left stays as an empty one, and a null one stays null. First is by doc_id (nulls
    first), then the hash of the text, then place; rows with equal ids and texts share their text. Very long texts are cut
    like others, an empty table stays empty, and columns of other names stay as they are."""
    out = _cut(docs, True, "text")
    return out.select(*[(F.col("new") if c == "text" else F.col(f"d{i}")).alias(c) for i, c in enumerate(docs.columns)])
