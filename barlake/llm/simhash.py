"""SimHash near-duplicates: tiled exact comparison of fingerprints by exclusive-or and bit count."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import common
from barlake.llm.common import by_arrow, components, forest, free, spool, whole_groups

#: Fingerprints compared at once in a task; a bucket above it is cut into tiles.
TILE = 1024
#: Texts compared at once in a task when their min-hash keys agree.
WIDE_TILE = 4096
#: Min-hash keys of a text, and values in each: texts of similarity 0.8 share none with a probability
#: of (1 - 0.8 ** ROWS) ** BANDS, 0.2 %.
BANDS, ROWS = 20, 6
#: Distinct fingerprints up to which one agreeing block of four keys the buckets.
FOUR_BLOCKS = 1 << 23


def shingles_of(text: str | None, shingle: int) -> list[bytes]:
    """Runs of ``shingle`` words; a shorter text is one shingle, no words give none."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return [b" ".join(x) for x in zip(*[tokens[i:] for i in range(min(shingle, len(tokens)))])]


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 values of the different shingles, sorted."""
    return np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles_of(text, shingle)], np.uint64))


def fingerprint(text: str | None, shingle: int = 3, words: int = 1) -> tuple[int, list[int]]:
    """(number of shingles, ``words`` 64-bit words): a bit is set if it is set in over half of the
    shingles' XXH64 values. Word w hashes with seed 42 + w. With more than one word, a shingle counts
    once, however often it occurs. No words: zeros."""
    shingles = shingles_of(text, shingle)
    if not shingles:
        return 0, [0] * words
    if words > 1:
        shingles = list(dict.fromkeys(shingles))
    out = []
    for w in range(words):
        h = np.fromiter((xxhash.xxh64_intdigest(s, 42 + w) for s in shingles), np.uint64, len(shingles))
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 65536):
            ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0]))
    return len(shingles), out


_ODD = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = np.random.default_rng(12).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    h = h + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def set_sketch(h: np.ndarray, words: int) -> tuple[list[int], np.ndarray]:
    """(``words`` words of a fingerprint, BANDS keys) of the hash values of a set: word w has the bits that over
    half of the values mixed with w have; a key is made of ROWS least values under as many orders."""
    ones, least = np.zeros((words, 64), np.int64), np.full(len(_ODD), np.uint64(2**64 - 1))
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096]
        for w in range(words):
            ones[w] += np.unpackbits((mixed(part, w) if w else part).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        least = np.minimum(least, ((part[:, None] ^ _FLIP) * _ODD).min(0))
    key = np.arange(BANDS, dtype=np.uint64)
    for value in least.reshape(BANDS, ROWS).T:
        key = mixed(key ^ value, 1)
    return np.packbits(2 * ones > len(h), axis=1, bitorder="little").view(np.int64).ravel().tolist(), key.view(np.int64)


def set_sketches(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """(doc_id, size, w0 …, node, keys, text_hash) of rows (doc_id, text, text_hash): node is a hash of the set of
    shingles, keys are its min-hash keys (none without words)."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b.column(1).to_pylist()]
            got = [set_sketch(h, words) if len(h) else ([0] * words, np.zeros(0, np.int64)) for h in sets]
            ends = np.cumsum([0, *[len(k) for _, k in got]]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([k for _, k in got] or [np.zeros(0, np.int64)])))
            node = np.array([xxhash.xxh3_64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
            cols = [b.column(0), pa.array([len(h) for h in sets], pa.int64()), *[pa.array([x[w] for x, _ in got], pa.int64()) for w in range(words)], pa.array(node), keys, b.column(2)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "size", *[f"w{w}" for w in range(words)], "node", "keys", "text_hash"])

    kind = docs.schema[0].dataType.simpleString()
    return by_arrow(docs, run, f"doc_id {kind}, size long, " + "".join(f"w{w} long, " for w in range(words)) + "node long, keys array<bigint>, text_hash long")


def fingerprints(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """(doc_id, size, w0 …, text_hash) of each row; the last only if ``docs`` has it after id and text."""

    def run(batches):
        for b in batches:
            got = [fingerprint(t, shingle, words) for t in b.column(1).to_pylist()]
            cols = [b.column(0), pa.array([x[0] for x in got], pa.int64())] + [pa.array([x[1][w] for x in got], pa.int64()) for w in range(words)]
            yield pa.RecordBatch.from_arrays(cols + b.columns[2:], names=["doc_id", "size"] + [f"w{w}" for w in range(words)] + b.schema.names[2:])

    kind = docs.schema[0].dataType.simpleString()
    return by_arrow(docs, run, f"doc_id {kind}, size long, " + ", ".join([f"w{w} long" for w in range(words)] + [f"{c} long" for c in docs.columns[2:]]))


def apart(x: np.ndarray, y: np.ndarray, words: int) -> np.ndarray:
    """Differing bits of the first ``words`` (at most 3: the sum fits a byte) words of rows of ``x`` and ``y``."""
    d = np.bitwise_count(x[..., 0] ^ y[..., 0])
    for w in range(1, words):
        d += np.bitwise_count(x[..., w] ^ y[..., w])
    return d


def close_pairs(x: np.ndarray, tile: np.ndarray, cross: bool, radius: int, step: int = 256):
    """Positions of the pairs of rows of ``x`` (n, words) at most ``radius`` bits apart; with
    ``cross``, of different tiles only. Blocks in order of population count; a pair of blocks
    whose counts differ by more than the radius is skipped, and pairs whose first three words
    differ by more than it aren't looked at further: neither loses a pair."""
    pop, first = np.bitwise_count(x).sum(1, dtype=np.int64), min(x.shape[1], 3)
    order = np.argsort(pop, kind="stable")
    x, pop, tile = x[order], pop[order], tile[order]
    for i in range(0, len(x), step):
        top = pop[min(i + step, len(x)) - 1]
        end = np.searchsorted(pop, top + radius, side="right")
        for j in range(i, end, step * 16):
            k = min(j + step * 16, end)
            a, b = np.nonzero(apart(x[i : i + step, None], x[None, j:k], first) <= radius)
            a, b = a + i, b + j
            keep = a < b
            if cross:
                keep &= tile[a] != tile[b]
            a, b = a[keep], b[keep]
            if x.shape[1] > first and len(a):
                d = np.bitwise_count(x[a] ^ x[b]).sum(1)
                a, b = a[d <= radius], b[d <= radius]
            if len(a):
                yield order[a], order[b]


def links(rows: DataFrame, words: int, radius: int) -> DataFrame:
    """Spanning links (a, b) of the pairs within ``radius`` in each group ``g`` of rows
    (g, cross, tile, node, w0 …), by task: never more than its nodes."""
    names = [f"w{w}" for w in range(words)]

    def run(batches):
        for t in whole_groups(batches, "g"):
            g, cross, tile, node = (np.asarray(t.column(c)) for c in ("g", "cross", "tile", "node"))
            x = np.stack([np.asarray(t.column(c)) for c in names], 1).view(np.uint64)
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            sizes = np.diff(np.r_[starts, len(g)])
            found = []
            small = np.repeat(sizes <= 48, sizes)
            for d in range(1, int(sizes[sizes <= 48].max(initial=0))):
                a = np.flatnonzero((g[d:] == g[:-d]) & small[d:])
                b = a + d
                keep = ~cross[a] | (tile[a] != tile[b])
                keep &= apart(x[a], x[b], min(words, 3)) <= radius
                a, b = a[keep], b[keep]
                if words > 3 and len(a):
                    keep = np.bitwise_count(x[a] ^ x[b]).sum(1) <= radius
                    a, b = a[keep], b[keep]
                found.append((node[a], node[b]))
            for s, n in zip(starts[sizes > 48], sizes[sizes > 48]):
                got = [forest(node[s + a], node[s + b]) for a, b in close_pairs(x[s : s + n], tile[s : s + n], bool(cross[s]), radius)]
                if got:
                    found.append(forest(np.concatenate([p for p, _ in got]), np.concatenate([q for _, q in got])))
            a, b = forest(np.concatenate([p for p, _ in found] or [node[:0]]), np.concatenate([q for _, q in found] or [node[:0]]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return by_arrow(rows.repartition("g").sortWithinPartitions("g"), run, "a long, b long")


def similar(x: np.ndarray, tile: np.ndarray, cross: bool, radius: int, at: np.ndarray, values: np.ndarray, similarity: float):
    """Links (positions) of rows of ``x`` at most ``radius`` bits apart whose shingle sets have a Jaccard index of
    ``similarity``, but for pairs that other links connect. Row i's set is values[at[i] : at[i + 1]]."""
    n, label = np.diff(at), np.arange(len(x))
    for a, b in close_pairs(x, tile, cross, radius):
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        for group in np.split(np.arange(len(a)), np.flatnonzero(a[1:] != a[:-1]) + 1):
            i = a[group[0]]
            j = b[group]
            j = j[label[j] != label[i]]
            if not len(j):
                continue
            mine = values[at[i] : at[i + 1]]
            for k in range(0, len(j), 64):
                js = j[k : k + 64]
                theirs = np.concatenate([values[at[y] : at[y + 1]] for y in js])
                if len(mine) and len(theirs):
                    hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
                    common_ = np.bincount(np.repeat(np.arange(len(js)), n[js]), hit, len(js))
                else:
                    common_ = np.zeros(len(js))
                js = js[common_ >= similarity * (n[i] + n[js] - common_) - 1e-9]
                if len(js):
                    yield np.full(len(js), i), js
                    label[np.isin(label, label[js])] = label[i]


def checked(edges: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, words: int, radius: int, similarity: float) -> DataFrame:
    """Spanning links of the pairs within ``radius`` whose shingle sets are similar. Such pairs lie inside the
    components of ``edges``: only texts of these are read again (``docs``: text, text_hash), and a large component
    is compared by pairs of its tiles."""
    names = [f"w{w}" for w in range(words)]
    comp = components(edges)
    linked = spool(comp.join(reps, "node").select("node", F.col("root").alias("k"), "text_hash", *names))
    # by the hash at every size: this many texts go to tasks that hold a part of the links
    texts = docs.join(linked.select("text_hash").distinct().hint("merge"), "text_hash", "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))

    def cut(batches):
        for b in batches:
            sets = [shingle_set(t, shingle).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["text_hash", "shingles"])

    sets = by_arrow(texts.select("text_hash", "text"), cut, "text_hash long, shingles array<bigint>")
    rows = spool(linked.join(sets, "text_hash").select("k", "node", "shingles", *names))
    sizes = spool(rows.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > TILE))
    dealt = in_tiles(rows, sizes, TILE).select("g", "cross", "tile", "node", "shingles", *names)

    def run(batches):
        for t in whole_groups(batches, "g", rows=2000):
            g, cross, tile, node = (np.asarray(t.column(c)) for c in ("g", "cross", "tile", "node"))
            x = np.stack([np.asarray(t.column(c)) for c in names], 1).view(np.uint64)
            column = t.column("shingles").combine_chunks()
            at, values = np.zeros(len(g) + 1, np.int64), np.asarray(column.flatten()).view(np.uint64)
            np.cumsum(np.asarray(column.value_lengths()), out=at[1:])
            cuts = np.r_[np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)]
            found = [(node[:0], node[:0])]
            for s, e in zip(cuts[:-1], cuts[1:]):
                found += [(node[s + a], node[s + b]) for a, b in similar(x[s:e], tile[s:e], bool(cross[s]), radius, at[s : e + 1], values, similarity)]
            a, b = forest(np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found]))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    out = spool(by_arrow(dealt.repartition("g").sortWithinPartitions("g"), run, "a long, b long"))
    free(comp, linked, rows, sizes)
    return out


def in_tiles_by_bits(rows: DataFrame, sizes: DataFrame, tile: int, radius: int) -> DataFrame:
    """As in_tiles(), for one word: a large key's tiles are cut in the order of bit counts, and a row goes only to pairs with
    tiles that hold counts within ``radius`` of its own, so that far pairs of tiles aren't even shuffled. Where a
    key's tiles begin is told by its rows per bit count, 65 numbers."""
    hot = sizes.where(F.col("n") > tile).select("k")
    per = rows.join(hot, "k", "left_semi").groupBy("k", F.bit_count("w0").alias("p")).agg(F.count("*").alias("n"))
    by = per.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("p", "n"))).alias("m"))
    each = F.transform(F.sequence(F.lit(0), F.lit(64)), lambda p: F.coalesce(F.try_element_at("m", p.cast("int")), F.lit(0).cast("long")))
    below = F.transform(F.sequence(F.lit(0), F.lit(65)), lambda i: F.aggregate(F.slice("each", 1, i), F.lit(0).cast("long"), lambda a, x: a + x))
    starts = by.select("k", each.alias("each")).select("k", below.alias("below"))
    r = rows.join(starts, "k", "left").withColumn("p", F.bit_count("w0").cast("int"))
    at = lambda i: F.get("below", i)
    place = at(F.col("p")) + F.pmod(F.xxhash64("node", F.lit(7)), at(F.col("p") + 1) - at(F.col("p")))
    low, high = at(F.greatest(F.col("p") - radius, F.lit(0))), at(F.least(F.col("p") + radius, F.lit(64)) + 1) - 1
    whole = lambda x: F.coalesce(F.floor(x / tile), F.lit(0)).cast("int")  # noqa: E731  # keys that aren't hot are one tile
    r = r.withColumn("tile", whole(place)).withColumn("other", F.explode(F.sequence(whole(low), whole(high))))
    low, high = F.least("tile", "other"), F.greatest("tile", "other")
    return r.withColumn("g", F.xxhash64("k", low, high)).withColumn("cross", low != high).drop("other", "below", "p", "k")


def in_tiles(rows: DataFrame, sizes: DataFrame, tile: int) -> DataFrame:
    """Rows with key ``k`` dealt to groups ``g``: a key of up to ``tile`` rows is one group, a
    larger one has a group for each pair of its tiles, so no task holds a whole hot key.
    ``sizes`` (k, n) has at least the keys above ``tile``."""
    r = rows.join(sizes.where(F.col("n") > tile), "k", "left")
    n = F.ceil(F.coalesce("n", F.lit(1)) / tile)
    r = r.withColumn("tiles", n).withColumn("tile", F.pmod(F.xxhash64("node", F.lit(7)), "tiles").cast("int"))
    one = r.where("tiles = 1").withColumn("other", F.lit(0)).withColumn("tile", F.lit(0))
    more = r.where("tiles > 1").withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("tiles") - 1).cast("int"))))
    out = one.unionByName(more)
    low, high = F.least("tile", "other"), F.greatest("tile", "other")
    return out.withColumn("g", F.xxhash64("k", low, high)).withColumn("cross", low != high).drop("tiles", "other", "n", "k")


def by_blocks(reps: DataFrame, n: int) -> DataFrame:
    """(k, node, w0): fingerprints at most 3 bits apart agree in one of four 16-bit blocks, and in
    two of five; the latter keys more than ``FOUR_BLOCKS`` fingerprints. Both are exact."""
    if n <= FOUR_BLOCKS:
        masks = [0xFFFF << (16 * j) for j in range(4)]
    else:
        cuts = [0, 13, 26, 39, 52, 64]
        blocks = [((1 << cuts[j + 1]) - 1) ^ ((1 << cuts[j]) - 1) for j in range(5)]
        masks = [blocks[i] | blocks[j] for i in range(5) for j in range(i)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("w0").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)]))
    return reps.select(keys.alias("k"), "node", "w0")


def groups(docs: DataFrame, shingle: int = 3, words: int = 1, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id, size) for each row of ``docs``; fingerprint is the hex of the words.

    With one word and a radius of 3, tiles share a block of the fingerprint. With more words, texts
    whose counts of different shingles differ by over 1.5 to 2.25 times aren't compared: tiles are cut by bands of
    that count. With a ``similarity`` of 0.8 or more, tiles share a min-hash key, pairs within the radius are candidates,
    and they are linked if the Jaccard index of their shingle sets reaches it. A null or empty
    text has the fingerprint zero, linked like any other; a row whose id is null has the component
    of the other rows of its group. Copies meet as one fingerprint (or set) first, so repeated rows and ties
    cost nothing; component_id is the smallest id of the group. Very long texts are taken whole, other columns
    aren't looked at, and an empty table gives no rows.
    """
    names = [f"w{w}" for w in range(words)]
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if similarity is not None:
        docs = docs.withColumn("text_hash", F.xxhash64("text"))
        prints = spool(set_sketches(docs, shingle, words))
    else:
        prints = spool(fingerprints(docs, shingle, words)).withColumn("node", F.col("w0") if words == 1 else F.xxhash64(*names))
    more = ["text_hash", "keys"] if similarity is not None else []
    reps = spool(prints.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.max("size").alias("size"), *[F.min(c).alias(c) for c in names + more]))
    if similarity is not None:
        rows = reps.select(F.explode("keys").alias("k"), "node", *names)
        sizes = spool(rows.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > WIDE_TILE))
        dealt = in_tiles(rows, sizes, WIDE_TILE)
    elif words == 1:
        rows = by_blocks(reps, reps.count())
        sizes = spool(rows.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > TILE))
        dealt = in_tiles_by_bits(rows, sizes, TILE, radius)
    else:
        tile = min(max(reps.count() // 24, 2 * TILE), 1 << 16)
        # the band of the size and the next one: a pair of neighbouring bands meets in the lower one's group
        band = F.floor(F.log(F.greatest("size", F.lit(1))) / F.log(F.lit(1.5))).cast("long")
        rows = reps.select(band.alias("k"), "node", *names)
        sizes = spool(rows.groupBy("k").agg(F.count("*").alias("n")))
        dealt = in_bands(rows, sizes, tile)
    edges = spool(links(dealt.select("g", "cross", "tile", "node", *names), words, radius))
    if similarity is not None:
        loose, edges = edges, checked(edges, reps, docs, shingle, words, radius, similarity)
        free(loose)
    comp = components(edges)
    named = spool(comp.join(reps.select("node", "least_id"), "node").select("node", "root", "least_id"))
    low = spool(named.groupBy("root").agg(F.min("least_id").alias("component_id")))
    of = spool(named.join(low, "root").select("node", "component_id"))
    free(sizes, edges, comp, named, low)
    out = prints.join(reps.select("node", "least_id"), "node", "left").join(of, "node", "left")
    return out.select("doc_id", F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in names])).alias("fingerprint"), F.coalesce("component_id", "least_id").alias("component_id"), "size")


def in_bands(rows: DataFrame, sizes: DataFrame, tile: int) -> DataFrame:
    """As in_tiles, for bands ``k`` of which neighbours are compared too."""
    n = F.ceil(F.col("n") / tile).cast("int")
    counts = sizes.select("k", n.alias("tiles"))
    above = counts.select((F.col("k") - 1).alias("k"), F.col("tiles").alias("tiles_above"))
    below = counts.select((F.col("k") + 1).alias("k"), F.col("tiles").alias("tiles_below"))
    dims = F.broadcast(counts.join(above, "k", "left").join(below, "k", "left"))  # a row for each of at most 110 bands
    r = rows.join(dims, "k").withColumn("tile", F.pmod(F.xxhash64("node", F.lit(7)), "tiles").cast("int"))

    def partners(count: str):
        return F.sequence(F.lit(0), F.col(count) - 1)

    own = F.transform(partners("tiles"), lambda o: F.xxhash64("k", F.lit(0), F.least("tile", o), F.greatest("tile", o)))
    up = F.when(F.col("tiles_above").isNotNull(), F.transform(partners("tiles_above"), lambda o: F.xxhash64("k", F.lit(1), F.col("tile"), o))).otherwise(F.array().cast("array<bigint>"))
    down = F.when(F.col("tiles_below").isNotNull(), F.transform(partners("tiles_below"), lambda o: F.xxhash64(F.col("k") - 1, F.lit(1), o, F.col("tile")))).otherwise(F.array().cast("array<bigint>"))
    mark = (F.col("k") * 1_000_000 + F.col("tile")).cast("int")
    r = r.withColumn("tile_id", mark)
    a = r.select("*", F.posexplode(own).alias("o", "g")).withColumn("cross", F.col("o") != F.col("tile")).drop("o")
    b = r.select("*", F.explode(F.concat(up, down)).alias("g")).withColumn("cross", F.lit(True))
    return a.unionByName(b).drop("tile").withColumnRenamed("tile_id", "tile")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for all documents: 3-word shingles, 3 bits."""
    return groups(common.table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def candidate_radius(similarity: float, bits: int) -> int:
    """Bits that differ between texts of that Jaccard index, by the angle between their sets, and five
    standard deviations more; texts of a few shingles spread wider."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * p + 5 * math.sqrt(bits * p * (1 - p)))


def near_dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, words: int = 4) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest doc_id
    (of rows that repeat it, any one with that id's whole text group). Near copies are linked by pairs whose
    sets of ``shingle`` words have a Jaccard index of ``similarity``. Documents without words, and rows
    whose id is null, stay."""
    g = groups(docs.select("doc_id", "text"), shingle, words, candidate_radius(similarity, 64 * words), similarity=similarity)
    drop = spool(g.where("doc_id is not null and size > 0 and doc_id <> component_id").select("doc_id").distinct())
    return docs.join(drop, "doc_id", "left_anti")
