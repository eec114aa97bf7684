"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import common
from barlake.llm.common import by_arrow, components, forest, free, spool, whole_groups
from barlake.llm.simhash import TILE, in_tiles

#: About so many different vectors, chosen by their hashes, teach the rotations; all are indexed.
SAMPLE = 20_000
#: Share of the pairs at the cosine that the tables are to find, by the bits that differ there on average.
RECALL = 0.99
ITERATIONS = 25


def rotations(x: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """(n, d, d): rotations of unit vectors such that the signs of the rotated coordinates are balanced and
    near the coordinates. Each starts from its own random rotation; alternates signs and the best
    rotation to them. Principal axes only rotate once more, as all of them are kept."""
    d = x.shape[1]
    axes = np.linalg.svd(np.cov((x - x.mean(0)).T) if len(x) > 1 else np.eye(d))[0]
    z, out = (x @ axes), []
    for k in range(n):
        r = np.linalg.qr(np.random.default_rng(seed + k).standard_normal((d, d)))[0]
        for _ in range(ITERATIONS if len(x) else 0):
            b = np.where(z @ r >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(z.T @ b)
            r = u @ vt
        out.append(axes @ r)
    return np.stack(out)


def plan(n: int, cosine: float) -> tuple[int, int]:
    """(tables, bits of each): substrings grow with the logarithm of the vectors, so that buckets don't,
    and tables until a pair at ``cosine`` agrees in one of them with probability RECALL."""
    bits = min(max(8, math.ceil(math.log2(max(n, 1) + 1)) - 5), 24)
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(1 - RECALL) / math.log(1 - same)), bits


def radius(cosine: float, bits: int) -> int:
    """Bits of a whole code in which a pair at ``cosine`` may differ: six deviations above their mean."""
    p = math.acos(cosine) / math.pi
    return math.ceil(bits * p + 6 * math.sqrt(bits * p * (1 - p)))


def unit(w: np.ndarray) -> np.ndarray:
    """Rows of ``w`` at length one; the largest component is divided out first, so that no square over- or underflows."""
    w = w / np.abs(w).max(1, keepdims=True)
    return w / np.linalg.norm(w, axis=1, keepdims=True)


def pairs_of(s: int, e: int, tile: np.ndarray, cross: bool, close) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (a < b) of rows s to e that ``close(i, j, e)`` marks, by blocks; in a group of two tiles, those across."""
    for i in range(s, e, 512):
        j = min(i + 512, e)
        a, b = np.nonzero(close(i, j, e))
        a, b = a + i, b + i
        keep = a < b
        if cross:
            keep &= tile[a] != tile[b]
        yield a[keep], b[keep]


def near(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id) for each row of ``vectors``.

    Links join rows whose vectors are of one length, have a cosine, in double precision, of at least ``cosine``
    and share a bucket of some table. Null, empty or zero vectors and those with null or non-finite components
    link with nothing. Rotations are learned for the most frequent length; others get random directions.
    Equal vectors are one entry with a count, so any number of copies costs one; a bucket with very many
    different vectors is compared tile by tile. Into the tables go codes; vectors follow only into the buckets
    where a pair within radius() of their codes meets first. A row with a null id has its links' component, if
    linked; other columns aren't looked at, and an empty table gives no rows."""
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    kind = "float" if v.schema["v"].dataType.elementType.simpleString() == "float" else "double"
    plain = F.transform("v", lambda x: x.cast(kind) + F.lit(0.0).cast(kind))
    bad = F.coalesce(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    fit = ~bad & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    good = v.where(fit).withColumn("v", plain)
    reps = spool(good.groupBy("v").agg(F.min("vec_id").alias("node_id"), F.count("*").alias("m")).withColumn("node", F.xxhash64("v")))
    lengths = reps.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).agg(F.sum("n"), F.max(F.struct("n", -F.col("d")))).first()
    if lengths[0] is None:
        free(reps)
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    n, d = lengths[0], -lengths[1][1]
    tables, bits = plan(n, cosine)
    sample = reps.where(F.size("v") == d).where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(n)) < SAMPLE).select("v").collect()
    x = np.array([r["v"] for r in sample], float).reshape(-1, d)
    turn = np.concatenate(rotations(unit(x) if len(x) else x, -(-tables * bits // d)).astype(np.float32), 1)[:, : tables * bits]
    weights = 1 << np.arange(bits, dtype=np.int64)
    number = np.dtype(np.float32 if kind == "float" else np.float64)

    def index(batches):
        for b in batches:
            flat, ends = np.asarray(b.column(0).flatten()), np.asarray(b.column(0).offsets)
            ends = ends - ends[0]
            size = np.diff(ends)
            code = np.zeros((b.num_rows, tables * bits), bool)
            for k in np.unique(size):
                at = np.flatnonzero(size == k)
                toward = turn if k == d else np.random.default_rng([7, int(k)]).standard_normal((k, tables * bits), np.float32)
                code[at] = unit(flat[ends[at][:, None] + np.arange(k)].astype(float)) @ toward >= 0
            keys = code.reshape(-1, tables, bits) @ weights + (np.arange(tables) << 32) + (size.astype(np.int64) << 40)[:, None]
            of = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * tables)
            body = [flat[i:j].astype(number).tobytes() for i, j in zip(ends, ends[1:])]
            packed = [r.tobytes() for r in np.packbits(code, axis=1)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.ListArray.from_arrays(of, pa.array(keys.ravel())), pa.array(packed, pa.binary()), pa.array(body, pa.binary())], names=["node", "m", "keys", "code", "body"])

    coded = spool(by_arrow(reps.select("v", "node", "m"), index, "node long, m long, keys array<bigint>, code binary, body binary"))
    sizes = spool(coded.select(F.explode("keys").alias("k")).groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > TILE))
    dealt = in_tiles(coded.select("node", "code", F.posexplode("keys").alias("table", "k")), sizes, TILE)

    def groups(batches, *names, rows):
        """Of each group (start, end, whether of two tiles) and the columns of its table; codes as numbers of a table and as words of 64 bits."""
        for t in whole_groups(batches, "g", rows=rows):
            g, cross = np.asarray(t.column("g")), np.asarray(t.column("cross"))
            code = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(g), -1)
            keys = np.unpackbits(code, axis=1)[:, : tables * bits].reshape(-1, tables, bits) @ weights
            words = np.pad(code, ((0, 0), (0, -code.shape[1] % 8))).view(np.uint64)
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            yield t, keys, words, [(s, e, cross[s]) for s, e in zip(starts, np.r_[starts[1:], len(g)]) if e - s > 1], *(np.asarray(t.column(c)) for c in names)

    def first_here(keys: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        """Whether each pair shares no bucket of an earlier table."""
        return ~(keys[a, :k] == keys[b, :k]).any(1)

    within = radius(cosine, tables * bits)

    def sift(batches):
        """The rows of groups in which a pair within the radius of its codes meets first."""
        for t, keys, words, found, tile, table in groups(batches, "tile", "table", rows=20_000):
            wanted = np.zeros(len(t), bool)

            def close(i, j, e):
                far = np.zeros((j - i, e - i), np.int64)
                for w in words.T:
                    far += np.bitwise_count(w[i:j, None] ^ w[i:e])
                return far <= within

            for s, e, cross in found:
                for a, b in pairs_of(s, e, tile, cross, close):
                    new = first_here(keys, a, b, table[s])
                    wanted[a[new]] = wanted[b[new]] = True
            yield from t.filter(pa.array(wanted)).select(["g", "cross", "tile", "node", "table"]).to_batches()

    def rerank(batches):
        """Of a group's pairs those not found in an earlier table: partial link counts and spanning links."""
        for t, keys, _, found, tile, node, table, m in groups(batches, "tile", "node", "table", "m", rows=4096):
            body = t.column("body").to_pylist()
            links = np.zeros(len(t), np.int64)
            pairs = [(node[:0], node[:0])]
            for s, e, cross in found:
                w = unit(np.frombuffer(b"".join(body[s:e]), number).reshape(e - s, -1).astype(float))
                for a, b in pairs_of(s, e, tile, cross, lambda i, j, e, s=s, w=w: w[i - s : j - s] @ w[i - s : e - s].T >= cosine - 1e-9):
                    near_ = np.einsum("ij,ij->i", w[a - s], w[b - s]) >= cosine
                    a, b = a[near_], b[near_]
                    new = first_here(keys, a, b, table[s])
                    a, b = a[new], b[new]
                    np.add.at(links, a, m[b])
                    np.add.at(links, b, m[a])
                    pairs.append(forest(node[a], node[b]))
            a, b = forest(np.concatenate([p for p, _ in pairs]), np.concatenate([q for _, q in pairs]))
            has = links > 0
            k = has.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[node[has], a]), pa.array(np.r_[np.zeros(k, np.int64), b], mask=np.r_[np.ones(k, bool), np.zeros(len(a), bool)]), pa.array(np.r_[links[has], np.zeros(len(a), np.int64)])], names=["a", "b", "links"])

    by_group = lambda df: df.repartition("g").sortWithinPartitions("g")
    met = spool(by_arrow(by_group(dealt.select("g", "cross", "tile", "node", "table", "code")), sift, "g long, cross boolean, tile int, node long, table int"))
    full = met.join(coded.select(F.col("node").alias("c_node"), "m", "code", "body"), F.col("node") == F.col("c_node")).drop("c_node")
    found = spool(by_arrow(by_group(full), rerank, "a long, b long, links long"))
    comp = components(found.where("b is not null").select("a", "b"))
    counts = found.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    info = reps.select("node", "m", "node_id").join(counts, "node", "left").join(comp, "node", "left")
    info = spool(info.withColumn("root", F.coalesce("root", "node")))
    low = spool(info.groupBy(F.col("root").alias("r")).agg(F.min("node_id").alias("component_id")))
    out_info = spool(info.join(low, F.col("root") == F.col("r")).select(F.col("node").alias("i_node"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")))
    free(reps, coded, sizes, met, found, comp, info, low)
    out = v.withColumn("node", F.when(fit, F.xxhash64(plain))).join(out_info, F.col("node") == F.col("i_node"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
