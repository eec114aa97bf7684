"""Cost-balanced packing of token sequences."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import bpe, common
from barlake.llm.common import by_arrow, spool

CAPACITY = 4096
#: Sequences that one group fills; groups are packed apart from each other.
GROUP_SEQUENCES = 256
END_ID = 2
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n, attention staying inside the piece.
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY


def pieces(docs: DataFrame, path: str = bpe.VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, row): each document's ids and ``end_id``, cut
    at multiples of ``capacity``. row is unique; write the result before using it."""

    def run(batches):
        e, end, row = bpe.encoder(path, "library"), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 33
        for b in batches:
            at, out = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                ids = e.ids(t or "") + end
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    part = ids[4 * s : 4 * (s + capacity)]
                    at.append(k)
                    out.append((s, len(part) // 4, zlib.crc32(part), n, row))
                    row += 1
            cols = np.array(out, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(cols[:, i]) for i in range(5)]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])

    kind = docs.schema[id_col].dataType.simpleString()
    return by_arrow(docs.select(id_col, text_col), run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, row long")


def assign(length: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece: by descending cost to the sequence of least cost that has
    room, over as many sequences as the tokens fill; what finds no room starts over."""
    cost = LINEAR * length + QUADRATIC * length.astype(float) ** 2
    todo = np.argsort(-cost, kind="stable")
    seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    first = 0
    while len(todo):
        n = max(1, -(-int(length[todo].sum()) // capacity))
        heap, used, least, left = [(0.0, i) for i in range(n)], [0] * n, int(length[todo].min()), []
        for p in todo.tolist():
            need, aside = int(length[p]), []
            while heap:
                c, i = heapq.heappop(heap)
                if used[i] + need <= capacity:
                    seq[p], off[p] = first + i, used[i]
                    used[i] += need
                    if used[i] + least <= capacity:
                        heapq.heappush(heap, (c + cost[p], i))
                    break
                aside.append((c, i))
            else:
                left.append(p)
            for x in aside:
                heapq.heappush(heap, x)
        first += n
        todo = np.array(left, np.int64)
    return seq, off


def pack(docs: DataFrame, path: str = bpe.VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost): one row per piece.

    A null or empty text is the end id alone; ids of any type, null, tied or repeated, come back as they are, each
    row with pieces of its own. A very long text is cut into full pieces. An empty table gives no rows; columns of
    other names aren't looked at. Full pieces are sequences of their own; the others are dealt at random to groups of
    about GROUP_SEQUENCES sequences, so that groups are alike whatever the order, repetition or source of
    documents, and each is packed in one task."""
    p = spool(pieces(docs, path, capacity, end_id, id_col, text_col))
    total = p.where(F.col("length") < capacity).agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // (capacity * GROUP_SEQUENCES)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    cost = (LINEAR * F.col("length") + QUADRATIC * F.col("length") * F.col("length")).alias("cost")
    full = p.where(F.col("length") == capacity).select(*names, (2 * F.col("row") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("row")  # ids stay Arrow columns, which know nulls beside whole numbers
        seq, off = assign(t.column("length").to_numpy(), capacity)
        return t.select(names[:5]).append_column("sequence_id", pa.array(2 * ((key[0].as_py() << 24) + seq))).append_column("offset", pa.array(off))

    part = p.where(F.col("length") < capacity).withColumn("bin", F.pmod(F.xxhash64("row"), F.lit(groups)))
    packed = part.groupBy("bin").applyInArrow(run, full.schema)
    return packed.unionByName(full).select("*", cost)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents", "doc_id", "text")).drop("cost")
