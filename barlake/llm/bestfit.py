"""Best-two-fit packing: bins are filled greedily, then a bin's smallest piece gives way to two that fit its gap better."""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barlake.llm import bpe, common
from barlake.llm.common import by_arrow, spool

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY = 2048
END_ID = 0
#: Sequences that one group fills; groups are packed apart from each other.
GROUP_SEQUENCES = 512
#: Sequences filled below this share are packed once more, with those of all groups.
WELL_FILLED = 15 / 16
#: Pieces up to this share of the capacity are no part of pairs and are packed last.
SMALL = 1 / 6
#: Characters whose class no Unicode version disputes: ASCII, Latin, Greek, Cyrillic, kana, the common Han ones.
PLAIN = re.compile("[\t-\r\x20-\x7e\xa0-ɏΑ-ΡΣ-ϿА-яぁ-んァ-ヴ一-龥]*")


class ByteEncoder:
    """Ids of texts as the tokenizers library gives them, little-endian. Plain texts take the faster library of the
    same vocabulary, whose order of merges is that of its ids; other texts take the tokenizers library itself."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        plain = special.keys() == {"<|endoftext|>"} and all(a < b for a, b in zip(made, made[1:])) and spec["normalizer"] is None
        self.quick = None
        if plain:
            of = {c: i for i, c in enumerate(bpe.byte_chars())}
            ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if t not in special}
            self.quick = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.special = set(special)

    def ids(self, text: str) -> np.ndarray:
        if self.quick and PLAIN.fullmatch(text):
            return np.array(self.quick.encode(text, allowed_special=self.special), "<u4")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(2)
def encoder(path: str = VOCABULARY) -> ByteEncoder:
    return ByteEncoder(path)


def pieces(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, row): each document's ids and ``end_id``; longer ones than ``capacity`` are
    cut into pieces of it, the first taking what is over. row is unique; write the result before using it."""

    def run(batches):
        e, row = encoder(path), TaskContext.get().partitionId() << 33
        for b in batches:
            at, out = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                ids = np.append(e.ids(t or ""), np.uint32(end_id)).astype("<u4").tobytes()
                n = len(ids) // 4
                stop = [*range((n - 1) % capacity + 1, n + 1, capacity)]
                for i, (s, z) in enumerate(zip([0, *stop], stop)):
                    at.append(k)
                    out.append((i, s, z - s, zlib.crc32(ids[4 * s : 4 * z]), row))
                    row += 1
            c = np.array(out, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(c[:, 0].astype(np.int32)), *[pa.array(c[:, i]) for i in range(1, 5)]], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    kind = docs.schema[id_col].dataType.simpleString()
    return by_arrow(docs.select(id_col, text_col), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, row long")


def best_two_fit(length: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset, fill of the sequence) of each piece.

    A sequence takes the largest piece that fits until none does. If it has a gap, its smallest piece is then
    replaced by the two unpacked pieces that together fill the gap and that piece's place best, if they hold more.
    Pieces up to SMALL of the capacity wait, so that pairs don't use them up, and fill the gaps at the end, largest
    first, each in the fullest sequence that has room. Pieces of a length are alike: the unpacked ones are a pile per
    length and a bit set of the lengths that are left, and so are the gaps."""
    small = int(capacity * SMALL)
    order = np.argsort(length, kind="stable").tolist()
    count = np.bincount(length, minlength=capacity + 1)
    first = (np.cumsum(count) - count).tolist()
    left = count.tolist()
    open_ = sum(1 << n for n in np.flatnonzero(count).tolist() if n > small)

    def largest(limit: int) -> int:
        """The largest unpacked length up to ``limit``; 0 for none."""
        return max((open_ & ((1 << (limit + 1)) - 1)).bit_length() - 1, 0) if limit > 0 else 0

    def take(n: int) -> tuple[int, int]:
        nonlocal open_
        left[n] -= 1
        if not left[n]:
            open_ &= ~(1 << n)
        return n, order[first[n] + left[n]]

    def give(n: int, p: int) -> None:
        nonlocal open_
        order[first[n] + left[n]] = p
        left[n] += 1
        open_ |= 1 << n

    def pair(gap: int, least: int) -> tuple[int, int] | None:
        """The unpacked lengths a >= b of largest sum in (least, gap]."""
        best, found = least, None
        a = largest(gap - 1)
        while a and 2 * a > best:
            b = largest(min(a, gap - a))
            if b == a and left[a] < 2:
                b = largest(a - 1)
            if b and a + b > best:
                best, found = a + b, (a, b)
                if best == gap:
                    break
            a = largest(a - 1)
        return found

    packed: list[list[tuple[int, int]]] = []
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    while open_:
        room, held = capacity, []
        while n := largest(room):
            held.append(take(n))
            room -= n
        n, p = held[-1]
        if room and (found := pair(room + n, n)):
            held.pop()
            give(n, p)
            held += [take(found[0]), take(found[1])]
            room += n - sum(found)
        gaps[room].append(len(packed))
        packed.append(held)
    some = sum(1 << n for n in range(1, capacity + 1) if gaps[n])
    for n in range(small, 0, -1):
        while left[n]:
            fits = some >> n
            if fits:
                room = (fits & -fits).bit_length() - 1 + n
                at = gaps[room].pop()
                if not gaps[room]:
                    some &= ~(1 << room)
            else:
                room, at = capacity, len(packed)
                packed.append([])
            packed[at].append(take(n))
            gaps[room - n].append(at)
            if room > n:
                some |= 1 << (room - n)
    seq, off, fill = (np.zeros(len(length), np.int64) for _ in range(3))
    for i, held in enumerate(packed):
        at, total = 0, sum(n for n, _ in held)
        for n, p in held:
            seq[p], off[p], fill[p] = i, at, total
            at += n
    return seq, off, fill


def _in_groups(p: DataFrame, capacity: int, salt: int) -> DataFrame:
    """``p`` with seq, offset and fill, packed in random groups of about GROUP_SEQUENCES sequences."""
    total = p.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // (capacity * GROUP_SEQUENCES)))

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("row")
        seq, off, fill = best_two_fit(t.column("length").to_numpy(), capacity)
        t = t.drop_columns(["bin"])
        for name, c in (("seq", (key[0].as_py() << 24) + seq), ("offset", off), ("fill", fill)):
            t = t.append_column(name, pa.array(c))
        return t

    kinds = ", ".join(f"{n} {k}" for n, k in p.dtypes)
    return p.withColumn("bin", F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(groups))).groupBy("bin").applyInArrow(run, f"{kinds}, seq long, offset long, fill long")


def pack(docs: DataFrame, path: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece, in few sequences.

    A null or empty text is the end id alone; ids of any type, null, tied or repeated, come back as they are, each row with
    pieces of its own. A very long text gives full pieces, which are sequences of their own. An empty table gives no
    rows; columns of other names aren't looked at. The other pieces are dealt at random to groups that fill about
    GROUP_SEQUENCES sequences, alike whatever the order, repetition or source of documents; each group is packed in one
    task. What lies in sequences that are not well filled then, as each group's last, is dealt to groups and packed anew."""
    p = spool(pieces(docs, path, capacity, end_id, id_col, text_col))
    part = p.where(F.col("length") < capacity)
    once = spool(_in_groups(part, capacity, 0))
    loose = F.col("fill") < int(capacity * WELL_FILLED)
    again = _in_groups(once.where(loose).drop("seq", "offset", "fill"), capacity, 1)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    row = lambda df, seq, k, at: df.select(*names, (3 * seq + k).alias("sequence_id"), at.cast("long").alias("offset"))
    full = row(p.where(F.col("length") == capacity), F.col("row"), 0, F.lit(0))
    return full.unionByName(row(once.where(~loose), F.col("seq"), 1, F.col("offset"))).unionByName(row(again, F.col("seq"), 2, F.col("offset")))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents", "doc_id", "text"))
