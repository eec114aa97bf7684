"""Scores of a causal self-attention model over subword ids, trained in numpy by all tasks.

Subwords fall into classes by frequency and by whether they end a word; half of the classes are single subwords. The
model gives the class of the next subword from the classes before it. Inside a class, counts of the whole training text give the subword:
at the start of a word by the subword before, else by the word's last subword and its whole beginning.
Training is data parallel: texts are dealt by hash to shards of a fixed size, a task walks over all windows of a
shard in a fixed order, and the shards' weights are averaged by Spark, weighted by tokens, after each round. So
the weights follow from the rows alone, not from the files or partitions that hold them. Scoring runs overlapping windows in
batches with a causal mask; each token counts once, in the first window that holds it.
"""

from __future__ import annotations

import copy
import json
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import bpe, common
from barlake.llm.common import by_arrow, free, spool

#: Model: classes, width, window and from one window to the next; the end of a text is class 0, as is the start before it.
CLASSES, WIDTH, WINDOW, STEP = 256, 16, 32, 16
#: Classes are scored by groups of as many, neighbours in number.
GROUPS = 16
MEMBERS = CLASSES // GROUPS
#: Places of context before those that a window scores.
LEAD = WINDOW - STEP
#: Windows scored at once: their arrays stay in a core's cache.
AT_ONCE = 128
#: Texts whose subwords are scored at once, for the same reason.
TEXTS_AT_ONCE = 32
#: Rounds of averaging, each over its share of the training texts (together all windows of all of them), and the step size.
TRAIN_ROUNDS, RATE = 4, 0.02
#: Windows of a step of training, at least.
PER_STEP = 64
#: Frequent words whose counts every task holds; the others' counts are joined.
FREQUENT = 100_000
#: Frequent pairs of a subword, or a word's beginning, and the next subword that every task holds, of either kind, and what
#: they count against; the others are joined with the blocks of texts that hold them.
PAIRS = 500_000
#: Subwords of a block of texts, at least but for a task's last.
BLOCK_TOKENS = 1_000_000
#: Neighbouring subwords that a task sums up at once.
GATHERED = 2_000_000
#: Training tokens of a shard: what one task learns from in a round, wherever the rows lie.
SHARD_TOKENS = 250_000
END = " "
SMOOTH = 0.1


def words(text: str) -> list[bytes]:
    return text.encode("utf-8").lower().split()


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def ones(n: int) -> np.ndarray:
    return ONES[:n] if n <= len(ONES) else np.ones(n, np.float32)


ONES = np.ones(1 << 12, np.float32)


def exp_of(z: np.ndarray, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(exp(z) where ``seen`` is 1, else 0, up to a factor for each row; one over the rows' sums); ``z`` is overwritten."""
    if max(z.max(initial=0), -z.min(initial=0)) > 60:  # beyond the range of exp
        z -= (z if seen is None else np.where(seen, z, -np.inf)).max(-1, keepdims=True)
        np.minimum(z, 0, out=z)
    np.exp(z, out=z)
    if seen is not None:
        z *= seen
    return z, 1 / (z @ ONES[: z.shape[-1]])


class Attention:
    """One layer, one head: class and place embeddings, causal attention added to them, class scores in two levels: those of
    GROUPS groups of classes, then those of the group's members, so that a place costs a row of each instead of all classes."""

    SHAPES = {"e": (CLASSES, WIDTH), "pos": (WINDOW, WIDTH), "q": (WIDTH, WIDTH), "kv": (WIDTH, 2 * WIDTH), "o": (WIDTH, GROUPS), "b": (GROUPS,), "deep": (GROUPS, WIDTH, MEMBERS), "deep_b": (GROUPS, MEMBERS)}
    SIZE = sum(math.prod(shape) for shape in SHAPES.values())
    #: Places that a place sees.
    SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))
    SCALE = np.float32(1 / math.sqrt(WIDTH))

    def __init__(self, flat: np.ndarray | None = None, bias: np.ndarray | None = None) -> None:
        rng = np.random.default_rng(5)
        self.all = (rng.standard_normal(self.SIZE) * 0.3 if flat is None else flat).astype(np.float32)
        for name, part in self.parts(self.all).items():
            setattr(self, name, part)
        if flat is None and bias is not None:  # starts as the shares of the classes themselves
            self.o[:], self.deep[:] = 0, 0
            self.deep_b[:] = bias.reshape(GROUPS, MEMBERS)
            self.b[:] = np.logaddexp.reduce(bias.reshape(GROUPS, MEMBERS), 1)

    @classmethod
    def parts(cls, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Views of ``flat`` by name."""
        out, at = {}, 0
        for name, shape in cls.SHAPES.items():
            out[name] = flat[at : at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
        return out

    def flat(self) -> np.ndarray:
        return self.all.copy()

    def forward(self, c: np.ndarray):
        """Log-probabilities (natural) of the next class at each place of windows ``c`` (n, WINDOW)."""
        x = self.e[c] + self.pos
        k, v = np.split(x @ self.kv, 2, 2)
        s, of_one = exp_of(x @ (self.q * self.SCALE) @ k.transpose(0, 2, 1), self.SEEN)
        h = x + s @ v * of_one[..., None]
        z, deep = h @ self.o + self.b, np.einsum("nij,gjk->nigk", h, self.deep) + self.deep_b
        for y in (z, deep):
            y -= y.max(-1, keepdims=True)
            y -= np.log(np.exp(y).sum(-1, keepdims=True))
        return (z[..., None] + deep).reshape(*c.shape, CLASSES), h

    def seen(self, c: np.ndarray) -> tuple[np.ndarray, ...]:
        """(inputs of all places and of the last STEP, keys and values, queries times SCALE, what each of these places attends to and
        by what its row is to be multiplied to sum to 1, what it gets)."""
        n = len(c)
        x = self.e.take(c.ravel(), 0).reshape(n, WINDOW, WIDTH)
        x += self.pos
        last = x[:, LEAD:].reshape(-1, WIDTH)
        kv = (x.reshape(-1, WIDTH) @ self.kv).reshape(n, WINDOW, 2 * WIDTH)
        q = (last @ (self.q * self.SCALE)).reshape(n, STEP, WIDTH)
        s, of_one = exp_of(q @ kv[..., :WIDTH].transpose(0, 2, 1), self.SEEN[LEAD:])
        got = s @ kv[..., WIDTH:]
        got *= of_one[..., None]
        return x, last, kv, q, s, of_one, got.reshape(-1, WIDTH)

    def members(self, h: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, ...]:
        """(order of the rows by the group of ``target``, the groups in it, ``h`` in it, the group's scores of its members, [(group, its rows)])."""
        group = (target // MEMBERS).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        group = group[order]
        edges = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        runs = [(g, slice(a, b)) for g, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
        h, z = h.take(order, 0), np.empty((len(h), MEMBERS), np.float32)
        for g, rows in runs:
            np.matmul(h[rows], self.deep[g], out=z[rows])
        z += self.deep_b.take(group, 0)
        return order, group, h, z, runs

    def table(self) -> tuple[np.ndarray, ...]:
        """Keys and values, queries times SCALE, and inputs of each class at each place, WINDOW rows a class."""
        x = (self.e[:, None] + self.pos).reshape(-1, WIDTH)
        return x @ self.kv, x @ (self.q * self.SCALE), x

    def log_probability(self, c: np.ndarray, target: np.ndarray, table: tuple[np.ndarray, ...]) -> np.ndarray:
        """Natural log-probability of the target at each of the last STEP places, in fewer passes than forward();
        ``table`` is table()'s result."""
        at = c * WINDOW + np.arange(WINDOW)
        late = at[:, LEAD:]
        kv, q, x = (y.take(i, 0) for y, i in zip(table, (at, late, late)))
        s, of_one = exp_of(q @ kv[..., :WIDTH].transpose(0, 2, 1), self.SEEN[LEAD:])
        h = s @ kv[..., WIDTH:]
        h *= of_one[..., None]
        h += x
        h = h.reshape(-1, WIDTH)
        t = target[:, LEAD:].ravel()
        order, group, h, z, _ = self.members(h, t)
        top = h @ self.o
        top += self.b
        at = np.arange(len(t))
        got = top[at, group] + z[at, t[order] % MEMBERS]
        for y in (top, z):
            np.exp(y, out=y)
            got -= np.log(y @ ONES[: y.shape[1]])
        out = np.empty_like(got)
        out[order] = got
        out = out.reshape(-1, STEP)
        if not np.isfinite(out).all():  # scores beyond the range of exp
            out = np.take_along_axis(self.forward(c)[0], target[..., None], 2)[:, LEAD:, 0]
        return out

    def step(self, c: np.ndarray, target: np.ndarray, weight: np.ndarray, rate: float, moments: dict | None = None) -> None:
        """One step of gradient descent on the mean loss of the weighted ones of the last STEP places; with ``moments``, which it
        keeps, each weight's step goes by the running mean and square of its gradients."""
        n = len(c)
        wide = lambda y: y.reshape(n, STEP, WIDTH)
        x, last, kv, q, s, of_one, got = self.seen(c)
        h = got + last
        t, w = target[:, LEAD:].ravel(), weight[:, LEAD:].ravel()
        w = w / max(w.sum(), 1)
        order, group, hs, z, runs = self.members(h, t)
        top = h @ self.o
        top += self.b
        at = np.arange(len(t))
        for y, weights, right in ((top, w, t // MEMBERS), (z, w[order], t[order] % MEMBERS)):
            y, part = exp_of(y)
            y *= (weights * part)[:, None]
            y[at, right] -= weights
        all_grad = np.zeros(self.SIZE, np.float32)
        grad = self.parts(all_grad)
        np.matmul(h.T, top, out=grad["o"])
        np.matmul(ones(len(top)), top, out=grad["b"])
        dhs, back = np.empty_like(hs), np.empty_like(order)
        for g, rows in runs:
            y = z[rows]
            np.matmul(hs[rows].T, y, out=grad["deep"][g])
            np.matmul(ones(len(y)), y, out=grad["deep_b"][g])
            np.matmul(y, self.deep[g].T, out=dhs[rows])
        dh = top @ self.o.T
        back[order] = at
        dh += dhs.take(back, 0)
        deep = wide(dh) * of_one[..., None]
        ds = deep @ kv[..., WIDTH:].transpose(0, 2, 1)
        ds -= np.einsum("nij,nij->ni", deep, wide(got))[..., None]
        ds *= s
        dkv = np.empty_like(kv)
        np.matmul(ds.transpose(0, 2, 1), q, out=dkv[..., :WIDTH])  # q holds the scale
        np.matmul(s.transpose(0, 2, 1), deep, out=dkv[..., WIDTH:])
        dq = (ds @ kv[..., :WIDTH]).reshape(-1, WIDTH)
        dq *= self.SCALE
        np.matmul(last.T, dq, out=grad["q"])
        dkv = dkv.reshape(-1, 2 * WIDTH)
        np.matmul(x.reshape(-1, WIDTH).T, dkv, out=grad["kv"])
        dx = (dkv @ self.kv.T).reshape(n, WINDOW, WIDTH)
        dh += dq @ self.q.T
        dx[:, LEAD:] += wide(dh)
        np.matmul(ones(n), dx.reshape(n, -1), out=grad["pos"].reshape(-1))
        each = c.astype(np.uint8).ravel()
        order = np.argsort(each, kind="stable")
        each = each[order]
        first = np.flatnonzero(np.r_[True, each[1:] != each[:-1]])
        grad["e"][each[first]] = np.add.reduceat(dx.reshape(-1, WIDTH).take(order, 0), first, 0)
        d = np.clip(all_grad, -1, 1, out=all_grad)
        if moments is not None:
            moments["n"] = k = moments.get("n", 0) + 1
            mean, square = moments.setdefault("mean", np.zeros_like(d)), moments.setdefault("square", np.zeros_like(d))
            mean *= 0.9
            mean += 0.1 * d
            square *= 0.99
            d *= d
            d *= 0.01
            square += d
            np.sqrt(square, out=d)
            d *= np.float32(1 / math.sqrt(1 - 0.99**k))
            d += 1e-8
            np.divide(mean, d, out=d)
            d *= np.float32(1 / (1 - 0.9**k))
        d *= np.float32(rate)
        self.all -= d


class Windows:
    """The overlapping windows of a batch of texts, given as 16-bit ids: each scores the last STEP places after
    LEAD places of context; what lies before a text is class 0. Windows are cut out when asked for."""

    def __init__(self, texts: list[bytes], cls: np.ndarray) -> None:
        sizes = np.array([len(t) // 2 + 1 for t in texts], np.int64)
        self.count = -(-sizes // STEP)  # windows of each text
        self.first = np.cumsum(sizes) - sizes  # its first token
        begin = np.cumsum(LEAD + self.count * STEP) - (LEAD + self.count * STEP)
        total = int(sizes.sum())
        self.ids = np.full(total, len(cls) - 1, np.int64)  # the end, after the ids of each text
        held = np.ones(total, bool)
        held[self.first + sizes - 1] = False
        self.ids[held] = np.frombuffer(b"".join(texts), "<u2")
        at = np.arange(total) + np.repeat(begin + LEAD - self.first, sizes)
        room = int((LEAD + self.count * STEP).sum())
        self.inputs, self.targets, self.new = np.zeros(room + 1, np.int64), np.zeros(room, np.int64), np.zeros(room, bool)
        self.inputs[at + 1] = self.targets[at] = cls[self.ids]
        self.new[at] = True
        self.of = np.repeat(np.arange(len(texts)), self.count)
        self.nth = np.arange(len(self.of)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        self.start = np.repeat(begin, self.count) + self.nth * STEP

    def cut(self, which) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, targets, whether a place is scored) of the windows ``which``."""
        at = self.start[which, None] + np.arange(WINDOW)
        return self.inputs[at], self.targets[at], self.new[at] & (np.arange(WINDOW) >= LEAD)


def subwords(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, held, text_hash, ids, block): the subword ids of each text as 16-bit integers, the end not included. Texts
    that a task reads one after another form a block, of BLOCK_TOKENS subwords or so."""

    def run(batches):
        e = bpe.encoder(path, "library")
        block, room = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            ids = [np.frombuffer(e.ids(t or ""), "<u4").astype("<u2").tobytes() for t in b.column(1).to_pylist()]
            blocks = []
            for i in ids:
                if room > BLOCK_TOKENS:
                    block, room = block + 1, 0
                blocks.append(block)
                room += len(i) // 2 + 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([held_out(i) for i in doc_ids]), b.column(2), pa.array(ids, pa.binary()), pa.array(blocks, pa.int64())], names=["doc_id", "held", "text_hash", "ids", "block"])

    return by_arrow(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held boolean, text_hash long, ids binary, block long")


def word_ends(path: str, size: int) -> np.ndarray:
    """Whether each id (and the end of a text, after the last) ends a word: what is no beginning of one does."""
    out = np.ones(size + 1, bool)
    vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    if max(vocab.values(), default=0) >= size:
        raise ValueError(f"ids of the vocabulary must be below {size}")
    for token, i in vocab.items():
        out[i] = token.endswith(bpe.END)
    return out


def before(ids: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """The id before each of ``ids``; texts begin at ``first``, where it is ``end``."""
    out = np.roll(ids, 1)
    out[first] = end
    return out


def joined(h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    h = (h.view(np.uint64) + ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def beginnings(last: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes): the places after two or more subwords of their word, and a hash of these subwords."""
    at = np.arange(len(last))
    first = np.maximum.accumulate(np.where(start, at, 0))
    nth = at - first
    deep = np.flatnonzero(nth > 1)
    # sums of mixed ids times powers of an odd number: a word's part of them, turned back to the same power
    power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(len(last) - 1, 0), ODD)][: len(last)])
    back = np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(len(last) - 1, 0), INVERSE)][: len(last)])
    sums = np.add.accumulate(joined(np.zeros(len(last), np.int64), last).view(np.uint64) * power)
    h = (sums[deep] - sums[first[deep]]) * back[first[deep]]
    return deep, joined(h.view(np.int64), nth[deep])


#: An odd number and its inverse, modulo 2 ** 64.
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order and the sum of the counts of each."""
    if not len(keys):
        return keys, counts
    o = np.argsort(keys)
    keys = keys[o]
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[edge], np.add.reduceat(counts[o], edge)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """summed() of keys that count once each: a plain sort, which needs no order of places."""
    keys = np.sort(keys)
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[edge], np.diff(np.r_[edge, len(keys)])


def neighbours(ids: DataFrame, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """(counts, counts at starts of words, pairs (id, c) as a table) in training texts. Counts are by id, the end of
    a text after the last: the vocabulary bounds them. A pair is a subword and the next one (the end before a
    text's first), given as one number."""
    size = len(ends) - 1

    def run(batches):
        n = np.zeros(2 * size + 2, np.int64)
        raw, room = [np.zeros(0, np.int64)], 0
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def together() -> tuple[np.ndarray, np.ndarray]:
            k, c = counted(np.concatenate(raw))
            return summed(np.r_[keys, k], np.r_[sums, c])

        for b in batches:
            ws = Windows(b.column(0).to_pylist(), np.zeros(size + 1, np.int64))
            last = before(ws.ids, ws.first, size)
            n[: size + 1] += np.bincount(ws.ids, minlength=size + 1)
            n[size + 1 :] += np.bincount(ws.ids[ends[last]], minlength=size + 1)
            raw.append(last * (size + 1) + ws.ids)
            room += len(last)
            if room > GATHERED:
                keys, sums = together()
                raw, room = raw[:1], 0
            if len(keys) > GATHERED:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["id", "c"])
                keys, sums = keys[:0], sums[:0]
        keys, sums = together()
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1 - at, keys]), pa.array(np.r_[n[at], sums])], names=["id", "c"])

    rows = spool(by_arrow(ids.where("not held").select("ids"), run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")))
    out = np.zeros(2 * size + 2, np.int64)
    for r in rows.where("id < 0").collect():
        out[-1 - r["id"]] = r["c"]
    return out[: size + 1], out[size + 1 :], rows.where("id >= 0")


def word_beginnings(counts: DataFrame, path: str, ends: np.ndarray) -> DataFrame:
    """(id, c, head): pairs of a word's beginning of two subwords or more and the next one, by 64-bit hashes, their
    counts and beginnings. No subword reaches over white space, so that ``counts`` of words tell them."""
    size = len(ends) - 1

    def run(batches):
        e = bpe.encoder(path, "library")
        for b in batches:
            ids = [np.frombuffer(e.ids(w.decode("utf-8")), "<u4") for w in b.column(0).to_pylist()]
            n = np.array([len(i) for i in ids])
            if not n.sum():
                continue
            flat, c = np.concatenate(ids).astype(np.int64), np.repeat(np.asarray(b.column(1)), n)
            last = before(flat, (np.cumsum(n) - n)[n > 0], size)
            deep, head = beginnings(last, ends[last])
            yield pa.RecordBatch.from_arrays([pa.array(joined(head, flat[deep])), pa.array(c[deep]), pa.array(head)], names=["id", "c", "head"])

    rows = by_arrow(counts.where(F.col("word") != F.lit(END.encode())).select("word", "c"), run, "id long, c long, head long")
    return rows.groupBy("id").agg(F.sum("c").alias("c"), F.min("head").alias("head"))


def share_rows(pairs: DataFrame, longer: DataFrame, cls: np.ndarray, ends: np.ndarray) -> DataFrame:
    """(kind, key, c, value) of all pairs (kinds 0 and 2) and of what they count against (1 and 3), a written table: the
    share of a pair, and what the pairs of a group leave to what is known without them."""
    size, row = len(cls), word_rows(ends)

    def run(batches):
        for b in batches:
            last, ids = np.divmod(np.asarray(b.column(0)), size)
            group = np.where(ends[last], start_group(row, cls, last, ids), INSIDE - last)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(group)], names=["key", "c", "group"])

    near = by_arrow(pairs.select("id", "c"), run, "key long, c long, group long").withColumn("kind", F.lit(0))
    far = longer.select(F.col("id").alias("key"), "c", F.col("head").alias("group"), F.lit(2).alias("kind"))
    every = spool(near.unionByName(far))
    groups = spool(every.groupBy("kind", "group").agg(F.sum("c").alias("n"), F.count("*").alias("kinds")))
    mine = every.join(groups, ["kind", "group"]).select("kind", "key", "c", (F.col("c") / (F.col("n") + F.col("kinds"))).alias("value"))
    rest = groups.select((F.col("kind") + 1).alias("kind"), F.col("group").alias("key"), F.col("n").alias("c"), (F.col("kinds") / (F.col("n") + F.col("kinds"))).alias("value"))
    out = spool(mine.unionByName(rest))
    free(every, groups)
    return out


#: Keys of what pairs inside words count against: this less the subword; those at starts are negative numbers above.
INSIDE = -(1 << 40)


def word_rows(ends: np.ndarray) -> np.ndarray:
    """The number of each id that ends a word among them."""
    return np.where(ends, np.cumsum(ends) - 1, 0)


def start_group(row: np.ndarray, cls: np.ndarray, last: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The key of what a pair at the start of a word counts against: all that follow ``last`` and are of the class of ``ids``."""
    return -1 - (row[last] * CLASSES + cls[ids])


def in_class(cls: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 share of each id in its class by ``counts``."""
    n = counts + SMOOTH
    return np.log10(n / np.bincount(cls, n, CLASSES)[cls])


def classes_of(counts: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(class, log10 share inside the class) of each id; the end is class 0. The most frequent ids have
    classes of their own, the others share the rest by mass, so that classes are balanced; ids that end
    words and others have classes apart."""
    size = len(counts) - 1
    order = np.argsort(-counts[:size], kind="stable")
    cls = np.zeros(size + 1, np.int64)
    own = CLASSES // 2
    cls[order[:own]] = np.arange(1, own + 1)
    rest, room, at = order[own:], CLASSES - own - 1, own + 1
    groups = [rest] if ends is None else [rest[ends[rest]], rest[~ends[rest]]]
    mass = [float((counts[g] + SMOOTH).sum()) for g in groups]
    for k, g in enumerate(groups):
        n = room if len(groups) == 1 else min(max(1, round(room * mass[0] / max(sum(mass), SMOOTH))), room - 1) if k == 0 else CLASSES - at
        upto = np.cumsum(counts[g] + SMOOTH)
        if len(g):
            cls[g] = at + np.minimum((upto / upto[-1] * n).astype(np.int64), n - 1)
        at += n
    return cls, in_class(cls, counts)


class Shares:
    """log10 probability of each subword, given that of its class and the subwords of the word before it.

    At the start of a word the class is the model's alone, and the subword before tells its members apart.
    Where a word goes on, its last subword, then its whole beginning, count against what is known without them.
    What is known without them counts as often as there were different subwords after what is counted."""

    def __init__(self, cls: np.ndarray, ends: np.ndarray, counts: np.ndarray, starts: np.ndarray, pairs: np.ndarray, sums: np.ndarray, longer: np.ndarray, heads: np.ndarray, longer_sums: np.ndarray) -> None:
        longer, one = np.unique(longer, return_index=True)  # of equal hashes, one
        last, ids = pairs // len(cls), pairs % len(cls)
        groups, of = np.unique(np.where(ends[last], start_group(word_rows(ends), cls, last, ids), INSIDE - last), return_inverse=True)
        share, rest = self.weights(of, sums, len(groups))
        heads, of = np.unique(heads[one], return_inverse=True)
        longer_share, longer_rest = self.weights(of, longer_sums[one], len(heads))
        self.hold(cls, ends, counts, starts, [(pairs, share), (groups, rest), (longer, longer_share), (heads, longer_rest)])

    def hold(self, cls: np.ndarray, ends: np.ndarray, counts: np.ndarray, starts: np.ndarray, values: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Take ``values``: keys and their values by kind, as share_rows() gives them."""
        self.cls, self.ends, self.row = cls, ends, word_rows(ends)
        self.alone = 10.0 ** np.stack([in_class(cls, counts - starts), in_class(cls, starts)])  # inside words, at their starts
        # the last value is that of keys without a pair
        self.values = [(pd.Index(k), np.r_[v, float(kind % 2)]) for kind, (k, v) in enumerate(values)]
        self.more = None

    @classmethod
    def of_frequent(cls, classes: np.ndarray, ends: np.ndarray, counts: np.ndarray, starts: np.ndarray, rows: DataFrame) -> tuple[Shares, bool]:
        """(the shares that hold PAIRS rows at most of each kind of share_rows(), those of the largest counts, whether these are all)."""
        out, values, whole = cls.__new__(cls), [], True
        for kind in range(4):
            mine = rows.where(F.col("kind") == kind)
            low = frequent_from(mine, PAIRS)
            whole &= low == 1
            t = mine.where(F.col("c") >= low).select("key", "value").orderBy("key").toArrow()
            k, one = np.unique(np.asarray(t.column("key"), np.int64), return_index=True)
            values.append((k, np.asarray(t.column("value"), float)[one]))
        out.hold(classes, ends, counts, starts, values)
        return out, whole

    @staticmethod
    def weights(of: np.ndarray, sums: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
        """(share of each count, what each of ``room`` groups leaves to what is known without it)."""
        kinds = np.bincount(of, minlength=room)
        n = np.bincount(of, sums, room) + kinds
        return sums / n[of] if len(of) else np.zeros(0), np.where(kinds > 0, kinds / np.maximum(n, 1), 1.0)

    def keys(self, ids: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(places after two or more subwords of their word, keys of each kind)."""
        start = self.ends[last]
        deep, head = beginnings(last, start)
        group = np.where(start, start_group(self.row, self.cls, last, ids), INSIDE - last)
        return deep, [last * len(self.cls) + ids, group, joined(head, ids[deep]), head]

    def lacking(self, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The different keys that are not held."""
        return np.unique(np.concatenate([k[index.get_indexer(k) < 0] for k, (index, _) in zip(self.keys(ids, last)[1], self.values)]))

    def with_more(self, keys: np.ndarray, values: np.ndarray) -> Shares:
        """These shares and the values of ``keys``, which are not held."""
        out = copy.copy(self)
        keys, one = np.unique(keys, return_index=True)
        out.more = pd.Index(keys), values[one]
        return out

    def value(self, kind: int, keys: np.ndarray) -> np.ndarray:
        index, values = self.values[kind]
        at = index.get_indexer(keys)
        out = values[at]
        if self.more is not None:
            lack = np.flatnonzero(at < 0)
            at = self.more[0].get_indexer(keys[lack])
            out[lack[at >= 0]] = self.more[1][at[at >= 0]]
        return out

    def __call__(self, ids: np.ndarray, last: np.ndarray, of_class: np.ndarray) -> np.ndarray:
        start = self.ends[last]
        deep, keys = self.keys(ids, last)
        share, rest = self.value(0, keys[0]), self.value(1, keys[1])
        of_class = np.exp(of_class * math.log(10))
        alone = self.alone[start.astype(np.int64), ids]
        # inside a word the class counts too; at a start it is the model's alone
        p = np.where(start, of_class * (share + rest * alone), share + rest * of_class * alone)
        if len(deep):
            p[deep] *= self.value(3, keys[3])
            p[deep] += self.value(2, keys[2])
        return np.log10(p)


def learn(batches, start: np.ndarray, cls: np.ndarray):
    """A shard's part of a round: steps over every window of the texts, from the weights ``start``. Gives the
    weights times the tokens learned from, and these, as rows (at, sum)."""
    m, seen, held, moments = Attention(start), 0, [], {}

    def step() -> None:
        nonlocal seen
        c, t, w = held[0] if len(held) == 1 else (np.concatenate(y) for y in zip(*held))
        m.step(c, t, w.astype(np.float32), RATE, moments)
        seen += int(w.sum())
        held.clear()

    for b in batches:
        ws = Windows(b.column(0).to_pylist(), cls)
        for at in range(0, len(ws.start), PER_STEP):
            held.append(ws.cut(np.arange(at, min(at + PER_STEP, len(ws.start)))))
            if sum(len(h[0]) for h in held) >= PER_STEP:
                step()
    if held:
        step()
    if seen:
        flat = m.flat().astype(float) * seen
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat) + 1)), pa.array(np.r_[flat, seen])], names=["at", "sum"])


def train(ids: DataFrame, cls: np.ndarray, counts: np.ndarray) -> np.ndarray:
    mass = np.bincount(cls, counts, CLASSES) + 1.0
    model = Attention(bias=np.log(mass / mass.sum()))
    shards = max(1, -(-int(counts.sum()) // (TRAIN_ROUNDS * SHARD_TOKENS)))
    spread = F.pmod(F.xxhash64("text_hash"), F.lit(shards)).cast("int").alias("shard")
    for n in range(TRAIN_ROUNDS):
        start, part = model.flat(), F.pmod("text_hash", F.lit(TRAIN_ROUNDS)) == n

        def run(batches, start=start):
            yield from learn(batches, start, cls)  # a partition is a shard

        mine = ids.where("not held").where(part).select(spread, "text_hash", "ids").repartitionById(shards, "shard").sortWithinPartitions("text_hash", "ids")
        rows = by_arrow(mine.select("ids"), run, "at long, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).orderBy("at").collect()
        if rows:
            got = np.array([r["sum"] for r in rows])
            model = Attention(got[:-1] / got[-1])
    return model.flat()


def model_scores(ids: DataFrame, cls: np.ndarray, shares: Shares, flat: np.ndarray, rows: DataFrame | None = None) -> DataFrame:
    """(doc_id, held, text_hash, score): log10 probability of each text and its end. With ``rows`` (share_rows()) what
    ``shares`` don't hold is joined: each block of texts asks for its different keys, and meets their values."""
    spark = ids.sparkSession
    held = spark.sparkContext.broadcast((cls, shares, flat))  # bounded by the vocabulary and PAIRS

    def scored(batches, shares: Shares):
        cls, _, flat = held.value
        m = Attention(flat)
        table = m.table()
        for b in (b.slice(at, TEXTS_AT_ONCE) for b in batches for at in range(0, b.num_rows, TEXTS_AT_ONCE)):
            ws = Windows(b.column(3).to_pylist(), cls)
            parts = [np.zeros(0, np.float32)]
            for at in range(0, len(ws.start), AT_ONCE):
                c, t, w = ws.cut(np.arange(at, min(at + AT_ONCE, len(ws.start))))
                parts.append(m.log_probability(c, t, table)[w[:, LEAD:]])  # each token once, in the order of the texts
            of_class = np.concatenate(parts).astype(float) / math.log(10)
            each = shares(ws.ids, before(ws.ids, ws.first, len(cls) - 1), of_class)
            score = np.add.reduceat(each, ws.first) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(3)], pa.array(score)], names=["doc_id", "held", "text_hash", "score"])

    schema = f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, held boolean, text_hash long, score double"
    if rows is None:
        return by_arrow(ids, lambda batches: scored(batches, held.value[1]), schema)

    def ask(batches):
        cls, shares, _ = held.value
        for b in batches:
            blocks = np.asarray(b.column(1))
            for block in np.unique(blocks):
                ws = Windows(b.column(0).filter(pa.array(blocks == block)).to_pylist(), cls)
                keys = shares.lacking(ws.ids, before(ws.ids, ws.first, len(cls) - 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block)), pa.array(keys)], names=["block", "key"])

    def meet(texts: pa.Table, values: pa.Table) -> pa.Table:
        more = held.value[1].with_more(np.asarray(values.column("key"), np.int64), np.asarray(values.column("value"), float))
        return pa.Table.from_batches(scored(texts.to_batches(), more))

    values = by_arrow(ids.select("ids", "block"), ask, "block long, key long").join(rows.select("key", "value"), "key").select("block", "key", "value")
    return ids.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(meet, schema)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c): tokens of the training texts, each text's end included; tasks add up before the shuffle."""

    def run(batches):
        from collections import Counter

        n: Counter = Counter()
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not held_out(i):
                    n.update(words(t or ""))
                    n[END.encode()] += 1
                if len(n) > 400_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "c"])
                    n.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "c"])

    rows = by_arrow(docs.select("doc_id", "text"), run, "word binary, c long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


def frequent_from(counts: DataFrame, most: int | None = None) -> int:
    """The least count such that at most ``most`` (FREQUENT) words have it or a larger one (1 if all words fit), on a scale of
    five leading bits, whose table of words per step is small."""
    steps = counts.groupBy(F.expr("shiftleft(shiftright(c, greatest(0, length(bin(c)) - 5)), greatest(0, length(bin(c)) - 5))").alias("at")).agg(F.count("*").alias("n")).orderBy(F.desc("at")).collect()
    total, low = 0, None
    for r in steps:
        total += r["n"]
        if total > (FREQUENT if most is None else most):
            return low if low is not None else r["at"] * 2
        low = r["at"]
    return 1


def base_scores(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_tokens, n_known, train_tokens, base_score) of each distinct doc_id and text by word_counts().

    Counts of FREQUENT words go to every task; the rest of a text's words are summed per text and
    joined with their counts by the word's hash, so no task needs the whole vocabulary."""
    total, kinds = counts.agg(F.sum("c"), F.count("*")).first()
    total, kinds = total or 0, kinds or 0
    floor = SMOOTH / (total + SMOOTH * (kinds + 1))
    low = frequent_from(counts)
    top = counts.where(F.col("c") >= low).collect()
    known = docs.sparkSession.sparkContext.broadcast({bytes(r["word"]): math.log10((r["c"] + SMOOTH) / SMOOTH * floor) for r in top})
    last = low - 1  # the largest count that the table lacks

    def run(batches):
        from collections import Counter

        get = known.value.get
        for b in batches:
            head, at, word, tf = [], [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                n = Counter(words(t or ""))
                n[END.encode()] = 1
                before, missed, score = len(word), 0, 0.0
                for w, m in n.items():
                    x = get(w)
                    if x is not None:
                        score += m * x
                    else:
                        missed += m
                        word.append(w)
                        tf.append(m)
                if not last:  # no training text has them
                    score += missed * math.log10(floor)
                    del word[before:], tf[before:]
                at += [k] * (len(word) - before)
                size = n.total()
                head.append((size, size - missed, score))
            n, h, s = zip(*head) if head else ((), (), ())
            nil = pa.nulls(len(head), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(s, pa.float64()), nil], names=["doc_id", "text_hash", "n", "hits", "score", "word"])
            if at:
                i = pa.array(at, pa.int64())
                zero = np.zeros(len(at))
                yield pa.RecordBatch.from_arrays([b.column(0).take(i), b.column(2).take(i), pa.array(tf, pa.int64()), pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(word, pa.binary())], names=["doc_id", "text_hash", "n", "hits", "score", "word"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = by_arrow(docs, run, f"doc_id {kind}, text_hash long, n long, hits long, score double, word binary")
    if last:
        rows = rows.withColumn("word", F.when(F.col("word").isNotNull(), F.xxhash64("word")))
        rows = spool(rows.withColumnRenamed("word", "k"))
        rare = rows.where("k is not null").join(counts.where(F.col("c") <= last).select(F.xxhash64("word").alias("k"), "c"), "k", "left")
        rare = rare.select("doc_id", "text_hash", F.lit(0).cast("long").alias("n"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("hits"), (F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + SMOOTH) / SMOOTH * floor)).alias("score"))
        rows = rows.where("k is null").select("doc_id", "text_hash", "n", "hits", "score", F.lit(1).alias("rows")).unionByName(rare.withColumn("rows", F.lit(0)))
    else:
        rows = rows.drop("word").withColumn("rows", F.lit(1))
    out = rows.groupBy("doc_id", "text_hash").agg(*[F.sum(c).alias(c) for c in ("n", "hits", "score", "rows")])  # rows: how often the row repeats
    return out.select("doc_id", "text_hash", F.expr("n div rows").alias("n_tokens"), F.expr("hits div rows").alias("n_known"), (F.col("score") / F.col("rows")).alias("base_score"), F.lit(total).cast("long").alias("train_tokens"))


def score(docs: DataFrame, path: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``.

    The model is trained once on every window of the training texts, which are dealt to shards by their hash, so that scores
    follow from the rows and not from their partitions. A null text is empty: its end is its one token. Rows that
    repeat an id and a text count as often in training and get equal scores; a null id is never held out. Very long
    texts are scored window by window; ties of counts go by id; an empty table gives no rows; other columns aren't
    looked at, whatever their names."""
    t = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    ids = spool(subwords(t, path))
    size = 1 << 16
    ends = word_ends(path, size)
    in_words = spool(word_counts(t))
    counts, starts, pairs = neighbours(ids, ends)
    cls, _ = classes_of(counts, ends)
    flat = train(ids, cls, counts)
    rows = share_rows(pairs, word_beginnings(in_words, path, ends), cls, ends)
    shares, whole = Shares.of_frequent(cls, ends, counts, starts, rows)
    mine = model_scores(ids, cls, shares, flat, None if whole else rows)
    base = spool(base_scores(t, in_words))
    b = base.select(F.col("doc_id").alias("b_id"), F.col("text_hash").alias("b_hash"), "n_tokens", "n_known", "train_tokens", "base_score")
    j = mine.join(b, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_hash") == F.col("b_hash")))
    return j.select("doc_id", F.col("held").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents", "doc_id", "text"))
