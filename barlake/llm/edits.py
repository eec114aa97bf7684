"""Token counts under edits: a segment tree of token counts over each document's pre-tokens.

The tree's units are the pre-tokens between white space, which no pre-token, normal form or lower case
of the vocabulary reaches over: so a unit and its neighbours are all the context an edit needs."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import bpe, common
from barlake.llm.common import by_arrow

#: A leaf: white space and the word after it, or what white space ends the text. No pre-token,
#: normal form or lower case of the vocabulary reaches over white space.
LEAF = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+\Z")


#: Words of a tree's leaf when it is made; one that grows beyond twice as many is split.
LEAF_WORDS = 64
#: Words whose numbers of tokens a worker remembers; beyond it the memory starts anew.
REMEMBERED = 300_000


class Counts(dict):
    """Numbers of tokens by word (with the white space before it), encoded when first met."""

    def __init__(self, ids) -> None:
        self.ids = ids

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = len(self.ids(word)) // 4
        if len(word) < 64:
            self[word] = n
        return n


class CountTree:
    """A segment tree of characters and tokens. A leaf holds up to 2 * LEAF_WORDS words and the tokens of
    each; an edit encodes the words it touches and one on each side, and updates the sums above
    their leaves. A leaf that grows too long is split, which sums the nodes anew but encodes nothing."""

    def __init__(self, text: str, counts: Counts) -> None:
        self.counts = counts
        words = LEAF.findall(text)
        tokens = [counts[w] for w in words]
        self.leaves = [(words[i : i + LEAF_WORDS], tokens[i : i + LEAF_WORDS]) for i in range(0, len(words), LEAF_WORDS)] or [([], [])]
        self.encoded = 0
        self.build()

    def build(self) -> None:
        self.size = size = 1 << (len(self.leaves) - 1).bit_length()
        rest = [0] * (size - len(self.leaves))
        self.char_sums = [0] * size + [sum(map(len, w)) for w, _ in self.leaves] + rest
        self.token_sums = [0] * size + [sum(t) for _, t in self.leaves] + rest
        for sums in (self.char_sums, self.token_sums):
            for i in range(size - 1, 0, -1):
                sums[i] = sums[2 * i] + sums[2 * i + 1]

    tokens = property(lambda self: self.token_sums[1])
    chars = property(lambda self: self.char_sums[1])

    def find(self, at: int) -> tuple[int, int, int]:
        """(leaf, word in it, the word's first place) of the word that holds place ``at``; the last one for the end."""
        node, begin, sums = 1, 0, self.char_sums
        while node < self.size:
            left = sums[2 * node]
            node *= 2
            if at >= begin + left and sums[node + 1]:
                node, begin = node + 1, begin + left
        leaf = node - self.size
        words = self.leaves[leaf][0]
        for k, w in enumerate(words):
            if at < begin + len(w) or k == len(words) - 1:
                return leaf, k, begin
            begin += len(w)
        return leaf, 0, begin

    def update(self, leaf: int) -> None:
        words, tokens = self.leaves[leaf]
        node = self.size + leaf
        self.char_sums[node], self.token_sums[node] = sum(map(len, words)), sum(tokens)
        while node > 1:
            node //= 2
            for sums in (self.char_sums, self.token_sums):
                sums[node] = sums[2 * node] + sums[2 * node + 1]

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace characters [start, stop), cut to the text, by ``new``."""
        start = max(0, min(start, self.chars))
        stop = max(start, min(stop, self.chars))
        a, i, begin = self.find(start)
        if begin:
            a, i, begin = self.find(begin - 1)
        z, k, at = self.find(stop)
        if self.leaves[z][0]:
            end = at + len(self.leaves[z][0][k])
            if end < self.chars:
                z, k, at = self.find(end)
        old = []
        for leaf in range(a, z + 1):
            words = self.leaves[leaf][0]
            old += words[i if leaf == a else 0 : k + 1 if leaf == z else len(words)]
        old = "".join(old)
        text = old[: start - begin] + new + old[stop - begin :]
        self.encoded += len(text)
        words = LEAF.findall(text)
        tokens = [self.counts[w] for w in words]
        tail = [x[k + 1 :] for x in self.leaves[z]]
        for leaf in range(a + 1, z + 1):
            self.leaves[leaf] = ([], []) if leaf < z else (tail[0], tail[1])
        head = self.leaves[a]
        self.leaves[a] = (head[0][:i] + words, head[1][:i] + tokens) if z > a else (head[0][:i] + words + tail[0], head[1][:i] + tokens + tail[1])
        if len(self.leaves[a][0]) > 2 * LEAF_WORDS:
            w, t = self.leaves[a]
            self.leaves[a : a + 1] = [(w[j : j + LEAF_WORDS], t[j : j + LEAF_WORDS]) for j in range(0, len(w), LEAF_WORDS)]
            self.leaves = [x for x in self.leaves if x[0]]
            self.build()
        else:
            for leaf in range(a, z + 1):
                self.update(leaf)


def edited_counts(docs: DataFrame, path: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, n_tokens_after, n_chars_after, n_chars_encoded) of rows (doc_id, text,
    edits array<struct<start, stop, text>>), the edits applied in order, each to the result of the
    last. Null texts and null edits are empty; places beyond the text are cut to it; null places
    are 0. Rows are apart from each other, so repeated ones and ties of ids give repeated rows; very
    long texts are trees like others, columns of other names aren't looked at, and an empty table gives
    no rows. No shuffle. n_chars_encoded: what the edits made anew, besides the text itself."""

    def run(batches):
        counts = Counts(bpe.encoder(path, "library").ids)
        for b in batches:
            out = []
            for text, edits in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                tree = CountTree(text or "", counts)
                before = tree.tokens
                for x in edits or ():
                    if x is not None:
                        tree.edit(x["start"] or 0, x["stop"] or 0, x["text"] or "")
                out.append((before, tree.tokens, tree.chars, tree.encoded))
            cols = np.array(out, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(cols[:, i]) for i in range(4)]], names=["doc_id", "n_tokens", "n_tokens_after", "n_chars_after", "n_chars_encoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return by_arrow(docs.select("doc_id", "text", "edits"), run, f"doc_id {kind}, n_tokens long, n_tokens_after long, n_chars_after long, n_chars_encoded long")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, text, edits) from ``edits`` (doc_id, seq, start, stop, text), in the order of seq."""
    lists = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "stop", "text"))).alias("x"))
    lists = lists.select(F.col("doc_id").alias("e_id"), F.transform("x", lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["text"].alias("text"))).alias("edits"))
    return docs.select("doc_id", "text").join(lists, F.col("doc_id") == F.col("e_id"), "left").drop("e_id")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits to every document: 12 characters at a third replaced, the first 40 repeated at two
    thirds, the last 25 removed."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    n = F.char_length(F.coalesce("text", F.lit("")))

    def edit(start, stop, text):
        return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), text.alias("text"))

    third, two = F.floor(n / 3), F.floor(2 * n / 3)
    edits = F.array(edit(third, third + 12, F.lit("edited span ")), edit(two, two, F.substring("text", 1, 40)), edit(n - 25, n + 65, F.lit("")))
    return edited_counts(docs.select("doc_id", "text", edits.alias("edits")))
