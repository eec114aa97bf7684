"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

The vocabulary file lower-cases texts, drops white space and marks word ends; its path is a
parameter, and every worker reads its own installed copy.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from barlake.llm import common
from barlake.llm.common import by_arrow

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Pre-tokens, and words of plain texts, remembered by a worker; beyond it the memory starts anew.
REMEMBERED = 300_000
#: Characters whose lower case, letter class and normal form no Unicode version disputes.
PLAIN = re.compile("[\t-\r\x20-\x7e\xa0-įı-ňŊ-ſ]*")
END = "</w>"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: its own where it is printable, else the next from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Backtracker:
    """Encodes one pre-token. A sequence of tokens is what merging gives exactly if each pair of
    neighbours, merged by itself, stays as it is; so the longest match that is compatible with the
    token before it is taken, shorter ones and earlier tokens being tried when none is."""

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab: dict[str, int] = model["vocab"]
        chars = byte_chars()
        shift = {c: chr(0x1000 + ord(c)) for c in chars}  # a byte at the end of a word is a unit of its own
        self.of_byte, self.shift = chars, shift

        def units(token: str) -> str:
            return token[: -len(END) - 1] + shift[token[-len(END) - 1]] if token.endswith(END) and len(token) > len(END) else token

        self.id = {units(t): i for t, i in vocab.items()}
        self.text = {i: t for t, i in self.id.items()}
        self.pair: dict[tuple[int, int], int] = {}
        self.halves = {i: (i, i) for i in vocab.values()}
        self.rank = {i: -1 for i in vocab.values()}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.pair.setdefault((left, right), made)
            if self.rank[made] < 0:
                self.rank[made], self.halves[made] = r, (left, right)
        self.shorter: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.matcher = ahocorasick.Automaton()
        for t, i in self.id.items():
            self.matcher.add_word(t[::-1], i)
        self.matcher.make_automaton()

    def prefix(self, token: int) -> int:
        """The longest proper prefix that is a token, or -1."""
        if (got := self.shorter.get(token)) is None:
            t = self.text[token]
            got = self.shorter[token] = next((self.id[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.id), -1)
        return got

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the text of both leaves these two tokens: no merge across their border
        comes before the merges that made what it joins."""
        if (got := self.fits.get((a, b))) is not None:
            return got
        x, y = a, b
        until = len(self.pair) + 1  # merges of this rank and later come too late
        good = True
        while True:
            made = self.pair.get((x, y))
            if made is not None and self.rank[made] < until:
                good = False
                break
            # undo the later of the merges at the border; of equal merges the left one comes first
            rx, ry = self.rank[x], self.rank[y]
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                until, x = rx, self.halves[x][1]
            else:
                until, y = ry + 1, self.halves[y][0]
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[a, b] = good
        return good

    def __call__(self, units: str) -> list[int]:
        n = len(units)
        longest = [-1] * n
        for end, token in self.matcher.iter(units[::-1]):
            at = n - 1 - end
            if longest[at] < 0 or len(self.text[token]) > len(self.text[longest[at]]):
                longest[at] = token
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            end = at + len(self.text[token])
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
                continue
            token = self.prefix(token)
            while token < 0:
                dead[at] = 1
                last = out.pop()
                at -= len(self.text[last])
                token = self.prefix(last)
        return out


class Pieces(dict):
    """Pre-token to its ids as little-endian 32-bit bytes; what is missing is encoded."""

    def __init__(self, path: str, method: str) -> None:
        self.chars = byte_chars()
        if method == "library":
            model = Tokenizer.from_file(path).model
            self.encode = lambda s: [t.id for t in model.tokenize(s)]
        else:
            tracker = Backtracker(path)
            self.encode = lambda s: tracker(s[:-1] + tracker.shift[s[-1]])

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        chars = self.chars
        plain = piece.isascii() and piece.isprintable()  # each byte stands for itself
        ids = self.encode(piece if plain else "".join([chars[b] for b in piece.encode("utf-8")]))
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) < 64:
            self[piece] = ids
        return ids


class Words(dict):
    """What stands between white space in a plain text to its ids; no pre-token reaches over white space."""

    def __init__(self, find, pieces: Pieces) -> None:
        self.find, self.pieces = find, pieces

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        pieces = self.pieces
        ids = pieces[word] if word.isalpha() else b"".join([pieces[p] for p in self.find(word)])
        if len(word) < 64:
            self[word] = ids
        return ids


class Encoder:
    """ids(text) equals the library's encode(text, add_special_tokens=False).ids, as bytes."""

    def __init__(self, path: str, method: str = "backtrack") -> None:
        spec = json.load(open(path, encoding="utf-8"))
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        whole = Tokenizer.from_file(path)
        self.normal, self.split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.pieces = Pieces(path, method)
        self.words = Words(self.find, self.pieces)
        self.back = {c: b for b, c in enumerate(self.pieces.chars)}

    def part(self, text: str) -> bytes:
        """ids() of a text without special tokens."""
        if PLAIN.fullmatch(text):
            return b"".join(map(self.words.__getitem__, text.lower().split()))
        back, pieces = self.back, self.pieces
        return b"".join([pieces[bytes(back[c] for c in p).decode("utf-8")] for p, _ in self.split(self.normal(text))])

    def ids(self, text: str) -> bytes:
        if "<|" in text:
            return b"".join([self.special[s] if s in self.special else self.part(s) for s in self.cut(text)])
        return self.part(text)


class Decoder:
    """Token bytes end to end, and where each begins. The file names no decoder, so tokens are
    joined by a space, as the library joins them."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        text = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        parts = [(text.get(i, "") + " ").encode("utf-8") for i in range(max(text) + 1)]
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def __call__(self, ids: bytes, step: int = 1 << 20) -> list[bytes]:
        """Bytes of the decoded text in parts, of up to ``step`` ids each."""
        tokens, out = np.frombuffer(ids, "<u4"), []
        for at in range(0, len(tokens), step):
            t = tokens[at : at + step]
            size = self.offset[t + 1] - self.offset[t]
            ends = np.cumsum(size)
            where = np.arange(ends[-1]) + np.repeat(self.offset[t] - (ends - size), size)
            out.append(self.flat[where].tobytes())
        if out:
            out[-1] = out[-1][:-1]
        return out


@lru_cache(4)
def encoder(path: str = VOCABULARY, method: str = "backtrack") -> Encoder:
    return Encoder(path, method)


@lru_cache(2)
def decoder(path: str = VOCABULARY) -> Decoder:
    return Decoder(path)


def round_trip(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, decoded string) of each row; a null text is empty and has no ids.

    No shuffle: each task encodes its rows, whatever their order, ties or repetition. Very long texts are encoded
    whole, an empty table gives no rows, and columns of other names aren't looked at."""

    def run(batches):
        e, d = encoder(path), decoder(path)
        for b in batches:
            ids = [e.ids(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([b"".join(d(i)).decode("utf-8", "replace") for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return by_arrow(docs.select(id_col, text_col), run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, ids binary, decoded string")


def digests(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): round_trip's digests without its texts, for the same rows: null
    and empty texts, very long ones, repeated rows, null ids, an empty table and other columns are as there."""

    def run(batches):
        e, d = encoder(path), decoder(path)
        for b in batches:
            n, a, c = [], [], []
            for t in b.column(1).to_pylist():
                ids = e.ids(t or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                h = hashlib.sha256()
                for part in d(ids):
                    h.update(part)
                c.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(c)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return by_arrow(docs.select(id_col, text_col), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents", "doc_id", "text"))
