"""SentencePiece encoding and decoding as a weighted finite-state transducer in the tropical semiring.

Compiled from the model file: the normaliser (dummy prefix, extra white space, white space to the escape mark), a trie of
the pieces, and byte fallback for characters outside the alphabet. An input is composed with it as a lattice over its
characters whose states are (place, last piece), and the encoding is the shortest path.

Weights: for a unigram model an arc weighs minus its piece's score. For a BPE model the merge order is a constraint between
neighbours: a piece sequence is the BPE encoding exactly if each two neighbours are the encoding of their own
concatenation. Such transitions weigh 0, others infinity, so the one path of finite weight is the encoding that the
library gives. Each prefix has one such path, so a place stands for the state (place, last piece).

No piece has the escape mark behind another character, so texts are cut before marks that follow others, and around ASCII
characters that are in no longer piece; words, which repeat, are kept in a bounded memory.

Nulls: a null text encodes as empty, to no ids. Any text is encoded; NUL and other characters go by byte pieces where the
alphabet lacks them. Rows with null or repeated ids are texts of their own.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
INFINITE = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0]
            at += n


class Transducer:
    """The compiled model. encode and decode work on one text."""

    KEPT = 1_000_000
    _compiled: ClassVar[dict[str, Transducer]] = {}

    def __init__(self, model: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f.get(1, b"").decode(), f.get(2, 0.0), f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if normalizer.get(2):
            raise ValueError("the model's normaliser has a character map, which isn't supported")
        self.kind = trainer.get(3, UNIGRAM)
        self.prefix, self.squeeze = bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.bytes = {int(p[0][3:5], 16): i for i, p in enumerate(self.pieces) if p[2] == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.surface = ["" if kind == CONTROL else " ⁇ " if kind == UNKNOWN else text for text, _, kind in self.pieces]
        self.ids = {p[0]: i for i, p in enumerate(self.pieces) if p[2] in (NORMAL, USER)}
        self.score = [p[1] for p in self.pieces]
        self.pair: dict[tuple[str, str], bool] = {}
        self.packed = {p: struct.pack("<I", i) for p, i in self.ids.items()}
        self.known: dict[str, bytes] = {}
        self.whole = all(MARK not in p.lstrip(MARK) for p in self.ids)
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in joined)
        self.chunk = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))
        # arcs of the pieces, as a trie: the key "" of a node holds the piece that ends there and its weight
        self.trie: dict = {}
        for p, i in self.ids.items():
            if self.kind == BPE and self._merged(p) != [p]:
                continue  # merges never make it
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = (p, len(p), 0.0 if self.kind == BPE else -self.score[i])
        normal = [x[1] for x in self.pieces if x[2] == NORMAL]
        self.outside = 0.0 if self.kind == BPE else 10.0 - min(normal, default=0.0)

    @classmethod
    def of(cls, path: str) -> Transducer:
        """The model of a file, compiled once in each Python worker."""
        if path not in cls._compiled:
            with open(path, "rb") as f:
                cls._compiled[path] = cls(f.read())
        return cls._compiled[path]

    def normalised(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (MARK if self.prefix else "") + text.replace(" ", MARK)

    def _merged(self, text: str) -> list[str]:
        """BPE by merging, for short texts: defines which neighbours are compatible."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _compatible(self, a: str, b: str) -> bool:
        ok = self.pair.get((a, b))
        if ok is None:
            if len(self.pair) > 1_000_000:
                self.pair.clear()
            ok = self.pair[a, b] = self._merged(a + b) == [a, b]
        return ok

    def path(self, chunk: str) -> list[str]:
        """The pieces of the shortest path, by min-plus relaxation over the lattice of places: an arc for each piece of the
        trie that starts at a place, and one of weight ``outside`` for a character that no piece is, which byte fallback
        writes. BPE adds the weight between neighbours. A character outside is a piece of its own."""
        n, bpe, pair, compatible = len(chunk), self.kind == BPE, self.pair, self._compatible
        cost, last = [INFINITE] * (n + 1), [""] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            so_far = cost[i]
            if so_far == INFINITE:
                continue
            before, node, at = last[i], self.trie, i
            one = node.get(chunk[i])
            if one is None or "" not in one:
                arcs = [(chunk[i], 1, self.outside)]
            else:
                arcs = []
            while at < n:
                node = node.get(chunk[at])
                if node is None:
                    break
                at += 1
                arc = node.get("")
                if arc is not None:
                    arcs.append(arc)
            for p, size, weight in arcs:
                j = i + size
                if so_far + weight < cost[j]:
                    if bpe and before:
                        ok = pair.get((before, p))
                        if not (compatible(before, p) if ok is None else ok):
                            continue
                    cost[j], last[j] = so_far + weight, p
        out, j = [], n
        while j:
            out.append(last[j])
            j -= len(last[j])
        return out[::-1]

    def _outside(self, c: str) -> bytes:
        """Ids of a character that no piece has."""
        ids = [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]
        out = self.packed[c] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def _arcs(self, chunk: str) -> bytes:
        packed = self.packed
        out = b"".join([packed.get(p) or self._outside(p) for p in self.path(chunk)])
        if len(chunk) < 40:
            if len(self.known) >= self.KEPT:
                self.known.clear()
            self.known[chunk] = out
        return out

    def encoded(self, text: str) -> bytes:
        """The ids, little-endian unsigned 32-bit."""
        s, known, arcs = self.normalised(text), self.known, self._arcs
        return b"".join([known.get(c) or arcs(c) for c in (self.chunk.findall(s) if self.whole else [s] if s else [])])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The normalised text without its dummy prefix; runs of byte pieces are UTF-8."""
        if self.byte_of.keys().isdisjoint(ids):
            return self._plain("".join(map(self.surface.__getitem__, ids)))
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(self.surface[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return self._plain("".join(out))

    def _plain(self, s: str) -> str:
        s = s.replace(MARK, " ")
        return s[1:] if self.prefix and s.startswith(" ") else s


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), n_ids, n_bytes (ids of byte fallback), decoded_sha256 (of the text
    decoded from the ids), exact (that it is the normalised text). model: path of the model file, on every machine."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Transducer.of(model)
        is_byte = np.zeros(len(t.pieces), bool)
        is_byte[list(t.byte_of)] = True
        for batch in batches:
            rows = []
            for text_ in batch["text"]:
                a = np.frombuffer(t.encoded(text_), "<u4")
                back = t.decode(a.tolist())
                wanted = t.normalised(text_).replace(MARK, " ")
                rows.append((a.tobytes(), len(a), int(is_byte[a].sum()), hashlib.sha256(back.encode()).hexdigest(), back == (wanted[1:] if t.prefix else wanted)))
            out = pd.DataFrame(rows, columns=["ids", "n_ids", "n_bytes", "decoded_sha256", "exact"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").values)
            yield out

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    return d.mapInPandas(run, "doc_id long, ids binary, n_ids long, n_bytes long, decoded_sha256 string, exact boolean")
