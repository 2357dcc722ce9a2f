"""Packing token sequences into windows of near-equal length by Karmarkar-Karp multiway differencing.

Documents are tokenized where they lie, without a shuffle. Whole windows are cut off first; what remains of each document
(less than one window) is cut into pieces and gathered into blocks of ``block`` windows. In a block each piece starts as
a partial partition of its own; the two with the widest spread are merged, the largest sums of one on the smallest of the
other, until one partition is left. If a window then holds more than its capacity, the block is packed again with one
window more. A block has a fixed size, so memory is bounded whatever the documents' sizes. A partition's last tokens, which
fill no block, make sequences of lengths that are powers of two, which need no padding.

Sequence ids are (Spark partition, number in it), so a task that runs again gives the same ids.

Nulls: a null or empty text is the end id alone. Rows with null or repeated ids are documents of their own. A document of
any length is cut; none is dropped. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
#: White space is Unicode's, as tokenizers have it; Python's \\s holds the separators 1C to 1F besides.
BLANK = "[^\\S\x1c-\x1f]"
#: Chunks that byte-level pre-tokenization never joins: an optional space with what isn't white space, or white space.
CHUNK = re.compile(rf" ?(?:(?!{BLANK})[\s\S])+|{BLANK}+(?!(?!{BLANK})[\s\S])|{BLANK}+")
#: Fixed value: the pre-tokenization that byte-level BPE files name (ByteLevel with its regex) without stating it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_ranks(tokenizer_json: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Vocabulary in bytes, and the special tokens, of a byte-level BPE file whose ids are in merge order."""
    with open(tokenizer_json, encoding="utf-8") as f:
        j = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"]: t["id"] for t in j.get("added_tokens", [])}
    return {bytes(back[c] for c in k): v for k, v in j["model"]["vocab"].items() if k not in special}, special


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, equal to the tokenizers library's for the same file. Words repeat,
    so ids are kept by chunk, up to a fixed number of chunks; texts with special tokens go to the library itself."""

    KEPT = 300_000

    def __init__(self, tokenizer_json: str):
        import tiktoken

        ranks, self.special = byte_ranks(tokenizer_json)
        self.bpe = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.path, self.whole, self.known = tokenizer_json, None, {}

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.path)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        chunks = CHUNK.findall(text)
        got = list(map(self.known.get, chunks))
        if None in got:
            for i, v in enumerate(got):
                if v is None:
                    c = chunks[i]
                    v = self.known.get(c)
                    if v is None:
                        v = np.array(self.bpe.encode_ordinary(c), "<u4").tobytes()
                        if len(c) < 40:
                            if len(self.known) >= self.KEPT:
                                self.known.clear()
                            self.known[c] = v
                    got[i] = v
        return b"".join(got)


def differencing(sizes: list[int], n: int) -> list[list[int]]:
    """Karmarkar-Karp for n subsets: the items of each."""
    heap = []
    for i, s in enumerate(sizes):
        sums, groups = [0] * n, [()] * n
        sums[0], groups[0] = s, (i,)
        heap.append((-s, i, sums, groups))
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        _, _, a, ga = heapq.heappop(heap)
        _, _, b, gb = heapq.heappop(heap)
        merged = sorted(((a[k] + b[n - 1 - k], k) for k in range(n)), reverse=True)
        low = merged[-1][0]
        sums = [s - low for s, _ in merged]  # only differences matter
        groups = [ga[k] + gb[n - 1 - k] if ga[k] or gb[n - 1 - k] else () for _, k in merged]
        heapq.heappush(heap, (-sums[0], number, sums, groups))
        number += 1
    return [list(g) for g in heap[0][3]] if heap else []


def windows(sizes: list[int], n: int, capacity: int) -> list[list[int]]:
    """Items by window; the number of windows rises from n while one holds more than the capacity."""
    while True:
        out = differencing(sizes, n)
        if all(sum(sizes[i] for i in g) <= capacity for g in out):
            return [g for g in out if g]
        n += 1


class Packer:
    """Takes token bytes by document and yields pieces: (document number, start, bytes, sequence, offset)."""

    def __init__(self, window: int = WINDOW, block: int = 32, piece: int = 256, slack: int = 2, fine: int = 16):
        self.window, self.block, self.piece, self.slack, self.fine = window, block, piece, slack, fine
        self.full, self.held, self.total, self.sequence = block * (window - slack), [], 0, 0

    def add(self, doc: int, ids: bytes) -> Iterator[tuple]:
        n = len(ids) // 4
        whole = n - n % self.window
        for at in range(0, whole, self.window):
            yield doc, at, ids[4 * at : 4 * (at + self.window)], self._next(), 0
        at = whole
        while at < n:
            size = min(self.piece, n - at, self.full - self.total)
            self.held.append((doc, at, ids[4 * at : 4 * (at + size)]))
            self.total += size
            at += size
            if self.total == self.full:
                yield from self._pack(self.held, self.block)
                self.held, self.total = [], 0

    def end(self) -> Iterator[tuple]:
        """The rest: near-equal windows as far as it fills them, then powers of two."""
        n = self.total // self.window
        if n:
            cut, size, kept = n * (self.window - self.slack), 0, []
            while self.held and size < cut:
                doc, at, ids = self.held.pop(0)
                take = min(len(ids) // 4, cut - size)
                kept.append((doc, at, ids[: 4 * take]))
                size += take
                if 4 * take < len(ids):
                    self.held.insert(0, (doc, at + take, ids[4 * take :]))
            yield from self._pack(kept, n)
        left = sum(len(x[2]) for x in self.held) // 4
        while left:
            size = min(self.window, 1 << (left.bit_length() - 1))
            sequence, offset = self._next(), 0
            left -= size
            while offset < size:
                doc, at, ids = self.held.pop(0)
                take = min(len(ids) // 4, size - offset)
                yield doc, at, ids[: 4 * take], sequence, offset
                offset += take
                if 4 * take < len(ids):
                    self.held.insert(0, (doc, at + take, ids[4 * take :]))
        self.held, self.total = [], 0

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def _pack(self, held: list[tuple], n: int) -> Iterator[tuple]:
        """The last tokens, ``fine`` for each window, are cut ever finer, so that the last merges can level the windows."""
        pieces, left = list(held), self.fine * n
        fine = []
        while pieces and left:
            doc, at, ids = pieces.pop()
            size = len(ids) // 4
            if size > left:
                pieces.append((doc, at, ids[: 4 * (size - left)]))
                at, ids, size = at + size - left, ids[4 * (size - left) :], left
            fine.append((doc, at, ids))
            left -= size
        left = sum(len(x[2]) for x in fine) // 4
        for doc, at, ids in reversed(fine):
            while ids:
                size = min(len(ids) // 4, max(1, left // (2 * n)))
                pieces.append((doc, at, ids[: 4 * size]))
                ids, at, left = ids[4 * size :], at + size, left - size
        for group in windows([len(p[2]) // 4 for p in pieces], n, self.window):
            sequence, offset = self._next(), 0
            for i in sorted(group):
                yield *pieces[i], sequence, offset
                offset += len(pieces[i][2]) // 4


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 0, **layout: int) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.
    tokenizer: path of a byte-level BPE file, on every machine."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return d.mapInPandas(_packed(tokenizer, window, end_id, layout), schema)


def _packed(tokenizer: str, window: int, end_id: int, layout: dict[str, int]) -> Callable:
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, packer, docs = Encoder(tokenizer), Packer(window, **layout), {}
        first, number, out, held = TaskContext.get().partitionId() << 34, 0, [], 0

        def rows() -> pd.DataFrame:
            frame = pd.DataFrame([(docs[d][0], at, len(ids) // 4, ids, docs[d][1], first + s, off) for d, at, ids, s, off in out], columns=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            keep = {x[0] for x in packer.held}
            for d in [d for d in docs if d not in keep]:
                del docs[d]
            out.clear()
            return frame

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                ids = encode(text) + end
                docs[number] = (doc_id, len(ids) // 4)
                for x in packer.add(number, ids):
                    out.append(x)
                    held += len(x[2])
                number += 1
                if held > 8_000_000:
                    yield rows()
                    held = 0
        out.extend(packer.end())
        if out:
            yield rows()

    return run

