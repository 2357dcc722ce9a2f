"""Toxicity by noisy-channel deobfuscation: restore disguised words with a character language model, then score the text.

Channel: a lower-cased word is a lattice. Look-alike characters may stand for letters, runs of three or more equal
characters for one or two, and letters set apart by spaces, dots or dashes for one word. A word without such places has a
lattice of one path and stays as it is; the others are decoded by Viterbi search over states (last two characters) with
the weight of the language model and a cost for each substitution. Decoded words are kept in a bounded memory.

Language model: counts of character triples of all documents, from one pass with counts added up by task.

Score: a lexicon of words and word beginnings that are much more frequent in toxic than in clean labelled documents, and a
logistic model of how many words of a document hit it, how strongly, and how densely. Both are fitted on ``sample``
labelled documents at most (distinct texts, by smallest hash): each third of them is described by a lexicon of the other two,
the logistic model is fitted on those descriptions, and the lexicon that scores is that of all three. Labels are used
nowhere else.

Nulls and odd values: a null text is empty; an empty text scores as one without hits; rows with null or repeated ids are
scored each; without any labelled toxic document all score 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Look-alikes and the letters that they may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "*": "aeiou", "#": "h", "%": "", "&": ""}
SYMBOLS = "".join(LOOKALIKES)
# letters or digits apart from each other: i d i o t, i.d.i.o.t
SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_]){3,}[^\W_](?![^\W_])")
# a look-alike between or before letters, inside one word
DISGUISED = re.compile(rf"[^\W_]*(?:(?<=[^\W\d_])[{re.escape(SYMBOLS)}]+(?=[^\W\d_])|(?<![^\s])[{re.escape(SYMBOLS)}](?=[^\W\d_]{{2}}))[^\s,.;:?]*")
REPEATED = re.compile(r"[^\W_]*([^\W\d_])\1{2,}[^\W_]*")
THREE = re.compile(r"([^\W\d_])\1\1")
ANY = re.compile(r"[^\W\d_]+")
SIZE = 64  # character classes of the language model
SAMPLE = 4000
CHARS = 500_000
FOLDS = 3
BEGINNINGS = (4, 5, 6)
#: What is known of tokens without hits, one object for all that have as many words.
NO_HITS = [(n, 0, 0.0) for n in range(8)]


def _codes() -> np.ndarray:
    """Class of each character: 0 what isn't a letter, 1-26 a-z, the rest by code."""
    table = np.zeros(0x250, np.int64)
    for c in range(0x250):
        ch = chr(c).lower()
        if ch.isalpha() and len(ch) == 1:
            table[c] = ord(ch) - 96 if "a" <= ch <= "z" else 27 + ord(ch) % (SIZE - 27)
    return table


CODES = _codes()


def code(c: str) -> int:
    o = ord(c)
    return int(CODES[o]) if o < len(CODES) else 27 + o % (SIZE - 27) if c.isalpha() else 0


def triple_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character triples over all texts, as an array [SIZE, SIZE, SIZE]. Each task gives one row of fixed size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 500):
                text = "\n\n".join(batch["text"].iloc[at : at + 500])
                x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
                k = CODES[np.minimum(x, len(CODES) - 1)]
                wide = x >= len(CODES)
                k[wide] = 27 + x[wide] % (SIZE - 27)
                total += np.bincount((k[:-2] * SIZE + k[1:-1]) * SIZE + k[2:], minlength=SIZE**3)
        i = np.flatnonzero(total)
        yield pd.DataFrame({"triple": i, "n": total[i]})

    rows = docs.mapInPandas(count, "triple long, n long").groupBy("triple").agg(F.sum("n").alias("n")).collect()  # SIZE^3 rows at most
    out = np.zeros(SIZE**3)
    for r in rows:
        out[r.triple] = r.n
    return out.reshape(SIZE, SIZE, SIZE)


class Channel:
    """Decodes words. counts: triples of the corpus."""

    KEPT = 200_000

    def __init__(self, counts: np.ndarray):
        smooth = counts + 0.05
        self.cost = (-np.log(smooth / smooth.sum(2, keepdims=True))).astype(np.float32)
        self.known: dict[str, str] = {}
        self.tokens: dict[str, list[str]] = {}

    def word(self, raw: str) -> str:
        out = self.known.get(raw)
        if out is None:
            if len(self.known) >= self.KEPT:
                self.known.clear()
            out = self._viterbi(raw)
            if len(raw) < 60:
                self.known[raw] = out
        return out

    def _viterbi(self, raw: str) -> str:
        """Cheapest restored text of a lattice: at each place the character itself, what it stands for, or, in a run of
        equal characters and for marks, nothing."""
        states: dict[tuple[int, int, str], tuple[float, str]] = {(0, 0, ""): (0.0, "")}
        for i, c in enumerate(raw):
            choices = [(c, 0.0 if c.isalpha() else 6.0)] + [(x, 1.0) for x in LOOKALIKES.get(c, "")]
            if not c.isalpha():
                choices.append(("", 12.0 if LOOKALIKES.get(c) else 4.0))
            elif i and raw[i - 1] == c:
                choices.append(("", 0.3))
            new: dict[tuple[int, int, str], tuple[float, str]] = {}
            for (a, b, _), (w, text) in states.items():
                for x, extra in choices:
                    if x:
                        k = code(x)
                        state, cost = (b, k, ""), w + extra + float(self.cost[a, b, k])
                    else:
                        state, cost = (a, b, ""), w + extra
                    if state not in new or cost < new[state][0]:
                        new[state] = (cost, text + x)
            states = new
        return min((w + float(self.cost[a, b, 0]), text) for (a, b, _), (w, text) in states.items())[1]

    def restore(self, text: str) -> str:
        """The text, lower-cased, with disguised words restored."""
        text = self.joined(text)
        if any(c in text for c in SYMBOLS):
            text = DISGUISED.sub(lambda m: m[0] if m[0].isdigit() else self.word(m[0]), text)
        return REPEATED.sub(lambda m: self.word(m[0]), text) if THREE.search(text) else text

    def joined(self, text: str) -> str:
        """The text, lower-cased, with letters that are set apart put together."""
        return SPACED.sub(lambda m: self.word(re.sub(r"[ .\-_]", "", m[0])), text.lower())

    def fresh(self, token: str) -> list[str]:
        """Restored words of what stands between white space."""
        return ANY.findall(self.restore(token))

    def words(self, token: str) -> list[str]:
        """The same, kept for the next time."""
        out = self.tokens.get(token)
        if out is None:
            out = self.fresh(token)
            if len(self.tokens) < self.KEPT:
                self.tokens[token] = out
        return out

    def bag(self, text: str) -> Counter:
        """Restored words of a text with their numbers."""
        out: Counter = Counter()
        for token, n in Counter(self.joined(text).split()).items():
            for w in self.words(token):
                out[w] += n
        return out


def features(word: str) -> list[str]:
    return [f"={word}", *(f"{n}{word[:n]}" for n in BEGINNINGS if len(word) >= n)]


@dataclass(frozen=True)
class Model:
    """lexicon: feature to weight. coefficients: of (1, log of hits, strongest hit, log of hits per 100 words)."""

    counts: np.ndarray
    lexicon: dict[str, float]
    coefficients: tuple[float, ...]
    any_toxic: bool = True

    def inputs(self, bag: Counter, seen: dict[str, tuple], words=lambda token: (token,)) -> list[float]:
        """bag: tokens with their numbers. seen: what is known of tokens: words, hits, strongest hit."""
        hits, strongest, total = 0, 0.0, 0
        for token, n in bag.items():
            known = seen.get(token)
            if known is None:
                values = [max((self.lexicon.get(f, 0.0) for f in features(w)), default=0.0) for w in words(token)]
                known = (len(values), sum(v > 0 for v in values), max(values, default=0.0))
                if not known[1] and len(values) < len(NO_HITS):
                    known = NO_HITS[len(values)]
                if len(seen) < Channel.KEPT:
                    seen[token] = known
            total += n * known[0]
            if known[1]:
                hits += n * known[1]
                strongest = max(strongest, known[2])
        return [1.0, math.log1p(hits), strongest, math.log1p(100 * hits / max(20, total))]

    def score(self, bag: Counter, seen: dict[str, tuple], words) -> float:
        if not self.any_toxic:
            return 0.0
        z = sum(a * b for a, b in zip(self.coefficients, self.inputs(bag, seen, words), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _lexicon(docs: list[tuple[Counter, int]]) -> dict[str, float]:
    """Features at least ten times as frequent in toxic documents, in 2 % of them and 2 at least."""
    seen = [Counter(), Counter()]
    n = [sum(y == 0 for _, y in docs), sum(y == 1 for _, y in docs)]
    for words, y in docs:
        seen[y].update({f for w in words for f in features(w)})
    least = max(2, 0.02 * n[1])
    out = {}
    for f, a in seen[1].items():
        if a >= least and len(f) > 3:
            v = math.log((a + 0.5) / (n[1] + 1)) - math.log((seen[0][f] + 0.5) / (n[0] + 1))
            if v > math.log(10):
                out[f] = min(v, 6.0)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, steps: int = 40) -> np.ndarray:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: doc_id, text (all documents, for the language model). labels: doc_id, label (1 toxic, 0 clean) of rows to
    learn from. Only hashes are dealt out to choose the sample; then its texts are fetched, ``sample`` at most."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = triple_counts(d.select("text"))
    channel = Channel(counts)
    hashes = d.select("doc_id", F.xxhash64("text", F.lit(5)).alias("h"))
    known = hashes.join(labels.where("label in (0, 1)").select("doc_id", "label"), "doc_id").groupBy("h").agg(F.max("label").alias("label"), F.min("doc_id").alias("doc_id"))
    chosen = {r.doc_id: int(r.label) for r in known.orderBy("h").limit(sample).collect()}
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")
    texts = {r.doc_id: r.text for r in d.join(F.broadcast(ids), "doc_id").collect()}
    data = [(channel.bag(texts.pop(i)), chosen[i]) for i in sorted(texts)]
    toxic = sum(y for _, y in data)
    if not toxic or toxic == len(data):
        return Model(counts, {}, (0.0,) * 4, any_toxic=False)
    folds = [data[k::FOLDS] for k in range(FOLDS)]
    x, y = [], []
    for k, fold in enumerate(folds):
        part = Model(counts, _lexicon([d for j, f in enumerate(folds) if j != k for d in f]), (0.0,) * 4)
        seen: dict[str, tuple] = {}
        x += [part.inputs(bag, seen) for bag, _ in fold]
        y += [label for _, label in fold]
    return Model(counts, _lexicon(data), tuple(float(v) for v in _logistic(np.array(x), np.array(y, float))))


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut into runs of rows of about ``CHARS`` characters, or one longer text, so that what is made of them stays
    small; no batch is held while the next one is read."""
    for batch in batches:
        run = np.cumsum([len(t) if isinstance(t, str) else 0 for t in batch["__text"]]) // CHARS
        ends = [*(np.flatnonzero(np.diff(run)) + 1), len(batch)]
        for start, end in zip([0, *ends[:-1]], ends, strict=True):
            yield batch.iloc[start:end]
        del batch


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, extra: list[str] | None = None) -> DataFrame:
    """doc_id, score, predicted, and the columns named in ``extra``: one row for each row of docs."""
    passed = {"__text" if c == text else f"x_{c}": docs.schema[c].dataType.simpleString() for c in extra or []}
    others = [F.col(c).alias(f"x_{c}") for c in extra or [] if c != text]
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("__text"), *others)
    shared = d.sparkSession.sparkContext.broadcast(model)  # SIZE^3 numbers and a lexicon of a bounded sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        channel, seen = Channel(m.counts), {}
        for part in _slices(batches):
            texts = [t if isinstance(t, str) else "" for t in part["__text"]]
            out = [m.score(Counter(channel.joined(t).split()), seen, channel.fresh) for t in texts]
            yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "score": out} | {c: part[c].astype("Int64") if kind == "bigint" else part[c] for c, kind in passed.items()})

    out = d.mapInPandas(run, ", ".join(["doc_id long", "score double", *(f"`{c}` {kind}" for c, kind in passed.items())]))
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(F.col(c).alias(text if c == "__text" else c[2:]) for c in passed))


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id, label of the labelled documents that may be learnt from: crc32 of the id's text mod 4 isn't 2."""
    may = labels.where(F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    return may.select("doc_id", F.col("toxic").alias("label"))
