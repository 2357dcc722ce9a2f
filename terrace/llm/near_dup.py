"""Near-duplicate classes by Order MinHash, verified by banded alignment.

1. Texts with equal normalised words (lower-cased, split at white space) are one text; its smallest id stands for it.
2. A text's k-mers are its runs of two words, each labelled with its occurrence. Each of ``SKETCHES`` hash functions
   takes the ``ORDER`` smallest labelled k-mers and keeps them in text order, so equal sketches speak for equal content in
   equal order. At similarity 0.8 two long texts share 3 in 7 of their k-mers at least (every fifth word changed), and a
   sketch with a chance of 0.08. Texts of at most ``SHORT`` words have ``SHORT_SKETCHES`` of order 1, since few k-mers
   remain; texts of 0.8 ``SHORT`` words or more have those of long texts, so that near texts always have sketches of one
   kind.
3. Texts that share a sketch meet in its bucket. The smallest id of a bucket leads it, and the others are checked against
   it. Then the members of each bucket that aren't all joined, held by its leader or not, are compared in parts of about
   ``PART`` texts, without any cap; only pairs that are joined already are left out.
4. A pair is near when its edit similarity over words, 1 - distance / longer length, is at least 0.8, found by bit-parallel
   alignment in the band of diagonals that this similarity allows.
5. Classes are the connected components of near pairs, of ``FEW`` pairs at most in one task, of more by rounds of
   smallest-label propagation with checkpoints.

Hot keys: joins by bucket, print and node go through ``join_hot``, which deals out the rows of the largest keys. Leaders and
labels are found by partial aggregates.

Result: one row for each row of docs: doc_id, class_id (smallest id of its class), n_texts (different texts in the class).
Nulls: a null or empty text has no words and equals other such texts only if ``empty_equal``; otherwise each is a class of
its own. Rows with a null id are not compared and have a null class. Rows that share an id are one
document: of different texts the one with the smallest fingerprint is compared, and copies of any of them share its class.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrace.llm.shared import cut, join_hot

K, SIMILAR, SKETCHES, ORDER = 2, 0.8, 64, 3
SHORT, SHORT_SKETCHES = 40, 24
SIDE = ["id", "label", "keys", "words"]
LEAST = 8
PART, PART_WORDS, CHARS, FEW = 512, 160_000, 500_000, 100_000
BLOCK = 1024
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(1099511628211)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of lower-cased texts, one after the other, and the number of words of each text."""
    lists = [t.lower().split() for t in texts]
    counts = np.array([len(x) for x in lists], np.int64)
    joined = " ".join(" ".join(x) for x in lists if x)
    if not joined:
        return np.zeros(0, np.uint64), counts
    data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    gap = data == 32
    starts = np.concatenate([[0], np.flatnonzero(gap) + 1])
    ends = np.concatenate([starts[1:] - 1, [len(data)]])
    # a word's polynomial: its bytes times powers by their place in the word
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(data)]])))
    longest = int((ends - starts).max()) + 1
    powers = np.ones(longest + 1, np.uint64)
    with np.errstate(over="ignore"):
        powers[1:] = np.cumprod(np.full(longest, BASE, np.uint64))
        terms = np.where(gap, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * powers[place])
        sums = np.add.reduceat(terms, starts)
        return mixed(sums + (ends - starts).astype(np.uint64) * MULTIPLY), counts


def labelled(grams: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes of the grams with their occurrence: the place of each among equal ones of its text."""
    by = np.lexsort((grams, text))
    same = np.concatenate([[False], (grams[by][1:] == grams[by][:-1]) & (text[by][1:] == text[by][:-1])])
    run = np.arange(len(by)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))
    label = np.zeros(len(by), np.uint64)
    label[by] = run.astype(np.uint64)
    with np.errstate(over="ignore"):
        return mixed(grams + label * MULTIPLY)


def sketches(words: np.ndarray, counts: np.ndarray, number: int = SKETCHES, order: int = ORDER, k: int = K) -> np.ndarray:
    """Order MinHash of texts with at least one word: an array [texts, number] of 64-bit keys."""
    with np.errstate(over="ignore"):
        shifted = [mixed(np.roll(words, -i) + np.uint64(i + 1) * MULTIPLY) for i in range(k)]
        grams = np.maximum(counts - k + 1, 1)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        first = np.concatenate([[0], np.cumsum(grams)[:-1]])
        at = np.arange(grams.sum()) - np.repeat(first, grams) + np.repeat(starts, grams)
        width = np.repeat(np.minimum(counts, k), grams)
        gram = np.zeros(len(at), np.uint64)
        for i in range(k):
            gram += np.where(i < width, shifted[i][at], np.uint64(0))
        text = np.repeat(np.arange(len(counts)), grams)
        gram = labelled(gram, text)
        out = np.zeros((len(counts), number), np.uint64)
        top = np.uint64(0xFFFFFFFFFFFFFFFF)
        for s in range(number):
            h = (gram ^ np.uint64(s * 0x5851F42D4C957F2D + 0x14057B7EF767814F & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            places, values = [], []
            for _ in range(order):
                least = np.minimum.reduceat(h, first)
                where = np.flatnonzero(h == np.repeat(least, grams))
                _, one = np.unique(text[where], return_index=True)
                places.append(where[one])
                values.append(np.where(least == top, np.uint64(0), gram[where[one]]))
                h[where[one]] = top
            p, v = np.array(places), np.array(values)
            v = np.take_along_axis(v, np.argsort(p, axis=0, kind="stable"), 0)
            key = np.full(len(counts), s + 1, np.uint64)
            for x in v:
                key = mixed(key * MULTIPLY + x)
            out[:, s] = key
    return out


def edit_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else most + 1. Bit-parallel, in a band of 2 most + 1
    diagonals: bits of the band slide by one for each element of b."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    lead = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        lead += 1
    a, b = a[lead:], b[lead:]
    tail = 0
    for x, y in zip(reversed(a), reversed(b), strict=False):
        if x != y:
            break
        tail += 1
    if tail:
        a, b = a[:-tail], b[:-tail]
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    if sum((Counter(a) & Counter(b)).values()) < max(len(a), len(b)) - most:
        return most + 1
    # Rows are a, columns b, and the band holds the diagonals, row - column from -up to down, that a path of cost ``most`` can
    # use. Bit k of column j is row j - up + k, so columns slide down a row each; score follows the lowest diagonal.
    n, m = len(a), len(b)
    up, down = (most - (n - m)) // 2, (most + (n - m)) // 2
    full = (1 << (up + down + 1)) - 1
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    minus, score, spare = (1 << up) - 1, down, m + down - n
    plus = full & ~minus
    for j, y in enumerate(b):
        seen = where.get(y, 0)
        eq = (seen >> (j - up) if j >= up else seen << (up - j)) & full
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        h_plus = (minus | ~(d0 | plus)) & full
        h_minus = plus & d0
        if not d0 >> (up + down):
            score += 1
            if score - spare > most:
                return most + 1
        x = d0 >> 1
        plus, minus = (h_minus | ~(x | h_plus)) & full, x & h_plus
    for k in range(up + down - 1, up + down - 1 - spare, -1):  # from the lowest diagonal up to the last row
        score += (minus >> k & 1) - (plus >> k & 1)
    return min(score, most + 1)


def near(a: np.ndarray, b: np.ndarray, similar: float = SIMILAR) -> bool:
    """Edit similarity of two texts' word hashes, at least ``similar``?"""
    longest = max(len(a), len(b))
    most = math.floor((1 - similar) * longest + 1e-9)
    return edit_distance(a.tolist(), b.tolist(), most) <= most


def prints(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each text's words in order."""
    ends = np.cumsum(counts)
    starts = ends - counts
    with np.errstate(over="ignore"):
        one = mixed(words + (np.arange(len(words)) - np.repeat(starts, counts)).astype(np.uint64) * MULTIPLY)
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (one, mixed(one + np.uint64(99)))]
        a, b = (s[ends] - s[starts] for s in sums)
    return a.view(np.int64), b.view(np.int64)


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut into runs of rows of about ``CHARS`` characters, or one longer text, which bounds the arrays over them."""
    for batch in batches:
        for _, part in batch.groupby((batch["text"].str.len().cumsum() // CHARS).values, sort=False):
            yield part


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fingerprint and words, as 32-bit hashes, of each text."""
    for batch in _slices(batches):
        words, counts = word_hashes(batch["text"].tolist())
        short, ends = (words & np.uint64(0xFFFFFFFF)).astype("<u4"), np.cumsum(counts)
        yield pd.DataFrame({"id": batch["id"].values, "print_a": prints(words, counts)[0], "words": [short[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)]})


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fingerprints, number of words and sketches of each text."""
    for part in _slices(batches):
        words, counts = word_hashes(part["text"].tolist())
        one, two = prints(words, counts)
        some = counts > 0
        keys = [np.zeros(0, np.int64)] * len(counts)
        for kind, how in ((some & (counts >= SIMILAR * SHORT), (SKETCHES, ORDER)), (some & (counts <= SHORT), (SHORT_SKETCHES, 1))):
            if kind.any():
                for i, row in zip(np.flatnonzero(kind), sketches(words[np.repeat(kind, counts)], counts[kind], *how).view(np.int64), strict=True):
                    keys[i] = np.concatenate([keys[i], row])
        yield pd.DataFrame({"id": part["id"].values, "print_a": one, "print_b": two, "n": counts, "keys": keys})


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ok = [near(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) for x, y in zip(batch["a_words"], batch["b_words"], strict=True)]
        yield batch[["a", "b"]].assign(ok=ok)


def links(docs: DataFrame, texts: DataFrame, keys: str = "keys") -> DataFrame:
    """Links (a, b) whose components are those of all near pairs that share a bucket. docs: id, text. texts: id, print_a, n of
    the texts to compare, and the keys of their buckets."""
    buckets = texts.select(F.explode(keys).alias("key"), "id")
    leaders = buckets.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("size")).where("size > 1")
    met = cut(join_hot(buckets, leaders, ["key"], "size", ["id"]).select("key", "id", "a"))
    sizes = texts.select("id", "n")
    pairs = met.where("id <> a").select("a", F.col("id").alias("b")).distinct()
    pairs = pairs.join(sizes.toDF("a", "a_n"), "a").join(sizes.toDF("b", "b_n"), "b")
    pairs = cut(pairs.where(F.least("a_n", "b_n") >= SIMILAR * F.greatest("a_n", "b_n") - 1e-9).select("a", "b"))
    words = _asked(docs, met.select("id").distinct()).mapInPandas(_words, "id long, print_a long, words binary")
    words = cut(words.join(texts.select("id", "print_a"), ["id", "print_a"], "left_semi").dropDuplicates(["id"]).select("id", "words"))
    near_by = _asked(words, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    sides = pairs.join(near_by.select(F.col("id").alias("a"), F.col("words").alias("a_words")), "a").join(near_by.select(F.col("id").alias("b"), F.col("words").alias("b_words")), "b")
    ok = sides.select("a", "b", "a_words", "b_words").mapInPandas(_verified, "a long, b long, ok boolean").where("ok").select("a", "b")
    joined = components(ok)
    # members that a leader holds and those that it doesn't hold meet too, unless they are joined already
    left = met.select("key", "id").join(joined, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    several = left.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low < high").select("key", "size")
    left = cut(join_hot(left, several, ["key"], "size", ["id"]).select("key", "id", "label").join(sizes, "id"))
    out = joined.select(F.col("label").alias("a"), F.col("id").alias("b"))
    return out if left.isEmpty() else out.unionByName(_rest_links(_asked(words, left.select("id").distinct()), left))


def few(keys: DataFrame) -> DataFrame:
    """keys, to be broadcast where they are few, by their count."""
    return F.broadcast(keys) if keys.limit(FEW + 1).count() <= FEW else keys


def _asked(words: DataFrame, ids: DataFrame) -> DataFrame:
    """Words of the asked ids. Where these are few, only their words move."""
    return words.join(few(ids), "id", "left_semi")


def _rest_links(texts: DataFrame, rest: DataFrame) -> DataFrame:
    """Buckets (key, id, n, label) whose members aren't all joined: members are dealt into parts of about ``PART`` texts and
    ``PART_WORDS`` words, those of a label with as many into parts of their own. A part gives a row for each part that it
    meets, which excludes those of its label, and the two rows of a pair come together in one task. Two texts are compared
    where neither their labels nor the pair's links join them already, and where no smaller key is among the ``LEAST`` smallest
    of both, under which they are compared too; so the links and labels give the classes of all near pairs of the buckets."""
    weight = F.greatest(F.lit(1.0), F.col("n") * (PART / PART_WORDS))
    number = lambda c: F.ceil(c / PART).cast("long")
    own = rest.groupBy("key", "label").agg(F.sum(weight).alias("own"))
    # a key's labels with parts of their own stand in one list, at most one label for PART of its texts, so that members meet
    # one row by key and none by label
    alone, pool_parts = F.when(F.col("own") >= PART, F.struct("label", number(F.col("own")).alias("parts"))), number(F.col("pool"))
    pool = F.coalesce(F.sum(F.when(F.col("own") < PART, F.col("own"))), F.lit(0.0))
    per_key = own.groupBy("key").agg(pool.alias("pool"), F.array_sort(F.collect_list(alone)).alias("large"), F.sum("own").alias("size"))
    until = lambda i: pool_parts + F.aggregate(F.slice("large", F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x.parts)
    spans = F.transform("large", lambda x, i: F.struct(x.label.alias("label"), until(i).alias("first"), (until(i) + x.parts).alias("end")))
    per_key = per_key.select("key", "size", pool_parts.alias("pool_parts"), until(F.size("large")).alias("parts"), spans.alias("spans"))
    dealt = join_hot(rest, per_key, ["key"], "size", ["id"]).withColumn("own", F.get(F.filter("spans", lambda x: x.label == F.col("label")), F.lit(0)))
    h = F.xxhash64("id", F.lit(3))
    part = F.when(F.col("own").isNotNull(), F.col("own.first") + F.pmod(h, F.col("own.end") - F.col("own.first"))).otherwise(F.pmod(h, F.greatest("pool_parts", F.lit(1))))
    dealt = dealt.select("key", "id", "label", part.alias("part"), F.struct("parts", F.col("own.first").alias("first"), F.col("own.end").alias("end")).alias("span"))
    keys = rest.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LEAST).alias("keys"))
    full = dealt.join(texts.join(keys, "id"), "id").select("key", "part", "span", F.struct(*SIDE).alias("text"))
    parts = full.groupBy("key", "part").agg(F.collect_list("text").alias("texts"), F.max("span").alias("span"))
    met = F.filter(F.sequence(F.lit(0).cast("long"), F.col("span.parts") - 1), lambda q: F.when(F.col("span.first").isNull(), F.lit(True)).otherwise((q < F.col("span.first")) | (q >= F.col("span.end"))))
    rows = parts.select("key", "part", F.explode(met).alias("other"), *(F.col(f"texts.{c}").alias(c) for c in SIDE))
    rows = rows.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", *SIDE)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            out = set()
            for row in batch.itertuples():
                if row.low == row.high:
                    out |= _part_links(row.key, row, row, True)
                elif held is None:
                    held = row
                else:
                    out |= _part_links(row.key, held, row, False)
                    held = None
            yield pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")

    return cut(rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInPandas(check, "a long, b long"))


def _most_shared(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """At least the number of words that each two texts share. A word with its occurrence is a place in a row of zeros and
    ones, of which ``BLOCK`` places are held at a time; words of a text that fall on one place are counted besides."""
    longest = max(len(x) for x in [*one, *two])
    places = min(1 << 14, 1 << max(8, (4 * longest).bit_length()))

    def marks(side: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in side])
        text = np.repeat(np.arange(len(side)), sizes)
        place = (labelled(np.concatenate(side).astype(np.uint64), text) % np.uint64(places)).astype(np.int64)
        place, text = np.divmod(np.unique(place * len(side) + text), len(side))
        return place, text, sizes - np.bincount(text, minlength=len(side))

    def block(side: tuple[np.ndarray, np.ndarray, np.ndarray], low: int) -> np.ndarray:
        place, text, more = side
        some = slice(*np.searchsorted(place, [low, low + BLOCK]))
        m = np.zeros((len(more), BLOCK), np.float32)
        m[text[some], place[some] - low] = 1
        return m

    a = marks(one)
    b = a if one is two else marks(two)
    shared = np.minimum(a[2][:, None], b[2]).astype(np.float32)
    for low in range(0, places, BLOCK):
        left = block(a, low)
        shared += left @ (left if one is two else block(b, low)).T
    return shared


def _part_links(key: int, texts: Any, others: Any, same: bool) -> set[tuple[int, int]]:
    """Near pairs between two parts of a bucket that join its texts, with their labels, as all its near pairs do. A part has
    arrays of its texts' ``SIDE``. How many words two texts share bounds their edit distance from below."""
    sides = [[np.frombuffer(x, "<u4") for x in side.words] for side in (texts, others)]
    sizes = np.array([len(w) for w in sides[1]])
    shared = _most_shared(sides[0], sides[0] if same else sides[1])
    root: dict[int, int] = {int(i): int(x) for side in (texts, others) for i, x in zip(side.id, side.label, strict=True)}
    ids = [[int(i) for i in side.id] for side in (texts, others)]

    def top(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = set()
    for i, x in enumerate(ids[0]):
        longest = np.maximum(sizes, len(sides[0][i]))
        most = np.floor((1 - SIMILAR) * longest + 1e-9)
        may = longest - np.minimum(sizes, len(sides[0][i])) <= most
        if same:
            may &= np.arange(len(sizes)) > i
        may = np.flatnonzero(may & (shared[i] >= longest - most))
        mine = set(texts.keys[i]) if len(may) else set()
        for j in may:
            y = ids[1][j]
            a, b = top(x), top(y)
            if a != b and min(mine.intersection(others.keys[j]), default=key) >= key and near(sides[0][i], sides[1][j]):
                root[max(a, b)] = min(a, b)
                out.add((min(x, y), max(x, y)))
    return out


def _is_star(edges: DataFrame) -> bool:
    """Does each edge lead from a node with no other edge to a node that leads nowhere?"""
    roles = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = roles.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def _lowest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (u, v) of a whole graph to its nodes (id, label) that aren't the smallest of their component, which is the label."""
    edges = [b[["u", "v"]].to_numpy(np.int64) for b in batches]
    if not edges:
        return
    nodes, at = np.unique(np.concatenate(edges), return_inverse=True)
    u, v = at.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while ((a := root[u]) != (b := root[v])).any():
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up
    low = root != np.arange(len(nodes))
    yield pd.DataFrame({"id": nodes[low], "label": nodes[root[low]]})


def components(pairs: DataFrame) -> DataFrame:
    """(id, label): the smallest id of each linked id's component, for all ids but the smallest. ``FEW`` edges at most, a fixed
    number, are solved in one task, which spares the driver the tasks of all rounds. More go through large-star and small-star
    rounds; each keeps the number of edges, and their number grows with the logarithm of the component's size."""
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if edges.count() <= FEW:
        return cut(edges.coalesce(1).mapInPandas(_lowest, "id long, label long"))
    while not _is_star(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("size"))
        # large star: larger neighbours to the least one
        large = cut(join_hot(both.where("v > u"), least, ["u"], "size", ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: smaller neighbours, and the node, to the least one
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size"))
        small = join_hot(large, down, ["u"], "size", ["v"]).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.where("u <> v").distinct())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", empty_equal: bool = True) -> DataFrame:
    """doc_id, class_id, n_texts."""
    d = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    hashed = d.where("id is not null").mapInPandas(_hashed, "id long, print_a long, print_b long, n long, keys array<long>")
    if not empty_equal:
        hashed = hashed.withColumn("print_b", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("print_b")))
    hashed = cut(hashed)
    # equal prints have equal sketches; of the texts of one id the one with the smallest print is compared
    same = hashed.groupBy("print_a", "print_b", "n").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    several = cut(same.where("n > 0").groupBy("first").agg(F.min("print_a").alias("least"), F.count("*").alias("texts")).where("texts > 1").select("first", "least"))
    firsts = hashed.where("n > 0").groupBy("print_a", "print_b", "n").agg(F.min("id").alias("first"), F.first("keys").alias("keys"))
    firsts = firsts.join(few(several), "first", "left").where("least is null or least = print_a")
    texts = cut(firsts.select(F.col("first").alias("id"), "print_a", "n", "keys"))
    member = cut(join_hot(hashed.select("id", "print_a", "print_b", "n"), same, ["print_a", "print_b", "n"], "copies", ["id"]).select("id", "first"))
    near_pairs = links(d, texts)
    # rows that share an id but not a text are linked through the id
    labels = components(near_pairs.unionByName(member.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))))
    found = member.select("id", "first").distinct().join(labels, "id", "left").select("id", "first", F.coalesce("label", "id").alias("class_id"))
    sizes = found.groupBy("class_id").agg(F.count_distinct("first").alias("n_texts"))
    per_id = found.select("id", "class_id").distinct().join(sizes, "class_id")
    return d.select(F.col("id").alias("doc_id")).join(per_id.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "class_id", "n_texts")
