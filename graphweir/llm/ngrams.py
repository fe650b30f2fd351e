"""Words, n-grams and interpolated Kneser-Ney models of a bounded inventory, counted over all texts.

Words are 63-bit hashes, so that no dictionary is held. Counts are exact, by one
distributed aggregation of the different trigrams of all texts. The models know the
n-grams of given texts, and all that occur twice or more. Those of given texts, and all
that occur ``LEAST_SHARE`` times a text, are held in one place, the inventory, whose size
is bounded by that share, not by the texts. All others stay a table, the rest: each row
of text is joined with the counts of those that it holds, and scored by both. So the
share sets what is held where, and no result.

Empty and null texts hold no word; empty tables give an inventory of the given texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweir.session import dropped, written

DISCOUNT = 0.75
#: Occurrences a text from which an n-gram that no given text holds is held in one place.
LEAST_SHARE = 1e-4
#: Occurrences from which the models know an n-gram that no given text holds: one alone is but the place that is scored.
LEAST = 2


class WordIds(dict):
    """Ids of words: 63 bits of a hash, 0 for the end of a sentence. Remembered in a table of bounded size."""

    def __init__(self, split: Callable[[str], list[str]], reveal: Callable[[str], str] | None = None) -> None:
        super().__init__({"": 0})
        self.split, self.reveal = split, reveal

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
            self[""] = 0
            if not word:
                return 0
        known = self.reveal(word) if self.reveal else word
        self[word] = number = int.from_bytes(hashlib.blake2b(known.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1 | 1
        return number

    def text(self, text: str | None) -> np.ndarray:
        """The ids of a text, split into words and, between sentences, empty strings: 0 before and after every sentence."""
        tokens = self.split(text) if text else []
        return np.array([0, *map(self.__getitem__, tokens), 0] if tokens else [], np.int64)


class Runs(dict):
    """What is read out of runs of signs between blanks, remembered in a table of bounded size; long runs are read each time."""

    def __init__(self, read: Callable[[str], object], most: int = 200_000, longest: int = 40) -> None:
        super().__init__()
        self.read, self.most, self.longest = read, most, longest

    def __missing__(self, run: str) -> object:
        found = self.read(run)
        if len(run) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[run] = found
        return found

    def of(self, text: str) -> Iterator:
        """What is read out of the runs of a text, one after another."""
        return map(self.__getitem__, text.split(" "))


#: Constants of the public hash function xxHash64 (fixed values).
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_SEED = np.int64(42)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def chain(seed: np.ndarray, number: np.ndarray) -> np.ndarray:
    """xxhash64 of a number after others, whose hash is the seed, as Spark computes it."""
    x = seed.view(np.uint64) + (_P5 + np.uint64(8))
    x ^= _turn(number.view(np.uint64) * _P2, 31) * _P1
    x = _turn(x, 27) * _P1 + _P4
    x ^= x >> np.uint64(33)
    x *= _P2
    x ^= x >> np.uint64(29)
    x *= _P3
    x ^= x >> np.uint64(32)
    return x.view(np.int64)


def grams(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the bigram and the trigram that end at each place; a sentence begins as after two marks."""
    if not len(ids):
        return ids, ids
    first = chain(np.full(len(ids), _SEED), ids)
    before = chain(np.full(1, _SEED), np.zeros(1, np.int64))
    two = chain(np.concatenate([before, first[:-1]]), ids)
    marks = chain(before, np.zeros(1, np.int64))
    two[ids == 0] = marks[0]
    return two, chain(np.concatenate([marks, two[:-1]]), ids)


class Index:
    """Places of keys in an array, by a hash table with open addresses."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        size = 1 << max(4, (2 * len(keys)).bit_length())
        self.mask = np.int64(size - 1)
        self.table = np.full(size, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slot = self._first(keys)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            lost = self.table[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys ^ (keys >> np.int64(23))) & self.mask

    def find(self, asked: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        found = np.full(len(asked), -1, np.int32)
        if not len(self.keys):
            return found
        at, slot = np.arange(len(asked)), self._first(asked)
        while len(at):
            there = self.table[slot]
            hit = (there >= 0) & (self.keys[np.maximum(there, 0)] == asked[at])
            found[at[hit]] = there[hit]
            on = (there >= 0) & ~hit
            at, slot = at[on], (slot[on] + 1) & self.mask
        return found


@dataclass
class Inventory:
    """The words, bigrams and trigrams that are held in one place, and their counts over all documents.

    A bigram names its two words, a trigram the bigrams it begins and ends with, all by place.
    """

    one: Index
    two: Index
    three: Index
    two_mid: np.ndarray  # the word before the last, by place
    two_last: np.ndarray
    three_ctx: np.ndarray  # the first two words, by place
    three_suf: np.ndarray
    n: np.ndarray  # times each trigram occurs
    tot3: np.ndarray  # times a word follows each bigram
    low3: np.ndarray  # of these, what the trigrams of the rest keep when discounted
    cont2: np.ndarray  # different words before each bigram
    tot2: np.ndarray  # different trigrams around each word
    low2: np.ndarray  # of these, what the bigrams of the rest keep when discounted
    cont1: np.ndarray  # different words before each word
    n1: np.ndarray  # times each word occurs
    types: int  # different bigrams
    low1: np.ndarray  # over the words of the rest: number, cont1, cont1 discounted, n1, n1 discounted
    rest: DataFrame | None  # (level, key, vals): words (cont1, n1, tot2, low2), bigrams (cont2, tot3, low3) and trigrams (n) of the rest

    def counts(self, texts: list[np.ndarray]) -> np.ndarray:
        """Times each trigram occurs in some texts."""
        return times(self.three, np.concatenate([np.zeros(0, np.int64), *texts]))

    def whole(self) -> float:
        """The lowest counts of all words, one added to each."""
        return float((self.cont1 + 1).sum() + self.low1[0] + self.low1[1])

    def shared(self) -> np.ndarray:
        """The lowest distribution: how many different words each word follows in all texts, plus one."""
        return (self.cont1 + 1) / self.whole()

    def words(self, n: np.ndarray) -> np.ndarray:
        """Times each word occurs as the last of some trigrams."""
        return np.bincount(self.two_last[self.three_suf], n, len(self.cont1))


@dataclass
class Changes:
    """What trigrams of the rest, found in some spans, add to one class and take from the other, by places of an inventory.

    Of bigrams: different trigrams found that end with each, times that some begin with it, these discounted; trigrams that
    the other class loses, change of what it keeps discounted, and of the times. Of words, by bigrams of the rest: different
    ones found that end with each, times it is found as the last, different trigrams found around it, these discounted; changes
    of the other class's different words before it, of the trigrams around it, of these discounted, and of the times. Over the
    words of the rest, for each class: as ``Inventory.low1`` without the number. ``table`` holds the same for all that is of
    the rest, and of its trigrams the times found and those that the other class loses.
    """

    two: np.ndarray
    one: np.ndarray
    low_found: np.ndarray
    low_left: np.ndarray
    table: DataFrame | None

    @classmethod
    def none(cls, inventory: Inventory) -> Changes:
        return cls(np.zeros((len(inventory.cont2), 6)), np.zeros((len(inventory.cont1), 8)), np.zeros(4), np.zeros(4), None)


class Local:
    """The n-grams of the rest that some rows hold: their places come after those of the inventory."""

    def __init__(self, rest: pa.Array, changed: pa.Array) -> None:
        level, key, values = _entries(rest, 4)
        asked = _entries(changed, 8)
        self.index, self.counts, self.changes = [], [], []
        for k in (1, 2, 3):
            keys, first = np.unique(key[level == k], return_index=True)
            own, change = Index(keys), np.zeros((len(keys), 8))
            at = own.find(asked[1][asked[0] == k])
            change[at[at >= 0]] = asked[2][asked[0] == k][at >= 0]
            self.index.append(own)
            self.counts.append(values[level == k][first])
            self.changes.append(change)

    def find(self, level: int, index: Index, asked: np.ndarray) -> np.ndarray:
        """Places in the inventory, else among the rest, or -1."""
        at = index.find(asked)
        miss = np.flatnonzero(at < 0)
        there = self.index[level - 1].find(asked[miss])
        at[miss] = np.where(there >= 0, there + len(index.keys), -1)
        return at


def _entries(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels, keys and values of a column of lists of n-grams."""
    level, key, values = column.flatten().flatten()
    return np.asarray(level), np.asarray(key), np.asarray(values.flatten()).reshape(-1, width)


class Model:
    """One class, by interpolated Kneser-Ney: counts of trigrams, discounted, over counts of the different
    words before a bigram, over those of the different words before a word, over the shared distribution.

    ``kind`` tells what the class holds of the rest: nothing, what was found, or all but that.
    """

    def __init__(self, kind: str, whole: float, arrays: tuple[np.ndarray, ...], shared: np.ndarray, types: float, low: np.ndarray) -> None:
        n, tot3, mass3, cont2, tot2, mass2, cont1, n1 = arrays
        self.kind, self.whole = kind, whole
        total = max(float(n1.sum() + low[2]), 1.0)
        self.types, self.total = max(types, float(cont1.sum() + low[0]), 1.0), total
        self.left0 = 1 - (np.maximum(cont1 - DISCOUNT, 0).sum() + low[1]) / self.types
        self.left_words = 1 - (np.maximum(n1 - DISCOUNT, 0).sum() + low[3]) / total
        self.parts = self._parts(n, tot3, mass3, cont2, tot2, mass2, cont1, n1, shared)

    def _parts(self, n: np.ndarray, tot3: np.ndarray, mass3: np.ndarray, cont2: np.ndarray, tot2: np.ndarray, mass2: np.ndarray, cont1: np.ndarray, n1: np.ndarray, shared: np.ndarray) -> list[np.ndarray]:
        """Discounted trigrams; what they are divided by and what is left for bigrams; the same of bigrams and words; words of both kinds."""

        def kept(counts: np.ndarray) -> np.ndarray:
            return np.maximum(counts - DISCOUNT, 0)

        left2, left1 = (np.where(total > 0, 1 - mass / np.maximum(total, 1), 1.0) for mass, total in ((mass3, tot3), (mass2, tot2)))
        one, words = kept(cont1) / self.types + self.left0 * shared, kept(n1) / self.total + self.left_words * shared
        return [x.astype(np.float32) for x in (kept(n), np.maximum(tot3, 1), left2, kept(cont2), np.maximum(tot2, 1), left1, one, words)]

    @classmethod
    def of(cls, inventory: Inventory, n: np.ndarray, shared: np.ndarray, changes: Changes | None = None) -> Model:
        """A model of some counts alone, and of what changes found."""
        kind, c = "found" if changes else "none", changes or Changes.none(inventory)
        some = n > 0
        cont2 = np.bincount(inventory.three_suf[some], minlength=len(inventory.two_mid)) + c.two[:, 0]
        cont1 = np.bincount(inventory.two_last[cont2 > 0], minlength=len(inventory.cont1)) + c.one[:, 0]
        tot3 = np.bincount(inventory.three_ctx, n, len(cont2)) + c.two[:, 1]
        tot2 = np.bincount(inventory.two_mid, cont2, len(cont1)) + c.one[:, 2]
        mass3 = np.bincount(inventory.three_ctx, np.maximum(n - DISCOUNT, 0), len(cont2)) + c.two[:, 2]
        mass2 = np.bincount(inventory.two_mid, np.maximum(cont2 - DISCOUNT, 0), len(cont1)) + c.one[:, 3]
        return cls(kind, inventory.whole(), (n, tot3, mass3, cont2, tot2, mass2, cont1, inventory.words(n) + c.one[:, 1]), shared, 0.0, c.low_found)

    @classmethod
    def rest(cls, inventory: Inventory, more: np.ndarray, less: np.ndarray, shared: np.ndarray, changes: Changes | None = None) -> Model:
        """A model of all documents with some counts added and others, and what changes found, taken away."""
        c = changes or Changes.none(inventory)
        n = np.maximum(inventory.n + more - less, 0)
        turned = (n > 0).astype(np.float64) - (inventory.n > 0)
        cont2 = np.maximum(inventory.cont2 + np.bincount(inventory.three_suf, turned, len(inventory.cont2)) - c.two[:, 3], 0)
        tot3 = np.maximum(inventory.tot3 + np.bincount(inventory.three_ctx, n - inventory.n, len(inventory.tot3)) + c.two[:, 5], 0)
        tot2 = np.maximum(inventory.tot2 + np.bincount(inventory.two_mid, cont2 - inventory.cont2, len(inventory.tot2)) + c.one[:, 5], 0)
        pairs = (cont2 > 0).astype(np.float64) - (inventory.cont2 > 0)
        cont1 = np.maximum(inventory.cont1 + np.bincount(inventory.two_last, pairs, len(inventory.cont1)) + c.one[:, 4], 0)
        n1 = np.maximum(inventory.n1 + inventory.words(n - inventory.n) + c.one[:, 7], 0)
        tot3, tot2 = np.maximum(tot3, np.bincount(inventory.three_ctx, n, len(tot3))), np.maximum(tot2, np.bincount(inventory.two_mid, cont2, len(tot2)))
        mass3 = np.bincount(inventory.three_ctx, np.maximum(n - DISCOUNT, 0), len(cont2)) + inventory.low3 + c.two[:, 4]
        mass2 = np.bincount(inventory.two_mid, np.maximum(cont2 - DISCOUNT, 0), len(cont1)) + inventory.low2 + c.one[:, 6]
        low = inventory.low1[1:] + c.low_left
        types = inventory.types + pairs.sum() + c.one[:, 4].sum() + c.low_left[0]
        return cls("rest", inventory.whole(), (n, tot3, mass3, cont2, tot2, mass2, cont1, n1), shared, types, low)

    def parts_with(self, local: Local | None) -> list[np.ndarray]:
        """The parts, those of the rest that some rows hold after them."""
        if local is None or not any(len(i.keys) for i in local.index):
            return self.parts
        (one, two, three), (by1, by2, by3) = local.counts, local.changes
        if self.kind == "rest":
            arrays = (three[:, 0] - by3[:, 1], two[:, 1] + by2[:, 5], two[:, 2] + by2[:, 4], two[:, 0] - by2[:, 3], one[:, 2] + by1[:, 5], one[:, 3] + by1[:, 6], one[:, 0] + by1[:, 4], one[:, 1] + by1[:, 7])
        else:
            arrays = (by3[:, 0], by2[:, 1], by2[:, 2], by2[:, 0], by1[:, 2], by1[:, 3], by1[:, 0], by1[:, 1])
            if self.kind == "none":
                arrays = tuple(np.zeros(len(a)) for a in arrays)
        return [np.concatenate(pair) for pair in zip(self.parts, self._parts(*arrays, (one[:, 0] + 1) / self.whole), strict=True)]

    def logs(self, one: np.ndarray, two: np.ndarray, three: np.ndarray, mid: np.ndarray, context: np.ndarray, order: int, local: Local | None = None) -> np.ndarray:
        kept3, tot3, left2, kept2, tot2, left1, lowest, words = self.parts_with(local)
        if order == 1:
            p = words[np.maximum(one, 0)]
        else:
            p = lowest[np.maximum(one, 0)]
            p = np.where((two >= 0) & (mid >= 0), kept2[two] / tot2[mid], 0.0) + np.where(mid >= 0, left1[mid], 1.0) * p
            p = np.where((three >= 0) & (context >= 0), kept3[three] / tot3[context] if len(kept3) else 0.0, 0.0) + np.where(context >= 0, left2[context], 1.0) * p
        return np.log(np.maximum(p, 1e-12)).astype(np.float64)


@dataclass
class Ratio:
    """Log-likelihood ratios of two classes: all that scoring needs of an inventory and its models. With ``order`` 1 by words alone."""

    one: Index
    two: Index
    three: Index
    first: Model
    second: Model
    order: int = 3

    @classmethod
    def of(cls, inventory: Inventory, first: Model, second: Model, order: int = 3) -> Ratio:
        return cls(inventory.one, inventory.two, inventory.three, first, second, order)

    def ratios(self, ids: np.ndarray, local: Local | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ratio at each place, 0 for unknown words, and which places hold known words."""

        def find(level: int, index: Index, keys: np.ndarray) -> np.ndarray:
            return local.find(level, index, keys) if local else index.find(keys)

        one = find(1, self.one, ids)
        known = (one >= 0) & (ids != 0)
        if self.order == 1:
            two = three = mid = context = one
        else:
            keys2, keys3 = grams(ids)
            two, three = find(2, self.two, keys2), find(3, self.three, keys3)
            mid, context = (np.concatenate([np.full(1, -1, np.int32), x[:-1]]) for x in (one, two))
        args = (one, two, three, mid, context, self.order, local)
        return np.where(known, self.first.logs(*args) - self.second.logs(*args), 0.0), known


def times(three: Index, ids: np.ndarray) -> np.ndarray:
    """Times each trigram of an index occurs in a run of words."""
    at = three.find(grams(ids)[1][ids != 0])
    return np.bincount(at[at >= 0], minlength=len(three.keys)).astype(np.float64)


def counted(rows: DataFrame, inventory: Inventory, choose: Callable[[np.ndarray, np.ndarray, Local], np.ndarray]) -> tuple[np.ndarray, DataFrame]:
    """Times each trigram occurs in what ``choose`` leaves of a run of ids, its row bounds and its n-grams of the rest, in all
    rows (ids, rest and changed): of the inventory by place, and a table (u, v, w, f) of all others."""
    spark, size, others = rows.sparkSession, len(inventory.three.keys), inventory.rest is not None
    shared = spark.sparkContext.broadcast((inventory.three, choose))  # an inventory of bounded size
    names = ["at", "u", "v", "w", "f"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, chosen = shared.value
        n = np.zeros(size)
        for batch in batches:
            for ids, bounds, local, _, _ in runs(batch):
                if len(ids):
                    left = chosen(ids, bounds, local)
                    n += times(index, left)
                    if others and left.any():
                        u, v, w, f = trigrams(left)
                        miss = index.find(chain(chain(chain(np.full(len(u), _SEED), u), v), w)) < 0
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(int(miss.sum()), -1)), *(pa.array(c[miss]) for c in (u, v, w)), pa.array(f[miss].astype(np.float64))], names)
        at = np.flatnonzero(n)
        none = pa.array(np.zeros(len(at), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(at), none, none, none, pa.array(n[at])], names)

    found = written(rows.select("ids", "rest", "changed").mapInArrow(count, "at bigint, u bigint, v bigint, w bigint, f double"), "found")
    held = found.where("at >= 0").groupBy("at").agg(F.sum("f").alias("n")).toArrow()
    n = np.zeros(size)
    n[column(held, "at")] = column(held, "n")
    shared.destroy()
    return n, found.where("at < 0").groupBy("u", "v", "w").agg(F.sum("f").alias("f"))


def _kept(count: Column) -> Column:
    return F.greatest(count - DISCOUNT, F.lit(0.0))


def changes(inventory: Inventory, found: DataFrame) -> Changes:
    """What trigrams of the rest, as :func:`counted` found them, change in both classes: one gains them (f), the other loses as
    many, or a count of its own (l). The larger of several counts of one counts."""
    result = Changes.none(inventory)
    if inventory.rest is None:
        return result
    lost = F.col("l" if "l" in found.columns else "f")
    three = found.groupBy("u", "v", "w").agg(F.max("f").alias("f"), F.max(lost).alias("l"))
    three = three.select(F.xxhash64("u", "v", "w").alias("key"), F.xxhash64("u", "v").alias("ctx"), F.xxhash64("v", "w").alias("suf"), F.col("v").alias("mid"), F.col("w").alias("last"), "f", "l")
    rest, zero = {k: inventory.rest.where(F.col("level") == k).select("key", "vals") for k in (1, 2, 3)}, F.lit(0.0)
    three = written(three.join(rest[3], "key").select("key", "ctx", "suf", "mid", "last", "f", "l", F.col("vals")[0].alias("n")), "found-trigrams")
    three = three.withColumn("g", F.least("l", "n"))
    f, n, g = F.col("f"), F.col("n"), F.col("g")
    begin = three.select(F.col("ctx").alias("key"), *[F.lit(None).cast("bigint").alias(c) for c in ("mid", "last")], zero.alias("c0"), f.alias("c1"), _kept(f).alias("c2"), zero.alias("c3"), (_kept(n - g) - _kept(n)).alias("c4"), (-g).alias("c5"), zero.alias("f"), zero.alias("g"))
    end = three.select(F.col("suf").alias("key"), "mid", "last", (f > 0).cast("double").alias("c0"), zero.alias("c1"), zero.alias("c2"), (n - g <= 0).cast("double").alias("c3"), zero.alias("c4"), zero.alias("c5"), "f", "g")
    two = begin.unionByName(end).groupBy("key").agg(F.max("mid").alias("mid"), F.max("last").alias("last"), *[F.sum(c).alias(c) for c in (*_EIGHT[:6], "f", "g")])
    two = _marked(two, rest[2], "found-bigrams", "cont")
    own, left, ends = F.col("is_rest").cast("double"), F.col("cont") - F.col("c3"), two.where("mid is not null")
    around = ends.select(F.col("mid").alias("key"), *[zero.alias(c) for c in ("c0", "c1")], (own * F.col("c0")).alias("c2"), (own * _kept(F.col("c0"))).alias("c3"), zero.alias("c4"), (-own * F.col("c3")).alias("c5"), (own * (_kept(left) - _kept(F.col("cont")))).alias("c6"), zero.alias("c7"))
    last = ends.select(F.col("last").alias("key"), own.alias("c0"), F.col("f").alias("c1"), zero.alias("c2"), zero.alias("c3"), (-own * (left <= 0).cast("double")).alias("c4"), zero.alias("c5"), zero.alias("c6"), (-F.col("g")).alias("c7"))
    one = _marked(around.unionByName(last).groupBy("key").agg(*[F.sum(c).alias(c) for c in _EIGHT]), rest[1], "found-words", "cont1", "n1")
    for index, table, into, names in ((inventory.two, two, result.two, _EIGHT[:6]), (inventory.one, one, result.one, _EIGHT)):
        held = table.where("not is_rest").select("key", *names).toArrow()  # places of the inventory at most
        at = index.find(column(held, "key"))
        for k, c in enumerate(names):
            into[at[at >= 0], k] = column(held, c)[at >= 0]
    cont1, n1, c0, c1, c4, c7 = (F.col(c) for c in ("cont1", "n1", "c0", "c1", "c4", "c7"))
    sums = one.where("is_rest").agg(*[F.coalesce(F.sum(e), zero) for e in (c0, _kept(c0), c1, _kept(c1), c4, _kept(cont1 + c4) - _kept(cont1), c7, _kept(n1 + c7) - _kept(n1))]).first()
    result.low_found, result.low_left = np.array(sums[:4]), np.array(sums[4:])
    rows = three.select(F.lit(3).alias("level"), "key", F.array(f, g, *[zero] * 6).alias("vals"))
    rows = rows.unionByName(two.where("is_rest").select(F.lit(2).alias("level"), "key", F.array(*_EIGHT[:6], zero, zero).alias("vals")))
    result.table = written(rows.unionByName(one.where("is_rest").select(F.lit(1).alias("level"), "key", F.array(*_EIGHT).alias("vals"))), "found-rest")
    return result


_EIGHT = [f"c{k}" for k in range(8)]


def _marked(table: DataFrame, rest: DataFrame, name: str, *counts: str) -> DataFrame:
    """Changes by n-gram, with whether it is of the rest, and its counts if so."""
    table = written(table, name)
    there = written(rest.join(table.select("key"), "key").select("key", *[F.col("vals")[k].alias(c) for k, c in enumerate(counts)]), name)
    return table.join(there.withColumn("is_rest", F.lit(True)), "key", "left").withColumn("is_rest", F.coalesce("is_rest", F.lit(False))).fillna(0.0, list(counts))


_ENTRY = "array<struct<level:int,key:bigint,vals:array<double>>>"


def _told(asks: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """For each row (row) the entries of a table for the n-grams (level, key) that it asks for."""
    return asks.join(table, ["level", "key"]).groupBy("row").agg(F.collect_list(F.struct("level", "key", "vals")).alias(name))


def with_rest(texts: DataFrame, inventory: Inventory) -> DataFrame:
    """Rows of text, each with the counts of the n-grams of the rest that it holds (rest), and without changes (changed).
    Where there are such, a new table takes the place of that of the texts."""
    if inventory.rest is None:
        return texts.withColumn("rest", F.array().cast(_ENTRY)).withColumn("changed", F.lit(None).cast(_ENTRY))
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((inventory.one, inventory.two, inventory.three))  # of bounded size

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = np.asarray(batch.column(0))
            for lo, hi, ids, bounds in parts(batch.column(1)):
                owner = np.repeat(number[lo:hi], np.diff(bounds))
                for level, (index, keys) in enumerate(zip(shared.value, (ids, *grams(ids)), strict=True), 1):
                    miss = np.flatnonzero(index.find(keys) < 0)
                    yield pa.RecordBatch.from_arrays([pa.array(owner[miss]), pa.array(np.full(len(miss), level, np.int32)), pa.array(keys[miss])], ["row", "level", "key"])

    asks = texts.select("row", "ids").mapInArrow(ask, "row bigint, level int, key bigint")
    told = written(_told(asks, inventory.rest, "rest"), "document-rest")
    shared.destroy()
    del asks
    dropped(spark)
    rows = written(texts.join(told, "row", "left").withColumn("rest", F.coalesce("rest", F.array().cast(_ENTRY))), "document-counts")
    dropped(spark, texts, told)
    return rows.withColumn("changed", F.lit(None).cast(_ENTRY))


def with_changes(rows: DataFrame, found: Changes, order: int = 3) -> DataFrame:
    """Rows of :func:`with_rest` with the changes of the n-grams of the rest that they hold, of words alone for models of ``order`` 1."""
    if found.table is None:
        return rows
    asks = rows.select("row", F.explode("rest").alias("own")).select("row", "own.level", "own.key")
    asks, table = (t.where("level = 1") if order == 1 else t for t in (asks, found.table))
    return rows.drop("changed").join(written(_told(asks, table, "changed"), "changed"), "row", "left")


def runs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, Local, int, int]]:
    """Rows (ids, rest, changed) in slices: the ids end to end, the bounds of rows, their n-grams of the rest; first row and end row."""
    ids, rest, changed = (batch.column(batch.schema.get_field_index(c)) for c in ("ids", "rest", "changed"))
    for lo, hi, own, bounds in parts(ids):
        yield own, bounds, Local(rest.slice(lo, hi - lo), changed.slice(lo, hi - lo)), lo, hi


def parts(column: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """A column of id lists in slices of about ``most`` ids: first row, end row, the ids end to end, the bounds of rows."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    flat, base = np.asarray(column.flatten()), offsets[0]
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, flat[offsets[lo] - base : offsets[hi] - base], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


_TRIGRAM = ("u", "v", "w", "n")


def trigrams(ids: np.ndarray) -> list[np.ndarray]:
    """The different trigrams of a run of words, and the times of each; marks stand before the words of a sentence."""
    at = np.flatnonzero(ids != 0)
    _, first, n = np.unique(grams(ids)[1][at], return_index=True, return_counts=True)
    at = at[first]
    before = ids[at - 1]
    return [np.where(before == 0, 0, ids[at - 2]), before, ids[at], n]


def weighted(texts: list[np.ndarray]) -> pa.Table:
    """The trigrams of some texts of the driver."""
    found = [trigrams(ids) for ids in texts if len(ids)]
    return pa.table({name: np.concatenate([np.zeros(0, np.int64), *(c[k] for c in found)]) for k, name in enumerate(_TRIGRAM)})


def _cut(v: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """The trigrams that the texts of some trigrams (of these last two words) have besides, where they are cut before any word: it begins a sentence then."""
    after = v != 0
    found = np.unique(np.concatenate([np.stack([v * 0, v * 0, w], axis=1), np.stack([v * 0, v, w], axis=1)[after]]), axis=0)
    return [found[:, k] for k in range(3)]


def _of_sample(columns: list[np.ndarray], own: int) -> pa.RecordBatch:
    """Trigrams that are kept (``own`` 2) or cut from those (1), without a count."""
    n = len(columns[0])
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, own, np.int32))], [*_TRIGRAM, "own"])


def column(table: pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy()


def take_inventory(texts: DataFrame, kept: pa.Table, documents: int, sample: list[int] | None = None) -> Inventory:
    """The models' words and n-grams, and their counts over all documents: those of ``kept`` (trigrams of the seeds), those
    of the texts with the ids (doc_id) of a ``sample``, which are read where the texts are, and all that occur at least ``LEAST`` times.

    The counts are exact, by one aggregation of all different trigrams. What is collected are those of ``kept`` and
    ``sample``, those that occur ``LEAST_SHARE`` times a document, and those that cutting the kept ones gives: not more n-grams can occur so often than a document has words,
    over the share. The rest is written as a table.
    """

    chosen = pa.array(sample or [], pa.int64())  # of bounded size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = np.asarray(pc.is_in(batch.column(1), chosen)) if len(chosen) else np.zeros(batch.num_rows, bool)
            for lo, hi, ids, bounds in parts(batch.column(0)):
                if len(ids):
                    found = trigrams(ids)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, found), pa.array(np.zeros(len(found[0]), np.int32))], [*_TRIGRAM, "own"])
                    if mine[lo:hi].any():
                        u, v, w, _ = trigrams(ids[np.repeat(mine[lo:hi], np.diff(bounds))])
                        yield _of_sample([u, v, w], 2)
                        yield _of_sample(_cut(v, w), 1)

    spark, least = texts.sparkSession, max(LEAST, int(np.ceil(LEAST_SHARE * documents)))
    lowest = LEAST
    seeded = spark.createDataFrame(kept.drop_columns(["n"])).withColumn("n", F.lit(0).cast("bigint")).withColumn("own", F.lit(2))  # of fixed size
    rows = texts.select("ids", *["doc_id"] * bool(sample)).mapInArrow(count, "u bigint, v bigint, w bigint, n bigint, own int").unionByName(seeded)
    rows = rows.unionByName(spark.createDataFrame(pa.Table.from_batches([_of_sample(_cut(column(kept, "v"), column(kept, "w")), 1)])))
    every = rows.groupBy("u", "v", "w").agg(F.sum("n").alias("n"), F.max("own").alias("own")).where("n > 0 OR own = 2")
    often = (F.col("n") >= least) | ((F.col("own") == 1) & (F.col("n") >= lowest))
    table = written(every.select("u", "v", "w", "n", (F.col("own") == 2).alias("kept"), (often | (F.col("own") == 2)).alias("held")), "trigrams")
    del rows, every
    dropped(spark)
    every = table.select(F.xxhash64("u", "v", "w").alias("key"), F.xxhash64("u", "v").alias("ctx"), F.xxhash64("v", "w").alias("suf"), F.col("v").alias("mid"), F.col("w").alias("last"), "n", "kept", "held")
    seen, no = F.when(F.col("n") > 0, 1), F.lit(False)
    rest3 = ~F.col("held") & (F.col("n") >= lowest)
    by_suffix = every.groupBy(F.col("suf").alias("key")).agg(F.first("mid").alias("mid"), F.first("last").alias("last"), F.count(seen).alias("cont"), F.sum("n").alias("n"), F.max("kept").alias("kept"), F.max("held").alias("held"))
    by_context = every.groupBy(F.col("ctx").alias("key")).agg(F.sum("n").alias("tot"), F.max("kept").alias("ctx_kept"), F.max("held").alias("ctx_held"), F.max("n").alias("most"), F.sum(F.when(rest3, _kept(F.col("n"))).otherwise(0.0)).alias("low"))
    pairs = by_suffix.join(by_context, "key", "full_outer")

    def wanted(times: int) -> Column:
        return F.coalesce("kept", no) | F.coalesce("ctx_kept", no) | (F.coalesce("most", F.lit(0)) >= times) | (F.coalesce("n", F.lit(0)) >= times)

    pairs = pairs.withColumn("held", wanted(least) | F.coalesce("held", no) | F.coalesce("ctx_held", no)).withColumn("rest", wanted(lowest) & ~F.col("held"))
    pairs = written(pairs.drop("ctx_held"), "bigrams")
    words = pairs.where("cont is not null").groupBy(F.col("last").alias("id")).agg(F.count(F.when(F.col("cont") > 0, 1)).alias("cont"), F.sum("n").alias("n"), F.max("kept").alias("kept"), F.max("held").alias("held"))
    around = pairs.where("cont is not null").groupBy(F.col("mid").alias("id")).agg(F.sum("cont").alias("tot"), F.max("kept").alias("mid_kept"), F.max("held").alias("mid_held"), F.sum("n").alias("m"), F.sum(F.when(F.col("rest"), _kept(F.col("cont"))).otherwise(0.0)).alias("low"))
    words = words.join(around, "id", "full_outer")

    def wanted_word(times: int) -> Column:
        return (F.coalesce("n", F.lit(0)) >= times) | (F.coalesce("m", F.lit(0)) >= times) | F.coalesce("kept", no) | F.coalesce("mid_kept", no)

    def numbers(*names: str) -> list[Column]:
        return [F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in names]

    words = words.withColumn("held", wanted_word(least) | F.coalesce("held", no) | F.coalesce("mid_held", no)).withColumn("rest", wanted_word(lowest) & ~F.col("held")).select("id", "held", "rest", *numbers("cont", "n", "tot", "low"))
    low1, rest = np.zeros(5), None
    if least > lowest:
        zero = F.lit(0.0)
        rest = every.where(rest3).select(F.lit(3).alias("level"), "key", F.array(F.col("n").cast("double"), zero, zero, zero).alias("vals"))
        rest = rest.unionByName(pairs.where("rest").select(F.lit(2).alias("level"), "key", F.array(*numbers("cont", "tot", "low"), zero).alias("vals")))
        words = written(words, "words")
        rest = written(rest.unionByName(words.where("rest").select(F.lit(1).alias("level"), F.col("id").alias("key"), F.array("cont", "n", "tot", "low").alias("vals"))), "rest")
        low1 = np.array(words.where("rest").agg(F.count(F.lit(1)).cast("double"), *[F.coalesce(F.sum(e), zero) for e in (F.col("cont"), _kept(F.col("cont")), F.col("n"), _kept(F.col("n")))]).first(), np.float64)
    three = every.where("held").select("key", "ctx", "suf", "n").toArrow()
    two = pairs.where("held").select("key", F.coalesce("mid", F.lit(0)).alias("mid"), F.coalesce("last", F.lit(0)).alias("last"), *numbers("cont", "tot", "low")).toArrow()
    one = words.where("held").select("id", "cont", "tot", "low", "n").toArrow()
    types = pairs.agg(F.count(F.when(F.col("cont") > 0, 1))).first()[0]
    dropped(spark, table, pairs, *([words] if least > lowest else []))
    index1, index2, index3 = Index(column(one, "id")), Index(column(two, "key")), Index(column(three, "key"))
    places = [index1.find(column(two, "mid")), index1.find(column(two, "last")), index2.find(column(three, "ctx")), index2.find(column(three, "suf"))]
    places = [np.maximum(p, 0) for p in places]  # a mark is the last word of no bigram but that of two marks
    arrays = [np.array(x, np.float64) for x in (column(three, "n"), *(column(two, c) for c in ("tot", "low", "cont")), *(column(one, c) for c in ("tot", "low", "cont", "n")))]
    for index in (index1, index2, index3):
        index.keys = np.array(index.keys)  # a copy, so that nothing holds the tables
    del one, two, three
    pa.default_memory_pool().release_unused()
    return Inventory(index1, index2, index3, *places, arrays[0], arrays[1], arrays[2], arrays[3], arrays[4], arrays[5], arrays[6], arrays[7], types, low1, rest)
