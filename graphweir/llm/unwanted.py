"""Abusive, hateful or sexual content, by class-conditional Kneser-Ney models.

Two word models, of unwanted and of ordinary language, give each span of a
text a log-likelihood ratio, normalised by its length; the highest of a text's
spans is its score. Spans are sentences, and within long or unpunctuated runs
also every window of ``WINDOW`` words. Words are read through common disguises
(spaced letters, look-alike letters and digits, hidden characters, stars).

Both models interpolate absolutely discounted trigram counts, the numbers of
different words before each bigram, and those before each word, down to one
distribution that the classes share, the number of different words that each
word follows in all documents. What only that distribution knows is so equally
likely in both, and a rare expression counts for no more than its known parts.

Fitting. Counts are exact and cover all documents (:mod:`.ngrams`); the models
know the n-grams of the labelled sample and the seeds, and all that occur twice
or more: frequent ones are broadcast, all others joined to the documents. The
labelled rows are a bounded sample (``MOST_LABELLED`` documents of
``MOST_CHARACTERS`` in all, by hash order).
Labels hold for whole documents, most of whose sentences are ordinary even in
an unwanted one: a first model takes all sentences of unwanted documents, the
next only those that the one before found unwanted. The threshold is set on
labelled documents that the scoring model has not seen (folds).

Defined results
---------------
* Null, empty and blank texts score 0 and are not unwanted.
* Texts of any length are read whole. Repeated texts get equal scores.
* A document with as many clean as unwanted ratings, or of unknown labels
  only, trains nothing. Without labels the seed sentences alone train.
* Only the named columns are read, so further columns may have any names.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweir.llm.ngrams import Changes, Inventory, Local, Model, Ratio, WordIds, changes, counted, runs, take_inventory, weighted, with_changes, with_rest
from graphweir.llm.seeds import ORDINARY_SEEDS, UNWANTED_SEEDS
from graphweir.session import written

#: Labelled documents that are fitted on at most.
MOST_LABELLED = 10_000
#: Characters of theirs in all; a text that would pass this is left out of the sample, but counted and scored whole like all others.
MOST_CHARACTERS = 50_000_000
WINDOW = 8
#: Added to a span's length, so that one odd word does not decide.
CALM = 2.0
ROUNDS = 3
FOLDS = 5
#: Scores from which a span of any document is taken as unwanted: by a model of the labelled sample and by words over all
#: documents, both of which must hold; and then by the whole model.
SURE_LABELLED, SURE_WORDS, SURE = 1.5, 0.3, 1.0
#: Scores from which a sentence of an unwanted document counts as unwanted, and below which it is known as ordinary.
KEPT, UNKNOWN = 1.0, -0.2
#: Range in which the threshold is sought, and the one used without labels.
LEAST_THRESHOLD, MOST_THRESHOLD, DEFAULT_THRESHOLD = 0.9, 2.6, 1.4

#: Letters that look like Latin ones, and digits or signs that stand for letters (fixed values).
_LOOK = dict(zip("аеорсухіјѕһкмтАВЕКМНОРСТХІЈЅ", "aeopcyxijshkmtABEKMHOPCTXIJS", strict=True))
_LEET = dict(zip("013457@$!", "oieastasi", strict=True))
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ ]{1,3}[^\W\d_]){2,}(?![^\W_])|(?<![^\W_])[^\W\d_](?:[.\-_*][^\W\d_]){2,}(?![^\W_])")
_LONG = re.compile(r"([^\W\d_])\1{2,}")
_ATOM = re.compile(r"[^\W_]+(?:['’*#@$!]+[^\W_]+)*|[.!?…\n\r]+")
_ORDINAL = re.compile(r"\d+[^\W\d_]+")  # 2nd, 19th, 5kg
_DIGIT_OR_SIGN = re.compile(r"[013457@$!]")


def _unspace(match: re.Match) -> str:
    """Spaced letters as words; two or more spaces part words."""
    if " " in match[0]:
        return " ".join(part.replace(" ", "") for part in re.split(r" {2,}", match[0]))
    return re.sub(r"[.\-_*]", "", match[0])


class _Words(dict):
    """What an atom of text reads as, remembered: a word in lower case, "0" for numbers, "" for ends of sentences."""

    def __missing__(self, atom: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[atom] = word = self.read(atom)
        return word

    @staticmethod
    def read(atom: str) -> str:
        if atom[0] in ".!?…\n\r":
            return ""
        word = atom
        letters = sum(c.isalpha() for c in word)
        digits = sum(c.isdigit() for c in word)
        if digits and not letters:
            return "0"
        if letters and digits <= letters + 1 and _DIGIT_OR_SIGN.search(word) and not _ORDINAL.fullmatch(word):
            word = "".join(_LEET.get(c, c) for c in word)
        if word[0].isdigit():
            return "0"
        return _LONG.sub(r"\1", word).lower().replace("’", "'")


_WORDS = _Words()


def plain(text: str) -> str:
    """A text without hidden characters, look-alike letters and letters set apart."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
        if any("\u0400" <= c <= "\u04ff" for c in text):
            text = "".join(_LOOK.get(c, c) for c in text)
    return text


def atoms(text: str) -> list[str]:
    """Words in lower case and, between sentences, empty strings."""
    text = plain(text)
    found = _ATOM.findall(text)
    # letters set apart: only where three atoms of one character follow each other
    short = bytes([len(a) == 1 for a in found])
    if b"\x01\x01\x01" in short and _SPACED.search(text):
        found = _ATOM.findall(_SPACED.sub(_unspace, text))
    return [_WORDS[a] for a in found]


class Disguises:
    """Words of the sample that stars or accents may hide; of fixed size, as the sample is."""

    def __init__(self, unwanted: Counter[str], clean: Counter[str], most: int = 2000) -> None:
        self.known = frozenset(unwanted) | frozenset(clean)
        total, other = sum(unwanted.values()) + 1, sum(clean.values()) + 1
        odds = {w: n / total * other / (clean[w] + 0.5) for w, n in unwanted.items() if len(w) > 2 and "*" not in w and "#" not in w}
        self.starred = sorted(odds, key=lambda w: (-odds[w], w))[:most]

    def reveal(self, word: str) -> str:
        if "*" in word or "#" in word:
            pattern = re.compile("".join(".{1,3}" if part[0] in "*#" else re.escape(part) for part in re.findall(r"[*#]+|[^*#]+", word)))
            return next((w for w in self.starred if pattern.fullmatch(w)), word)
        if word.isascii() or word in self.known:
            return word
        bare = "".join(c for c in unicodedata.normalize("NFKD", word.replace("ø", "o")) if not unicodedata.combining(c))
        return bare if bare in self.known else word


class Scorer:
    """Scores texts by the likelihood ratio of their spans; with ``order`` 1 by words alone."""

    def __init__(self, inventory: Inventory, unwanted: Model, ordinary: Model, order: int = 3) -> None:
        self.ratio = Ratio.of(inventory, unwanted, ordinary, order)

    def spans(self, ids: np.ndarray, local: Local | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First place, end place and score of every span of a run of words; ends of sentences have id 0."""
        n = len(ids)
        ratio, is_known = self.ratio.ratios(ids, local)
        total, known = np.concatenate([[0.0], np.cumsum(ratio)]), np.concatenate([[0], np.cumsum(is_known)])
        ends = np.concatenate([np.flatnonzero(ids == 0), [n]])
        starts = np.concatenate([[0], ends[:-1] + 1])
        keep = starts < ends
        starts, ends = starts[keep], ends[keep]
        long = ends - starts > WINDOW
        lengths = (ends - starts - WINDOW)[long] + 1
        first = np.repeat(starts[long], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        a, z = np.concatenate([starts, first]), np.concatenate([ends, first + WINDOW])
        return a, z, (total[z] - total[a]) / (known[z] - known[a] + CALM)

    def within(self, ids: np.ndarray, least: float, local: Local | None = None) -> np.ndarray:
        """The words in spans of at least that score; all others as ends of sentences."""
        a, z, scores = self.spans(ids, local)
        sure = scores >= least
        edges = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edges, a[sure], 1)
        np.add.at(edges, z[sure], -1)
        return np.where(np.cumsum(edges)[:-1] > 0, ids, 0)

    def score(self, ids: np.ndarray) -> float:
        scores = self.spans(ids)[2] if len(ids) else np.zeros(0)
        return float(scores.max()) if len(scores) else 0.0

    def score_texts(self, ids: np.ndarray, bounds: np.ndarray, local: Local | None = None) -> np.ndarray:
        """Scores of many texts laid end to end."""
        result = np.zeros(len(bounds) - 1)
        if len(ids):
            a, _, scores = self.spans(ids, local)
            best = np.full(len(result), -np.inf)
            np.maximum.at(best, np.searchsorted(bounds, a, "right") - 1, scores)
            result = np.where(np.isfinite(best), best, 0.0)
        return result


def _within(scorers: list[tuple[Scorer, float]], ids: np.ndarray, _: np.ndarray, local: Local) -> np.ndarray:
    """The words in spans of at least that score by every scorer."""
    for scorer, least in scorers:
        ids = np.where(scorer.within(ids, least, local) == 0, 0, ids) if ids.any() else ids
    return ids


# --- passes over all documents -----------------------------------------------------


def read_words(documents: DataFrame, disguises: Disguises) -> DataFrame:
    """Documents (row, doc_id, source, ids) with a number of their own and the ids of their words; written, as all passes read it."""
    shared = documents.sparkSession.sparkContext.broadcast(disguises)  # of fixed size

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(atoms, shared.value.reveal)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                own = [words.text(t) for t in part.column(2).to_pylist()]
                offsets = np.cumsum([0, *map(len, own)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *own])))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(own))), part.column(0), part.column(1), ids], ["row", "doc_id", "source", "ids"])
                row += len(own)

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(read, "row bigint, doc_id bigint, source string, ids array<bigint>"), "document-words")


# --- fitting -------------------------------------------------------------------------


def chosen_labels(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_characters: int = MOST_CHARACTERS) -> dict[int, int]:
    """Ids of labelled documents with 1 for unwanted, 0 for clean, by majority of their ratings: in the order of a hash, as
    many as both bounds allow."""
    known = labels.where("doc_id is not null").withColumn("unwanted", F.lower(F.trim("label")).isin("abusive", "hateful", "sexual").cast("int")).where(F.col("unwanted").eqNullSafe(1) | F.lower(F.trim("label")).eqNullSafe("clean"))
    votes = known.groupBy("doc_id").agg(F.avg(F.col("unwanted")).alias("share")).where("share != 0.5")
    sample = votes.select("doc_id", (F.col("share") > 0.5).cast("int").alias("unwanted")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sized = documents.select("doc_id", F.length("text").alias("size")).where("text is not null").join(F.broadcast(sample), "doc_id")  # at most ``most`` rows of two numbers
    total, chosen = 0, {}
    for r in sized.orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if total + r.size <= most_characters:
            total += r.size
            chosen[r.doc_id] = r.unwanted
    return chosen


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_characters: int = MOST_CHARACTERS) -> list[tuple[str, int]]:
    """The texts of :func:`chosen_labels` with their labels."""
    return labelled_texts(documents, chosen_labels(documents, labels, most, most_characters))


def labelled_texts(documents: DataFrame, chosen: dict[int, int]) -> list[tuple[str, int]]:
    if not chosen:
        return []
    picked = documents.sparkSession.createDataFrame([(k,) for k in chosen], "doc_id bigint")
    rows = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")
    return [(r.text, chosen[r.doc_id]) for r in rows.orderBy("doc_id").collect()]


def _unwanted_part(scorer: Scorer, ids: np.ndarray) -> np.ndarray:
    """The sentences of an unwanted document that say so (windows of long ones), the rest as
    sentence ends: all of at least ``KEPT``, else the best one if it isn't known as ordinary."""
    a, z, scores = scorer.spans(ids)
    if not len(a):
        return ids
    ends = np.concatenate([np.flatnonzero(ids == 0), [len(ids)]])
    sentence = np.searchsorted(ends, a)
    order = np.lexsort((a, -scores, sentence))  # the best span of each sentence comes first
    best = order[np.concatenate([[True], sentence[order][1:] != sentence[order][:-1]])]
    kept = best[scores[best] >= KEPT]
    if not len(kept):
        top = best[int(np.argmax(scores[best]))]
        kept = np.array([top] if scores[top] >= UNKNOWN else [], np.int64)
    mask = np.zeros(len(ids), bool)
    for k in kept.tolist():
        lo, hi = int(a[k]), int(z[k])
        at = int(np.searchsorted(ends, lo))
        begin = int(ends[at - 1]) + 1 if at else 0
        if ends[at] - begin <= 2 * WINDOW:
            lo, hi = begin, int(ends[at])
        mask[lo:hi] = True
    return np.where(mask, ids, 0)


@dataclass
class Sample:
    """The labelled documents and the seeds as ids of words."""

    unwanted: list[np.ndarray]
    clean: list[np.ndarray]
    seeds: list[np.ndarray]
    ordinary: list[np.ndarray]


def _refined(inventory: Inventory, sample: Sample, ordinary: Model, seeds: np.ndarray, shared: np.ndarray, changed: Changes | None = None) -> tuple[Model, list[Scorer]]:
    """The unwanted class of some counts and what makes the labelled documents unwanted, and scorers that leave out a fold each.

    The sentences that make a document unwanted are sought by models that have not seen the document: those of the
    other folds. An ordinary sentence of an unwanted or wrongly labelled document is known to be ordinary; one that
    neither class knows stays.
    """
    chosen = sample.unwanted
    for number in range(ROUNDS + 1):
        folds = [inventory.counts(chosen[k::FOLDS]) for k in range(FOLDS)]
        everything = seeds + sum(folds)
        scorers = [Scorer(inventory, Model.of(inventory, everything - f, shared, changed), ordinary, 1 if number == 0 else 3) for f in folds]
        if number < ROUNDS:
            chosen = [_unwanted_part(scorers[k % FOLDS], ids) for k, ids in enumerate(sample.unwanted)]
    return Model.of(inventory, everything, shared, changed), scorers


def _fit(inventory: Inventory, sample: Sample, found: np.ndarray, documents: int, changed: Changes | None = None) -> tuple[Scorer, list[Scorer]]:
    """A scorer, and those that have not seen a fold of the unwanted documents.

    Counts over all documents, without those ``found`` unwanted (``changed`` those of the rest), make the ordinary class; look-alikes labelled as
    clean, and seeds, count again.
    """
    shared = inventory.shared()
    more = 3 * inventory.counts(sample.clean) + max(2, documents // 2000) * inventory.counts(sample.ordinary)
    ordinary = Model.rest(inventory, more, found, shared, changed)
    unwanted, folds = _refined(inventory, sample, ordinary, inventory.counts(sample.seeds) + found, shared, changed)
    return Scorer(inventory, unwanted, ordinary), folds


def _fit_labelled(inventory: Inventory, sample: Sample) -> Scorer:
    """A scorer of the labelled sample and the seeds alone, whose ordinary class no unlabelled document can spoil."""
    shared = inventory.shared()
    ordinary = Model.of(inventory, inventory.counts(sample.clean) + 2 * inventory.counts(sample.ordinary), shared)
    unwanted, _ = _refined(inventory, sample, ordinary, inventory.counts(sample.seeds), shared)
    return Scorer(inventory, unwanted, ordinary)


def _threshold(bad: np.ndarray, clean: np.ndarray) -> float:
    """The median of the thresholds at which labelled documents are told apart best (F1)."""
    if len(bad) < 5:
        return DEFAULT_THRESHOLD
    candidates = np.arange(LEAST_THRESHOLD, MOST_THRESHOLD + 0.01, 0.05)
    hit = (bad >= candidates[:, None]).sum(axis=1)
    f1 = 2 * hit / (hit + (clean >= candidates[:, None]).sum(axis=1) + len(bad)) if len(clean) else hit / len(bad)
    return float(np.quantile(candidates[f1 >= f1.max() - 1e-9], 0.5))


def _read(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, Sample, list[int]]:
    """The words of all documents, and of the labelled sample and the seeds; the ids of the sample."""
    chosen = chosen_labels(documents, labels)
    labelled = labelled_texts(documents, chosen)
    bad, good = Counter(), Counter()
    for text, label in labelled:
        (bad if label else good).update(w for w in atoms(text) if w)
    for text in UNWANTED_SEEDS:
        bad.update(w for w in atoms(text) if w)
    for text in ORDINARY_SEEDS:
        good.update(w for w in atoms(text) if w)
    disguises = Disguises(bad, good)
    texts = read_words(documents, disguises)
    words = WordIds(atoms, disguises.reveal)
    return texts, Sample([words.text(t) for t, label in labelled if label], [words.text(t) for t, label in labelled if not label], [words.text(t) for t in UNWANTED_SEEDS], [words.text(t) for t in ORDINARY_SEEDS]), list(chosen)


def fit(documents: DataFrame, labels: DataFrame) -> tuple[Scorer, float, DataFrame]:
    """A scorer, its threshold, and the words of all documents with the counts of those of the rest.

    Unwanted sentences are all but few in documents without labels, where they would teach the ordinary class. A first
    pass over all documents finds spans that are unwanted by the labelled sample, in which labels part the classes, and
    by words over all documents; a second pass those that the whole model finds unwanted. Their counts pass from the
    ordinary to the unwanted class, but for n-grams that more clean than unwanted labelled documents hold.
    """
    texts, sample, chosen = _read(documents, labels)
    n = texts.count()
    inventory = take_inventory(texts, weighted([*sample.seeds, *sample.ordinary]), n, sample=chosen)
    texts = with_rest(texts, inventory)
    clean = inventory.counts([*sample.clean, *sample.ordinary]) > inventory.counts(sample.unwanted)
    by_words = _fit(inventory, sample, np.zeros(len(clean)), n)[0]
    by_words.ratio.order = 1
    chosen = partial(_within, [(_fit_labelled(inventory, sample), SURE_LABELLED), (by_words, SURE_WORDS)])
    found, others = counted(texts, inventory, chosen)
    found, changed = np.where(clean, 0, found), changes(inventory, others)
    del chosen, by_words
    whole = _fit(inventory, sample, found, n, changed)[0]
    again, more = counted(with_changes(texts, changed), inventory, partial(_within, [(whole, SURE)]))
    del whole
    found, changed = np.maximum(found, np.where(clean, 0, again)), changes(inventory, others.unionByName(more))
    scorer, folds = _fit(inventory, sample, found, n, changed)
    texts = with_changes(texts, changed)
    held = [np.array([folds[k % FOLDS].score(ids) for k, ids in enumerate(own)]) for own in (sample.unwanted, sample.clean)]
    return scorer, _threshold(*held), texts


_SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("unwanted", T.BooleanType())])


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its score and the decision: doc_id, source, score, unwanted."""
    scorer, threshold, texts = fit(documents, labels)
    shared = documents.sparkSession.sparkContext.broadcast(scorer)  # an inventory of bounded size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, bounds, local, lo, hi in runs(batch):
                scores = shared.value.score_texts(ids, bounds, local)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores), pa.array(scores >= threshold)], _SCORED.fieldNames())

    return texts.select("doc_id", "source", "ids", "rest", "changed").mapInArrow(score, _SCORED)


def rates(scored: DataFrame) -> DataFrame:
    """Per source: documents, unwanted ones and their rate."""
    n = F.count(F.lit(1))
    bad = F.sum(F.col("unwanted").cast("bigint"))
    return scored.groupBy("source").agg(n.alias("documents"), bad.alias("unwanted"), (bad / n).alias("rate"), F.avg("score").alias("mean_score"))
