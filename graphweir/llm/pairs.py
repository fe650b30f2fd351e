"""Broken prompt and response pairs.

Each answer unfit for use gets the one defect it has:

* ``empty``: no content but placeholders and bare labels;
* ``copies_question``: nothing but the question again, and labels;
* ``refusal``: declines, or claims not to know, although a gold answer exists; told
  by class-conditional n-gram models of whole answers (:mod:`.declining`);
* ``other_language``: naive Bayes over character n-grams gives the answer and
  its question different languages by a clear margin, and no gold answer is in
  the language of the answer;
* ``truncated``: the text breaks off before its sentence, word or name is
  complete. A model of ends of text gives the likelihood that a text ends
  after its last words, by counts of n-grams of these words over all texts and
  gold answers, those of its own pair weighing ``CACHE`` times; and another the
  likelihood that its last word ends with its last letter, by how often all
  texts hold the word, and longer ones that begin with it.

Models. Languages are fitted on a bounded sample of labelled documents
(``MOST_TEXTS`` per language, of ``MOST_CHARACTERS`` in all) and on all questions
and gold answers whose language that fit is sure of; n-grams are hashed into a
fixed number of features. Counts of ends and of words cover all documents,
questions and gold answers: they are exact, by 64-bit keys of n-grams, aggregated
for the n-grams that answers end with and joined to these; nothing of them is
held in one place.

Defined results
---------------
* A null answer is empty. Null questions and null, empty or placeholder gold
  answers are missing evidence: without a question nothing is copied and no
  language differs; without a gold answer nothing is a refusal.
* The first defect that holds in the order above is the one. Wrong answers are
  no defect, nor is a missing full stop.
* Repeated rows count once; several answers under one id can each add a row of
  another defect. Texts of any length are read whole.
* Empty tables give no row; without documents the built-in sentences train.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweir.llm import declining
from graphweir.llm.ngrams import Runs
from graphweir.session import written

LANGUAGES = ("en", "de", "fr", "es")
#: Spellings of language labels (fixed values).
SPELLINGS = {
    "en": "en", "eng": "en", "english": "en", "en-us": "en", "en-gb": "en", "de": "de", "deu": "de", "ger": "de", "german": "de", "deutsch": "de",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr", "français": "fr", "es": "es", "spa": "es", "spanish": "es", "español": "es",
}
MOST_TEXTS = 400
#: Characters of theirs in all; a text that would pass this is left out of the sample.
MOST_CHARACTERS = 20_000_000
#: Hashed features of the language model, a power of two.
FEATURES = 1 << 17
ORDERS = 5
#: Places of the filter that spares n-grams nobody asks for the exchange; full, it spares none, and counts stay the same.
PLACES = 1 << 20
GRAMS = range(1, 6)
#: Log-odds, in all and per character, by which an answer must be in another language.
SURE, SURE_PER_CHARACTER = 6.0, 0.25
#: Likelihood of an end of text under which a text breaks off.
LEAST_END = 0.02
#: Texts that the gold answers of a pair count for, when the end of its own answer is judged.
CACHE = 50
#: Share of answers that are cut inside a word, letters of a word, and what a word that no text holds counts for: their
#: product tells whether a last word is more likely a whole one or the beginning of others.
CUT, LETTERS, NOVEL = 0.03, 6.0, 0.002

# --- what an answer says -------------------------------------------------------

#: Labels that may stand around an answer, and values that stand for none (fixed values).
LABELS = r"(?:the\s+|final\s+|your\s+|my\s+)*(?:answers?|antwort|réponse|respuesta|thoughts?|thinking|question|frage|pregunta|output|response|result|a|q)"
PLACEHOLDERS = frozenset("none null nan nil na n/a n.a. n.a n/d n.d. tbd tba todo undefined unknown empty leer vide vacío [] {} () <> - -- --- – — _ . .. ... … ? ?? ??? ! / // \\ * ** # x xx xxx \"\" '' keine ninguna ninguno aucune aucun".split())
_TAG = re.compile(r"</?[A-Za-z][\w-]*\s*/?>")
_LABEL = re.compile(rf"(?:(?<=^)|(?<=[\s>*#]))[*#_\s]*{LABELS}[*_\s]*[:：][*_]*", re.I)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_BREAK = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+|\n+")

def _folded(text: str) -> str:
    return text.casefold().replace("’", "'")


def words(text: str | None) -> list[str]:
    return _WORD.findall(_folded(text)) if text else []


@lru_cache(maxsize=1024)  # the rows of a slice
def bare(text: str | None) -> str:
    """An answer without tags and labels."""
    if not text:
        return ""
    text = text.replace(" ", " ").replace("​", "")
    if "<" in text:
        text = _TAG.sub(" ", text)
    for _ in range(4 if ":" in text or "：" in text else 0):  # labels may follow each other
        previous, text = text, _LABEL.sub(" ", text)
        if previous == text:
            break
    return text.strip()


def says_nothing(text: str | None) -> bool:
    content = bare(text).casefold()
    return content in PLACEHOLDERS or not _WORD.search(content) or content.strip(" .!?*_#-[](){}<>\"'`:;") in PLACEHOLDERS


#: Words that may introduce the question when it is given again (fixed values).
ECHO = frozenset("you asked ask your the question is was question: so i want wants wanted to know asking about sie fragten du fragtest fragst frage die lautet ist vous avez demandé la question est tu as preguntaste usted preguntó pregunta es".split())


def copies(question: str | None, answer: str) -> bool:
    """Whether the answer is the question again, in whole and nothing else."""
    text, asked = _folded(bare(answer)), _folded(question or "")
    if any(w[0] not in ECHO and w[0] not in asked for w in _WORD.finditer(text)):  # a word that neither has; most answers begin with one
        return False
    q, a = words(question), words(text)
    if not q or not a:
        return False
    if q[0] in a:
        rest, k, found = [], 0, 0
        while k < len(a):
            if a[k] == q[0] and a[k : k + len(q)] == q:
                found += 1
                k += len(q)
            else:
                rest.append(a[k])
                k += 1
        if found:
            return all(w in ECHO for w in rest)
    # most of the question in its order, nothing else
    at, used = 0, 0
    for w in a:
        while at < len(q) and q[at] != w:
            at += 1
        if at == len(q):
            return False
        at, used = at + 1, used + 1
    return used >= 0.8 * len(q) and len(q) >= 4


def gold_texts(gold: list[str | None] | None) -> list[str]:
    return [g for g in gold or [] if g and not says_nothing(g)]


# --- languages -------------------------------------------------------------------


#: The words of runs between blanks that carry language: digits do not.
_LETTERS = Runs(lambda run: " ".join(w for w in words(run) if not w[0].isdigit()))


def features_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of many texts, and the text of each; words padded by spaces; digits and signs carry no language."""
    bodies = [" " + " ".join(filter(None, _LETTERS.of(text))) + " " for text in texts]
    codes = np.frombuffer("".join(bodies).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owners = np.repeat(np.arange(len(texts)), [len(b) for b in bodies])
    found, whose = [], []
    mixed = np.zeros(len(codes), np.uint64)
    for n in GRAMS:
        if len(codes) < n:
            break
        mixed = ((mixed[: len(codes) - n + 1] ^ codes[n - 1 :]) + np.uint64(n)) * np.uint64(0x100000001B3)
        mixed ^= mixed >> np.uint64(31)
        own = owners[: len(mixed)] == owners[n - 1 :]
        found.append(((mixed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) & np.uint64(FEATURES - 1))[own])
        whose.append(owners[: len(mixed)][own])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found).view(np.int64), np.concatenate(whose)


def features(text: str) -> np.ndarray:
    return features_of([text])[0]


#: Words that join names.
_LINKS = frozenset(("sur", "am", "upon"))


class Languages:
    """Naive Bayes over hashed character n-grams."""

    def __init__(self, counts: np.ndarray) -> None:
        smooth = counts + 0.5
        self.logs = np.log(smooth / smooth.sum(axis=1, keepdims=True))

    @staticmethod
    def unnamed(text: str) -> tuple[str, int]:
        """A text without its names (words with a capital, but for a short first of a sentence), and the letters left."""
        kept = []
        for sentence in _BREAK.split(text):
            own = _WORD.findall(sentence)
            lower = [w for w in own if w[0].islower()]
            if lower:  # links of names, as in Stratford upon Avon, belong to the names
                last = len(own) - 1
                if not _LINKS.isdisjoint(lower):
                    link = [w in _LINKS and 0 < k < last and own[k - 1][0].isupper() and own[k + 1][0].isupper() for k, w in enumerate(own)]
                    lower = [w for k, w in enumerate(own) if w[0].islower() and not link[k]]
                if not own[0][0].islower() and last > 0 and len(own[0]) <= 5:
                    kept.append(own[0])
                kept += lower
        return " ".join(kept), sum(map(len, kept))

    def scores_of(self, texts: list[str | None]) -> np.ndarray:
        """Log-likelihoods of many texts, one row each; null and empty ones have all the same."""
        return self.scores_at(*features_of([t or "" for t in texts]), len(texts)) if texts else np.zeros((0, len(LANGUAGES)))

    def scores_at(self, at: np.ndarray, whose: np.ndarray, texts: int) -> np.ndarray:
        """The same by features and the text of each."""
        sums = [np.bincount(whose, own[at], texts) for own in self.logs]
        return np.stack(sums, axis=1) / len(GRAMS)  # each character is in as many n-grams as there are lengths

    def scores(self, text: str | None) -> np.ndarray:
        return self.scores_of([text])[0]

    def sure(self, text: str | None, least: float = SURE) -> int | None:
        """The language of a text, if all others are unlikelier by that much."""
        return surest(self.scores(text), least) if text else None


def surest(scores: np.ndarray, least: float) -> int | None:
    second, first = np.argsort(scores)[-2:]
    return int(first) if scores[first] - scores[second] >= least else None


#: One sentence pair a language, so that a model exists without documents (fixed values).
STARTERS = {
    "en": "Which of the workers left the town first? The passages say that it was founded in the year of the flood and what they did not know.",
    "de": "Welche der Arbeiter haben die Stadt zuerst verlassen? Die Texte sagen, dass sie im Jahr der Flut gegründet wurde und was sie nicht wussten.",
    "fr": "Quels ouvriers ont quitté la ville les premiers ? Les passages disent qu'elle fut fondée l'année de la crue et ce qu'ils ne savaient pas.",
    "es": "¿Qué trabajadores dejaron la ciudad primero? Los pasajes dicen que se fundó en el año de la inundación y lo que no sabían.",
}


def fit_languages(documents: DataFrame, pairs: DataFrame) -> Languages:
    counts = np.zeros((len(LANGUAGES), FEATURES))
    for k, code in enumerate(LANGUAGES):
        np.add.at(counts[k], features(STARTERS[code]), 1)
    spelling = F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv])
    labelled = documents.select("doc_id", "text", spelling[F.lower(F.trim("lang"))].alias("code")).where("code is not null and text is not null")
    order = Window.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id")
    sized = labelled.select("doc_id", "code", F.length("text").alias("size")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= MOST_TEXTS)
    total, ids = 0, []
    for row in sized.orderBy("n", "code").collect():  # at most MOST_TEXTS rows a language
        if total + row.size <= MOST_CHARACTERS:
            total += row.size
            ids.append((row.doc_id,))
    chosen = documents.sparkSession.createDataFrame(ids, "doc_id bigint")
    for row in labelled.join(F.broadcast(chosen), "doc_id", "left_semi").select("code", "text").toLocalIterator():
        np.add.at(counts[LANGUAGES.index(row.code)], features(row.text), 1)
    weights = counts.sum(axis=1, keepdims=True)
    counts *= weights.min() / weights  # equal sizes: no language is likelier for having more text
    first = documents.sparkSession.sparkContext.broadcast(Languages(counts))  # of fixed size

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = np.zeros(len(LANGUAGES) * FEATURES)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4000):
                part = batch.slice(lo, 4000)
                asked, given = (c.to_pylist() for c in part.columns)
                at, whose = features_of([q or "" for q in asked])
                own = [surest(s, 4.0) if q else None for q, s in zip(asked, first.value.scores_at(at, whose, len(asked)), strict=True)]
                told = [(k, g) for k, golds in zip(own, given, strict=True) if k is not None for g in gold_texts(golds)]
                sure = np.array([-1 if k is None else k for k in own])[whose]
                more += np.bincount((sure * FEATURES + at)[sure >= 0], minlength=len(more))
                if told:
                    at, whose = features_of([g for _, g in told])
                    more += np.bincount(np.array([k for k, _ in told])[whose] * FEATURES + at, minlength=len(more))
        at = np.flatnonzero(more)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(more[at])], ["at", "n"])

    learnt = pairs.select("question", "gold_answers").mapInArrow(learn, "at bigint, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most FEATURES rows a language
    more = np.zeros(counts.size)
    more[learnt.column("at").to_numpy()] = learnt.column("n").to_numpy()
    more = more.reshape(counts.shape)
    sizes = np.maximum(more.sum(axis=1, keepdims=True), 1)
    return Languages(counts + 2 * more * (counts.sum(axis=1, keepdims=True).min() / np.maximum(sizes, sizes.max() / 20)))


# --- ends of text ------------------------------------------------------------------

_PIECE = re.compile(r"[^\W_]++(?:['’.-][^\W_]++)*+|[.!?…](?=[\s\"'”’»)\]*]|$)|\n+|[(\[{,;:/–—-]")
_NAME_LINKS = frozenset("sur am see de la del the von le".split())
#: Words whose full stop does not end a sentence (fixed values).
_SHORT = frozenset("dr mr mrs ms prof st no nr vol fig approx ca etc bzw sr sra av vs cf ed".split())
_CLOSED = re.compile(r"[.!?。][\"'”’»)\]*]*$")


def code(word: str) -> int:
    """64 bits for a word."""
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


_START, _NAME, _NUMBER = map(code, ("\x01start", "\x01name", "\x01number"))
_CAPITAL, _BREAKS, _ABBREVIATED, _LINK, _DIGITS, _STOP, _MARK = 1, 2, 4, 8, 16, 32, 64
#: Kinds of starts: after a line end, after a sentence mark, of a text.
LINE, MARK, TEXT = 1, 2, 3


class _PieceIds(dict):
    def __init__(self, add: Callable[[str], int]) -> None:
        super().__init__()
        self.add = add

    def __missing__(self, piece: str) -> int:
        return self.add(piece)


class Pieces:
    """Words of texts as codes and kinds, remembered in a table of bounded size. No piece goes on over a blank, so each run between blanks is cut once."""

    def __init__(self, most: int = 500_000) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.ids = _PieceIds(self.add)
        self.runs = Runs(lambda run: tuple(map(self.ids.__getitem__, _PIECE.findall(run))))
        self.codes, self.kinds = np.array([_START], np.uint64), np.array([_BREAKS], np.uint8)  # by number; the first is the start of a text

    def add(self, piece: str) -> int:
        low = piece.lower()
        kind = 0
        if piece[0] in ".!?…\n":
            kind = _BREAKS | (_STOP if piece == "." else 0) | (_MARK if piece[0] in ".!…" else 0)
        elif piece[0].isdigit():
            kind = _DIGITS
        elif piece[0].isupper():
            kind = _CAPITAL
        if low in _SHORT or (len(piece) == 1 and piece.isalpha()):
            kind |= _ABBREVIATED
        if piece in _NAME_LINKS:
            kind |= _LINK
        self.ids[piece] = number = len(self.ids) + 1
        if number == len(self.codes):
            self.codes, self.kinds = (np.concatenate([x, np.zeros(len(x), x.dtype)]) for x in (self.codes, self.kinds))
        self.codes[number], self.kinds[number] = code(low), kind
        return number

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all texts in a row; a sentence or text begins with the start code. Names and
        numbers stand for their kind, a run of names for one name. Also the kind of start at each place, 0 for none."""
        if len(self.ids) > self.most:
            self.clear()
        start = ((0,),)
        ids = np.fromiter(chain.from_iterable(chain.from_iterable(chain(start, self.runs.of(text)) for text in texts)), np.int32)
        codes, kinds = self.codes[ids], self.kinds[ids]
        after = np.concatenate([kinds[1:], np.full(1, _BREAKS, np.uint8)])
        before = np.concatenate([np.full(1, _BREAKS, np.uint8), kinds[:-1]])
        stop = (kinds & _STOP > 0) & (before & _ABBREVIATED > 0)  # the full stop of an abbreviation
        keep = ~stop
        breaks = (kinds & _BREAKS > 0) & keep
        capital = kinds & _CAPITAL > 0
        first = np.concatenate([[True], breaks[:-1]])
        name = capital & (~first | (after & _CAPITAL > 0))
        linked = (kinds & _LINK > 0) & np.concatenate([[False], name[:-1]]) & (after & _CAPITAL > 0)
        name |= linked
        keep &= ~(name & np.concatenate([[False], name[:-1]]))
        keep &= ~(breaks & np.concatenate([[False], breaks[:-1]]) & (ids > 0))  # one start for several marks
        for where, one in ((breaks, _START), (kinds & _DIGITS > 0, _NUMBER), (name, _NAME)):
            codes[where] = one
        kind = np.where(breaks, np.where(kinds & _MARK > 0, np.uint8(MARK), np.uint8(LINE)), np.uint8(0))
        kind[ids == 0] = TEXT
        return codes[keep], kind[keep]


@lru_cache(maxsize=1)
def shared_pieces() -> Pieces:
    """The one of this process, whose tables all tasks share."""
    return Pieces()


def _mixed(keys: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The keys of n-grams with one more piece before them."""
    mixed = (keys ^ codes) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ mixed >> np.uint64(29)


def keys(codes: np.ndarray, starts: np.ndarray, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: places of pieces that have so many in their sentence, start included, and the keys of these n-grams. ``wanted``
    marks places of ``PLACES``: who asks for an n-gram asks for its ends too, so that none is sought where its end isn't wanted."""
    begin = np.maximum.accumulate(np.where(starts > 0, np.arange(len(codes)), 0))
    where = np.flatnonzero(starts == 0)
    mixed = np.zeros(len(where), np.uint64)
    for order in range(ORDERS):
        there = where - order >= begin[where]
        where = where[there]
        mixed = _mixed(mixed[there], codes[where - order])
        if wanted is not None:
            kept = wanted[mixed & np.uint64(PLACES - 1)]
            where, mixed = where[kept], mixed[kept]
        yield where, mixed.view(np.int64)


def end_keys_of(sentences: list[str], pieces: Pieces) -> list[list[int]]:
    """Keys of the last 1, 2, ... pieces of each sentence."""
    if not sentences:
        return []
    codes, starts = pieces.read(sentences)
    at = np.arange(len(codes))
    last = np.full(len(sentences), -1)
    np.maximum.at(last, np.cumsum(starts == TEXT) - 1, np.where(starts == 0, at, -1))
    there = np.where(last < 0, 0, last - np.maximum.accumulate(np.where(starts > 0, at, 0))[last] + 1)  # pieces of the last sentence, start included
    found, mixed = np.zeros((len(sentences), ORDERS), np.int64), np.zeros(len(sentences), np.uint64)
    for order in range(ORDERS):
        mixed = _mixed(mixed, codes[np.maximum(last - order, 0)])
        found[:, order] = mixed.view(np.int64)
    return [own[:n] for own, n in zip(found.tolist(), there.tolist(), strict=True)]


def end_keys(sentence: str, pieces: Pieces | None = None) -> list[int]:
    """Keys of the last 1, 2, ... pieces of a sentence."""
    return end_keys_of([sentence], pieces or Pieces())[0]


def split_sentences(text: str) -> list[str]:
    parts = [p for p in _BREAK.split(text) if p and p.strip()]
    joined: list[str] = []
    for part in parts:
        if joined and (m := re.search(r"(\w+)\.$", joined[-1].rstrip())) and (m[1].lower() in _SHORT or len(m[1]) == 1):
            joined[-1] += " " + part
        else:
            joined.append(part)
    return joined


@dataclass
class Ends:
    """How often texts went on or ended after some n-grams: times seen and times ended by key."""

    counts: dict[int, tuple[int, int]]
    #: The keys of the one sentence that is judged, if they are known.
    keys: list[int] | None = None

    def after(self, sentence: str) -> list[tuple[int, int]]:
        """Times seen and times ended of the last 1, 2, ... pieces of a sentence."""
        return [self.counts.get(key, (0, 0)) for key in (end_keys(sentence) if self.keys is None else self.keys)]

    def likelihood(self, sentence: str) -> float:
        """That a text ends after these words, by the longest known context, smoothed by shorter
        ones; where no three words are known together, the more hopeful of the last two decides.
        Several ends after the same four words or more are certain."""
        p, known, hope = 0.2, 0, 0.0
        after = self.after(sentence)
        if len(after) >= 4 and after[0][1] == 0 and after[1][0] == 0:  # no text has these two words, nor ends with the last
            return 0.0
        for order, (seen, ended) in enumerate(after):
            if order >= 3 and ended >= max(2, 0.003 * seen):
                return 1.0
            p = (ended + p) / (seen + 1.0)
            if order < 2:
                hope = max(hope, p)
            if seen >= 2:
                known = order + 1
        return p if known >= 3 else max(p, hope)

    def breaks_off(self, sentence: str, seen: int = 0, ended: int = 0) -> bool:
        """Whether the likelihood of an end is too small; ``seen`` and ``ended`` are counts of the whole text in texts of its own pair."""
        return (ended + self.likelihood(sentence)) / (seen + 1.0) < LEAST_END


def count_ends(texts: DataFrame, asked: np.ndarray | None = None) -> DataFrame:
    """Exact counts over all texts (text, whole): key, seen, ended. A sentence ends at its mark, a question as no answer does; the
    end of a text without a mark counts for ``whole`` texts only, since others may be cut off. ``asked`` marks the places of
    ``PLACES`` whose n-grams are wanted; further n-grams may come along."""
    shared = None if asked is None else texts.sparkSession.sparkContext.broadcast(asked)  # of fixed size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared_pieces()
        for batch in batches:
            for whole in (False, True):
                values = batch.column(0).filter(pa.array([bool(w) == whole for w in batch.column(1).to_pylist()])).to_pylist()
                for first in range(0, len(values), 2000):
                    codes, starts = pieces.read(values[first : first + 2000])
                    following = np.concatenate([starts[1:], [TEXT]])
                    last = (following == MARK) | (whole & (following == TEXT))
                    found, ends = [], []
                    for where, key in keys(codes, starts, None if shared is None else shared.value):
                        found.append(key)
                        ends.append(last[where])
                    own, at, seen = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
                    ended = np.bincount(at[np.concatenate(ends)], minlength=len(own))
                    for k in range(0, len(own), 200_000):
                        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 200_000].astype(np.int64)) for x in (own, seen, ended)], ["key", "seen", "ended"])

    rows = texts.where("text is not null").select("text", "whole").mapInArrow(count, "key bigint, seen bigint, ended bigint")
    return rows.groupBy("key").agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended"))


def fit_ends(texts: DataFrame) -> Ends:
    """All counts at once, for texts that fit into memory."""
    return Ends({r.key: (r.seen, r.ended) for r in count_ends(texts).collect()})


def ends_of(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """The counts for answers' last n-grams (keys, arrays of ``end_keys``): keys, counts (key, seen, ended; those that texts hold)."""
    wanted = asked.select("keys").where(F.size("keys") > 0).distinct().select("keys", F.explode("keys").alias("key"))
    places = np.zeros(PLACES, bool)
    found = wanted.select(F.col("key").bitwiseAND(F.lit(PLACES - 1)).cast("int").alias("at")).distinct().toArrow()  # at most PLACES rows, whatever the data
    places[found.column("at").to_numpy()] = True
    return wanted.join(count_ends(texts, places), "key").groupBy("keys").agg(F.collect_list(F.struct("key", "seen", "ended")).alias("counts"))


def open_end(text: str) -> str | None:
    """The last sentence of a bare text, if no mark closes it."""
    if _CLOSED.search(text) and not text.endswith("...") and not ((m := re.search(r"(\w+)\.$", text)) and m[1].lower() in _SHORT):
        return None
    return split_sentences(text)[-1].strip()


def cut_inside(last: str, word: tuple[int, int], own: list[str]) -> bool:
    """Whether the last word is more likely the beginning of a longer one: times that all texts hold it, and longer ones
    that begin with it; words of its own pair count ``CACHE`` times."""
    whole = word[0] + CACHE * sum(w == last for w in own)
    longer = word[1] + CACHE * sum(len(w) > len(last) and w.startswith(last) for w in own)
    return CUT * longer / LETTERS > whole + NOVEL


def breaks_off(answer: str, golds: list[str], word: tuple[int, int], question: str | None, ends: Ends) -> bool:
    """Whether a text stops before its sentence, word or name is complete."""
    text = bare(answer)
    tail = open_end(text)
    if tail is None:
        return False
    said, own = " ".join(words(text)), [" ".join(words(g)) for g in golds]
    begun = [g for g in own if g.startswith(said)]  # gold answers that begin so
    if ends.breaks_off(tail, CACHE * len(begun), CACHE * begun.count(said)):
        return True
    last = re.search(r"[^\W\d_]+$", text)
    return bool(last) and said not in own and cut_inside(last[0].casefold(), word, [w for g in (*golds, question) for w in words(g)])


def judge(question: str | None, answer: str | None, gold: list[str | None] | None, word: tuple[int, int], languages: Languages, ends: Ends, decline: Callable[[str], float], spoken: tuple[np.ndarray, np.ndarray, int] | None = None) -> str | None:
    """The defect of a pair; ``word`` are the counts of its last word, ``decline`` scores how surely a text declines,
    ``spoken`` are the likelihoods of languages of question and answer, and the letters of the answer (:func:`languages_of`)."""
    if answer is None or says_nothing(answer):
        return "empty"
    if copies(question, answer):
        return "copies_question"
    if decline(bare(answer)) >= declining.THRESHOLD:
        golds = gold_texts(gold)
        if any(f" {' '.join(words(g))} " in f" {' '.join(words(answer))} " for g in golds):  # it says what was asked for
            return None
        return "refusal" if any(decline(g) <= declining.GOLD_THRESHOLD for g in golds) else None
    if question:
        text = bare(answer)
        of_question, of_answer, letters = spoken or languages_of([question], [answer], languages)[0]
        asked, said = surest(of_question, 2.0), int(np.argmax(of_answer))
        if asked is not None and said != asked:
            margin = of_answer[said] - of_answer[asked]
            if margin >= SURE and margin / max(letters, 1) >= SURE_PER_CHARACTER:
                if not any(languages.sure(Languages.unnamed(g)[0], 4.0) == said or words(g) == words(text) for g in gold_texts(gold)):
                    return "other_language"
    return "truncated" if open_end(bare(answer)) is not None and breaks_off(answer, gold_texts(gold), word, question, ends) else None


def languages_of(questions: list[str | None], answers: list[str | None], languages: Languages) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Likelihoods of the languages of questions and answers without their names, and the letters of the latter."""
    texts = [bare(a) for a in answers]
    questions = [Languages.unnamed(q)[0] if q else None for q in questions]
    unnamed = [Languages.unnamed(t if t.upper() != t else t.lower()) for t in texts]
    return list(zip(languages.scores_of(questions), languages.scores_of([t for t, _ in unnamed]), [n for _, n in unnamed], strict=True))


def last_words(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked word (last): times that texts hold it (whole), and longer words that begin with it (longer)."""
    spaced = texts.where("text is not null").select(F.explode(F.split("text", " ")).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))  # what stands between blanks, each once
    split = F.split(F.lower("run"), r"[^\p{L}\p{M}'’]+")  # d'eau is one word, so that d is none
    counts = spaced.select(F.explode(split).alias("word"), "n").where("word != ''").groupBy("word").agg(F.sum("n").alias("n"))
    tokens = counts.select(F.regexp_replace("word", "^['’]+|['’]+$", "").alias("word"), "n").where("word != ''")  # each word once a way it is quoted
    size = F.length("word")
    begun = tokens.select("n", "word", F.explode(F.sequence(F.lit(1), size)).alias("k")).select(F.substring("word", 1, F.col("k")).alias("last"), F.when(F.col("k") == size, F.col("n")).alias("whole"), F.when(F.col("k") < size, F.col("n")).alias("longer"))
    return begun.join(asked, "last", "left_semi").groupBy("last").agg(F.coalesce(F.sum("whole"), F.lit(0)).alias("whole"), F.coalesce(F.sum("longer"), F.lit(0)).alias("longer"))


def defects(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """Each defective pair with its defect: query_id, defect."""
    spark = pairs.sparkSession
    rows = pairs.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("question").cast("string"), F.col("answer").cast("string"), F.col("gold_answers").cast("array<string>").alias("gold_answers")).distinct()
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "pairs")  # read by several jobs, each a few of its columns
    no, yes = F.lit(False).alias("whole"), F.lit(True).alias("whole")
    texts = documents.select(F.col("text").cast("string").alias("text"), no).unionByName(rows.select(F.col("question").alias("text"), no)).unionByName(rows.select(F.explode("gold_answers").alias("text"), yes))
    closed = rows.select(F.col("answer").alias("text"), no).where(F.col("text").rlike(r"[.!?]\s*$"))  # whole sentences, fit or not
    shared = spark.sparkContext.broadcast(fit_languages(documents, rows))  # of bounded size
    scores = declining.pair_scores(rows, bare, gold_texts)

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared_pieces()
        for batch in (b.slice(lo, 2000) for b in batches for lo in range(0, b.num_rows, 2000)):
            tails = [None if a is None or says_nothing(a) else open_end(bare(a)) for a in batch.column(2).to_pylist()]
            known = iter(end_keys_of([t for t in tails if t], pieces))
            found = [next(known) if t else [] for t in tails]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names, "keys"])

    rows = written(rows.mapInArrow(end, "query_id bigint, question string, answer string, gold_answers array<string>, row bigint, keys array<bigint>"), "pair-ends")
    given = ["query_id", "question", "answer", "gold_answers", "row"]
    ends = ends_of(rows, texts.unionByName(closed))
    # the last words of open answers; answers themselves are no witnesses. An answer without one asks for a word of its own, so that no key is hot
    last = F.lower(F.regexp_extract("answer", r"([\p{L}\p{M}]+)\s*$", 1))
    opened = rows.where(F.size("keys") > 0).withColumn("last", F.when(last != "", last).otherwise(F.concat(F.lit("0"), F.col("query_id").cast("string"))))
    found = last_words(texts, opened.select("last").distinct())
    opened = opened.join(found, "last", "left").join(ends, "keys", "left").select(*given, "whole", "longer", "counts", "keys")
    shut = rows.where(F.size("keys") <= 0).select(*given, F.lit(0).cast("bigint").alias("whole"), F.lit(0).cast("bigint").alias("longer"), F.lit(None).cast(opened.schema["counts"].dataType).alias("counts"), "keys")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = shared.value
        for batch in (b.slice(lo, 1000) for b in batches for lo in range(0, b.num_rows, 1000)):
            ids, found = [], []
            heard = languages_of(batch.column(1).to_pylist(), batch.column(2).to_pylist(), languages)
            for (query, question, answer, gold, whole, longer, counts, last, score, least), spoken in zip(zip(*(c.to_pylist() for c in batch.columns), strict=True), heard, strict=True):
                after = Ends({c["key"]: (c["seen"], c["ended"]) for c in counts or []}, last)
                own = None if answer is None else bare(answer)

                def decline(text: str, own: str | None = own, score: float = score, least: float = least) -> float:
                    return score if text == own else least

                defect = judge(question, answer, gold, (whole or 0, longer or 0), languages, after, decline, spoken)
                if defect:
                    ids.append(query)
                    found.append(defect)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["query_id", "defect"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # Python work, more than its bytes tell
    rows = opened.unionByName(shut).repartition(tasks, "row").join(scores, "row", "left").drop("row")
    return rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("score", "gold")}).mapInArrow(find, "query_id bigint, defect string").distinct()
