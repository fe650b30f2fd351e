"""A model of answers that decline, or claim not to know, against answers that tell.

Two class-conditional Kneser-Ney models (:mod:`.ngrams`) of the words of whole
answers. The telling class are the gold answers, and the answers that hold one
of their gold answers. The declining class begins with the seed sentences below
and learns from all of them: those that a pass is sure of join it, ``PASSES``
times, and leave the telling class. Counts cover
all different texts, and all n-grams that occur twice or more in them are known
(:mod:`.ngrams`): frequent ones are broadcast, all others joined to the texts
that hold them. A whole answer declines
from a score of ``THRESHOLD``, a gold answer over ``GOLD_THRESHOLD``.

What is quoted is not said by the answer. Null and empty answers score 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweir.llm.ngrams import Local, Model, Ratio, Runs, WordIds, changes, counted, runs, take_inventory, weighted, with_changes, with_rest
from graphweir.session import dropped, written

CALM = 2.0
#: Order of the model and score by which an answer without a gold answer joins the declining class, in each pass.
PASSES = ((1, 1.2), (1, 1.0), (3, 1.0))
#: Score from which an answer declines, and over which a gold answer does: it needs no more than be nearer to that class.
THRESHOLD, GOLD_THRESHOLD = 1.0, 0.0
UNKNOWN, TELLING, GOLD = 0, 1, 2

_ATOM = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?…\n\r]+")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|„[^“”]*[“”]")

#: Sentences that decline or claim not to know, written for this project (fixed values: training data in plain text).
SEEDS = (
    # English
    "i cannot give you an answer", "i can't be of help here", "i am unable to answer", "i am not able to say", "sorry, i don't know", "i do not know the answer", "i have no idea", "unfortunately i cannot tell",
    "there is not enough information to answer", "the text does not say", "the passages do not mention it", "this is not stated in the documents", "the context does not contain the answer", "it is not possible to determine this",
    "as an ai language model i cannot give an opinion", "i would rather not answer that", "i prefer not to discuss this", "i must decline to answer", "i am not allowed to talk about this", "my guidelines do not permit me to answer", "please provide more information",
    "that is outside of what i can help with", "there is no answer to that", "i refuse to comment", "i'm sorry, but i cannot assist you with that matter", "we cannot help you with a request like that", "it is not mentioned", "unknown, the sources give no information", "it would not be appropriate for me to say", "let us talk about another subject instead",
    # German
    "das kann ich nicht beantworten", "dazu kann ich nichts sagen", "ich weiß es nicht", "leider habe ich keine informationen dazu", "tut mir leid, dabei kann ich nicht helfen", "keine ahnung", "das steht nicht im text", "die texte erwähnen das nicht",
    "das lässt sich nicht bestimmen", "die angaben reichen nicht aus", "darüber möchte ich nicht sprechen", "ich darf dazu keine auskunft geben", "als sprachmodell kann ich keine meinung äußern", "eine antwort ist nicht möglich", "es ist nicht bekannt", "mir ist es nicht erlaubt zu antworten",
    # French
    "je ne peux pas vous donner de réponse", "je ne sais pas", "désolé, je ne peux pas vous aider", "aucune idée", "je ne le sais vraiment pas", "le texte ne le dit pas", "les passages ne le mentionnent pas", "il n'y a pas assez d'informations",
    "cela n'y est pas précisé", "impossible de répondre", "je préfère ne pas en parler", "je ne suis pas autorisé à répondre", "en tant que modèle de langage je ne peux pas donner d'avis", "je refuse de répondre", "aucune réponse n'est possible", "il m'est interdit d'en parler",
    # Spanish
    "no puedo darte una respuesta", "no lo sé", "lo siento, no puedo ayudar con eso", "no tengo la menor idea al respecto", "el texto no lo dice", "los pasajes no lo mencionan", "no hay suficiente información", "no se indica en los documentos",
    "es imposible responder", "prefiero no hablar de eso", "no me está permitido responder", "como modelo de lenguaje no puedo dar una opinión", "me niego a contestar", "no es posible saberlo", "no dispongo de esa información", "se me ha prohibido hablar de ello",
)


def unquoted(text: str) -> str:
    """A text with plain apostrophes and without quotations."""
    return _QUOTED.sub(" ", text.replace("’", "'"))


def said(text: str) -> list[str]:
    """Words in lower case and, between sentences, empty strings; numbers as one word."""
    return ["" if a[0] in ".!?…\n\r" else "0" if a[0].isdigit() else a for a in (a.lower() for a in _ATOM.findall(text))]


def spoken(text: str) -> list[str]:
    """What is said outside of quotations."""
    return said(unquoted(text))


class SpokenIds(WordIds):
    """Ids of what is spoken: no word goes on over a blank, so each run between blanks is read once."""

    def __init__(self) -> None:
        super().__init__(spoken)
        self.runs = Runs(lambda run: tuple(map(self.__getitem__, said(run))))

    def text(self, text: str | None) -> np.ndarray:
        ids = [*chain.from_iterable(self.runs.of(unquoted(text)))] if text else []
        return np.array([0, *ids, 0] if ids else [], np.int64)


@lru_cache(maxsize=1)
def spoken_ids() -> SpokenIds:
    """The one of this process, whose tables all tasks and slices share."""
    return SpokenIds()


class Declining:
    """Scores whole answers by the likelihood ratio of their words."""

    def __init__(self, ratio: Ratio) -> None:
        self.ratio = ratio

    def scores(self, ids: np.ndarray, bounds: np.ndarray, local: Local | None = None) -> np.ndarray:
        """Length-normalised log-likelihood ratios of many answers laid end to end."""
        if not len(ids):
            return np.zeros(len(bounds) - 1)
        total, n = (np.concatenate([[0], np.cumsum(x)]) for x in self.ratio.ratios(ids, local))
        return (total[bounds[1:]] - total[bounds[:-1]]) / (n[bounds[1:]] - n[bounds[:-1]] + CALM)

    def sure(self, least: float) -> Callable[[np.ndarray, np.ndarray, Local], np.ndarray]:
        """Leaves the words of answers of at least that score."""
        return partial(_answers, self, least)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Scores by the n-grams of the inventory; :func:`pair_scores` has those of the rest too."""
        words = spoken_ids()
        own = [words.text(t) for t in texts]
        return self.scores(np.concatenate([np.zeros(0, np.int64), *own]), np.cumsum([0, *map(len, own)]))


def _answers(model: Declining, least: float, ids: np.ndarray, bounds: np.ndarray, local: Local) -> np.ndarray:
    return np.where(np.repeat(model.scores(ids, bounds, local) >= least, np.diff(bounds)), ids, 0)


def _whole(ids: np.ndarray, _: np.ndarray, __: Local) -> np.ndarray:
    return ids


def _holds(answer: np.ndarray, gold: np.ndarray) -> bool:
    """Whether the words of an answer hold those of a gold answer in a row, ends of sentences aside."""
    a, g = answer[answer != 0], gold[gold != 0]
    return 0 < len(g) <= len(a) and g.tobytes() in a.tobytes() and any((a[k : k + len(g)] == g).all() for k in np.flatnonzero(a[: len(a) - len(g) + 1] == g[0]))


def _read(bare, gold_texts):
    """Maps rows (row, answer, gold_answers) to one row of word ids per answer and gold answer, with its kind."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = spoken_ids()
        for batch in batches:
            owners, kinds, found = [], [], []
            for row, answer, golds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, told = words.text(bare(answer)), [words.text(g) for g in gold_texts(golds)]
                kinds += [TELLING if any(_holds(own, g) for g in told) else UNKNOWN, *[GOLD] * len(told)]
                found += [own, *told]
                owners += [row] * (1 + len(told))
            offsets = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(kinds, pa.int32()), ids], ["owner", "kind", "ids"])

    return read


def _said(pairs: DataFrame, bare, gold_texts) -> DataFrame:
    """The words of all answers and gold answers: owner (the pair's ``row``), kind, ids; written."""
    return written(pairs.select("row", "answer", "gold_answers").mapInArrow(_read(bare, gold_texts), "owner bigint, kind int, ids array<bigint>"), "spoken-words")


def _fit(said: DataFrame) -> tuple[Declining, DataFrame]:
    """A model from all different texts, and these with the counts of their n-grams of the rest."""
    texts = written(said.select("kind", "ids").distinct().withColumn("row", F.monotonically_increasing_id()), "answer-words")
    words = spoken_ids()
    seeds = [words.text(t) for t in SEEDS]
    inventory = take_inventory(texts, weighted(seeds), texts.count())
    texts = with_rest(texts, inventory)
    shared = inventory.shared()
    own, found = inventory.counts(seeds), np.zeros(len(inventory.n))
    untold, left = counted(texts.where(F.col("kind") == UNKNOWN), inventory, _whole)
    # what is found joins one class and leaves the other, which what has no gold answer has left besides
    left = left.select("u", "v", "w", F.lit(0.0).alias("f"), F.col("f").alias("l"))
    changed = changes(inventory, left)
    for order, least in (*PASSES, (3, None)):
        told = with_changes(texts, changed, order)
        telling = Model.rest(inventory, np.zeros(len(inventory.n)), untold + found, shared, changed)
        model = Declining(Ratio.of(inventory, Model.of(inventory, own + found, shared, changed), telling, order))
        if least is not None:
            found, others = counted(told, inventory, model.sure(least))
            dropped(said.sparkSession)
            changed = changes(inventory, left.unionByName(others.withColumn("l", F.col("f"))).groupBy("u", "v", "w").agg(F.sum("f").alias("f"), F.sum("l").alias("l")))
    return model, told


def fit(pairs: DataFrame, bare, gold_texts) -> Declining:
    """A model from all rows of (answer, gold_answers); ``bare`` strips labels, ``gold_texts`` keeps the gold answers that say something."""
    return _fit(_said(pairs.withColumn("row", F.lit(0).cast("bigint")), bare, gold_texts))[0]


def pair_scores(pairs: DataFrame, bare, gold_texts) -> DataFrame:
    """For each pair (row, answer, gold_answers): row, the score of its answer, and the least of its gold answers if the answer declines.
    Pairs without words have no row."""
    said = _said(pairs, bare, gold_texts)
    model, texts = _fit(said)
    shared = pairs.sparkSession.sparkContext.broadcast(model)  # an inventory of bounded size

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, bounds, local, lo, hi in runs(batch):
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:3]), pa.array(shared.value.scores(ids, bounds, local))], ["kind", "a", "b", "score"])

    key, spoken = ["kind", "a", "b"], F.size("ids") > 0
    own = [F.xxhash64("ids").alias("a"), F.xxhash64(F.lit(1), "ids").alias("b")]  # 128 bits stand for a text
    scores = written(texts.where(spoken).select("kind", *own, "ids", "rest", "changed").mapInArrow(score, "kind int, a bigint, b bigint, score double"), "spoken-scores")
    answers = said.where(spoken & (F.col("kind") != GOLD)).select(F.col("owner").alias("row"), "kind", *own)
    answers = written(answers.join(scores, key).select("row", "score"), "answer-scores")
    golds = said.where(F.col("kind") == GOLD).select(F.col("owner").alias("row"), "kind", *own)
    golds = golds.join(answers.where(F.col("score") >= THRESHOLD).select("row"), "row", "left_semi").join(scores, key, "left")
    return answers.join(golds.groupBy("row").agg(F.min(F.coalesce("score", F.lit(0.0))).alias("gold")), "row", "left")
