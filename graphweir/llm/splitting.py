"""Splitting oversized items at natural boundaries.

A recursive separator hierarchy: an item over the limit is cut at its section
starts; a part still too large at its paragraph ends, then at line, sentence,
clause and word ends, and last between characters. The parts are packed
greedily into pieces up to the limit; each further piece begins with the tail
of the one before (the overlap).

A token is a maximal run of characters other than space, tab, line feed and
carriage return. With ``measure="tokens"`` sizes count tokens, so that a word
is never cut; with ``measure="chars"`` they count characters, and a word
longer than a piece is cut between characters.

Defined results
---------------
* Null, empty and blank texts are not oversized and give no piece.
* Texts of any length are split whole. Repeated rows of the same id and text
  are split once; two texts under one id are both split and told apart by
  ``text_hash``.
* Only the named columns are read, so further columns may have any names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 500
OVERLAP = 50
SECTION, PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, CHARACTER = range(7)

_TOKEN = re.compile(r"[^ \t\n\r]+")
_LINE_END = re.compile(r"\r\n|\n|\r")
_HEADING = re.compile(r"#{1,6}$|#{1,6}[^#]|={3,}$|-{3,}$|\*{3,}$|_{3,}$")
_SENTENCE_END = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*$")
_CLAUSE_END = re.compile(r"[,;:、，；：][\"'”’»)\]]*$|^[–—-]$|[–—]$|\)$")
#: Words whose full stop does not end a sentence (fixed values).
ABBREVIATIONS = frozenset("dr. mr. mrs. ms. prof. st. approx. ca. etc. e.g. i.e. z.b. d.h. bzw. sr. sra. p.ej. av. env. vs. cf. ed. jr.".split())

#: The same before a number only (fixed values).
NUMBERED = frozenset("no. nr. vol. fig. p. pp. art. sec.".split())


def boundary_levels(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """The level of the boundary after each token: the strongest that holds."""
    levels = np.full(len(spans), WORD, np.int8)
    for k, (start, end) in enumerate(spans[:-1]):
        follows = spans[k + 1]
        gap = text[end : follows[0]]
        if "\n" in gap or "\r" in gap:
            lines = len(_LINE_END.findall(gap))
            heading = _HEADING.match(text[follows[0] : follows[1]])
            levels[k] = SECTION if heading else PARAGRAPH if lines > 1 else LINE
            continue
        word = text[start:end]
        if _SENTENCE_END.search(word):
            initial = len(word) == 2 and word[0].isupper()
            low = word.lower().lstrip("(\"'“«")
            if not initial and low not in ABBREVIATIONS and not (low in NUMBERED and text[follows[0]].isdigit()):
                levels[k] = SENTENCE
        elif _CLAUSE_END.search(word):
            levels[k] = CLAUSE
    return levels


def _parts(total: np.ndarray, levels: np.ndarray, lo: int, hi: int, level: int, room: int) -> Iterator[tuple[int, int]]:
    """Ranges of atoms that fit into ``room``, cut at the strongest boundaries."""
    if total[hi] - total[lo] <= room or hi - lo == 1:
        yield lo, hi
        return
    if level >= WORD:  # no natural boundary is left: cut runs of words as large as fit
        while lo < hi:
            end = int(np.searchsorted(total, total[lo] + room, "right")) - 1
            end = min(max(end, lo + 1), hi)
            yield lo, end
            lo = end
        return
    cuts = lo + 1 + np.flatnonzero(levels[lo : hi - 1] <= level)
    for a, b in zip([lo, *cuts.tolist()], [*cuts.tolist(), hi], strict=True):
        yield from _parts(total, levels, a, b, level + 1, room)


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, measure: str = "tokens") -> list[tuple[int, int, int, int]]:
    """Pieces of a text: (first character, end character, size, size shared with the piece before)."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    spans = [m.span() for m in _TOKEN.finditer(text)]
    if not spans:
        return []
    levels = boundary_levels(text, spans)
    room = limit - overlap
    if measure == "chars":  # an atom runs to the start of the next token; longer ones are cut
        begins, ends, marks = [], [], []
        for k, (start, end) in enumerate(spans):
            stop = spans[k + 1][0] if k + 1 < len(spans) else end
            cuts = [*range(start, stop, room), stop] if stop - start > room else [start, stop]
            begins += cuts[:-1]
            ends += cuts[1:]
            marks += [CHARACTER] * (len(cuts) - 2) + [int(levels[k])]
        spans, levels = list(zip(begins, ends, strict=True)), np.array(marks, np.int8)
        sizes = np.array([e - b for b, e in spans])
    else:
        sizes = np.ones(len(spans), np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    if total[-1] <= limit:
        return [(spans[0][0], spans[-1][1], int(total[-1]), 0)]
    pieces, begin, fresh, end = [], 0, 0, 0
    for lo, hi in _parts(total, levels, 0, len(spans), SECTION, room):
        if total[hi] - total[begin] > limit:
            pieces.append((begin, end, fresh))
            fresh = lo
            begin = int(np.searchsorted(total, total[lo] - overlap, "left"))
        end = hi
    pieces.append((begin, end, fresh))
    return [(spans[b][0], spans[e - 1][1], int(total[e] - total[b]), int(total[f] - total[b])) for b, e, f in pieces]


def split_oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of every item of more than ``limit`` tokens.

    Columns: the key, ``text_hash``, ``piece`` (from 0), ``content``,
    ``num_tokens``, ``shared_tokens``. Whether an item is oversized is decided
    in the JVM, so that only oversized texts are shuffled (to split repeated
    ones once) and reach Python.
    """
    tokens = F.size(F.array_remove(F.split(F.col("__text"), "[ \t\n\r]+"), ""))
    large = (
        df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
        .where(F.length("__text") > 2 * limit)  # a token takes a character and a space at least
        .where(tokens > limit)
        .distinct()
        .withColumn("__hash", F.xxhash64("__text"))
    )
    schema = T.StructType([T.StructField(key, large.schema["__key"].dataType), T.StructField("text_hash", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("num_tokens", T.IntegerType()), T.StructField("shared_tokens", T.IntegerType())])
    names = schema.fieldNames()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, hashes = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            for first in range(0, len(texts), 256):  # bounds what a batch of very long texts yields at once
                parent, number, content, size, shared = [], [], [], [], []
                for k, one in enumerate(texts[first : first + 256], first):
                    for n, (b, e, tokens_n, shared_n) in enumerate(split_text(one, limit, overlap)):
                        parent.append(k)
                        number.append(n)
                        content.append(one[b:e])
                        size.append(tokens_n)
                        shared.append(shared_n)
                at = pa.array(parent, pa.int64())
                yield pa.RecordBatch.from_arrays([keys.take(at), hashes.take(at), pa.array(number, pa.int32()), pa.array(content, pa.string()), pa.array(size, pa.int32()), pa.array(shared, pa.int32())], names)

    return large.mapInArrow(split, schema)


def oversized_keys(pieces: DataFrame, key: str) -> DataFrame:
    """The keys of items that were divided; an item without a key has none."""
    return pieces.where("piece = 1").where(F.col(key).isNotNull()).select(key).distinct()
