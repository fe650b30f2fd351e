"""Model calls behind protocols, with deterministic offline stand-ins.

A cluster with models registers its own; without one every pipeline still
runs, and its results can be checked against another engine.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweir.functions.text import words


class Embedder(Protocol):
    dims: int

    def embed(self, text: Column) -> Column: ...


class HashedWords:
    """A bag of words hashed by md5 into ``dims`` counts, L2-normalised; blank texts give zeros."""

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def bucket(self, word: Column) -> Column:
        return F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("int") % self.dims

    def embed(self, text: Column) -> Column:
        # a lambda variable holds what would else be worked out again for every dimension
        def once(value: Column, use: Callable[[Column], Column]) -> Column:
            return F.get(F.transform(F.array(value), use), F.lit(0))

        def counts(hashed: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.lit(self.dims - 1)), lambda k: F.size(F.filter(hashed, lambda b: b == k)).cast("double"))

        def scaled(c: Column) -> Column:
            return once(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))

        return once(F.transform(words(F.lower(text)), self.bucket), lambda h: once(counts(h), scaled))


class KeepTop:
    """A reranker that keeps the best candidates by score."""

    def rerank(self, candidates: DataFrame, k: int) -> DataFrame:
        from graphweir.operators.retrieval import best

        return best(candidates, ["query_id"], "score", "fact_id", k)


#: Words that carry no topic (fixed values).
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "did", "do", "does", "for", "from", "how", "in", "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "were", "what", "when", "where", "which", "who", "why", "with")


def keywords(question: Column) -> Column:
    """Keywords of a question without a model: its words but for stop words and marks, in order."""
    plain = F.transform(words(F.lower(question)), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.array_distinct(F.filter(plain, lambda w: (w != "") & ~w.isin(*STOP_WORDS)))


def capitalised_runs(text: Column) -> Column:
    """Entities without a model: runs of capitalised words."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*)"), 1))


#: Embedding models by key: dimensions and most tokens of a text (fixed values).
EMBEDDING_MODELS = {"openai-small": (1536, 8191), "openai-large": (3072, 8191), "jina-v3": (1024, 8192), "gritlm": (4096, 8192), "nv-embed-v2": (4096, 32768)}
DEFAULT_EMBEDDING = "jina-v3"

_REGISTRIES: dict[str, dict[str, Callable]] = {"embedder": {"hashed-words": HashedWords}, "reranker": {"keep-top": KeepTop}, "retriever": {}, "chunker": {}, "indexer": {}, "summariser": {}}


def register(kind: str, name: str, make: Callable) -> None:
    _REGISTRIES.setdefault(kind, {})[name] = make


def get(kind: str, name: str) -> Callable:
    if name not in _REGISTRIES.get(kind, {}):
        raise KeyError(f"no {kind} {name!r}; there are {sorted(_REGISTRIES.get(kind, {}))}")
    return _REGISTRIES[kind][name]


def names(kind: str) -> list[str]:
    return sorted(_REGISTRIES.get(kind, {}))


def embedding_model(explicit: str | None = None, environment: str | None = None, llm: str | None = None) -> tuple[str, int, int]:
    """The embedding model by explicit key, else environment, else that of the language model's name, else the default."""
    by_llm = "openai-small" if llm and llm.startswith("gpt") else None
    for key in (explicit, environment, by_llm):
        if key:
            key = key if key in EMBEDDING_MODELS else DEFAULT_EMBEDDING
            return (key, *EMBEDDING_MODELS[key])
    return (DEFAULT_EMBEDDING, *EMBEDDING_MODELS[DEFAULT_EMBEDDING])
