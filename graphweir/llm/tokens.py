"""Token counts of a public tokenizer, from its vocabulary file."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vocabulary file: one base64 token and its rank per line. The path is a parameter.
VOCABULARY = os.environ.get("GRAPHWEIR_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The public pattern of that byte-level BPE (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """The file's bytes; read on the driver, so that workers need no such file."""
    with open(path, "rb") as f:
        return f.read()


_ENCODERS: dict[int, object] = {}


def counter(vocabulary: bytes) -> Callable[[list[str]], list[int]]:
    """A function that counts the tokens of texts; the encoder is kept per worker."""
    import tiktoken

    key = hash(vocabulary)
    if key not in _ENCODERS:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
        _ENCODERS[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode = _ENCODERS[key].encode_ordinary  # type: ignore[attr-defined]
    return lambda texts: [len(encode(t)) if t else 0 for t in texts]


def count_tokens(df: DataFrame, keys: list[str], text: str, vocabulary: str = VOCABULARY, out: str = "n_tokens") -> DataFrame:
    """``keys`` and the number of tokens of each text; null and empty texts have none."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))  # a vocabulary file: a megabyte, whatever the data
    source = df.select(*keys, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([source.schema[k] for k in range(len(keys))] + [T.StructField(out, T.LongType())])
    n = len(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = counter(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(sizes(batch.column(n).to_pylist()), pa.int64())], [*keys, out])

    return source.mapInArrow(count, schema)
