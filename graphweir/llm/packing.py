"""Filling fixed-capacity containers with items: bound-certified repacking.

Items are spread over partitions by a hash of their id and each partition is
packed by best-fit decreasing. Dual feasible functions give each partition a
lower bound on its number of containers; a partition that needs just so many
is certified optimal and done. The partitions with a gap exchange their items:
all of them are spread anew, over half as many partitions, and packed again;
the new packing is kept if it needs fewer containers. Rounds end when every
partition is certified or ``rounds`` is reached.

A partition holds about ``share`` items, so that neither a task nor the driver
ever holds a growing share of the data. An item over the capacity is divided
into full containers and a rest; no other item is divided.

Defined results
---------------
* Items of size zero are placed like others; they take no space.
* Null ids are kept, as items of their own; null sizes count as zero.
* Repeated rows are items of their own; ties go to the smaller id.
* Empty tables give no container.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweir.llm.tokens import VOCABULARY, count_tokens
from graphweir.session import written

CAPACITY = 2048
SHARE = 2_000
ROUNDS = 3


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; items come in decreasing size.

    Open containers are kept by the space they have left, one stack per space
    and one bit per non-empty stack, so the tightest fit is one bit operation.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0
    opened = 0
    place = np.empty(len(sizes), np.int64)
    for k, size in enumerate(sizes.tolist()):
        fits = some >> size
        if fits:
            left = size + ((fits & -fits).bit_length() - 1)
            bin_ = stacks[left].pop()
            if not stacks[left]:
                some &= ~(1 << left)
        else:
            left, bin_ = capacity, opened
            opened += 1
        left -= size
        stacks[left].append(bin_)
        some |= 1 << left
        place[k] = bin_
    return place


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that the items need at least, by dual feasible functions.

    The identity gives the total over the capacity. The step functions
    ``u_m`` round sizes to m-ths of the capacity unless (m+1) * size is a
    multiple of it; ``f_t`` counts items over C - t as whole containers and
    drops those under t.
    """
    if not len(sizes):
        return 0
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    for m in range(1, 21):
        whole = (x * (m + 1)) % capacity == 0
        value = np.where(whole, x * m, (x * (m + 1) // capacity) * capacity)  # in units of 1 / (m * capacity)
        best = max(best, -(-int((counts * value).sum()) // (m * capacity)))
    number = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])  # items of at least this size
    volume = np.concatenate([np.cumsum((counts * x)[::-1])[::-1], [0]])
    t = np.arange(1, capacity // 2 + 1)
    large = number[capacity - t + 1]
    middle = volume[t] - volume[capacity - t + 1]
    best = max(best, int((large + -(-middle // capacity)).max()))
    return max(best, 1)


def _packer(capacity: int):
    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        sizes = frame["n_tokens"].to_numpy(np.int64)
        frame["bin"] = best_fit_decreasing(sizes, capacity)
        frame["part"] = np.int64(key[0])
        frame["bound"] = np.int64(lower_bound(sizes, capacity))
        frame["bins"] = np.int64(frame["bin"].max() + 1)
        return frame[["doc_id", "piece", "token_start", "n_tokens", "part", "bin", "bins", "bound"]]

    return pack


_PACKED = "doc_id bigint, piece int, token_start bigint, n_tokens bigint, part bigint, bin bigint, bins bigint, bound bigint"


def _spread(items: DataFrame, partitions: int, seed: int, capacity: int) -> DataFrame:
    """Items packed in that many partitions; ids never decide the size of a partition."""
    part = F.pmod(F.xxhash64("doc_id", "piece", "copy", F.lit(seed)), F.lit(partitions))
    keyed = items.select("doc_id", "piece", "token_start", "n_tokens", part.alias("part"))
    return keyed.groupBy("part").applyInPandas(_packer(capacity), _PACKED)


def pieces_of(sizes: DataFrame, capacity: int) -> DataFrame:
    """Items of (doc_id, n_tokens): those over the capacity as full pieces and a rest."""
    total = F.coalesce("n_tokens", F.lit(0)).cast("bigint")
    pieces = F.greatest(F.ceil(total / capacity), F.lit(1)).cast("int")
    cut = sizes.select(F.col("doc_id").cast("bigint").alias("doc_id"), total.alias("total"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    start = F.col("piece").cast("bigint") * capacity
    # repeated rows get different places: rows are told apart by where they were read
    return cut.select("doc_id", "piece", start.alias("token_start"), F.least(F.col("total") - start, F.lit(capacity)).cast("bigint").alias("n_tokens"), F.monotonically_increasing_id().alias("copy"))


def fill(sizes: DataFrame, capacity: int = CAPACITY, share: int = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """A container for every item of (doc_id, n_tokens).

    Columns: doc_id, piece, token_start, n_tokens, container, and ``certified``
    (its partition provably needs no fewer containers).
    """
    items = written(pieces_of(sizes, capacity), "items")
    total = items.count()
    if not total:
        return items.selectExpr("doc_id", "piece", "token_start", "n_tokens", "cast(null as string) container", "true certified")
    partitions = -(-total // share)
    current = written(_spread(items, partitions, 0, capacity), "packed-0")
    done: list[DataFrame] = []
    for number in range(1, rounds + 1):
        gap = current.where("bins > bound")
        state = gap.where("bin = 0").select("part", "bins").distinct().agg(F.count("part"), F.sum("bins")).first()
        if state[0] < 2:  # none to exchange with
            break
        partitions = -(-state[0] // 2)
        again = written(_spread(gap.withColumn("copy", F.monotonically_increasing_id()), partitions, number, capacity), f"packed-{number}")
        needed = again.where("bin = 0").select("part", "bins").distinct().agg(F.sum("bins")).first()[0]
        if needed >= state[1]:
            break
        done.append(_named(current.where("bins <= bound"), number))
        current = again
    done.append(_named(current, 0))
    result = done[0]
    for one in done[1:]:
        result = result.unionByName(one)
    return result


def _named(packed: DataFrame, number: int) -> DataFrame:
    container = F.concat_ws("-", F.lit(number), "part", "bin")
    return packed.select("doc_id", "piece", "token_start", "n_tokens", container.alias("container"), (F.col("bins") <= F.col("bound")).alias("certified"))


def fill_texts(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, share: int = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """Containers for whole texts of (doc_id, text), measured in tokens of a public tokenizer."""
    return fill(count_tokens(documents, ["doc_id"], "text", vocabulary), capacity, share, rounds)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the volume bound, unused share, certified share."""
    used = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.min("certified").alias("certified"))
    return used.agg(
        F.count(F.lit(1)).alias("containers"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.ceil(F.sum("used") / capacity).alias("volume_bound"),
        (1 - F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("unused_share"),
        F.avg(F.col("certified").cast("double")).alias("certified_share"),
    )
