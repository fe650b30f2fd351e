"""Mixing sources to target weights.

The tokens of each source are packed into blocks of a fixed length, its texts
laid end to end in a pseudorandom order. How many blocks each source gives is
decided once for the whole output: its share of the total, but never more than
its tokens times its ``max_repeats``; what such a source cannot give goes to
the others in proportion to their shares. The slots of each output shard are
then drawn as multinomial source counts, conditioned on those totals: a shard
finds its counts by halving the range of shards from the whole down to itself,
drawing at each halving, with a seed of its own, how many blocks of each
source fall to the left. So shards draw apart from each other, yet their
counts add up exactly. A slot's place among the blocks its source gives is
mapped through a pseudorandom permutation of the source's block numbers, one
per epoch, and the slots are joined to the blocks by number.

No source, however large, meets in one task: the running token count that cuts
blocks is a sum within buckets of about ``SHARE`` texts, over a running sum of
bucket totals.

Defined results
---------------
* Sources without a target, and texts without tokens, are not used. A target
  without texts gets share 0. Repeated target rows count once; a target with
  null source or share, or a share of 0 or less, is no target. Null or
  negative ``max_repeats`` is 0.
* The last block of a source may be shorter. No block is used more often than
  ``max_repeats`` times. Repeated rows of texts are texts of their own.
* Empty tables give no slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweir.llm.tokens import VOCABULARY, count_tokens
from graphweir.session import written

BLOCK = 2048
SHARD_BLOCKS = 512
SHARE = 50_000
SEED = 7
#: Blocks from which draws come from the normal distribution of the same mean and variance, rounded: the library draws no larger ones.
MOST_EXACT = 900_000_000
#: A table of targets is a setting, not data; a longer one is refused.
MOST_TARGETS = 100_000


def allocate(available: np.ndarray, shares: np.ndarray, repeats: np.ndarray, total: float) -> np.ndarray:
    """Tokens of each source: its share of ``total`` up to its capacity, the
    remainder spread over the others in proportion to their shares."""
    capacity = available.astype(float) * repeats
    given = np.zeros(len(shares))
    free = (shares > 0) & (capacity > 0)
    left = min(float(total), float(capacity[free].sum()))
    while free.any() and left > 1e-9:
        want = left * shares / shares[free].sum()
        full = free & (want >= capacity)
        if not full.any():
            given[free] = want[free]
            break
        given[full] = capacity[full]
        left -= capacity[full].sum()
        free &= ~full
    return given


def natural_total(available: np.ndarray, shares: np.ndarray, repeats: np.ndarray) -> int:
    """The largest total at which every source that has texts reaches its share (of the shares of all that have some)."""
    some = (available * repeats > 0) & (shares > 0)
    if not some.any():
        return 0
    return int((available * repeats / np.where(some, shares, 1.0))[some].min() * shares[some].sum())


def _hypergeometric(good: int, bad: int, taken: int, rng: np.random.Generator) -> int:
    """How many of ``good`` are among ``taken`` of all, without replacement."""
    total = good + bad
    if total < MOST_EXACT:
        return int(rng.hypergeometric(good, bad, taken)) if total and taken else 0
    share = good / total
    spread = (taken * share * (1 - share) * (total - taken) / (total - 1)) ** 0.5
    return int(min(max(round(taken * share + spread * rng.standard_normal()), taken - bad, 0), good, taken))


def draw(counts: np.ndarray, taken: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source among so many taken of all: multinomial counts, conditioned on the totals."""
    drawn, rest = np.zeros_like(counts), int(counts.sum())
    for k, own in enumerate(counts.tolist()):
        rest -= own
        drawn[k] = _hypergeometric(own, rest, taken, rng)
        taken -= int(drawn[k])
    return drawn


def shard_counts(totals: np.ndarray, shards: int, shard: int, per_shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each source in a shard, and how many of them went to shards before it."""
    lo, hi = 0, shards
    counts, before = totals.copy(), np.zeros_like(totals)
    slots = int(totals.sum())
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left_slots = min(mid * per_shard, slots) - lo * per_shard
        rng = np.random.default_rng([seed, lo, hi])
        left = draw(counts, left_slots, rng)
        if shard < mid:
            hi, counts = mid, left
        else:
            lo, before, counts = mid, before + left, counts - left
    return counts, before


def permute(position: np.ndarray, size: int, key: tuple[int, ...]) -> np.ndarray:
    """A pseudorandom permutation of range(size): a four-round Feistel network
    on the next even power of two, walked until inside the range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(list(key)).integers(1, 2**63, 4, dtype=np.uint64) | np.uint64(1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= k
            left, right = right, left ^ ((mixed >> np.uint64(33)) & mask)
        return (left << np.uint64(half)) | right

    x = once(position.astype(np.uint64))
    while (outside := x >= np.uint64(size)).any():
        x[outside] = once(x[outside])
    return x.astype(np.int64)


def blocks(sizes: DataFrame, block: int, buckets: int) -> DataFrame:
    """Segments (source, block, doc_id, token_start, token_end) of texts laid end to end."""
    placed = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "copy", F.lit(SEED)), F.lit(buckets)))
    sums = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "bucket", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id", "copy"), "doc_id", "copy").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    laid = placed.join(offsets, ["source", "bucket"]).withColumn("begin", start).withColumn("end", F.col("begin") + F.col("n_tokens"))
    number = F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block)))
    cut = laid.select("source", "doc_id", "begin", "end", number.alias("block"))
    return cut.select(
        "source",
        "block",
        "doc_id",
        (F.greatest("begin", F.col("block") * block) - F.col("begin")).alias("token_start"),
        (F.least("end", (F.col("block") + 1) * block) - F.col("begin")).alias("token_end"),
    )


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """The selection: one row per text segment of each slot.

    Columns: shard, slot, source, epoch, block, doc_id, token_start, token_end,
    n_tokens. ``total_tokens`` is the size of the output, by default
    :func:`natural_total`.
    """
    spark = documents.sparkSession
    wanted = targets.where("source is not null and target_share > 0").select("source", F.col("target_share").cast("double"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("bigint").alias("max_repeats")).distinct()
    rows = sorted(wanted.limit(MOST_TARGETS + 1).collect())
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    names = [r.source for r in rows]
    if len(set(names)) < len(names):
        raise ValueError("a source has several targets")
    listed = documents.select("doc_id", "source", "text").where(F.col("source").isin(names) if names else F.lit(False))
    counted = count_tokens(listed, ["doc_id", "source"], "text", vocabulary).where("n_tokens > 0").withColumn("copy", F.monotonically_increasing_id())
    sizes = written(counted, "sizes")
    known = {r.source: (r.tokens, r.texts) for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("texts")).collect()}
    available = np.array([known.get(n, (0, 0))[0] for n in names], np.int64)
    numbers = -(-available // block)
    shares, repeats = np.array([r.target_share for r in rows]), np.array([r.max_repeats for r in rows], np.int64)
    total = natural_total(available, shares, repeats) if total_tokens is None else total_tokens
    given = allocate(available, shares, repeats, total)
    mean = np.divide(available, numbers, out=np.ones(len(names)), where=numbers > 0)  # tokens of a source's block
    exact = np.divide(given, mean)
    counts = np.minimum(np.floor(exact + 0.5).astype(np.int64), numbers * repeats)
    slots_n = int(counts.sum())
    shards = max(1, -(-slots_n // shard_blocks))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                drawn, before = shard_counts(counts, shards, shard, shard_blocks, seed)
                which = np.repeat(np.arange(len(names)), drawn)
                given_no = np.concatenate([b + np.arange(c) for b, c in zip(before.tolist(), drawn.tolist(), strict=True)] or [np.zeros(0, int)])
                epoch, number = np.zeros_like(given_no), np.zeros_like(given_no)
                for s in np.flatnonzero(drawn).tolist():
                    own = np.flatnonzero(which == s)
                    epoch[own] = given_no[own] // numbers[s]
                    for e in np.unique(epoch[own]).tolist():
                        at = own[epoch[own] == e]
                        number[at] = permute(given_no[at] % numbers[s], int(numbers[s]), (seed, s, e))
                order = np.random.default_rng([seed, 1, shard]).permutation(len(which))
                columns = [np.full(len(which), shard), np.arange(len(which)), pa.array([names[k] for k in which[order]], pa.string()), epoch[order].astype(np.int64), number[order].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "slot", "source", "epoch", "block"])

    drawn = spark.range(shards if slots_n else 0).mapInArrow(slots, "shard bigint, slot bigint, source string, epoch bigint, block bigint")
    buckets = max(1, -(-sum(t for _, t in known.values()) // SHARE))
    segments = blocks(sizes, block, buckets)
    return drawn.join(segments, ["source", "block"]).select("shard", "slot", "source", "epoch", "block", "doc_id", "token_start", "token_end", (F.col("token_end") - F.col("token_start")).alias("n_tokens"))


def mix_shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: the share wanted and reached, tokens, and the most often a segment was used."""
    selection = written(selection.select("source", "epoch", "n_tokens"), "selection")  # read twice
    used = selection.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), (F.max("epoch") + 1).alias("most_uses"))
    joined = targets.where("source is not null").select("source", "target_share", "max_repeats").distinct().join(used, "source", "left")
    tokens = F.coalesce("tokens", F.lit(0))
    everything = selection.agg(F.sum("n_tokens").alias("all_tokens"))
    return joined.join(F.broadcast(everything)).select(  # one row
        "source", "target_share", "max_repeats", tokens.alias("tokens"), F.coalesce(tokens / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses")
    )
