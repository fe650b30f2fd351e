"""Most similar vectors for every vector: a hash-prefix forest.

Each of L trees gives every vector a 64-bit hash string, the signs of random
projections (orthogonal within a tree). A tree is the array of its strings in
sorted order, so that the strings which share a prefix are a run of it.

A vector descends all trees to its longest prefix matches and ascends them in
step, one prefix length at a time, until at least ``WANTED`` entries of all
trees together share that many bits with it: in dense regions and in trees that
part a vector's neighbours late it takes few bits, elsewhere more. The length is
told by a forest of a bounded sample (``SAMPLE`` vectors, the same trees, broadcast),
whose counts are scaled to the number of all vectors; for fewer vectors than
that it is exact. In each full array the run of that prefix, but no more than
``REACH`` places on either side, are the candidates. They are scored exactly
where they meet, by block products over the sorted array; only the best of a
tree leave the task.

Arrays are cut by range over (tree, hash), never by a fixed bucket, so no
bucket can be hot, and no pair of rows but those in reach is ever formed.
Equal vectors enter the forest once; a class of equal vectors keeps its k+1
smallest ids, which are all that any vector can have among its k best.

The loss: a neighbour that shares too short a prefix in all L trees, or stands
beyond reach in all, is missed, and runs end at the edge of a range partition.
``tests/llm`` measures recall against brute force; the README gives figures.

Defined results
---------------
* Only vectors with ``dims`` finite elements that are not all zero take part;
  others neither ask nor answer. A repeated row counts once; if an id has
  several vectors, the largest of (time, vector) stands for it.
* Cosines are rounded to 6 decimals; ties go to the smaller id.
* Null ids take no part. Empty tables give no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from graphweir.session import written

DIMS = 96
TREES = 16
BITS = 64
#: Entries of all trees together that must share a prefix with a vector, before it ascends no further.
WANTED = 8_000
#: Places on either side in one tree at most.
REACH = 1_024
#: Vectors of the forest that tells prefix lengths.
SAMPLE = 16_384
SEED = 20240501
#: Copies of the result of a class of equal vectors, so that a class with very
#: many members is joined in as many parts.
SALTS = 16


def planes(dims: int, trees: int, seed: int = SEED) -> np.ndarray:
    """Projection directions, trees * BITS of them, orthogonal in runs of at most ``dims``."""
    rng = np.random.default_rng(seed)
    runs = []
    while sum(r.shape[1] for r in runs) < trees * BITS:
        q, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
        runs.append(q[:, : min(dims, BITS)])
    return np.ascontiguousarray(np.concatenate(runs, axis=1)[:, : trees * BITS], np.float32)


def _valid(df: DataFrame, node: str, vector: str, at: str, dims: int) -> DataFrame:
    """One row per usable node: id, raw float32 bytes, two hashes of them."""
    rows = df.select(F.col(node).cast("bigint").alias("node"), F.col(vector).cast("array<float>").alias("v"), F.col(at).alias("at"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("node").isNotNull() & (F.size("v") == dims) & finite & F.exists("v", lambda x: x != 0))
    one = rows.groupBy("node").agg(F.max(F.struct("at", "v")).getField("v").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(-1, dims) + np.float32(0)
            raw = pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(np.arange(0, (len(flat) + 1) * dims * 4, dims * 4, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
            yield pa.RecordBatch.from_arrays([batch.column(0), raw], ["node", "raw"])

    packed = one.mapInArrow(pack, "node bigint, raw binary")
    return packed.select("node", "raw", F.xxhash64("raw").alias("h1"), F.xxhash64("raw", F.lit(SEED)).alias("h2"))


def _unit(column: pa.Array, dims: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, dims).astype(np.float64)
    # scaled by the largest element first, so that squares neither vanish nor overflow
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def codes_of(unit: np.ndarray, directions: np.ndarray, trees: int) -> np.ndarray:
    """The hash strings of unit vectors, as numbers, one column a tree."""
    weights = (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)).astype(np.uint64)
    signs = (unit.astype(np.float32) @ directions) > 0
    return (signs.reshape(len(unit), trees, BITS) * weights).sum(axis=2, dtype=np.uint64)


def run_of(codes: np.ndarray, array: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end place of the entries of a sorted array that share so many first bits with each string."""
    rest = np.where(bits > 0, np.uint64(BITS) - bits.astype(np.uint64), np.uint64(0))
    rest = np.minimum(rest, np.uint64(BITS - 1))
    low = (codes >> rest) << rest
    high = low | ((np.uint64(1) << rest) - np.uint64(1))
    first, end = np.searchsorted(array, low, "left"), np.searchsorted(array, high, "right")
    return np.where(bits > 0, first, 0), np.where(bits > 0, end, len(array))


def prefix_lengths(codes: np.ndarray, sample: np.ndarray, wanted: float) -> np.ndarray:
    """For each vector the longest prefix that at least ``wanted`` entries of all sorted sample arrays together share with it."""
    low, high = np.zeros(len(codes), np.int64), np.full(len(codes), BITS)
    while (low < high).any():  # the count falls as prefixes grow
        middle = (low + high + 1) // 2
        total = np.zeros(len(codes), np.int64)
        for t in range(codes.shape[1]):
            first, end = run_of(codes[:, t], sample[t], middle)
            total += end - first
        enough = total >= wanted
        low, high = np.where(enough, middle, low), np.where(enough, high, middle - 1)
    return low


def _plant(dims: int, trees: int, shared, wanted: float):
    """Maps a vector to one row per tree: tree, hash, bits, id, members, vector; ``shared`` are the sorted sample arrays."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = planes(dims, trees)
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                unit = _unit(part.column(1), dims)
                n = len(unit)
                codes = codes_of(unit, directions, trees)
                bits = prefix_lengths(codes, shared.value, wanted)
                ordered = (codes ^ np.uint64(1 << 63)).view(np.int64)  # signed order as of the bit strings
                again = pa.array(np.tile(np.arange(n), trees))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.arange(trees, dtype=np.int32), n)), pa.array(ordered.T.ravel()), pa.array(np.tile(bits, trees).astype(np.int32)), part.column(0).take(again), part.column(2).take(again), part.column(1).take(again)],
                    ["tree", "hash", "bits", "node", "members", "raw"],
                )

    return plant


_FOUND = T.StructType([T.StructField("node", T.LongType()), T.StructField("near", T.ArrayType(T.StructType([T.StructField("less", T.DoubleType()), T.StructField("id", T.LongType())])))])


def _ascend(dims: int, k: int, reach: int, block: int = 256):
    """Maps rows in (tree, hash) order to the best of each among the run of its prefix within reach."""

    def score(tree: np.ndarray, code: np.ndarray, bits: np.ndarray, node: np.ndarray, members: list[bytes], unit: np.ndarray, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        """Results for rows lo..hi of a buffer whose other rows are their surroundings."""
        while lo < hi:
            end = lo + int(np.searchsorted(tree[lo:hi], tree[lo], "right"))  # the rows of one tree
            first, last = np.searchsorted(tree, tree[lo], "left"), np.searchsorted(tree, tree[lo], "right")
            starts, ends = run_of(code[lo:end], code[first:last], bits[lo:end])
            own = np.arange(lo, end)
            starts, ends = np.maximum(starts + first, own - reach), np.minimum(ends + first, own + reach + 1)
            yield best(node, members, unit, lo, end, starts, ends)
            lo = end

    def best(node: np.ndarray, members: list[bytes], unit: np.ndarray, lo: int, hi: int, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        q, a, z = hi - lo, int(starts.min()), int(ends.max())
        products = unit[lo:hi].astype(np.float32) @ unit[a:z].astype(np.float32).T
        at = np.arange(a, z)
        products[(at < starts[:, None]) | (at >= ends[:, None])] = -2
        products[np.arange(q), np.arange(lo, hi) - a] = -2
        take = min(k, z - a)
        kth = -np.partition(-products, take - 1, axis=1)[:, take - 1]
        row, col = np.nonzero(products >= np.maximum(kth - 2e-6, -1.5)[:, None])  # all that may tie with the k-th
        exact = np.round((unit[lo + row] * unit[a + col]).sum(axis=1), 6)
        order = np.lexsort((node[a + col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        row, col, exact = row[rank < k], col[rank < k], exact[rank < k]
        ids = [np.frombuffer(members[a + c], "<i8") for c in col.tolist()]
        sizes = np.array([len(x) for x in ids], np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, sizes, q))]).astype(np.int32)
        flat = pa.StructArray.from_arrays([pa.array(np.repeat(-exact, sizes)), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64))], ["less", "id"])
        return pa.RecordBatch.from_arrays([pa.array(node[lo:hi]), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["node", "near"])

    def ascend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, code, bits, node, unit, members = np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dims)), []
        done = 0  # rows at the head of the buffer that already have results
        for batch in batches:
            tree = np.concatenate([tree, batch.column(0).to_numpy()])
            code = np.concatenate([code, batch.column(1).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)])
            bits = np.concatenate([bits, batch.column(2).to_numpy().astype(np.int64)])
            node = np.concatenate([node, batch.column(3).to_numpy()])
            members += batch.column(4).to_pylist()
            unit = np.concatenate([unit, _unit(batch.column(5), dims)])
            while len(node) - done >= block + reach:
                a, z = max(0, done - reach), done + block + reach
                yield from score(tree[a:z], code[a:z], bits[a:z], node[a:z], members[a:z], unit[a:z], done - a, done - a + block)
                done += block
            drop = max(0, done - reach)
            tree, code, bits, node, members, unit, done = tree[drop:], code[drop:], bits[drop:], node[drop:], members[drop:], unit[drop:], done - drop
        while done < len(node):
            a, z = max(0, done - reach), min(len(node), done + block + reach)
            yield from score(tree[a:z], code[a:z], bits[a:z], node[a:z], members[a:z], unit[a:z], done - a, min(done + block, len(node)) - a)
            done += block

    return ascend


def nearest(df: DataFrame, node: str, vector: str, at: str, k: int = 5, dims: int = DIMS, trees: int = TREES, reach: int = REACH, wanted: int = WANTED, sample: int = SAMPLE) -> DataFrame:
    """The k most similar other nodes of every usable node: ``node``, ``rank``, ``neighbour``, ``cosine``."""
    spark = df.sparkSession
    nodes = written(_valid(df, node, vector, at, dims), "vectors")
    by_class = Window.partitionBy("h1", "h2").orderBy("node")
    few = nodes.select("h1", "h2", "node").withColumn("place", F.row_number().over(by_class)).where(F.col("place") <= k + 1)
    classes = few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("node")).alias("ids")).withColumn("node", F.col("ids")[0])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = pa.array([np.array(x, "<i8").tobytes() for x in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], ["node", "raw", "members"])

    distinct = nodes.select("node", "raw").join(classes.select("node", "ids"), "node").select("node", "raw", "ids")
    distinct = distinct.mapInArrow(members, "node bigint, raw binary, members binary")
    n = nodes.count()
    drawn = nodes.groupBy("h1", "h2").agg(F.min("node").alias("node")).orderBy(F.xxhash64("node"), "node").limit(sample).select("node")
    some = nodes.select("node", "raw").join(F.broadcast(drawn), "node", "left_semi").select("raw").toArrow()  # at most ``sample`` vectors
    raw = some.column("raw").combine_chunks() if some.num_rows else pa.array([], pa.binary())
    codes = codes_of(_unit(raw, dims), planes(dims, trees), trees) if len(raw) else np.zeros((0, trees), np.uint64)
    shared = spark.sparkContext.broadcast(np.sort(codes, axis=0).T.copy())  # of fixed size
    scale = len(raw) / n if len(raw) == sample and n else 1.0
    forest = distinct.mapInArrow(_plant(dims, trees, shared, wanted * scale), "tree int, hash bigint, bits int, node bigint, members binary, raw binary")
    size = n * trees * (dims * 4 + 60)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (48 << 20)))
    arrays = forest.repartitionByRange(ranges, "tree", "hash").sortWithinPartitions("tree", "hash")
    found = arrays.select("tree", "hash", "bits", "node", "members", "raw").mapInArrow(_ascend(dims, k, reach), _FOUND)
    near = found.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))

    # a class answers with its own members too; k + 1 entries serve every member, which then leaves itself out
    own = F.transform("ids", lambda x: F.struct(F.lit(-1.0).alias("less"), x.alias("id")))
    answered = classes.join(near, "node", "left").select("h1", "h2", "node", "ids", F.slice(F.array_sort(F.concat(own, F.coalesce("near", F.array().cast(_FOUND["near"].dataType)))), 1, k + 1).alias("near"))
    answered = written(answered, "nearest")
    single = answered.where(F.size("ids") == 1).select("node", "near")
    shared = answered.where(F.size("ids") > 1).select("h1", "h2", "near", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    copies = nodes.select("node", "h1", "h2", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt")).join(shared, ["h1", "h2", "salt"]).select("node", "near")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("node")), 1, k)
    return (
        single.unionByName(copies)
        .select("node", F.posexplode(others).alias("place", "one"))
        .select("node", (F.col("place") + 1).alias("rank"), F.col("one.id").alias("neighbour"), (-F.col("one.less")).alias("cosine"))
    )


def similar_pairs(near: DataFrame, least: float) -> DataFrame:
    """Pairs ``node_a`` < ``node_b`` of at least that cosine where one is among the nearest of the other."""
    pairs = near.where(F.col("cosine") >= least)
    return pairs.select(F.least("node", "neighbour").alias("node_a"), F.greatest("node", "neighbour").alias("node_b")).distinct()
