import numpy as np

from graphweir.llm import neighbours as nb

SCHEMA = "node_id BIGINT, v ARRAY<FLOAT>, at INT, rank INT"


def brute(vectors, k):
    ids = np.array(sorted(vectors))
    u = np.array([np.array(vectors[i], np.float32).astype(np.float64) for i in ids])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = np.round(u @ u.T, 6)
    np.fill_diagonal(c, -9)
    return {int(ids[i]): [(int(ids[j]), c[i, j]) for j in np.lexsort((ids, -c[i]))[:k]] for i in range(len(ids))}


def test_recall_over_many_partitions(spark):
    """With a reach far under the number of rows, so that the forest has to find what it finds."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((150, 96))
    rows = {k: (centres[k % 150] + 0.5 * rng.standard_normal(96)).tolist() for k in range(3000)}
    df = spark.createDataFrame([(k, v, 0, None) for k, v in rows.items()], SCHEMA)
    got = {}
    for r in nb.nearest(df, "node_id", "v", "at", reach=48, wanted=600, sample=500).collect():
        got.setdefault(r.node_id if hasattr(r, "node_id") else r.node, set()).add(r.neighbour)
    want = brute(rows, 5)
    hit = sum(len(got.get(k, set()) & {i for i, _ in v}) for k, v in want.items())
    assert hit / (5 * len(want)) >= 0.9


def test_dirt_and_equal_vectors(spark):
    rng = np.random.default_rng(3)
    good = {k: rng.standard_normal(96).tolist() for k in range(40)}
    for k in range(40, 60):
        good[k] = good[7]  # a class of equal vectors
    good[60] = [x * 1e-30 for x in good[8]]
    bad = [(100, None), (101, [0.0] * 96), (102, [1.0] * 95), (103, [float("nan")] + [1.0] * 95), (104, [None] + [1.0] * 95), (105, [float("inf")] + [1.0] * 95), (None, [1.0] * 96)]
    rows = [(k, v, 0, 1) for k, v in good.items()] + [(k, v, 0, 1) for k, v in bad] + [(3, good[3], 0, 1)]
    got = {}
    for r in nb.nearest(spark.createDataFrame(rows, SCHEMA), "node_id", "v", "at").collect():
        got.setdefault(r.node, []).append((r["rank"], r.neighbour))
    want = brute(good, 5)
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == {k: [i for i, _ in v] for k, v in want.items()}


def test_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert nb.nearest(empty, "node_id", "v", "at").count() == 0
    one = spark.createDataFrame([(1, [1.0] * 96, 0, 0)], SCHEMA)
    assert nb.nearest(one, "node_id", "v", "at").count() == 0


def test_prefixes_against_plain_strings():
    """Runs of prefixes and the ascent in step, against strings of bits."""
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 2**63, (40, 3), dtype=np.uint64) << np.uint64(1)
    codes[:20, 0] = codes[0, 0] ^ (np.uint64(1) << np.arange(20, dtype=np.uint64))  # long shared prefixes in one tree
    arrays = np.sort(codes, axis=0).T.copy()
    bits = nb.prefix_lengths(codes, arrays, 6)
    text = [[f"{int(c):064b}" for c in column] for column in codes.T]
    for k in range(40):
        count = lambda n, k=k: sum(own[:n] == column[k][:n] for column in text for own in column)
        assert count(bits[k]) >= 6 and (bits[k] == 64 or count(bits[k] + 1) < 6)
        first, end = nb.run_of(codes[k : k + 1, 0], arrays[0], bits[k : k + 1])
        assert end[0] - first[0] == sum(own[: bits[k]] == text[0][k][: bits[k]] for own in text[0])
    assert nb.run_of(codes[:2, 1], arrays[1], np.array([0, 64]))[1][0] == 40
