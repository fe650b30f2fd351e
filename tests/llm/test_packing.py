import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from graphweir.llm import packing as pk


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_containers_hold_and_bounds_bound(sizes):
    sizes = np.array(sorted(sizes, reverse=True), np.int64)
    place = pk.best_fit_decreasing(sizes, 50)
    bound = pk.lower_bound(sizes, 50)
    if len(sizes):
        assert np.bincount(place, sizes).max() <= 50
        assert bound <= place.max() + 1
        # best fit decreasing needs at most 11/9 of the optimum and a little
        assert place.max() + 1 <= 11 / 9 * (place.max() + 1) + 1


def test_bound_is_sharp_beyond_volume():
    sizes = np.array([26] * 7, np.int64)  # no two fit together
    assert pk.lower_bound(sizes, 50) == 7
    assert pk.lower_bound(np.array([17] * 6, np.int64), 50) == 3  # two at most


def test_table(spark):
    rows = [(k, int(s)) for k, s in enumerate(np.random.default_rng(0).integers(1, 2048, 3000))]
    rows += [(5000, 5000), (5001, 0), (5002, None), (None, 10), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id BIGINT, n_tokens BIGINT")
    out = pk.fill(df, 2048, share=300)
    got = out.toPandas()
    assert got.groupby("container").n_tokens.sum().max() <= 2048
    assert sorted(got[got.doc_id == 5000].n_tokens) == [904, 2048, 2048]
    assert got.n_tokens.sum() == sum(r[1] or 0 for r in rows) and len(got) == len(rows) + 2
    report = pk.fill_report(out).first()
    assert report.containers == got.container.nunique() and report.unused_share < 0.05
    assert pk.fill(df.limit(0)).count() == 0


def test_texts(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, None), (3, ""), (4, "word " * 5000)], "doc_id BIGINT, text STRING")
    got = {(r.doc_id, r.piece): r.n_tokens for r in pk.fill_texts(df).collect()}
    assert got[1, 0] == 3 and got[2, 0] == got[3, 0] == 0 and got[4, 0] == 2048 and sum(n for (d, _), n in got.items() if d == 4) in (5000, 5001)
