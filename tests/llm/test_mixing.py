import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from graphweir.llm import mixing as mx


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 5))
def test_permutation(size, key):
    assert sorted(mx.permute(np.arange(size), size, (key,)).tolist()) == list(range(size))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=5).filter(any), st.integers(1, 60))
def test_shards_add_up(totals, per_shard):
    totals = np.array(totals)
    shards = -(-int(totals.sum()) // per_shard)
    before = np.zeros_like(totals)
    for shard in range(shards):
        counts, offset = mx.shard_counts(totals, shards, shard, per_shard, 1)
        assert (offset == before).all() and counts.sum() == min(per_shard, totals.sum() - shard * per_shard)
        before = before + counts
    assert (before == totals).all()


def test_allocation():
    given_ = mx.allocate(np.array([1000, 10, 0, 500]), np.array([0.5, 0.2, 0.1, 0.2]), np.array([1, 3, 5, 2]), 800)
    assert given_[1] == 30 and given_[2] == 0 and abs(given_.sum() - 800) < 1e-6 and abs(given_[0] / given_[3] - 2.5) < 1e-9
    assert mx.allocate(np.array([10]), np.array([1.0]), np.array([2]), 1e9).tolist() == [20.0]


def test_selection(spark):
    rng = np.random.default_rng(1)
    docs = [(k, "big", "word " * int(rng.integers(1, 400))) for k in range(400)] + [(1000 + k, "small", "word " * 50) for k in range(10)] + [(2000, "unlisted", "word"), (2001, None, "x"), (2002, "big", None), (2003, "big", "")]
    documents = spark.createDataFrame(docs, "doc_id BIGINT, source STRING, text STRING")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 3), ("none", 0.1, 2), ("big", 0.7, 1), (None, 0.5, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
    out = mx.mix(documents, targets, total_tokens=20_000, block=128, shard_blocks=16)
    rows = out.collect()
    assert {r.source for r in rows} == {"big", "small"} and all(r.token_end - r.token_start == r.n_tokens > 0 for r in rows)
    uses = {}
    for r in rows:
        uses.setdefault((r.source, r.block), set()).add((r.shard, r.slot))
    assert max(len(v) for (s, _), v in uses.items() if s == "big") == 1 and max(len(v) for (s, _), v in uses.items() if s == "small") <= 3
    share = {r.source: r for r in mx.mix_shares(out, targets).where("source is not null").collect()}
    assert abs(share["small"].actual_share - 1500 / 20_000) < 0.02 and share["none"].actual_share == 0 and abs(sum(r.actual_share for r in share.values()) - 1) < 1e-9
    assert [tuple(r) for r in mx.mix(documents, targets, total_tokens=20_000, block=128, shard_blocks=16).orderBy("shard", "slot", "token_start").collect()] == sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[1], r[6]))
    assert mx.mix(documents.limit(0), targets).count() == 0 and mx.mix(documents, targets.limit(0)).count() == 0


def test_every_token_is_in_one_block(spark):
    sizes = spark.createDataFrame([(k, "s", 7 + k % 5, k) for k in range(500)], "doc_id BIGINT, source STRING, n_tokens BIGINT, copy BIGINT")
    got = mx.blocks(sizes, 64, 9).toPandas()
    assert (got.groupby("doc_id").apply(lambda g: (g.token_end - g.token_start).sum(), include_groups=False) == [7 + k % 5 for k in range(500)]).all()
    full = got.groupby("block").apply(lambda g: (g.token_end - g.token_start).sum(), include_groups=False)
    assert (full.sort_index().iloc[:-1] == 64).all()


def test_draws_of_very_many_blocks():
    """No limit on blocks: counts add up, stay within what there is, and near their expectation."""
    totals = np.array([6_000_000_000, 3_000_000_000, 1_000_000_000, 7], np.int64)
    shards = -(-int(totals.sum()) // 512)
    for shard in (0, 12_345_678, shards - 1):
        counts, before = mx.shard_counts(totals, shards, shard, 512, 3)
        assert counts.sum() == min(512, totals.sum() - shard * 512) and (counts >= 0).all() and (before + counts <= totals).all() and before.sum() == shard * 512
    middle, before = mx.shard_counts(totals, shards, shards // 2, 512, 3)
    assert abs(middle[0] - 307) < 80 and abs(before[0] / before.sum() - 0.6) < 1e-3


def test_default_total_meets_all_shares():
    available, shares, repeats = np.array([1000, 10, 0, 500]), np.array([0.5, 0.2, 0.1, 0.2]), np.array([1, 3, 5, 2])
    total = mx.natural_total(available, shares, repeats)
    given_ = mx.allocate(available, shares, repeats, total)
    assert total == 135 and np.allclose(given_ / given_.sum(), shares * np.array([1, 1, 0, 1]) / 0.9, atol=1e-2)
