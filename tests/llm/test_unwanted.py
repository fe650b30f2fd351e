from collections import Counter

import numpy as np
import pytest

from graphweir.llm import ngrams
from graphweir.llm import unwanted as un


@pytest.mark.parametrize(
    ("text", "want"),
    [("you i d i o t", "you idiot"), ("s h u t   u p", "shut up"), ("f-u-n", "fun"), ("1d10t", "idiot"), ("idіot", "idiot"), ("id​iot", "idiot"), ("noooo", "no"), ("In 1836, 2nd", "in 0 0"), ("sh1t b@d", "shit bad"), ("U.S.A. a b", "usa a b")],
)
def test_disguises(text, want):
    assert " ".join(w for w in un.atoms(text) if w) == want


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING, score DOUBLE")


CLEAN = ["The mill of {0} was rebuilt in 18{1:02d}. Clerks left {0} when the mill closed.", "A plot of {1} hectares near {0} was set aside for hemp.", "The court of {0} fined a man who had called his neighbour an idiot."]
BAD = ["You worthless fool of {0}, nobody will ever miss you.", "Crawl away from {0}, you worthless fool, and never come back.", "All of them in {0} are vermin and should be driven out of town."]


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = [], []
    for k in range(240):
        body = CLEAN[k % 3].format(f"Town{k % 17}", k % 90)
        bad = k % 12 == 0
        if bad:
            body += " " + BAD[k // 12 % 3].format(f"Town{k % 17}")
        rows.append((k, body, "ab"[k % 2], None))
        if k % 24 == 0 or k % 5 == 0:
            labels.append((k, "abusive" if bad else "clean", "r"))
    rows += [(900, None, "a", 0.0), (901, "", None, 0.0), (902, "word " * 50_000, "a", 0.0), (903, "All of you are w o r t h l e s s  fools", "b", 0.0)]
    return docs(spark, rows), spark.createDataFrame([*labels, (1, "clean", "r"), (1, "abusive", "q"), (None, "clean", "r"), (2, "odd", "r")], "doc_id BIGINT, label STRING, rater STRING")


def test_held_out(spark, tables):
    documents, labels = tables
    seen = {r.doc_id for r in labels.collect()}
    got = {r.doc_id: r for r in un.score_documents(documents, labels).collect()}
    held = [k for k in range(240) if k not in seen]
    wrong = [k for k in held if got[k].unwanted != (k % 12 == 0)]
    assert len(wrong) <= 0.05 * len(held), wrong[:5]
    assert all(got[k].score == 0 and not got[k].unwanted for k in (900, 901)) and not got[902].unwanted
    rates = {r.source: r for r in un.rates(un.score_documents(documents, labels)).collect()}
    assert rates["a"].documents == 122 and rates["a"].unwanted > rates["b"].unwanted


def test_without_labels_and_empty(spark, tables):
    documents, labels = tables
    scored = {r.doc_id: r.unwanted for r in un.score_documents(documents.where("doc_id < 60"), labels.limit(0)).collect()}
    assert not scored[1] and not scored[2] and not scored[4]
    assert un.score_documents(documents.limit(0), labels.limit(0)).count() == 0


def test_counts_cover_all_documents(spark):
    """What many documents hold is known and counted, though no label holds it; counts equal plain ones."""
    rows = [(k, f"plain{k % 50} text of the mill" + (" rareword stays here." if k % 6_500 == 7 else "."), "a", None) for k in range(20_000)]
    disguises = un.Disguises(Counter(), Counter())
    words = un.WordIds(un.atoms, disguises.reveal)
    texts = un.read_words(docs(spark, rows), disguises)
    own = un.take_inventory(texts, un.weighted([words.text("Rareword lives. A seed alone.")]), len(rows))

    def at(index, *pieces):
        ids = np.array([0, *map(words.__getitem__, pieces)], np.int64)
        two, three = ngrams.grams(ids)
        return int(index.find(np.array([ids[-1], two[-1], three[-1]][len(pieces) - 1 :][:1]))[0])

    assert own.n1[at(own.one, "rareword")] == 4 and own.n1[at(own.one, "mill")] == 20_000 and own.n1[at(own.one, "seed")] == 0
    assert own.cont1[at(own.one, "text")] == 50 and own.cont1[at(own.one, "rareword")] == 1  # words before it
    assert own.cont2[at(own.two, "of", "the")] == 1 and own.tot3[at(own.two, "of", "the")] == 20_000 and own.tot3[at(own.two, "rareword", "stays")] == 4
    assert own.n[at(own.three, "mill", "rareword", "stays")] == 4 and at(own.three, "plain1", "rareword", "stays") == -1
    assert own.types == 50 + 50 + 3 + 3  # marks and plain words, plain words and text, the common pairs, those of the rare word


def test_rest_is_scored_like_the_inventory(spark, tables, monkeypatch):
    """What is held in one place changes no score: n-grams under the share are known and learnt from all the same."""
    documents, labels = tables
    rows = [(1_000 + k, f"You worthless fool, nobody will ever miss you, you mouldy {'turnip pudding'.split()[k % 2]}. A cart went by." if k % 3 == 0 else f"A cart of mouldy turnips left Farm{k // 6}.", "c", None) for k in range(24)]
    documents = documents.where("doc_id <> 902").unionByName(docs(spark, rows))
    scores, learnt, changes = [], [], un.changes
    for name in ("SURE_LABELLED", "SURE_WORDS", "SURE"):  # so that many spans are found
        monkeypatch.setattr(un, name, 0.1)
    monkeypatch.setattr(un, "changes", lambda *args: learnt.append(changes(*args)) or learnt[-1])
    for share in (1e-4, 0.1):  # all n-grams that occur twice, those that occur 27 times
        monkeypatch.setattr(ngrams, "LEAST_SHARE", share)
        scores.append({r.doc_id: (r.score, r.unwanted) for r in un.score_documents(documents, labels).collect()})
    assert learnt[-1].table.count() > 0  # found among the rest
    assert scores[0].keys() == scores[1].keys()
    wrong = [k for k, (score, unwanted) in scores[0].items() if abs(score - scores[1][k][0]) > 1e-4 or unwanted != scores[1][k][1]]
    assert not wrong, [(k, scores[0][k], scores[1][k]) for k in wrong[:5]]


def test_kneser_ney_sums_to_one(spark):
    """Probabilities of all words after a context add up to one in both classes."""
    disguises = un.Disguises(Counter(), Counter())
    words = un.WordIds(un.atoms, disguises.reveal)
    rows = [(1, "ant bee cat. ant bee dog. bee cat ant. ant bee cat.", "s", None), (2, "bee cat dog. ant bee cat dog.", "s", None)]
    texts = un.read_words(docs(spark, rows), disguises)
    own = un.take_inventory(texts, un.weighted([words.text(r[1]) for r in rows]), 2)
    shared = np.where(own.one.keys == 0, 0, own.cont1 + 1)
    shared = shared / shared.sum()
    n = own.counts([words.text("ant bee cat. bee dog.")])
    for model in (ngrams.Model.of(own, n, shared), ngrams.Model.rest(own, np.zeros(len(own.n)), n, shared)):
        for context in ("ant bee", "bee cat", "ant"):
            total = 0.0
            for w in ("ant", "bee", "cat", "dog"):
                ids = np.array([0, *map(words.__getitem__, f"{context} {w}".split())], np.int64)
                two, three = ngrams.grams(ids)
                one, two, three = own.one.find(ids), own.two.find(two), own.three.find(three)
                mid, ctx = (np.concatenate([[-1], x[:-1]]) for x in (one, two))
                total += np.exp(model.logs(one, two, three, mid, ctx, 3)[-1])
            assert abs(total - 1) < 1e-6


def test_index():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    index = ngrams.Index(keys)
    assert (index.find(keys) == np.arange(len(keys))).all() and (index.find(keys + 1) == np.where(np.isin(keys + 1, keys), 0, -1)).all()
    assert (ngrams.Index(keys[:0]).find(keys) == -1).all()


def test_sample_is_bounded(spark, tables):
    documents, labels = tables
    assert len(un.labelled_sample(documents, labels)) > 40 and len(un.labelled_sample(documents, labels, 10)) <= 10
    few = un.labelled_sample(documents, labels, most_characters=500)
    assert 0 < sum(len(t) for t, _ in few) <= 500


def test_keys_are_those_of_spark(spark):
    ids = np.array([0, 5, -7, 2**61, 0, 9, 0], np.int64)
    two, three = ngrams.grams(ids)
    want = spark.sql("SELECT xxhash64(0L, 5L) a, xxhash64(5L, -7L) b, xxhash64(0L, 0L, 5L) c, xxhash64(0L, 5L, -7L) d, xxhash64(5L, -7L, 2305843009213693952L) e, xxhash64(0L, 0L, 9L) f").first()
    assert (two[1], two[2], three[1], three[2], three[3], three[5]) == tuple(want)
    assert sorted(zip(*(c.tolist() for c in ngrams.trigrams(ids)), strict=True)) == sorted([(0, 0, 5, 1), (0, 5, -7, 1), (5, -7, 2**61, 1), (0, 0, 9, 1)])


def test_sample_is_read_where_the_texts_are(spark, tables, monkeypatch):
    """Only n-grams of seeds go through the driver, and those of the labelled texts are kept all the same."""
    documents, labels = tables
    documents = documents.unionByName(docs(spark, [(None, "Nobody lists this.", "a", None), (5, "A second text of one id is kept too.", "a", None)]))
    taken, take = [], un.take_inventory
    monkeypatch.setattr(un, "take_inventory", lambda *args, **more: taken.append((args[1], take(*args, **more))) or taken[-1][1])
    un.fit(documents, labels)
    texts, sample, *_ = un._read(documents, labels)
    seeds = un.weighted([*sample.seeds, *sample.ordinary])
    assert taken[0][0].num_rows == seeds.num_rows
    whole = take(texts, un.weighted([*sample.unwanted, *sample.clean, *sample.seeds, *sample.ordinary]), texts.count())

    def held(own):
        one, two, three = ({k: tuple(c[i] for c in columns) for i, k in enumerate(index.keys.tolist())} for index, columns in ((own.one, (own.cont1, own.n1, own.tot2, own.low2)), (own.two, (own.cont2, own.tot3, own.low3)), (own.three, (own.n,))))
        return one, two, three, own.types, own.low1.tolist()

    assert held(taken[0][1]) == held(whole)
