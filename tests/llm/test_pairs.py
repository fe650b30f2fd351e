import numpy as np
import pytest

from graphweir.llm import declining as dc
from graphweir.llm import ngrams
from graphweir.llm import pairs as pr

GOLD = ["Old Mill"]
CASES = [
    ("empty", "Where is it?", "", GOLD), ("empty", "Where is it?", None, GOLD), ("empty", "Where is it?", "  ", GOLD), ("empty", "Where is it?", "N/A.", GOLD), ("empty", "Where is it?", "Answer:", None), ("empty", "Where is it?", "**Answer:** -", GOLD), ("empty", None, "[]", None), ("empty", "Where is it?", "<answer></answer>", GOLD),
    ("copies_question", "Where is the old mill?", "Where is the old mill", GOLD), ("copies_question", "Where is the old mill?", "Question: WHERE IS THE OLD MILL?\nAnswer:", GOLD), ("copies_question", "Where is the old mill?", "You asked: where is the old mill?", GOLD),
    (None, "Where is the old mill?", "The old mill is in the valley.", GOLD), (None, "Where is the old mill?", "Where is the old mill? It stands in the valley.", GOLD),
    ("refusal", "Where is it?", "I'm sorry, but I cannot help with that.", GOLD), ("refusal", "Where is it?", "The passages do not say.", GOLD), ("refusal", "Wo ist es?", "Dazu kann ich leider nichts sagen.", GOLD), ("refusal", "Où est-ce ?", "Je ne sais pas.", GOLD), ("refusal", "¿Dónde está?", "No lo sé, lo siento.", GOLD),
    (None, "Where is it?", "I don't know.", None), (None, "Where is it?", "Not stated.", ["not stated"]), (None, "Where is it?", 'The clerk refused: "I cannot help you."', GOLD), (None, "Where is it?", "I cannot be fully certain, but the passages point to the valley.", GOLD), (None, "Where is it?", "Sorry, my first reply was wrong: it is the valley.", GOLD),
    ("truncated", "Where is it?", "Old Mi", GOLD), ("truncated", "Where is it?", "Old", GOLD), (None, "Where is it?", "Old Mill", GOLD), (None, "Where is it?", "old mill.", GOLD), ("truncated", "Who came?", "The clerk came and then the (", None), ("truncated", "Who came?", "The clerk c", None),
]


@pytest.fixture(scope="module")
def models(spark):
    docs = spark.createDataFrame([(k, t, lang, "s") for k, (t, lang) in enumerate([(pr.STARTERS[c], c) for c in pr.LANGUAGES] * 3)], "doc_id BIGINT, text STRING, lang STRING, source STRING")
    told = [("Where is the mill?", f"The {w} is in the valley of Town{k}.", [f"The {w} is in the valley of Town{k}."]) for k, w in enumerate(["mill", "old mill", "court", "brickyard", "clerk"] * 8)]
    told += [("Where is it?", "I cannot be fully certain, but the passages point to the valley.", ["the valley"]), ("Where is it?", "Sorry, my first reply was wrong: it is the valley.", ["the valley"])] * 3
    pairs = spark.createDataFrame(told, "question STRING, answer STRING, gold_answers ARRAY<STRING>")
    decline = dc.fit(pairs, pr.bare, pr.gold_texts)
    return pr.fit_languages(docs, pairs), pr.fit_ends(docs.selectExpr("text", "false whole")), lambda text: float(decline.score([text])[0])


@pytest.mark.parametrize(("want", "question", "answer", "gold"), CASES)
def test_cases(models, want, question, answer, gold):
    assert pr.judge(question, answer, gold, (3, 4000) if answer and answer.endswith(" c") else (9, 9), *models) == want


def test_languages(models):
    german = "Die Arbeiter haben die Stadt zuerst verlassen, und das wussten sie nicht."
    told = (models[0], models[1], lambda text: -1.0)
    assert pr.judge("Which of the workers left the town first?", german, ["they left"], (9, 9), *told) == "other_language"
    assert pr.judge("Which of the workers left the town first?", german, [german], (9, 9), *told) is None
    assert pr.judge("Which of the workers left the town first?", "Gajo Ruban sur Vire", ["Someone"], (9, 9), *told) != "other_language"


def test_declining_learns_without_a_list(spark):
    """Wording that no seed has, but that many answers without a gold answer share with seeds, is learnt."""
    rows = [("q", f"The mill of Town{k} was rebuilt in {1800 + k}.", [f"The mill of Town{k} was rebuilt in {1800 + k}."]) for k in range(200)]
    rows += [("q", f"I cannot answer this question, my lips stay sealed about Town{k}.", ["1836"]) for k in range(20)] + [("q", f"My lips stay sealed about Town{k}.", ["1836"]) for k in range(20)] + [("q", "The passages do not say.", ["not stated"])] * 3
    model = dc.fit(spark.createDataFrame(rows, "question STRING, answer STRING, gold_answers ARRAY<STRING>"), pr.bare, pr.gold_texts)
    over = model.score(["My lips stay sealed about Town7.", "The passages do not say.", "The mill of Town3 was rebuilt in 1803.", 'The clerk said: "I cannot answer this question"', None, ""]) >= dc.THRESHOLD
    assert over.tolist() == [True, True, False, False, False, False]
    assert dc.fit(spark.createDataFrame([], "question STRING, answer STRING, gold_answers ARRAY<STRING>"), pr.bare, pr.gold_texts).score(["I do not know."])[0] > 0


def test_declining_knows_rare_wording(spark, monkeypatch):
    """What is held in one place changes no score: n-grams under the share are known and learnt from all the same."""
    rows = [("q", f"The {w} of Town{k} was rebuilt by clerk{k // 3}.", [f"The {w} of Town{k} was rebuilt by clerk{k // 3}."]) for k in range(60) for w in ("mill", "court")]
    rows += [("q", f"I cannot answer this question, my lips stay sealed about Town{k}.", ["1836"]) for k in range(6)] + [("q", f"My lips stay sealed about Town{k}.", ["1836", '"x"']) for k in range(6)] + [("q", None, None), ("q", "", ["It does not say."])]
    pairs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row BIGINT, question STRING, answer STRING, gold_answers ARRAY<STRING>")
    scores, taken, take = [], [], dc.take_inventory
    monkeypatch.setattr(dc, "take_inventory", lambda *args: taken.append(take(*args)) or taken[-1])
    for share in (1e-4, 0.1):  # all n-grams that occur twice, those that occur 18 times or more
        monkeypatch.setattr(ngrams, "LEAST_SHARE", share)
        scores.append({r.row: (r.score, r.gold) for r in dc.pair_scores(pairs, pr.bare, pr.gold_texts).collect()})
    assert taken[0].rest is None and taken[1].rest.count() > 0
    assert scores[0].keys() == scores[1].keys() == set(range(132))
    assert np.allclose([scores[0][k][0] for k in range(132)], [scores[1][k][0] for k in range(132)], atol=1e-4)
    assert all(scores[1][k][0] >= dc.THRESHOLD and scores[1][k][1] <= 0 for k in range(120, 132)) and all(scores[1][k] == (scores[1][k][0], None) for k in range(120))


def test_last_words(spark):
    texts = spark.createDataFrame([("The miller milled at the mill. Mill!",), (None,), ("",)], "text STRING")
    got = {r["last"]: (r.whole, r.longer) for r in pr.last_words(texts, spark.createDataFrame([("mill",), ("mi",), ("x",), ("the",)], "last STRING")).collect()}
    assert got == {"mill": (2, 2), "mi": (0, 4), "the": (2, 0)}
    assert pr.cut_inside("mi", (0, 4), []) and not pr.cut_inside("mill", (2, 2), []) and not pr.cut_inside("mi", (0, 4), ["mi"])


def test_ends_of_text(spark):
    texts = spark.createDataFrame([(f"The mill of Town{k} was rebuilt in 18{k:02d}. The clerks left Town{k} when the mill closed.",) for k in range(60)], "text STRING").selectExpr("text", "false whole")
    ends = pr.fit_ends(texts)
    assert not ends.breaks_off("The mill of Oldtown was rebuilt in 1901") and ends.breaks_off("The mill of Oldtown was rebuilt in") and ends.breaks_off("The clerks left Oldtown when the")


def test_counts_of_ends_are_exact(spark):
    """More n-grams than hashed cells would keep apart: what no text holds was never seen, and the join finds the same."""
    texts = spark.range(40_000).selectExpr("concat_ws(' ', 'a', hex(xxhash64(id)), hex(xxhash64(id, 1)), hex(xxhash64(id, 2)), hex(xxhash64(id, 3)), hex(xxhash64(id, 4))) || '.' AS text", "false whole").selectExpr("lower(translate(text, '0123456789', 'ghijklmnop')) AS text", "whole")
    held = [r.text for r in texts.limit(20).collect()]
    sentences = [f"some words {k} that no text has{k}x at all{k}x" for k in range(300)] + held
    asked = spark.createDataFrame([(pr.end_keys(s),) for s in sentences], "keys ARRAY<BIGINT>")
    found = {tuple(r["keys"]): {c.key: (c.seen, c.ended) for c in r.counts} for r in pr.ends_of(asked, texts).collect()}
    after = [pr.Ends(found.get(tuple(pr.end_keys(s)), {})).after(s) for s in sentences]
    assert all(x == (0, 0) for a in after[:300] for x in a) and all(a == [(1, 1)] * 5 for a in after[300:])


def test_table(spark):
    schema = "query_id BIGINT, question STRING, answer STRING, gold_answers ARRAY<STRING>, defect STRING"
    rows = [(k, q, a, g, "clash") for k, (_, q, a, g) in enumerate(CASES)]
    rows += rows[:3] + [(900, "Where?", "x " * 200_000 + "end.", ["x"], None), (901, None, None, None, None)]
    docs = spark.createDataFrame([(1, "The old mill stands in the valley. The clerk came.", "en", "s"), (2, None, None, None)], "doc_id BIGINT, text STRING, lang STRING, source STRING")
    got = [(r.query_id, r.defect) for r in pr.defects(spark.createDataFrame(rows, schema), docs).collect()]
    assert len(got) == len(set(got)) and {k for k, d in got if d == "empty"} >= {k for k, c in enumerate(CASES) if c[0] == "empty"} | {901}
    empty = spark.createDataFrame([], schema)
    assert pr.defects(empty, docs.limit(0)).count() == 0


def test_ends_are_read_once():
    """Known keys take the place of the sentence; without them it is read."""
    sentence = "The clerks left Oldtown when the"
    keys = pr.end_keys(sentence)
    counts = {key: (k + 2, k) for k, key in enumerate(keys)}
    assert pr.Ends(counts, keys).after("") == pr.Ends(counts).after(sentence) == list(counts.values())


def test_last_words_of_runs(spark):
    """Words are cut at all signs but apostrophes, whatever blanks, line ends and capitals stand around them."""
    texts = spark.createDataFrame([("Mill, mill\nMILLER  'mill' l'eau",), ("millstone\tmill-race mill",), ("",), (None,)], "text STRING")
    asked = spark.createDataFrame([("mill",), ("eau",)], "last STRING")
    assert {r["last"]: (r.whole, r.longer) for r in pr.last_words(texts, asked).collect()} == {"mill": (5, 2)}


ODD = ["Dr. Mill, of St. Gall.  He said:\n\n\"I can't… stop!\"\tNo. 7 of 1,900", "l'eau d’Évian.\n \nA-B.C (x) [y] 3.14 Straße ΣΑΣ", " ", "", "a." * 30 + " end.", "\u00a0The\u00a0mill. Stratford upon Avon fell", "One “quoted by the clerk” word, «deux mots» and more.", "...", "Who left?\r\nThey did"]


def test_runs_between_blanks_are_cut_once(monkeypatch):
    """The patterns see each run between blanks once, and what they find is as in whole texts."""
    piece, seen = pr._PIECE, []
    monkeypatch.setattr(pr, "_PIECE", type("", (), {"findall": staticmethod(lambda text: seen.append(text) or piece.findall(text))}))
    pieces = pr.Pieces()
    pieces.read(["The mill of Oldtown was rebuilt. " * 50, "The mill of Oldtown was closed."])
    assert sum(map(len, seen)) <= len("The mill of Oldtown was rebuilt. closed.")
    for text in ODD:
        assert [p for run in text.split(" ") for p in piece.findall(run)] == piece.findall(text)
        letters = " ".join(w for w in pr.words(text) if not w[0].isdigit())
        assert " ".join(filter(None, pr._LETTERS.of(text))) == letters
        assert dc.spoken_ids().text(text).tolist() == ngrams.WordIds(dc.spoken).text(text).tolist()
    long = "x" * 100
    runs = ngrams.Runs(len, most=3)
    assert [*runs.of(f"a bb {long}  cc dd ee")] == [1, 2, 100, 0, 2, 2, 2] and len(runs) <= 3 and long not in runs


def test_keys_of_many_ends():
    """Ends of many texts are those of each, as are n-grams sought by their ends."""
    pieces = pr.Pieces()
    assert pr.end_keys_of(ODD, pieces) == [pr.end_keys(t) for t in ODD] and pr.end_keys_of([], pieces) == []
    assert pr.end_keys("") == pr.end_keys("...") == [] and len(pr.end_keys("One two")) == 3 and len(pr.end_keys("so we came to see the old mill")) == pr.ORDERS
    codes, starts = pieces.read(ODD)
    every = {(order, *pair) for order, (where, key) in enumerate(pr.keys(codes, starts)) for pair in zip(where.tolist(), key.tolist(), strict=True)}
    wanted = np.zeros(pr.PLACES, bool)
    wanted[[k & (pr.PLACES - 1) for t in ODD for k in pr.end_keys(t)]] = True
    some = {(order, *pair) for order, (where, key) in enumerate(pr.keys(codes, starts, wanted)) for pair in zip(where.tolist(), key.tolist(), strict=True)}
    asked = {k for t in ODD for k in pr.end_keys(t)}
    assert some <= every and {x for x in every if x[2] in asked} <= some and len(some) < len(every)


@pytest.mark.parametrize(("want", "question", "answer"), [(True, "Where is the old mill?", "The question is: where is the old mill"), (True, "Where is the old mill?", "where is old mill"), (False, "Where is the old mill?", "where is the old mill now"), (False, None, "where"), (False, "Where?", "")])
def test_copies(want, question, answer):
    assert pr.copies(question, answer) == want
