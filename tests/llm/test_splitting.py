import re

from hypothesis import given, settings
from hypothesis import strategies as st

from graphweir.llm import splitting as sp

WORD = st.sampled_from(["alpha", "beta,", "gamma.", "Dr.", "é", "x;", "long-word", "end!", "#", "(a)", " "])
GAP = st.sampled_from([" ", "  ", "\n", "\n\n", "\r\n\r\n", "\t", "\n## "])
TOKEN = re.compile(r"[^ \t\n\r]+")


@settings(max_examples=120, deadline=None)
@given(st.lists(st.tuples(WORD, GAP), max_size=120), st.integers(2, 30), st.data())
def test_pieces_cover_the_text(parts, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    text = "".join(w + g for w, g in parts)
    tokens = TOKEN.findall(text)
    pieces = sp.split_text(text, limit, overlap)
    fresh = []
    for n, (b, e, size, shared) in enumerate(pieces):
        own = TOKEN.findall(text[b:e])
        assert len(own) == size <= limit and shared <= overlap and (n > 0 or shared == 0)
        if n:
            assert own[:shared] == fresh[len(fresh) - shared :] and shared == min(overlap, len(fresh))
        fresh += own[shared:]
    assert fresh == tokens


@settings(max_examples=60, deadline=None)
@given(st.text("ab \n.", max_size=200), st.integers(3, 20), st.integers(0, 2))
def test_characters(text, limit, overlap):
    pieces = sp.split_text(text, limit, overlap, measure="chars")
    assert all(e - b <= limit for b, e, _, _ in pieces)
    covered = {k for b, e, _, _ in pieces for k in range(b, e)}
    assert all(k in covered for k, c in enumerate(text) if c not in " \n\t\r")


def test_natural_ends():
    text = "\n\n".join("One two three four five. Six seven eight nine ten." for _ in range(20))
    for b, e, _, _ in sp.split_text(text, 27, 2):
        assert text[b:e].endswith(".")
    sentence = "Dr. Who said no. " * 30
    assert all(sentence[b:e].endswith("no.") for b, e, _, _ in sp.split_text(sentence, 11, 1))


def test_table(spark):
    long = " ".join(f"w{k}" for k in range(501))
    rows = [("a", long, 1), ("a", long, 1), ("b", " ".join(["w"] * 500), 2), ("c", None, 3), ("d", "", None), ("e", "x" * 5000, 5), ("f", " ".join(["w"] * 900), 6), ("g", "y " * 100_000, 7)]
    df = spark.createDataFrame(rows, "chunk_id STRING, content STRING, piece INT")
    pieces = sp.split_oversized(df, "chunk_id", "content")
    assert sorted(r.chunk_id for r in sp.oversized_keys(pieces, "chunk_id").collect()) == ["a", "g"]
    assert [(r.num_tokens, r.shared_tokens) for r in pieces.where("chunk_id = 'a'").orderBy("piece").collect()] == [(450, 0), (101, 50)]
    assert sp.split_oversized(df.limit(0), "chunk_id", "content").count() == 0
