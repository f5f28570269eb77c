from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm.splitting import split, split_text


def check(text, limit, overlap):
    pieces = split_text(text, limit, overlap)
    assert "".join(p.encode("utf-8", "surrogatepass")[o:].decode("utf-8", "surrogatepass") for p, o in pieces) == text
    assert all(len(p.encode("utf-8", "surrogatepass")) <= limit for p, _ in pieces)
    for (a, _), (b, o) in zip(pieces, pieces[1:]):
        assert 0 <= o <= overlap and a.encode("utf-8", "surrogatepass").endswith(b.encode("utf-8", "surrogatepass")[:o])
    assert pieces[0][1] == 0
    return pieces


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .\n#é漢e\u0301😀\r"), max_size=400), st.integers(20, 80), st.integers(0, 12))
def test_round_trip(text, limit, overlap):
    check(text, limit, overlap)


def test_boundaries():
    text = "# One\n\n" + "Short sentence here. " * 60 + "\n\n# Two\n\n" + "Another one there. " * 60
    pieces = check(text, 1400, 100)
    assert any(p.encode()[o:].decode().startswith("# Two") or "\n# Two" in p for p, o in pieces)
    assert all(p.rstrip().endswith(".") for p, _ in pieces)
    assert len(check("x" * 50_000, 3000, 200)) >= 17
    assert check("漢" * 4000, 3000, 200)
    assert split_text("", 3000, 200) == [("", 0)] and split_text("a" * 3000, 3000, 200) == [("a" * 3000, 0)]


def test_table(spark):
    df = spark.createDataFrame([("a", "w " * 3000, 1, "z"), ("a", "w " * 3000, 1, "z"), ("b", None, 2, "z"), (None, "x", 3, "z"), ("c", "", 4, None), ("d", "short", 5, None), ("d", "other", 5, None)], "k string, t string, piece int, rank string")
    rows = split(df, "k", "t").orderBy("item_key", "piece_no").collect()
    assert [(r.item_key, r.n_pieces) for r in rows if r.piece_no == 0] == [("a", 3), ("c", 1), ("d", 1)]
    assert sum(r.item_key == "a" for r in rows) == 3 and rows[0].start_byte == 0 and rows[2].end_byte == 6000
    assert split(df.limit(0), "k", "t").count() == 0
