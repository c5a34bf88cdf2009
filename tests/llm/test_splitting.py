from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import splitting as s


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.! \n#|,ế́", max_size=400), st.integers(20, 80), st.integers(0, 15))
def test_pieces_cover_the_text(text, limit, overlap):
    cuts = s.cuts(text, limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for a, b in cuts:
        assert b - a <= limit
    for (_, end), (begin, _) in zip(cuts, cuts[1:], strict=False):
        assert end - begin == overlap
    joined = text[: cuts[0][1]] + "".join(text[p[1] : q[1]] for p, q in zip(cuts, cuts[1:], strict=False))
    assert joined == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab.! \n#|,ế́", min_size=30, max_size=400), st.integers(20, 30), st.integers(10, 19))
def test_overlaps_over_half_the_limit_are_whole(text, limit, overlap):
    cuts = s.cuts(text, limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(b - a <= limit for a, b in cuts)
    assert all(end - begin == overlap for (_, end), (begin, _) in zip(cuts, cuts[1:], strict=False))


def test_natural_boundaries_win():
    text = "\n\n".join(f"# Part {k}\n" + "One sentence here. " * 20 for k in range(10))
    for begin, end in s.cuts(text, 2000, 200)[:-1]:
        assert text[end:].startswith("#")


def test_awkward_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "x" * 2000, 1), (4, "y" * 2001, 1), (4, "y" * 2001, 1), (5, "z " * 200_000, 1)], "k int, text string, cuts int")
    got = {r.k: r.n for r in s.split(df, "text", 2000).selectExpr("k", "size(cuts) n").collect()}
    assert got[2] == got[3] == 1 and got[4] == 2 and got[5] > 200 and got[1] in (None, -1)
    p = s.pieces(df.where("k = 4"), "text", 2000).collect()
    assert len(p) == 4 and all(r.content == "y" * (r.end - r.begin) for r in p)
    assert s.pieces(df.where("false"), "text", 2000).count() == 0
