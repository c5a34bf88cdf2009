import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import visual_form as v

LOOK = {x: y for a, b in v.LOOKALIKES.items() for x, y in zip(a, b, strict=True)}


def slow(s):
    """Character by character, with the standard library's normal forms."""
    out = []
    for k, c in enumerate(s):
        before, after = s[k - 1] if k else "", s[k + 1] if k + 1 < len(s) else ""
        if c == "\xad" and after in ("", "\n", "\r"):
            out.append(c)
        elif ord(c) in v.INVISIBLE:
            continue
        elif ord(c) in v.SPACES:
            out.append(" ")
        elif c in "ορνι" and not (before and unicodedata.category(before)[0] in "LM" and ord(before) < 0x3000) and not (after and unicodedata.category(after)[0] in "LM" and ord(after) < 0x3000):
            out.append(c)
        else:
            out.append(LOOK.get(c) or (c if c in v.KEPT or unicodedata.combining(c) else unicodedata.normalize("NFKC", c)))
    return unicodedata.normalize("NFC", "".join(out))


def test_cases():
    given_ = ["ﬁne", None, "", "ậ", "\xe2̣", "рһí", "hệ số ρ – Δ, β", "x\xad\ny", "x\xady", "Ⅳ．", "ＡＢ", "​kho hàng", "€ “x” ¬", "ÐỔI", "abc"]
    out, changed = v.one_form(pa.array(given_))
    assert out.to_pylist() == ["fine", None, "", "ậ", "ậ", "phí", "hệ số ρ – Δ, β", "x\xad\ny", "xy", "IV.", "AB", "kho hàng", "€ “x” ¬", "ĐỔI", "abc"]
    assert changed.tolist() == [a != b for a, b in zip(given_, out.to_pylist(), strict=True)]


LETTERS = "ếậ̴̧̕ᄀ가ᅡᆨ각ୋaeiouydnhstAĐđƠơưâêăợậế ̛̣̀́̂̃̆̉\xa0​\xadсорһіΑΝορβΔｆＡ𝐚ﬁⅣ\n–“€¬"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=LETTERS, max_size=12)), max_size=8))
def test_equal_to_brute_force(texts):
    out, changed = v.one_form(pa.array(texts, type=pa.string()))
    for a, b, c in zip(texts, out.to_pylist(), changed, strict=True):
        assert (b is None) == (a is None)
        if a is not None:
            assert b == slow(a)
            assert c == (a != b)


def test_awkward_rows(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("b", ""), ("c", "ｘ")], "changed string, text string")
    out = v.consistent(df, "text")
    assert sorted((r.text or "", r.clean or "", r.changed) for r in out.collect()) == [("", "", False)] * 3 + [("ｘ", "x", True)]
    assert v.consistent(df.where("false"), "text").count() == 0


def test_any_number_of_marks():
    """Seventy acutes and a dot below, overlay marks between a letter and its acute, a hundred thousand marks, in one batch with other rows."""
    texts = ["a" + "\u0301" * 70 + "\u0323", "e\u0334\u0335\u0336\u0301", "x" + "\u0301\u0323" * 50_000, "\u0301\u0323a", "ế\u0323", "plain é"]
    out, changed = v.one_form(pa.array(texts))
    assert out.to_pylist() == [unicodedata.normalize("NFC", x) for x in texts]
    assert changed.tolist() == [True, True, True, True, True, False]
