import random
import time

import pytest

from ledgerloom.llm import boosting, markup as m


@pytest.fixture(scope="module")
def reader():
    return m.Reader(m.trained())


def families(reader, text):
    (nodes,) = reader.read([text])
    return {m.FAMILY_NAMES[m._KINDS[n.kind][1]] for n in nodes if n.kept}, m.cleaned(text, nodes)


@pytest.mark.parametrize(
    ("text", "want", "clean"),
    [
        ("<h3>Net sales</h3>\n<p>They rose by 5%.</p>", {"html"}, "Net sales\n\nThey rose by 5%."),
        ("a &lt;b&gt;x&lt;/b&gt; &amp;amp; y", {"html"}, "a <b>x</b> & y"),
        ("<PRE><code>SUM(a, b) * 3 * c</code></PRE>", {"html"}, "SUM(a, b) * 3 * c"),
        ("Text before the heading.\n\n## Deferred tax\n\n* **One**\n* __two__", {"markdown"}, "Text before the heading.\n\nDeferred tax\n\n- One\n- two"),
        ("| a | b |\n|---|---:|\n| c | 5 |", {"markdown"}, "a | b\n c | 5"),
        ("'''Cash''' was [[net sales|sales]] here", {"wiki"}, "Cash was sales here"),
        ("\\section{Cash}\nIt rose by 5\\% in the year.", {"latex"}, "Cash\n\nIt rose by 5% in the year."),
        ("See $r = \\frac{a_{3}}{b}$ for it.", {"latex"}, "See r = \\frac{a_{3}}{b} for it."),
        ("The factor 2 * 3 = 6 holds for Q4/2022.", set(), None),
        ("See voucher #418 and account TK_331 (*).", set(), None),
        ("The P&L target needs a margin < 12% and > 3%.", set(), None),
        ("A price of $5 per unit is only indicative [3].", set(), None),
        ("so it went on\n- 7 -\nfor another year", set(), None),
    ],
)
def test_cases(reader, text, want, clean):
    got, out = families(reader, text)
    assert got == want
    squeeze = lambda x: " ".join(x.split())
    assert squeeze(out) == squeeze(clean if clean is not None else text)


def test_held_out_accuracy(reader):
    
    rng = random.Random(99)
    right = total = 0
    for _ in range(300):
        make = rng.choice([m._marked, m._plain])
        text = m._words(rng, 5, 15) + ".\n" + make(rng)
        (nodes,) = reader.read([text])
        right += any(n.kept for n in nodes) == (make is m._marked)
        total += 1
    assert right / total > 0.93


def test_awkward_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "<b>x</b> tail", 1), (3, "<b>x</b> tail", 1), (4, "[" * 3000 + "<i>" * 3000, 1), (5, "[code] | a > b | t | Mô tả: **bold words** here", 1)], "k int, text string, clean int")
    got = {r.k: (r.clean, list(r.families)) for r in m.without_markup(df, "text", payload=True).collect()}
    assert got[1] == (None, []) and got[2] == ("", []) and got[3] == ("x tail", ["html"]) and got[5] == ("[code] | a > b | t | Mô tả: bold words here", ["markdown"])
    assert m.without_markup(df.where("false"), "text").count() == 0


def test_boosting_learns():
    import numpy as np

    x = np.random.default_rng(0).normal(size=(500, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    assert ((boosting.fit(x, y).score(x) > 0) == y).mean() > 0.95


def test_features_cover_the_whole_subtree():
    inner = "word " * 100 + "1234567890" * 60 + " x = {2}|"
    text = f"<p title=\"{'a' * 420}=|\">{inner}</p>"
    nodes = m.nodes_of(text)
    x = m.features_of(text, nodes)[0]
    letters, digits, size = 401, 601, len(inner)
    assert x[4] == size and x[5] == letters / (size + 1) and x[6] == digits / (size + 1)
    assert x[14] == letters / nodes[0].inner and (x[15], x[19], x[21]) == (2, 1, nodes[0].inner) and x[17] == 1


def test_pairs_are_those_of_the_patterns_and_take_no_time():
    rng = random.Random(3)
    parts = ["<!--", "-->", "```\n", "```", "~~~ x\n", "\n", "{| a\n", "{|", "|}", "\n|}\n", "text ", "  ", "`"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        for name, _, pattern in m.KINDS:
            if name in m.PAIRED:
                want = [(x.start(), x.end(), x.end("o"), x.start("c") if "c" in pattern.groupindex else x.end()) for x in pattern.finditer(text)]
                assert m.paired(name, text) == want, (name, text)
    began = time.time()
    for text in ("<!-- a " * 40_000, "```x\nb\n" * 40_000, "{| a\nb\n" * 40_000, "-->" * 40_000):
        for name in m.PAIRED:
            m.paired(name, text)
    assert time.time() - began < 5
