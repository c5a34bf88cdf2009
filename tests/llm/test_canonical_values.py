import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from ledgerloom.llm import canonical_values as c
from ledgerloom.llm.editmetric import Tree, distance

NAMES = [("CASH", "Tiền mặt tại quỹ"), ("CASH", "Cash on hand"), ("LOAN", "Vay ngân hàng ngắn hạn"), ("LOAN_LONG", "Vay ngân hàng dài hạn"), ("GROSS", "Lãi gộp"), ("NET", "Lãi ròng"), ("TWIN", "Alpha beta one"), ("TWIN2", "Alpha beta two")]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@given(st.text("abcd", max_size=90), st.text("abcd", max_size=20))
def test_distance(a, b):
    assert distance(a, b) == plain_distance(a, b)


def test_tree_returns_every_word_within_the_limit():
    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    queries = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(60)] + ["a" * 70]
    limits = np.array([rng.randint(0, 3) for _ in queries])
    got = Tree(words).within(queries, limits)
    for q, lim, found in zip(queries, limits, got, strict=True):
        assert sorted(found) == sorted((plain_distance(q, w), w) for w in set(words) if plain_distance(q, w) <= lim)


def test_labels():
    r = [c.Reference(NAMES)]
    cases = {
        "II. TIỀN MẶT TẠI QUỸ (thuyết minh 12)": "CASH", "Tien_mat_tai_quy": "CASH", "Tieenf maawtj taij quyx - đơn vị triệu đồng": "CASH", "Cash on hnad [tr.đ]": "CASH",
        "Vay nhang NH": "LOAN", "Vay ngân hàng dài hạn ..... 5": "LOAN_LONG", "B. Vay n9ân lià-\nng ngắn hạn": "LOAN", "Lãi rng": "NET", "Mẫu B3-XX001 kỳ 2017\nLãi gộp": "GROSS",
        "Số nhân viên": "UNMATCHED", "": "UNMATCHED", "()": "UNMATCHED", "Alpha beta onne": "TWIN", "Alpha beta": "UNMATCHED", "x" * 5000: "UNMATCHED",
    }
    assert dict(zip(cases, c.resolved(list(cases), r), strict=True)) == cases


def test_shards_agree_and_awkward_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Lai gop", None), (3, "Lai gop", None)], "seq int, raw_label string, concept string")
    names = spark.createDataFrame([*NAMES, (None, "x")], "entry string, name string")
    for shard, block in ((100, 100), (3, 100), (2, 1)):
        got = sorted((r.seq, r.concept) for r in c.mapped_to(df, "raw_label", names, shard=shard, block=block).collect())
        assert got == [(1, "UNMATCHED"), (2, "UNMATCHED"), (3, "GROSS"), (3, "GROSS")]
    assert c.mapped_to(df.where("false"), "raw_label", names).count() == 0


def test_names_that_differ_in_accents(spark):
    """Two entries of one skeleton: the one written as the label wins, in one shard or in many; an equal pair is a tie."""
    names = [("SELL", "chi phí bán hàng"), ("SELL_PLAIN", "chi phi ban hang"), ("ONE", "lãi gộp"), ("TWO", "lãi gộp")]
    want = {"chi phí bán hàng": "SELL", "chi phi ban hang": "SELL_PLAIN", "Chi phí bán hnàg": "SELL", "lãi gộp": "UNMATCHED", "khác": "UNMATCHED"}
    assert dict(zip(want, c.resolved(list(want), [c.Reference(names)]), strict=True)) == want
    assert dict(zip(want, c.resolved(list(want), [c.Reference([n]) for n in names]), strict=True)) == want
    df = spark.createDataFrame([(x,) for x in want], "label string")
    for shard in (10, 1):
        got = c.mapped_to(df, "label", spark.createDataFrame(names, "entry string, name string"), shard=shard, block=2)
        assert {r.label: r.concept for r in got.collect()} == want


def test_shards_agree_on_damaged_names():
    rng = random.Random(8)
    names = [(f"E{k}", " ".join(rng.choice(["chi", "phí", "bán", "hàng", "tiền", "vay", "ngân", "lãi", "ròng", "gộp"]) for _ in range(rng.randint(1, 4)))) for k in range(60)]
    labels = []
    for _ in range(300):
        w = list(rng.choice(names)[1])
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [w[k], "x"], ["r", "n"], ["l"]])
            w = w or ["x"]
        labels.append("".join(w))
    whole = c.resolved(labels, [c.Reference(names)])
    for n in (2, 7, 60):
        assert c.resolved(labels, [c.Reference(names[k::n]) for k in range(n)]) == whole
