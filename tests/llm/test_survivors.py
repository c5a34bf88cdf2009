import datetime as dt
import itertools
import random

import pytest

from ledgerloom.llm import survivors as s

FACTS = "seq bigint, id string, prov_id string, doc_id string, concept string, standard_code string, raw_label string, value double, unit string, period string, period_type string, page int, table_id string, source string, confidence double, verification_status string, verification_detail string, created_at timestamp, rows int"
NAMES = [x.split()[0] for x in FACTS.split(", ")]
CODES = {"A": "01", "B": "02"}


def made(n=300, seed=2, docs=("d1", "d2", None)):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [
        (k, "i", pick("p", None), pick(*docs), pick("A", "B", "X", None), pick("01", "02", None), pick("l", "m", None), pick(1.0, 2.0, None), pick("VND", "USD", None), pick("2020", "2021"), pick("current", "previous"), pick(1, 2, None), pick("t1", "t2", "t3", None), pick("ocr", "local_ocr", "pdfplumber", "other", None), pick(0.5, 0.9, None), pick("V", None), pick("x", None), pick(dt.datetime(2023, 1, 1), dt.datetime(2023, 1, 2), None), 7)
        for k in range(n)
    ]


def groups_of(rows):
    out = {}
    for r in rows:
        f = dict(zip(NAMES, r, strict=True))
        if f["concept"] in CODES and f["doc_id"]:
            out.setdefault(tuple(f[c] for c in s.GROUP), []).append(f)
    return {k: g for k, g in out.items() if len(g) > 1}


def order(f):
    full = sum(f[c] is not None for c in s.COMPLETE)
    rank = {"pdfplumber": 3, "local_ocr": 2, "ocr": 1}.get(f["source"], 0)
    right = f["standard_code"] == CODES[f["concept"]]
    trust = ((right * 9 + full) * 1_000_001 + round((f["confidence"] or 0) * 1e6)) * 4 + rank
    tail = (f["created_at"] or dt.datetime.min, -f["seq"])
    return (right, full, f["confidence"] if f["confidence"] is not None else -1, rank, *tail), trust, tail


def exhaustive(group):
    """The survivor of a group, by all pairs of value and place."""
    worth = lambda f, b: (sum(f[c] is not None for c in s.BUNDLES[b]), order(f)[1], *order(f)[2])
    best = lambda b: max(group, key=lambda f: worth(f, b))
    together = {(f["table_id"], f["unit"], f["page"]) for f in group}
    pairs = [(m, p) for m, p in itertools.product(group, group) if p["table_id"] is None or (p["table_id"], m["unit"], p["page"]) in together]

    def total(x):
        m, p = worth(x[0], "measure"), worth(x[1], "place")
        return (m[0] + p[0], m[1] + p[1], p[2:], m[2:])

    m, p = max(pairs, key=total)
    source = {"measure": m, "place": p, "evidence": best("evidence"), "label": best("label"), "code": best("code")}
    return {"seq": max(group, key=lambda f: order(f)[0])["seq"], "rows": len(group)} | {c: source[b][c] for b, fields in s.BUNDLES.items() for c in fields}


CONCEPTS = [("A", "01"), ("B", "02"), (None, "03")]


@pytest.mark.parametrize("size,docs", [(300, ("d1", "d2", None)), (40, ("d1", "d2")), (3000, ("d1",))])
def test_against_exhaustive_search(spark, size, docs):
    rows = made(size, seed=size, docs=docs)
    got = s.surviving(spark.createDataFrame(rows, FACTS), spark.createDataFrame(CONCEPTS, "concept string, code string")).collect()
    want = {k: exhaustive(g) for k, g in groups_of(rows).items()}
    assert len(got) == len(want)
    for r in got:
        x = r.asDict()
        assert {c: x[c] for c in want[tuple(x[g] for g in s.GROUP)]} == want[tuple(x[g] for g in s.GROUP)]


def _row(at, value, unit, page, where, trust, seq):
    f = dict.fromkeys(s.FIELDS) | {"value": value, "unit": unit, "page": page, "table_id": where, "prov_id": "p"}
    return s.Row(at, tuple(f[c] for c in s.FIELDS), 0, trust, 0, 0, seq, 1)


def test_branches_are_cut_and_the_dependency_holds():
    rows = [_row(0, 1.0, "VND", 1, "t1", 50, 1), _row(1, 2.0, "USD", 2, "t2", 90, 2), *(_row(k, None, None, k, f"t{k}", 1, k) for k in range(3, 40))]
    g = s.Group(rows)
    measure, place, opened, cut = g.search()
    assert (measure.at, place.at) == (1, 1)
    assert opened < 4 and opened + cut == len(g.places) and cut > 30
    # The best value and the best place do not go together: their table never had that unit.
    rows = [_row(0, 1.0, "VND", None, "t1", 90, 1), _row(1, None, "USD", 2, "t2", 50, 2), _row(2, 3.0, "USD", 2, "t2", 10, 3)]
    measure, place, _, _ = s.Group(rows).search()
    assert (measure.at, place.at) == (2, 1)


def test_reduction_keeps_the_result():
    for seed in range(30):
        rng = random.Random(seed)
        pick = lambda *x: rng.choice(x)  # noqa: E731, B023
        rows = [_row(k, pick(1.0, 2.0, None), pick("VND", "USD", None), pick(1, 2, None), pick("t1", "t2", None), pick(1, 2, 3), k) for k in range(60)]
        whole = s.Group(rows)
        stay = set(whole.reduced())
        part = s.Group(r for r in rows if r.at in stay)
        assert len(stay) < 40 and whole.record()[2:] == part.record()[2:] and whole.record()[0] == part.record()[0]


def test_empty_single_and_copies(spark):
    concepts = spark.createDataFrame(CONCEPTS, "concept string, code string")
    assert s.surviving(spark.createDataFrame([], FACTS), concepts).count() == 0
    one = [r for r in made(40) if r[4] == "A" and r[3]][:1]
    assert s.surviving(spark.createDataFrame(one, FACTS), concepts).count() == 0
    copies = spark.createDataFrame(one * 25_000, FACTS)  # a hot group, over many batches
    assert [(r.seq, r.rows) for r in s.surviving(copies, concepts).collect()] == [(one[0][0], 25_000)]
