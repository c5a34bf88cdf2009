import random
import time

import numpy as np

from ledgerloom.llm import leakage as l


def brute(docs, items, least):
    out = set()
    for i, t in items:
        w = l.words(t)
        runs = {tuple(w[k : k + least]) for k in range(len(w) - least + 1)}
        for d, text in docs:
            x = l.words(text)
            if any(tuple(x[k : k + least]) in runs for k in range(len(x) - least + 1)):
                out.add((d, i))
    return out


def made():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)] + ["Đồng", "số", "ÉTÉ"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40)))) for k in range(25)]
    docs = []
    for k in range(80):
        t = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))
        w = rng.choice(items)[1].split()
        n = rng.randint(8, 16)
        docs.append((k, f"{t}. {', '.join(w[:n]).upper()}\n{t}"))
    return docs + [(100, None), (101, ""), (102, "short")], items


def test_equal_to_brute_force_broadcast_and_shuffled(spark):
    docs, items = made()
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame([*items, (None, "x"), (77, None)], "item_id bigint, text string")
    want = brute(docs, items, 12)
    assert want
    assert {(r.doc_id, r.item_id) for r in l.leaks(d, i).collect()} == want
    assert {(r.doc_id, r.item_id) for r in l.leaks(d, i, broadcast_chars=0).collect()} == want
    assert l.leaks(d.where("false"), i).count() == 0 and l.leaks(d, i.where("false")).count() == 0


def numbers(*texts):
    known = {}
    return [np.array([known.setdefault(w, len(known) + 1) for w in t.split()], dtype=np.uint64) for t in texts]


def slow_tiles(a, b, least):
    """Greedy string tiling by definition: every round marks the longest matches, ties by place."""
    used_a, used_b, out = set(), set(), []
    while True:
        best = {}
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in used_a and j + k not in used_b:
                    k += 1
                if k >= least:
                    best.setdefault(k, []).append((i, j))
        if not best:
            return out
        k = max(best)
        for i, j in best[k]:
            if not used_a & set(range(i, i + k)) and not used_b & set(range(j, j + k)):
                used_a |= set(range(i, i + k))
                used_b |= set(range(j, j + k))
                out.append((i, j, k))


def test_tiles_are_greedy_and_disjoint():
    a, b = numbers("a b c d e f x g h i j", "g h i j y a b c d e f")
    assert l.tiles(a, b, 3) == [(0, 5, 6), (7, 0, 4)]
    assert l.tiles(*numbers("a a a a a a a a a a", "a a a a"), 2) == [(0, 0, 4)]
    assert l.tiles(np.empty(0, np.uint64), b, 3) == []
    rng = random.Random(1)
    for _ in range(300):
        a, b = (np.array([rng.randint(1, 3) for _ in range(rng.randint(0, 25))], dtype=np.uint64) for _ in "ab")
        assert l.tiles(a, b, 3) == slow_tiles(a.tolist(), b.tolist(), 3)


def test_repetitive_texts_take_no_time():
    began = time.time()
    assert l.tiles(np.ones(200_000, np.uint64), np.ones(3000, np.uint64), 12) == [(0, 0, 3000)]
    a = np.array([1, 2] * 20_000, np.uint64)
    assert sum(k for _, _, k in l.tiles(a, np.array([2, 1] * 500 + [3] + [1, 2] * 700, np.uint64), 12)) == 2400
    assert time.time() - began < 10


def test_reordered_passages_reach_the_coverage(spark):
    parts = [" ".join(f"p{k}w{i}" for i in range(8)) for k in range(6)]
    items = spark.createDataFrame([(1, " ".join(parts))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, " x. ".join(reversed(parts))), (2, parts[2] + " y " + parts[0]), (3, " z ".join(parts[:3]))], "doc_id bigint, text string")
    for size in (1000, 0):
        got = {r.doc_id: (r.tiles, r.coverage) for r in l.leaks(docs, items, 6, 0.5, broadcast_chars=size).collect()}
        assert got == {1: (6, 1.0), 3: (3, 0.5)}
    assert l.leaks(docs, items).count() == 0


def test_search_equals_tiling_of_every_pair():
    rng = random.Random(6)
    for size in (3, 12, 200):
        say = lambda n: " ".join(f"w{rng.randrange(size)}" for _ in range(n))  # noqa: E731, B023
        items = [(k, say(rng.randint(0, 30))) for k in range(12)]
        docs = [say(rng.randint(0, 30)) + " " + " ".join(rng.choice(items)[1].split()[rng.randint(0, 9) :]) for _ in range(40)]
        got = l.Items(items, 5).search(docs)
        for d, found in zip(docs, got, strict=True):
            pairs = [(i, l.tiles(*numbers(d, t), 5), len(t.split())) for i, t in items]
            assert found == [p for p in pairs if p[1]]


def test_words():
    assert l.words("Đồng-tiền: e\u0301te\u0301 ÉTÉ x\u0302 \u0301 12a ß") == ["dong", "tien", "ete", "ete", "x", "12a", "ss"]
