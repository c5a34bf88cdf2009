import base64
import random

import pytest

from ledgerloom.llm import tokenize as t

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{t.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb"))}
    return t.Automaton(open(f"{t.TOKENIZERS}/byte_bpe_50k.json", "rb").read()), tiktoken.Encoding("own", pat_str=t.SPLIT, mergeable_ranks=ranks, special_tokens={})


def test_equal_to_the_public_encoder_and_round_trip(both):
    mine, theirs = both
    rng = random.Random(1)
    parts = [*"abcdeinorst ", "aa", "  ", "đ", "ế", "\n", "0", "12", "!!", "==", "中", "😀", "​", "ing", "tion", "the", "<|endoftext|>", "\x00"]
    for _ in range(4000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        ids = mine.encode(s)
        assert ids == theirs.encode_ordinary(s)
        assert mine.decode(ids) == s
    for s in ("a" * 3000, "=-" * 500, " " * 5000, "aab" * 400):
        assert mine.encode(s) == theirs.encode_ordinary(s)


def test_awkward_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "  \n", "x"), (3, "  \n", "x"), (None, "hi", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id or 0, list(r.ids)) for r in t.encoded(df, "doc_id", "text").collect())
    assert got == [(0, [5303]), (1, []), (2, []), (3, [220, 220, 198]), (3, [220, 220, 198])] or got[1:3] == [(1, []), (2, [])]
    assert t.encoded(df.where("false"), "doc_id", "text").count() == 0
