"""Problem 8: texts to token ids of a byte-level BPE vocabulary, by a tokenization automaton.

The automaton reads the bytes of a pre-split word. Its states are tokens: state t means that the
prefix read so far ends in token t. Arcs carry tokens, and an arc from t to u exists unless a merge
takes u's first part away from it: the gadget of merge (x, y) cuts the arc between a token exposing x
on its right spine and one exposing y on its left spine, unless an earlier merge has bound one of the
two. Adding the gadgets of all merges in order leaves exactly one accepted path per word, and its arc
labels are the BPE tokens. The states and their spines are written out; the arcs are not, as nearly every
pair of tokens has one (figures in the README). The gadgets that concern one arc lie on the two spines,
so an arc is compiled when a word first asks for it, and kept in the table of transitions. Distinct words
are compiled once into their path; texts are then a gather from the table of paths, a batch at a time.
Decoding joins the bytes of the arc labels.

Null and empty texts give an empty list; blank texts are encoded as they are. The vocabulary file is
read on the driver (1.5 MB, fixed) and broadcast, so executors need no copy of it.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.arrow import lists, mapped
from ledgerloom.tables import table

# Fixed value: the public pattern that splits text before the merges of this vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = "/opt/tokenizers"
#: Words kept compiled per Python worker, at most; beyond it the table is emptied and fills again.
WORDS_KEPT = 300_000
#: Later than every merge.
NEVER = 1 << 60


def printable_bytes() -> dict[str, int]:
    """The public byte-to-character scheme of byte-level vocabularies, by rule: printable bytes stand for themselves, others follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    def __init__(self, vocabulary: bytes) -> None:
        model = json.loads(vocabulary)["model"]
        to_byte = printable_bytes()
        ids: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.bytes_of: dict[int, bytes] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.order: dict[int, int] = {}
        self.byte_id = [0] * 256
        for ch, b in to_byte.items():
            self.byte_id[b] = ids[ch]
            self.bytes_of[ids[ch]] = bytes([b])
            self.order[ids[ch]] = -1
        for k, (a, b) in enumerate(merges):
            x, y, z = ids[a], ids[b], ids[a + b]
            self.rank[x, y] = k
            if z not in self.parts:
                self.parts[z], self.order[z] = (x, y), k
                self.bytes_of[z] = self.bytes_of[x] + self.bytes_of[y]
        self.id_of = {v: k for k, v in self.bytes_of.items()}
        self.longest = max(map(len, self.id_of))
        # Spines, innermost part first, with the merge that binds each part into the next.
        self.right = [self._spine(t, 1) for t in range(len(ids))]
        self.left = [self._spine(t, 0) for t in range(len(ids))]
        self.arcs: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(SPLIT)
        self.table = Paths(self)

    def _spine(self, t: int, side: int) -> list[tuple[int, int]]:
        out, bound = [], NEVER
        while True:
            out.append((t, bound))
            if t not in self.parts:
                return out[::-1]
            bound, t = self.order[t], self.parts[t][side]

    def arc(self, t: int, u: int) -> bool:
        """Whether the arc labelled u leaves state t once the gadgets of all merges are in."""
        known = self.arcs.get((t, u))
        if known is None:
            known = self.arcs[t, u] = self._gadgets(t, u)
        return known

    def _gadgets(self, t: int, u: int) -> bool:
        return self._cut(t, u) is None

    def _cut(self, t: int, u: int) -> tuple[int, bool] | None:
        """The rank of the first merge whose gadget cuts the arc from t to u, and whether it binds the two whole; None if none does.

        At step k of the merge order, the exposed part of each side is the largest one that is built by
        then. Of merges that want the same part, the one of the lower rank comes first; on a tie the
        occurrence further left wins: within t before the border, the border before within u.
        """
        right, left = self.right[t], self.left[u]
        i = j = 0
        while True:
            (x, next_right), (y, next_left) = right[i], left[j]
            k = self.rank.get((x, y))
            if k is not None and k < next_right and k <= next_left:
                return k, i == len(right) - 1 and j == len(left) - 1
            if next_right == next_left == NEVER:
                return None
            if next_right <= next_left:
                i += 1
            else:
                j += 1

    def path(self, word: str) -> list[int]:
        """The arc labels of the one accepted path of a word."""
        raw = word.encode("utf-8")
        whole = self.id_of.get(raw)
        if whole is not None and self._is_path_of_itself(whole):
            return [whole]
        ids, arcs, longest = self.id_of, self.arcs, self.longest
        n = len(raw)
        last = [-1] * (n + 1)  # the state after each prefix
        for end in range(1, n + 1):
            for begin in range(max(0, end - longest), end):
                u = ids.get(raw[begin:end])
                if u is None:
                    continue
                if begin == 0:
                    if self._is_path_of_itself(u):
                        last[end] = u
                        break
                    continue
                t = last[begin]
                ok = arcs.get((t, u))
                if ok is None:
                    ok = self.arc(t, u)
                if ok and self._is_path_of_itself(u):
                    last[end] = u
                    break
        out = []
        while n:
            out.append(last[n])
            n -= len(self.bytes_of[last[n]])
        return out[::-1]

    def _is_path_of_itself(self, t: int) -> bool:
        """Whether the automaton, reading the bytes of t, ends in t: the border between its parts is cut by its own merge and by none before."""
        known = self.arcs.get((t, -1))
        if known is None:
            known = t not in self.parts
            if not known:
                x, y = self.parts[t]
                known = self._is_path_of_itself(x) and self._is_path_of_itself(y) and self._cut(x, y) == (self.order[t], True)
            self.arcs[t, -1] = known
        return known

    def encode(self, text: str | None) -> list[int]:
        return self.batch([text])[0].tolist()

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        words: list[int] = []
        bounds = [0]
        number, split = self.table.__getitem__, self.split.findall
        self.table.room()
        for text in texts:
            if text:
                words += map(number, split(text))
            bounds.append(len(words))
        return self.table.gather(np.array(words, dtype=np.int64), np.array(bounds))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8")


class Paths(dict):
    """Numbers of words, and the table of their paths: arc labels one after the other, and where each word's begin."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton
        self.labels = np.empty(1 << 16, dtype=np.int32)
        self.begins = np.zeros(1 << 14, dtype=np.int64)

    def room(self) -> None:
        """Empties the table when it is full; never within a batch, so numbers hold there."""
        if len(self) >= WORDS_KEPT:
            self.clear()

    def __missing__(self, word: str) -> int:
        path, n = self.automaton.path(word), len(self)
        at = self.begins[n]
        while at + len(path) > len(self.labels):
            self.labels = np.concatenate([self.labels, np.empty_like(self.labels)])
        if n + 2 > len(self.begins):
            self.begins = np.concatenate([self.begins, np.zeros_like(self.begins)])
        self.labels[at : at + len(path)] = path
        self.begins[n + 1] = at + len(path)
        self[word] = n
        return n

    def gather(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The labels of a run of words, and how many lie between bounds."""
        begin = self.begins[words]
        length = self.begins[words + 1] - begin
        ends = np.concatenate([[0], np.cumsum(length)])
        labels = self.labels[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], length)]
        return labels, np.diff(ends[bounds])


_made: dict[int, Automaton] = {}


def automaton(vocabulary: bytes) -> Automaton:
    """The automaton of a vocabulary, compiled once per worker."""
    key = hash(vocabulary)
    if key not in _made:
        _made[key] = Automaton(vocabulary)
    return _made[key]


def encoded(df: DataFrame, key: str, column: str, out: str = "ids", folder: str = TOKENIZERS, file: str = "byte_bpe_50k.json") -> DataFrame:
    """(key, out): the token ids of `column`; rows and keys as they are, repeated ones too."""
    with open(os.path.join(folder, file), "rb") as f:
        shipped = df.sparkSession.sparkContext.broadcast(f.read())
    kind = df.schema[key].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        a = automaton(shipped.value)
        values, lengths = a.batch(b.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([b.column(0), lists(values, lengths, pa.int32())], names=[key, out])

    return mapped(df.select(key, column), run, f"{key} {kind}, {out} array<int>")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoded(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {"p8_ids": p8_ids}
