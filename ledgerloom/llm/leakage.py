"""Problem 9: evaluation items leaking into a corpus, by greedy string tiling with running Karp-Rabin.

Words are runs of letters and digits, compared without case and accents. Test words get numbers;
other words are 0. Karp-Rabin hashes of all windows of any length come from one prefix sum, over all words
of a batch of documents at once; those of `least` words are looked up among those of the test items
(the shared-token seeds). Documents with a seed are tiled: the longest match of unmarked words of document
and item, found by halving over lengths, is marked wherever it stands, then the next, until none of `least`
words is left. A tile is checked word by word, so hash collisions do no harm. Passages that were reordered
are found as several tiles; the share of the item in tiles is its coverage, and items below a threshold of
coverage are left out.

The items are broadcast when their size is proven small, by a sum over the table. Otherwise a bitmap of
fixed size tells the windows of documents that may be an item's; only their hashes are shuffled and joined
with those of the items, and the texts of pairs that share one are tiled.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.arrow import mapped
from ledgerloom.tables import table

LEAST = 12
#: Reordered passages: the least words of a tile, and the least share of an item in tiles.
LEAST_REORDERED = 6
LEAST_COVERAGE = 0.5
#: Items are broadcast up to this many characters in all.
BROADCAST_CHARS = 20_000_000
#: Bits of the bitmap of item windows, for items beyond that; 16 MB whatever the data.
BITS = 1 << 27
#: Words kept with their number per worker, at most.
KEPT = 1_000_000
_word = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")
_marks = regex.compile(r"\p{M}+")
# An odd number and its inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def folded(word: str) -> str:
    """A word in lower case, without accents, the barred d as d."""
    if not word.isascii():
        word = _marks.sub("", unicodedata.normalize("NFD", word)).replace("đ", "d").replace("Đ", "d")
    return word.casefold()


def words(text: str | None) -> list[str]:
    """The words of a text, folded."""
    return [w for w in map(folded, _word.findall(text)) if w] if text else []


class Numbers(dict):
    """Numbers of words as they are written: a number by the folded word, -1 when nothing is left of it."""

    def __init__(self, number) -> None:
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> int:
        w = folded(word)
        n = self.number(w) if w else -1
        if len(self) >= KEPT:
            self.clear()
        self[word] = n
        return n

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words of all texts, one after the other, and where each text's begin."""
        flat: list[int] = []
        bounds = [0]
        for t in texts:
            if t:
                flat += [n for n in map(self.__getitem__, _word.findall(t)) if n >= 0]
            bounds.append(len(flat))
        return np.array(flat, dtype=np.uint64), np.array(bounds)


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.ones((2, n + 1), dtype=np.uint64)
    out[:, 1:] = np.array([[_BASE], [_INVERSE]], dtype=np.uint64)
    return tuple(np.multiply.accumulate(out, axis=1))


class Windows:
    """Karp-Rabin hashes of the windows of a sequence of numbers, of any length, from one prefix sum."""

    def __init__(self, numbers: np.ndarray) -> None:
        size = 1 << max(4, int(len(numbers)).bit_length())
        self.up, down = (p[: len(numbers) + 1] for p in _powers(size))
        x = numbers ^ (numbers >> np.uint64(31))
        x = (x + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        self.sums = np.zeros(len(numbers) + 1, dtype=np.uint64)
        np.cumsum((x ^ (x >> np.uint64(32))) * down[:-1], out=self.sums[1:])

    def hashes(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.up[:n] if n > 0 else np.empty(0, np.uint64)


def tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in a, place in b, length), longest first, without overlap, of `least` words or more.

    a, b: numbers of words. In each round the longest common run of unmarked words is found by halving (if
    windows of a length match, shorter ones do), and all its matches are marked, from the left. A place
    of b whose words are taken is never looked at again, so a round is linear however often words repeat.
    """
    wa, wb = Windows(a), Windows(b)
    free_a, free_b = np.ones(len(a), dtype=bool), np.ones(len(b), dtype=bool)
    out: list[tuple[int, int, int]] = []

    def common(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of a and of b, with their hashes, whose unmarked windows of a length are in both."""
        sides = []
        for w, free in ((wa, free_a), (wb, free_b)):
            taken = np.concatenate([[0], np.cumsum(~free)])
            at = np.flatnonzero(taken[length:] == taken[: len(taken) - length]) if len(free) >= length else np.empty(0, np.int64)
            sides.append((at, w.hashes(length)[at]))
        (pa_, ha), (pb, hb) = sides
        ina, inb = np.isin(ha, hb), np.isin(hb, ha)
        return pa_[ina], ha[ina], pb[inb], hb[inb]

    longest = min(len(a), len(b))
    while longest >= least:
        low, high = least - 1, longest
        while low < high:
            middle = (low + high + 1) // 2
            if len(common(middle)[0]):
                low = middle
            else:
                high = middle - 1
        if low < least:
            break
        at_a, ha, at_b, hb = common(low)
        places = defaultdict(list)
        for j, h in zip(at_b[::-1].tolist(), hb[::-1].tolist(), strict=True):
            places[h].append(j)
        marked = False
        next_a = 0
        for i, h in zip(at_a.tolist(), ha.tolist(), strict=True):
            if i < next_a:
                continue
            rest = places[h]
            while rest and not free_b[rest[-1] : rest[-1] + low].all():
                rest.pop()
            j = next((j for j in reversed(rest) if free_b[j : j + low].all() and np.array_equal(a[i : i + low], b[j : j + low])), None)
            if j is not None:
                free_a[i : i + low] = free_b[j : j + low] = False
                out.append((i, j, low))
                next_a, marked = i + low, True
        longest = low if marked else low - 1
    return out


class Items:
    """Test items in the form that tasks search: words numbered, seeds sorted."""

    def __init__(self, rows: list[tuple], least: int) -> None:
        self.least = least
        by_item = {i: words(t) for i, t in rows}
        known = {w: k + 1 for k, w in enumerate(sorted({w for x in by_item.values() for w in x}))}
        self.numbers = Numbers(lambda w: known.get(w, 0))
        self.words = {i: np.array([known[w] for w in x], dtype=np.uint64) for i, x in by_item.items()}
        owners: dict[int, dict] = defaultdict(lambda: defaultdict(list))
        for i, x in self.words.items():
            for j, h in enumerate(Windows(x).hashes(least).tolist()):
                owners[h][i].append(j)
        self.owners = {h: sorted(v.items()) for h, v in owners.items()}
        self.hashes = np.array(sorted(owners), dtype=np.uint64)

    def apart(self, mine: np.ndarray, item: object, seeds: list[tuple[int, int]]) -> list[tuple[int, int, int]] | None:
        """The tiles of seeds (place in the document less place in the item, place in the document), if no two of them touch the same words; else None."""
        seeds.sort()
        runs: list[list[int]] = []
        for diagonal, i in seeds:
            if runs and runs[-1][0] == diagonal and runs[-1][2] == i:
                runs[-1][2] = i + 1
            else:
                runs.append([diagonal, i, i + 1])
        words = self.words[item]
        out = [(a, a - d, b - a + self.least - 1) for d, a, b in runs]
        for side in (0, 1):
            ends = sorted((t[side], t[side] + t[2]) for t in out)
            if any(x[1] > y[0] for x, y in zip(ends, ends[1:], strict=False)):
                return None
        if not all(np.array_equal(mine[i : i + k], words[j : j + k]) for i, j, k in out):
            return None
        return sorted(out, key=lambda t: (-t[2], t[0], t[1]))

    def search(self, texts: list[str | None], least_coverage: float = 0.0) -> list[list[tuple]]:
        """Per text, (item, tiles, words of the item) of each item that shares a tile, unless its seeds cannot reach the coverage."""
        least = self.least
        n, bounds = self.numbers.of(texts)
        out: list[list[tuple]] = [[] for _ in texts]
        h = Windows(n).hashes(least)
        if not len(h) or not len(self.hashes):
            return out
        # A window with a word that no item has cannot match; the others are looked up.
        strange = np.concatenate([[0], np.cumsum(n == 0)])
        at = np.flatnonzero(strange[least:] == strange[:-least])
        at = at[self.hashes[np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)] == h[at]]
        row = np.searchsorted(bounds, at, side="right") - 1
        inside = at + least <= bounds[row + 1]
        seeds: dict[tuple, list | None] = defaultdict(list)
        for r, place, x in zip(row[inside].tolist(), (at[inside] - bounds[row[inside]]).tolist(), h[at[inside]].tolist(), strict=True):
            for item, places in self.owners[x]:
                known = seeds[r, item]
                if known is not None:
                    if len(known) + len(places) > 4 * len(self.words[item]):
                        seeds[r, item] = None  # words that repeat
                    else:
                        known += [(place - j, place) for j in places]
        for (r, item), pairs in sorted(seeds.items()):
            mine, words = n[bounds[r] : bounds[r + 1]], self.words[item]
            if pairs is not None and least_coverage:
                reached = np.zeros(len(words) + 1, dtype=np.int64)
                for d, i in pairs:
                    reached[i - d] += 1
                    reached[i - d + least] -= 1
                if np.count_nonzero(np.cumsum(reached)) < least_coverage * len(words):
                    continue
            found = self.apart(mine, item, pairs) if pairs is not None else None
            if found is None:
                found = tiles(mine, words, least)
            if found:
                out[r].append((item, found, len(words)))
        return out


def leaks(docs: DataFrame, items: DataFrame, least: int = LEAST, least_coverage: float = 0.0, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(doc_id, item_id, tiles, longest, coverage): items with a tile of `least` words or more in a document.

    coverage: the share of the item's words in tiles; rows below `least_coverage` are left out. Null,
    empty and short texts hold nothing; repeated documents each give their rows, repeated item ids
    count with their first text in order of text.
    """
    items = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, tiles int, longest int, coverage double"
    names = ["doc_id", "item_id", "tiles", "longest", "coverage"]

    def rows(doc_ids: list, found: list[list[tuple]]) -> pa.RecordBatch | None:
        out = [(d, i, len(x), max(k for _, _, k in x), sum(k for _, _, k in x) / n) for d, f in zip(doc_ids, found, strict=True) for i, x, n in f]
        out = [r for r in out if r[4] >= least_coverage]
        if not out:
            return None
        kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
        types = [kinds.get(doc_kind), kinds.get(item_kind), pa.int32(), pa.int32(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    if size <= broadcast_chars:
        shipped = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])  # of a size just checked
        made: dict = {}

        def search(b: pa.RecordBatch) -> pa.RecordBatch | None:
            if "items" not in made:
                made["items"] = Items(shipped.value, least)
            return rows(b.column(0).to_pylist(), made["items"].search(b.column(1).to_pylist(), least_coverage))

        return mapped(docs.select("doc_id", "text"), search, schema)

    pairs = _seed_pairs(docs, items, least, doc_kind, item_kind)

    def tile(b: pa.RecordBatch) -> pa.RecordBatch | None:
        found = []
        known: dict = {}
        numbers = Numbers(lambda w: known.setdefault(w, len(known) + 1))
        for i, text, item in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            x, y = (numbers.of([t])[0] for t in (text, item))
            found.append([(i, t, len(y))] if (t := tiles(x, y, least)) else [])
        return rows(b.column(0).to_pylist(), found)

    return mapped(pairs, tile, schema)


def _seed_pairs(docs: DataFrame, items: DataFrame, least: int, doc_kind: str, item_kind: str) -> DataFrame:
    """(doc_id, item_id, text, item_text) of pairs that share a seed. What is shuffled before texts are fetched are hashes that the bitmap lets through."""

    def seeds(bitmap):
        numbers = Numbers(lambda w: xxhash.xxh64_intdigest(w) >> 1)

        def run(b: pa.RecordBatch) -> pa.RecordBatch | None:
            n, bounds = numbers.of(b.column(1).to_pylist())
            h = Windows(n).hashes(least)
            at = np.arange(len(h))
            if bitmap is not None and len(h):
                slot = h % np.uint64(BITS)
                at = np.flatnonzero((bitmap.value[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1))
            row = np.searchsorted(bounds, at, side="right") - 1
            inside = at + least <= bounds[row + 1]
            both = np.unique(np.stack([row[inside].astype(np.uint64), h[at[inside]]]), axis=1)
            ids = b.column(0).take(pa.array(both[0].astype(np.int64)))
            return pa.RecordBatch.from_arrays([ids, pa.array(both[1].view(np.int64))], names=["id", "h"]) if len(ids) else None

        return run

    of_items = mapped(items.select("item_id", "text"), seeds(None), f"id {item_kind}, h bigint").withColumnRenamed("id", "item_id")
    slot = F.pmod("h", F.lit(BITS))
    bits = of_items.select((slot / 64).cast("bigint").alias("at"), F.expr(f"shiftleft(1L, cast(pmod(h, {BITS}) % 64 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    bitmap = np.zeros(BITS // 64, dtype=np.uint64)
    got = bits.toArrow()  # a row per word of the bitmap, at most
    bitmap[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    shipped = docs.sparkSession.sparkContext.broadcast(bitmap)
    of_docs = mapped(docs.select("doc_id", "text"), seeds(shipped), f"id {doc_kind}, h bigint").withColumnRenamed("id", "doc_id").distinct()
    pairs = of_docs.join(of_items, "h").select("doc_id", "item_id").distinct()
    return pairs.join(docs.select("doc_id", "text"), "doc_id").join(items.withColumnRenamed("text", "item_text"), "item_id").select("doc_id", "item_id", "text", "item_text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Items of which a document holds at least half in tiles of 6 words or more, in whatever order, with their tiles and coverage."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), least=LEAST_REORDERED, least_coverage=LEAST_COVERAGE)


QUERIES = {"p9_found": p9_found, "p9_coverage": p9_coverage}
ORACLES = {
    "p9_found": """
WITH d AS (SELECT doc_id, regexp_extract_all(replace(lower(strip_accents(text)), 'đ', 'd'), '[\\pL\\p{Nd}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(replace(lower(strip_accents(text)), 'đ', 'd'), '[\\pL\\p{Nd}]+') AS w FROM eval_items),
dw AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)
""",
}
