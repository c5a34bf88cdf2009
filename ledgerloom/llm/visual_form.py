"""Problem 7: text that looks the same, brought to one form of its characters.

A column of an Arrow batch is one flat array of code points. Look-up tables give each code point its
replacement (compatibility forms and look-alike letters), its length (0: invisible, removed; several:
an expansion written at computed offsets); then marks are put in canonical order by one sort and composed by
searching pairs of letter and mark, however many marks a letter has, all on whole arrays. Only rows with a code point that any table
mentions are touched; the others pass through as they are.

Greek and Cyrillic letters that look like Latin ones become Latin. Small Greek letters standing alone
are symbols and stay, as do Greek letters without a Latin twin (beta, Delta), en dashes, curly quotes,
currency signs and the marks that scanning leaves (the not sign, a soft hyphen at a line end).
Null stays null, empty stays empty; equal rows give equal results.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.arrow import flat_utf8, mapped, utf8_column
from ledgerloom.tables import table

# Letters of other alphabets or code points, and the letters they look like.
LOOKALIKES = {
    "АВЕКМНОРСТХІЈЅЗҮаеорсухіјѕһԁԛԝѵ": "ABEKMHOPCTXIJS3Yaeopcyxijshdqwv",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧορνι": "ABEZHIKMNOPTYXopvi",
    "ÐƉðɖıǀ": "ĐĐđđil",
}
# Code points that show nothing (the soft hyphen only where no line ends after it).
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]
# Spaces other than the ordinary one; tabs and line ends are not among them.
SPACES = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
# Compatibility forms that print differently from what they stand for, and are kept.
KEPT = "…¨¯´¸˘˙˚˛˜˝²³¹ªº¼½¾‑‗™"


class Tables:
    """The look-up tables, over all code points; about 10 MB, whatever the data."""

    def __init__(self) -> None:
        n = 0x110000
        self.single = np.arange(n, dtype=np.uint32)
        self.length = np.ones(n, dtype=np.int16)
        self.start = np.zeros(n, dtype=np.int32)
        self.ccc = np.zeros(n, dtype=np.uint8)
        self.hit = np.zeros(n, dtype=bool)
        self.apart = np.ones(n, dtype=np.int16)
        self.apart_start = np.zeros(n, dtype=np.int32)
        many: list[int] = []
        pairs: list[tuple[int, int, int]] = []
        for c in (*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20)):
            ch = chr(c)
            d = unicodedata.decomposition(ch)
            if d and d[0] != "<":
                parts = [int(x, 16) for x in d.split()]
                if len(parts) == 2 and unicodedata.normalize("NFC", ch) == ch:
                    pairs.append((parts[0], parts[1], c))
                    apart = [ord(x) for x in unicodedata.normalize("NFD", ch)]
                    self.apart[c], self.apart_start[c] = len(apart), len(many)
                    many.extend(apart)
            self.ccc[c] = unicodedata.combining(ch)
            if ch in KEPT:
                continue
            out = unicodedata.normalize("NFKC", ch)
            if out != ch:
                self.set(c, [ord(x) for x in out], many)
        for c in SPACES:
            self.set(c, [0x20], many)
        for a, b in LOOKALIKES.items():
            for x, y in zip(a, b, strict=True):
                self.set(ord(x), [ord(y)], many)
        for c in INVISIBLE:
            self.set(c, [], many)
        self.hit |= self.ccc > 0
        # What composes with the letter before it: letters with a pair, and the vowels and finals of Hangul.
        self.second = np.zeros(n, dtype=bool)
        self.second[[b for _, b, _ in pairs if not self.ccc[b]]] = True
        self.second[[*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]] = True
        self.hit |= self.second
        self.many = np.array(many or [0], dtype=np.uint32)
        keys = sorted({(a << 32) | b: c for a, b, c in pairs}.items())
        self.pair = np.array([k for k, _ in keys], dtype=np.uint64)
        self.composed = np.array([c for _, c in keys], dtype=np.uint32)
        small_greek = [ord(x) for x in "ορνι"]
        self.symbol = np.zeros(n, dtype=bool)
        self.symbol[small_greek] = True
        self.letter = np.zeros(0x3000, dtype=bool)
        for c in range(0x3000):
            self.letter[c] = unicodedata.category(chr(c))[0] in "LM"

    def set(self, c: int, to: list[int], many: list[int]) -> None:
        self.hit[c] = True
        self.length[c] = len(to)
        if len(to) == 1:
            self.single[c] = to[0]
        elif to:
            self.start[c] = len(many)
            many.extend(to)


@functools.cache
def tables() -> Tables:
    return Tables()


def _expanded(values: np.ndarray, length: np.ndarray, start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Each value `length` times over; where that is more than once, the run of `many` that begins at `start` instead."""
    out = np.repeat(values, length)
    more = np.flatnonzero(length > 1)
    if len(more):
        n = length[more]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(np.cumsum(length)[more] - n, n) + within] = many[np.repeat(start[more], n) + within]
    return out


def _paired(a: np.ndarray, b: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of code points compose, and what to."""
    key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
    at = np.minimum(np.searchsorted(t.pair, key), len(t.pair) - 1)
    hit, to = t.pair[at] == key, t.composed[at].copy()
    # Hangul syllables are computed from their parts.
    a, b = a.astype(np.int64), b.astype(np.int64)
    lead, vowel, final, syllable = a - 0x1100, b - 0x1161, b - 0x11A7, a - 0xAC00
    two = (lead >= 0) & (lead < 19) & (vowel >= 0) & (vowel < 21)
    three = (syllable >= 0) & (syllable < 11172) & (syllable % 28 == 0) & (final > 0) & (final < 28)
    to[two] = 0xAC00 + (lead[two] * 21 + vowel[two]) * 28
    to[three] = a[three] + final[three]
    return hit | two | three, to


def _composed(cps: np.ndarray, rows: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Marks in canonical order and composed; rows: the row of each code point.

    Letters before marks are taken apart; a stable sort by (letter, class) orders all marks at once. Then
    the first mark of a class that composes with its letter does, until no letter has one.
    """
    k = t.ccc[cps]
    if k.any():
        first = np.concatenate([[True], rows[1:] != rows[:-1]])
        length = np.where((k == 0) & np.concatenate([(k[1:] > 0) & ~first[1:], [False]]), t.apart[cps], 1).astype(np.int64)
        cps, rows = _expanded(cps, length, t.apart_start[cps], t.many), np.repeat(rows, length)
        k = t.ccc[cps]
        letter = np.cumsum((k == 0) | np.concatenate([[True], rows[1:] != rows[:-1]]))
        order = np.lexsort((k, letter))
        cps, k = cps[order], k[order]
        while True:
            begins = np.flatnonzero(np.concatenate([[True], letter[1:] != letter[:-1]]))
            marks = np.flatnonzero((k[1:] > k[:-1]) & (letter[1:] == letter[:-1])) + 1
            base = begins[np.searchsorted(begins, marks, side="right") - 1]
            hit, to = _paired(cps[base], cps[marks], t)
            hit &= k[base] == 0
            if not hit.any():
                break
            base, at = np.unique(base[hit], return_index=True)
            cps[base] = to[hit][at]
            keep = np.ones(len(cps), dtype=bool)
            keep[marks[hit][at]] = False
            cps, rows, k, letter = cps[keep], rows[keep], k[keep], letter[keep]
    while t.second[cps].any():  # letters that compose with the letter before them, from the left
        at = np.flatnonzero(t.second[cps[1:]] & (rows[1:] == rows[:-1])) + 1
        hit, to = _paired(cps[at - 1], cps[at], t)
        at, to = at[hit], to[hit]
        alone = np.concatenate([[True], np.diff(at) > 1])[: len(at)]
        if not len(at):
            break
        cps[at[alone] - 1] = to[alone]
        keep = np.ones(len(cps), dtype=bool)
        keep[at[alone]] = False
        cps, rows = cps[keep], rows[keep]
    return cps, rows


def one_form(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The column in one form, and which rows changed."""
    t = tables()
    n = len(column)
    raw, offsets = flat_utf8(column)
    changed = np.zeros(n, dtype=bool)
    if not len(raw) or raw.max() < 0x80:
        return column, changed
    wide = np.add.reduceat(np.concatenate([raw >= 0x80, [False]]), np.minimum(offsets[:-1], len(raw)))
    touched = np.flatnonzero((np.diff(offsets) > 0) & (wide > 0))
    part, part_off = flat_utf8(column.take(pa.array(touched)))
    cps = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    starts = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[part_off]
    hit = t.hit[cps]
    rows = np.repeat(np.arange(len(touched)), np.diff(starts))
    mine = np.zeros(len(touched), dtype=bool)
    mine[rows[hit]] = True
    if not mine.any():
        return column, changed
    inside = mine[rows]
    cps, rows, touched = cps[inside], rows[inside], touched
    same_before = np.concatenate([[False], rows[1:] == rows[:-1]])
    same_after = np.concatenate([rows[1:] == rows[:-1], [False]])
    before = np.where(same_before, np.concatenate([[0], cps[:-1]]), 0)
    after = np.where(same_after, np.concatenate([cps[1:], [0]]), 0)
    letter = lambda x: (x < 0x3000) & t.letter[np.minimum(x, 0x2FFF)]
    stay = (t.symbol[cps] & ~letter(before) & ~letter(after)) | ((cps == 0xAD) & ((after == 0x0A) | (after == 0x0D) | ~same_after))
    length = np.where(stay, 1, t.length[cps]).astype(np.int64)
    out = _expanded(np.where(stay, cps, t.single[cps]), length, t.start[cps], t.many)
    out_rows = np.repeat(rows, length)
    out, out_rows = _composed(out, out_rows, t)
    text = out.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    size = 1 + (out >= 0x80) + (out >= 0x800) + (out >= 0x10000)
    per_row = np.bincount(out_rows, weights=size, minlength=len(touched)).astype(np.int64)[mine]
    new = utf8_column(text, np.concatenate([[0], np.cumsum(per_row)]))
    old = column.take(pa.array(touched[mine])).cast(pa.string())
    differs = np.asarray(pa.compute.not_equal(new, old).to_numpy(zero_copy_only=False), dtype=bool)
    changed[touched[mine][differs]] = True
    if not changed.any():
        return column, changed
    index = np.full(n, -1, dtype=np.int64)
    index[touched[mine]] = np.arange(len(new))
    base = column.cast(pa.string())
    pool = pa.concat_arrays([base, new])
    return pool.take(pa.array(np.where(index >= 0, n + index, np.arange(n)))), changed


def consistent(df: DataFrame, column: str, out: str = "clean", flag: str = "changed") -> DataFrame:
    """df with `out`, the text of `column` in one form, and `flag`: whether that differs (false for null)."""
    df = df.drop(out, flag)
    names = df.columns

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        new, changed = one_form(b.column(names.index(column)))
        return pa.RecordBatch.from_arrays([*b.columns, new.cast(pa.string()), pa.array(changed)], names=[*names, out, flag])

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(flag, T.BooleanType())])
    return mapped(df, run, schema)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "financial_facts").select(F.lit("financial_facts.raw_label").alias("field"), F.col("seq").cast("string").alias("record_key"), F.col("raw_label").alias("text"))
    titles = table(spark, d, "sections").select(F.lit("sections.title").alias("field"), F.col("id").alias("record_key"), F.col("title").alias("text"))
    return consistent(facts.unionByName(titles), "text").where("changed").select("field", "record_key")


def p7_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels in one form, with their count and the number of forms they were written in."""
    facts = table(spark, d, "financial_facts").groupBy("raw_label").count()
    return consistent(facts, "raw_label").groupBy(F.col("clean").alias("label")).agg(F.sum("count").alias("facts"), F.count("*").alias("forms"))


QUERIES = {"p7_found": p7_found, "p7_labels": p7_labels}
