"""Problem 3: oversized texts cut at natural boundaries, with overlap, by agglomerative merging.

A text over the limit begins as atoms: sentences, lines, paragraphs; an atom that is itself too large
is cut at clauses, then between words, then between characters (never before a combining mark).
Adjacent pairs wait in a heap, the weakest boundary first, of equal ones the smallest pair; a pair
merges while its size plus the overlap fits the limit. What remains is cut at the strongest boundaries.
Every piece but the first begins `overlap` characters before its own part, so consecutive pieces
share exactly that many, and the pieces without their overlaps are the text.

Only texts over the limit go to Python, as one Arrow column; sizes are counted in code points.
Null texts have no pieces; texts within the limit, also empty ones, are one piece.
"""

from __future__ import annotations

import heapq
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.tables import table

OVERLAP = 200
CHUNK_LIMIT = 2000
SECTION_LIMIT = 5000
CUTS = "array<struct<begin:int,end:int>>"
# Boundaries, by strength: a blank line 5 (before a heading 6), a line end 4, a sentence end 3, a clause 2, a space 1, none 0.
_natural = re.compile(r"\n[ \t\r]*\n\s*|\n|(?<=[.!?…。;])[\"”’)\]]*[ \t ]+")
_small = re.compile(r"(?<=[,:;|–—])\s+|\s+")


def _boundaries(text: str) -> list[tuple[int, int]]:
    """(place, strength) of the natural boundaries, in order; a place is where the next atom begins."""
    out = []
    for m in _natural.finditer(text):
        s = m.group()
        if "\n" not in s:
            strength = 3
        elif s.count("\n") > 1:
            strength = 6 if text.startswith("#", m.end()) else 5
        else:
            strength = 5 if text.startswith("#", m.end()) else 4
        out.append((m.end(), strength))
    return out


def _finer(text: str, begin: int, end: int, room: int) -> list[tuple[int, int]]:
    """Boundaries inside an atom that is over `room`: clauses and spaces, and cuts between characters where even those are too far apart."""
    out = []
    last = begin
    for m in _small.finditer(text, begin, end):
        at = m.end()
        if at >= end:
            break
        while at - last > room:
            last = _hard(text, last, room)
            out.append((last, 0))
        if at > last:
            out.append((at, 2 if m.start() and text[m.start() - 1] in ",:;|–—" else 1))
            last = at
    while end - last > room:
        last = _hard(text, last, room)
        out.append((last, 0))
    return out


def _hard(text: str, last: int, room: int) -> int:
    """A place at most `room` after `last`, not before a combining mark if that can be had."""
    at = last + room
    while at > last + max(1, room // 2) and unicodedata.combining(text[at]):
        at -= 1
    return at if not unicodedata.combining(text[at]) else last + room


def cuts(text: str, limit: int, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(begin, end) of the pieces of a text, overlaps included. The first piece is at least as long as the overlap, so all overlaps are whole, also those over half the limit."""
    if len(text) <= limit:
        return [(0, len(text))]
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    room = limit - overlap
    places: list[tuple[int, int]] = []
    last = 0
    n = len(text)
    for at, strength in [*_boundaries(text), (n, 9)]:
        if at < overlap and at < n:
            continue  # a first piece shorter than the overlap would not hold it
        if at - last > room:
            places += [p for p in _finer(text, last, at, room) if p[0] >= overlap]
        places.append((at, strength))
        last = at
    places = [p for p in places if 0 < p[0] < n]
    places = sorted(dict(reversed(places)).items())
    begin = [0, *(p for p, _ in places)]
    end = [*(p for p, _ in places), n]
    strength = [s for _, s in places]
    k = len(begin)
    after, before = list(range(1, k + 1)), list(range(-1, k - 1))
    alive = [True] * k
    heap = [(strength[i], end[i + 1] - begin[i], i, i + 1) for i in range(k - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, a, b = heapq.heappop(heap)
        if not (alive[a] and b < k and alive[b] and after[a] == b) or size != end[b] - begin[a] or size > room:
            continue
        end[a], alive[b] = end[b], False
        after[a] = after[b]
        if after[a] < k:
            c = after[a]
            before[c] = a
            heapq.heappush(heap, (strength[c - 1], end[c] - begin[a], a, c))
        if before[a] >= 0:
            p = before[a]
            heapq.heappush(heap, (strength[a - 1], end[a] - begin[p], p, a))
    return [(max(0, begin[i] - overlap) if i else 0, end[i]) for i in range(k) if alive[i]]


def split(df: DataFrame, text: str, limit: int, overlap: int = OVERLAP) -> DataFrame:
    """df with `cuts`, the (begin, end) of each piece of `text` in order; null where the text is null."""
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(CUTS)
    def long_cuts(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else [{"begin": a, "end": b} for a, b in cuts(t, limit, overlap)] for t in column.to_pylist()], type=kind)

    size = F.length(text)
    whole = F.array(F.struct(F.lit(0).alias("begin"), size.alias("end")))
    return df.drop("cuts").withColumn("cuts", F.when(size > limit, long_cuts(F.when(size > limit, F.col(text)))).when(size <= limit, whole))


def pieces(df: DataFrame, text: str, limit: int, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece: the columns of df but for the text, and piece (from 0), begin, end, content. The text is cut on the JVM."""
    cut = split(df, text, limit, overlap)
    out = cut.select("*", F.posexplode("cuts").alias("piece", "_c"))
    return out.withColumn("begin", F.col("_c.begin")).withColumn("end", F.col("_c.end")).withColumn("content", F.substring(F.col(text), F.col("begin") + 1, F.col("end") - F.col("begin"))).drop("_c", "cuts", text)


def chunk_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select(F.lit("chunks.full_content").alias("field"), F.col("chunk_id").alias("record_key"), F.col("full_content").alias("text"))


def section_items(spark: SparkSession, d: str) -> DataFrame:
    """The text of a section: its non-null block contents in order, joined by one blank line."""
    contents = F.filter(F.col("blocks.content"), lambda x: x.isNotNull())
    return table(spark, d, "sections").select(F.lit("sections.blocks").alias("field"), F.col("id").alias("record_key"), F.array_join(contents, "\n\n").alias("text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    a = split(chunk_items(spark, d), "text", CHUNK_LIMIT).select("field", "record_key", "cuts")
    b = split(section_items(spark, d), "text", SECTION_LIMIT).select("field", "record_key", "cuts")
    return a.unionByName(b).where(F.size("cuts") > 1).select("field", "record_key")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every item, with its place and content."""
    a = pieces(chunk_items(spark, d), "text", CHUNK_LIMIT)
    b = pieces(section_items(spark, d), "text", SECTION_LIMIT)
    return a.unionByName(b)


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces}
ORACLES = {
    "p3_found": """
SELECT 'chunks.full_content' AS field, chunk_id AS record_key FROM chunks WHERE length(full_content) > 2000
UNION ALL
SELECT 'sections.blocks', id FROM sections
WHERE length(array_to_string(list_filter(list_transform(blocks, lambda b: b.content), lambda x: x IS NOT NULL), chr(10) || chr(10))) > 5000
""",
}
