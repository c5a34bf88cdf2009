"""Problem 6: the best representative of each group of duplicate records, by consistent bundles.

Fields that depend on each other survive together, as a bundle taken whole from one row. The value bundle
and the place bundle are bound by the functional dependency table_id -> (unit, page): the survivor's table,
unit and page must occur together in a row of the group (a null table binds nothing). The other bundles
are free. A bundle is worth the pair (non-null fields, trust of its row), where the trust of a row is one
number made of right code, completeness, confidence and source; a record is worth the sum over its bundles.

Branch and bound, per group: free bundles take their best. The incumbent is the leading row with its own
value and place, which is always consistent. Places branch in order of worth; the bound of a branch is
its place with the best value bundle of the group, consistent or not; when it is below the incumbent, that
branch and all after it are cut. Within a branch the first consistent value bundle is its best. Ties end
with the place of the latest created_at, then smallest seq, then the same of the value.

Only the best value bundle per unit, the best place per (table, page), one row per (table, unit, page) and
the best of each free bundle can survive, so a group may be reduced to those rows at any time without
changing the result. This is done within the batches that tasks read, before the one shuffle, and again
where rows of a group arrive in more than one batch: a group that holds a third of all rows is never
gathered, only its distinct tables, units and pages are.

Rows with a null among the grouping columns, or whose concept is no key, are in no group. A group of one
row gives no row; repeated rows count as rows. A confidence that is no number counts as null, a null seq
as the largest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.tables import table

GROUP = ["doc_id", "concept", "period", "period_type"]
# The sources, most trusted first, and the fields that count as complete when not null.
SOURCES = ["pdfplumber", "local_ocr", "ocr"]
COMPLETE = ["standard_code", "value", "unit", "page", "table_id", "source", "confidence", "verification_detail"]
BUNDLES = {
    "measure": ["value", "unit", "verification_status", "verification_detail"],
    "place": ["page", "table_id", "prov_id"],
    "evidence": ["confidence", "source"],
    "label": ["raw_label"],
    "code": ["standard_code"],
}
FIELDS = [c for b in BUNDLES.values() for c in b]
#: Rows of a group in a batch from which on it is reduced before the shuffle; fewer gain nothing by it.
REDUCED_FROM = 8


class Row:
    """One row of a group: its fields, the rows it stands for, and its orders."""

    __slots__ = ("at", "fields", "n", "lead", "tail", "trust")

    def __init__(self, at: int, fields: tuple, head: int, trust: int, rank: int, latest: int | None, seq: int | None, n: int) -> None:
        self.at, self.fields, self.n, self.trust = at, fields, n, trust
        confidence = fields[_AT["confidence"]]
        self.tail = (-(1 << 63) if latest is None else latest, -(1 << 63) if seq is None else -seq)
        self.lead = (head, -1.0 if confidence is None else confidence, rank, *self.tail)

    def worth(self, bundle: str) -> tuple:
        """(non-null fields, trust of the row, latest, -seq) of a bundle of this row."""
        a, b = _SPAN[bundle]
        return (sum(x is not None for x in self.fields[a:b]), self.trust, *self.tail)


_AT = {c: k for k, c in enumerate(FIELDS)}
_SPAN = {b: (_AT[c[0]], _AT[c[0]] + len(c)) for b, c in BUNDLES.items()}
_UNIT, _PAGE, _TABLE = _AT["unit"], _AT["page"], _AT["table_id"]
FREE = ["evidence", "label", "code"]


class Group:
    """The rows of a group that can survive, by what they can survive as."""

    def __init__(self, rows: Iterable[Row]) -> None:
        rows = list(rows)
        self.rows = sum(r.n for r in rows)
        self.leading = max(rows, key=lambda r: r.lead)
        self.free = {b: max(rows, key=lambda r: r.worth(b)) for b in FREE}
        self.measures: dict[object, tuple[tuple, Row]] = {}
        self.places: dict[tuple, tuple[tuple, Row]] = {}
        self.together: dict[tuple, Row] = {}
        for r in rows:
            unit, page, where = r.fields[_UNIT], r.fields[_PAGE], r.fields[_TABLE]
            for best, key, bundle in ((self.measures, unit, "measure"), (self.places, (where, page), "place")):
                w = r.worth(bundle)
                if key not in best or w > best[key][0]:
                    best[key] = (w, r)
            self.together.setdefault((where, unit, page), r)

    def reduced(self) -> list[int]:
        """Places of the rows that stay when the group is reduced."""
        stay = [self.leading, *self.free.values(), *(r for _, r in self.measures.values()), *(r for _, r in self.places.values()), *self.together.values()]
        return sorted({r.at for r in stay})

    def search(self) -> tuple[Row, Row, int, int]:
        """The rows of the best consistent value and place, the branches opened and the branches cut."""
        places = sorted(self.places.values(), key=lambda x: x[0], reverse=True)
        measures = sorted(self.measures.values(), key=lambda x: x[0], reverse=True)
        top = measures[0][0]
        lead = self.leading
        p, m = lead.worth("place"), lead.worth("measure")
        best, chosen = (p[0] + m[0], p[1] + m[1], p[2:], m[2:]), (lead, lead)
        opened = 0
        for p, place in places:
            if (p[0] + top[0], p[1] + top[1]) < best[:2]:
                break
            opened += 1
            where, page = place.fields[_TABLE], place.fields[_PAGE]
            for m, measure in measures:
                if where is None or (where, measure.fields[_UNIT], page) in self.together:
                    worth = (p[0] + m[0], p[1] + m[1], p[2:], m[2:])
                    if worth > best:
                        best, chosen = worth, (measure, place)
                    break
        return *chosen, opened, len(places) - opened

    def record(self) -> tuple:
        """(seq of the leading row, rows, fields) of the survivor."""
        measure, place, _, _ = self.search()
        source = {"measure": measure, "place": place} | self.free
        seq = self.leading.tail[1]
        fields = tuple(x for b, (i, j) in _SPAN.items() for x in source[b].fields[i:j])
        return (None if seq == -(1 << 63) else -seq, self.rows, *fields)


def _scored(facts: DataFrame, concepts: DataFrame) -> DataFrame:
    """Facts whose concept is a key, with a hash of the group and what their order and trust need."""
    codes = concepts.where("concept is not null").groupBy("concept").agg(F.min("code").alias("_code"))
    rows = facts.select(*dict.fromkeys([*GROUP, *FIELDS, "created_at", "seq"])).dropna(subset=GROUP).join(codes, "concept")
    rows = rows.withColumn("confidence", F.when(~F.isnan("confidence"), F.col("confidence")))
    right: Column = F.coalesce(F.col("standard_code") == F.col("_code"), F.lit(False)).cast("int")
    rank = F.coalesce(*[F.when(F.col("source") == s, F.lit(len(SOURCES) - k)) for k, s in enumerate(SOURCES)], F.lit(0))
    head = right * (len(COMPLETE) + 1) + sum((F.col(c).isNotNull().cast("int") for c in COMPLETE), F.lit(0))
    sure = F.round(F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)) * 1_000_000).cast("bigint")
    return rows.select(
        F.xxhash64(*GROUP).alias("_h"), *GROUP, *FIELDS, "created_at", F.col("seq").cast("bigint").alias("seq"),
        head.alias("_head"), ((head.cast("bigint") * 1_000_001 + sure) * 4 + rank).alias("_trust"), rank.alias("_rank"), F.lit(1).cast("bigint").alias("_n"),
    )


def _groups(b: pa.RecordBatch, at: np.ndarray) -> dict[tuple, list[Row]]:
    """The rows at some places of a batch, by the values of their grouping columns."""
    part = b.take(pa.array(at))
    column = lambda c: part.column(part.schema.get_field_index(c))
    latest = column("created_at")
    latest = latest.cast(pa.int64()).to_pylist() if pa.types.is_timestamp(latest.type) else latest.to_pylist()
    out: dict[tuple, list[Row]] = {}
    rest = zip(*(column(c).to_pylist() for c in ("_head", "_trust", "_rank")), latest, column("seq").to_pylist(), column("_n").to_pylist(), strict=True)
    for k, key, fields, more in zip(at.tolist(), zip(*(column(c).to_pylist() for c in GROUP), strict=True), zip(*(column(c).to_pylist() for c in FIELDS), strict=True), rest, strict=True):
        out.setdefault(key, []).append(Row(k, fields, *more))
    return out


def reduced(b: pa.RecordBatch, least: int = REDUCED_FROM) -> pa.RecordBatch:
    """A batch in which groups of `least` rows or more are reduced to the rows that can survive."""
    h = b.column(0).to_numpy()
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    large = np.flatnonzero(counts[inverse] >= least)
    if not len(large):
        return b
    keep = np.ones(len(h), dtype=bool)
    keep[large] = False
    n = b.column(b.num_columns - 1).to_numpy().copy()
    for rows in _groups(b, large).values():
        g = Group(rows)
        stay = g.reduced()
        keep[stay] = True
        n[stay] = 1
        n[stay[0]] = g.rows - len(stay) + 1
    columns = [*b.columns[:-1], pa.array(n)]
    return pa.RecordBatch.from_arrays(columns, names=b.schema.names).filter(pa.array(keep))


def surviving(facts: DataFrame, concepts: DataFrame) -> DataFrame:
    """One record per group of two or more: grouping columns, seq of the leading row, rows, and every bundle's fields."""
    rows = _scored(facts, concepts)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in GROUP), "seq bigint", "rows bigint", *(f"`{c}` {types[c]}" for c in FIELDS)])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (reduced(b) for b in batches if b.num_rows)

    def found(b: pa.RecordBatch) -> pa.RecordBatch | None:
        h, n = b.column(0).to_numpy(), b.column(b.num_columns - 1).to_numpy()
        same = h[1:] == h[:-1]
        many = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (n > 1))
        if not len(many):
            return None
        out = []
        for key, rows in _groups(b, many).items():
            if len(rows) > 1 or rows[0].n > 1:
                out.append((*key, *Group(rows).record()))
        if not out:
            return None
        fields = [*(b.schema.field(c) for c in GROUP), pa.field("seq", pa.int64()), pa.field("rows", pa.int64()), *(b.schema.field(c) for c in FIELDS)]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], names=[f.name for f in fields])

    def survive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches in order of the hash; what may go on in the next batch is carried, reduced."""
        carried: pa.RecordBatch | None = None
        for b in batches:
            if not b.num_rows:
                continue
            if carried is not None:
                b = pa.concat_batches([carried, b])
            h = b.column(0).to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            carried = reduced(b.slice(cut))
            if cut and (out := found(b.slice(0, cut))) is not None:
                yield out
        if carried is not None and (out := found(carried)) is not None:
            yield out

    return rows.mapInArrow(combine, rows.schema).repartition("_h").sortWithinPartitions("_h").mapInArrow(survive, schema)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return surviving(table(spark, d, "financial_facts"), table(spark, d, "concept_definitions")).select("seq")


def p6_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each group, filled bundle by bundle."""
    return surviving(table(spark, d, "financial_facts"), table(spark, d, "concept_definitions"))


_FILLED = {b: " + ".join(f"({c} IS NOT NULL)::int" for c in fields) for b, fields in BUNDLES.items()}
_SCORED = f"""
WITH scored AS (
  SELECT f.*, {' + '.join(f'(f.{c} IS NOT NULL)::int' for c in COMPLETE)} + 9 * coalesce(f.standard_code = c.code, false)::int AS head,
    CASE source WHEN 'pdfplumber' THEN 3 WHEN 'local_ocr' THEN 2 WHEN 'ocr' THEN 1 ELSE 0 END AS rank,
    count(*) OVER (PARTITION BY f.doc_id, f.concept, f.period, f.period_type) AS rows
  FROM financial_facts f JOIN concept_definitions c ON f.concept = c.concept
  WHERE f.doc_id IS NOT NULL AND f.period IS NOT NULL AND f.period_type IS NOT NULL
), r AS (
  SELECT *, (head::bigint * 1000001 + round(coalesce(confidence, 0) * 1000000)::bigint) * 4 + rank AS trust,
    row_number() OVER (PARTITION BY doc_id, concept, period, period_type ORDER BY head DESC, confidence DESC NULLS LAST, rank DESC, created_at DESC NULLS LAST, seq) AS place_in_group
  FROM scored WHERE rows > 1
)"""


def _best(bundle: str) -> str:
    return f"""SELECT {', '.join(GROUP)}, {', '.join(BUNDLES[bundle])} FROM r
  QUALIFY row_number() OVER (PARTITION BY {', '.join(GROUP)} ORDER BY {_FILLED[bundle]} DESC, trust DESC, created_at DESC NULLS LAST, seq) = 1"""


def _of(alias: str, expression: str) -> str:
    return expression.replace("(", f"({alias}.")


QUERIES = {"p6_found": p6_found, "p6_survivors": p6_survivors}
ORACLES = {
    "p6_found": f"{_SCORED}\nSELECT seq FROM r WHERE place_in_group = 1",
    "p6_survivors": f"""{_SCORED}, pairs AS (
  SELECT {', '.join(f'm.{c}' for c in [*GROUP, *BUNDLES['measure']])}, {', '.join(f'p.{c}' for c in BUNDLES['place'])}
  FROM r m JOIN r p USING ({', '.join(GROUP)})
  WHERE p.table_id IS NULL OR EXISTS (SELECT 1 FROM r w WHERE {' AND '.join(f'w.{c} = p.{c}' for c in [*GROUP, 'table_id'])}
    AND w.unit IS NOT DISTINCT FROM m.unit AND w.page IS NOT DISTINCT FROM p.page)
  QUALIFY row_number() OVER (PARTITION BY {', '.join(f'm.{c}' for c in GROUP)}
    ORDER BY {_of('m', _FILLED['measure'])} + {_of('p', _FILLED['place'])} DESC, m.trust + p.trust DESC,
      p.created_at DESC NULLS LAST, p.seq, m.created_at DESC NULLS LAST, m.seq) = 1
), evidence AS ({_best('evidence')}), labels AS ({_best('label')}), codes AS ({_best('code')})
SELECT {', '.join(f'r.{c}' for c in GROUP)}, r.seq, r.rows, {', '.join(f'pairs.{c}' for c in [*BUNDLES['measure'], *BUNDLES['place']])},
  evidence.confidence, evidence.source, labels.raw_label, codes.standard_code
FROM r JOIN pairs USING ({', '.join(GROUP)}) JOIN evidence USING ({', '.join(GROUP)}) JOIN labels USING ({', '.join(GROUP)}) JOIN codes USING ({', '.join(GROUP)})
WHERE r.place_in_group = 1""",
}
