"""Problem 4: freely typed values mapped to the entries of a reference list, by a BK-tree.

A label is stripped of what surrounds its meaning (numbering, units, notes, page numbers, report
lines) and written as a skeleton: one form of its characters, lower case, no accents, single spaces,
and one sign for each class of signs that scanning confuses. References get skeletons of every way they
are written: accents or none, telex typing, usual abbreviations. The tree holds the distinct reference
skeletons under the Levenshtein distance; triangle-inequality pruning returns every one within a limit
that grows with the label's length. The nearest wins if no other entry is as near; else, with accents
and unconfused, the nearest of these; a tie of entries, or none within the limit, is UNMATCHED.

A list of up to `shard` names, counted first, is broadcast. A longer one is cut into shards of about that
size by a hash of the name: distinct labels, in blocks of `block`, meet every shard, each pair of block
and shard in a task of its own that builds one tree; the shards' winners merge by the least distance, and
labels get their entry by a join. No task, and never the driver, holds more than one shard or block.
Answers are the same for every number of shards. Distinct labels of a batch are looked up together, and
kept per worker. Null and empty labels are UNMATCHED; repeated rows each give their row.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.arrow import mapped
from ledgerloom.llm.editmetric import Tree, distance
from ledgerloom.llm.visual_form import one_form
from ledgerloom.operators.units import BASES, SCALES
from ledgerloom.tables import table

UNMATCHED = "UNMATCHED"
#: (found only unconfused, distance of skeletons, distance with accents, entry)
Found = tuple[bool, int, int, str]
#: Names of references in one shard, and distinct labels in one block.
SHARD = 20_000
BLOCK = 50_000
KEPT = 500_000
# Telex typing of letters and of tones.
TELEX_LETTERS = {"ă": "aw", "â": "aa", "ê": "ee", "ô": "oo", "ơ": "ow", "ư": "uw", "đ": "dd"}
TELEX_TONES = {"̀": "f", "́": "s", "̉": "r", "̃": "x", "̣": "j"}
# Usual abbreviations in labels, by phrase without accents.
SHORT = {
    "chi phi": ["cp"], "doanh thu": ["dt"], "tai san co dinh": ["tscd"], "tai san": ["ts"], "hoat dong": ["hd"], "loi nhuan": ["ln"], "khach hang": ["kh"], "thue": ["t"],
    "phai tra": ["ptra"], "phai thu": ["pthu"], "ngan han": ["nh"], "dai han": ["dh"], "ngan hang": ["nhang"], "nha cung cap": ["ncc"], "du phong": ["dp"], "huu hinh": ["hh"], "vo hinh": ["vh"],
    "gia tri gia tang": ["gtgt"], "cong ty": ["cty"], "hang ton kho": ["htk"], "thu nhap": ["tn"], "nguyen vat lieu": ["nvl"], "chu so huu": ["csh"],
    "cash flow": ["cf"], "receivables": ["recv", "rec"], "payables": ["pay"], "short term": ["st"], "long term": ["lt"], "expenses": ["exp"], "depreciation": ["depr"], "accumulated": ["acc"], "liabilities": ["liab"], "provision": ["prov"], "inventories": ["inv"],
}
# Small words that labels leave out.
SMALL = "đã của và theo tại các từ the of and at in to from".split()
# Signs that scanning confuses, as one sign a class.
CONFUSED_PAIRS = [("li", "h"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("u'", "u")]
CONFUSED = str.maketrans("0159!|l678", "oisgiiibtb")

_hyphen = regex.compile(r"[-‐¬­]\s*\n\s*")
_leader = regex.compile(r"(?:\s*(?:[.…·_]\s*){2,}|\s+)(?:tr\.?|trang|page|p\.?)?\s*\d{1,4}\s*$", regex.I)
_page = regex.compile(r"\s+(?:tr\.?|trang|page|p\.)\s*\d{1,4}\s*$", regex.I)
_bracket = regex.compile(r"\s*[(\[][^()\[\]]*[)\]]?\s*$")
_dash = regex.compile(r"\s+[–—]\s*.*$|[\s:;–—-]+$")
_number = regex.compile(r"^\s*(?:(?:mục|mucj|muc)[\s._]+(?=\S))?(?:(?:[ivx]{1,5}|[a-z]|\d{1,2})\s*[.)]\s*|[a-z]\s+-\s+|[-*+•]\s+|(?:mục|mucj|muc)[\s._]+(?:\d+[.)]?\s+)?)?", regex.I)
_unit_word = regex.compile(r"[\s_.]*(?:-[\s_]*)?(?:đvt|đơn[\s_]vị|don[\s_]vi|ddown[\s_]vij|tính[\s_]bằng)\b.*$", regex.I)
_spaces = regex.compile(r"[\s_.,;:]+")


def plain(text: str) -> str:
    """Lower case without accents."""
    return regex.sub(r"\p{M}+", "", unicodedata.normalize("NFD", text.lower())).replace("đ", "d")


def _unit_names() -> set[str]:
    return {f"{a} {b}".strip() for s in SCALES.values() for a in s for bs in BASES.values() for b in bs} | {f"{b} {a}".strip() for s in SCALES.values() for a in s for bs in BASES.values() for b in bs} | {"kusd"}


UNIT_NAMES = _unit_names()


def stems(label: str) -> list[str]:
    """What a label may mean, stripped of its surroundings; several when it holds several lines."""
    whole = _hyphen.sub("", label)
    lines = [x for x in whole.split("\n") if x.strip()]
    out = []
    for s in dict.fromkeys([" ".join(lines), *lines] if len(lines) > 1 else lines):
        for _ in range(3):
            before = s
            s = _unit_word.sub("", s)
            head, comma, tail = s.rpartition(",")
            if comma and _spaces.sub(" ", plain(tail)).strip(" .") in UNIT_NAMES | {x.rstrip(".") for x in UNIT_NAMES} or comma and plain(tail).strip() in UNIT_NAMES:
                s = head
            s = _bracket.sub("", s)
            s = _dash.sub("", s)
            s = _page.sub("", _leader.sub("", s))
            if s == before:
                break
        for _ in range(2):
            s = _number.sub("", s, count=1)
        s = _spaces.sub(" ", s.replace("-", " ").lower()).strip()
        if s:
            out.append(s)
    return out


def skeleton(text: str, confused: bool = True) -> str:
    """Without accents and with single spaces; `confused`: signs that scanning confuses as one sign."""
    s = plain(text).replace("-", " ")
    if confused:
        for a, b in CONFUSED_PAIRS:
            s = s.replace(a, b)
        s = s.translate(CONFUSED)
    return _spaces.sub(" ", s).strip()


def telex(word: str, tones: bool = True) -> str:
    """The keys typed for a Vietnamese word, with or without its tone."""
    tone, out = "", []
    for c in unicodedata.normalize("NFC", word):
        d = unicodedata.normalize("NFD", c)
        for m, t in TELEX_TONES.items():
            if m in d:
                tone, d = t, d.replace(m, "")
        base = unicodedata.normalize("NFC", d)
        out.append(TELEX_LETTERS.get(base, base))
    return "".join(out) + (tone if tones else "")


def _shortened(words: list[str]) -> list[list[str]]:
    """All ways to abbreviate phrases of a name; abbreviations are marked with a leading sign."""
    out = [[]] if not words else []
    if words:
        out = [[words[0], *rest] for rest in _shortened(words[1:])]
        for n in range(1, min(4, len(words)) + 1):
            for s in SHORT.get(plain(" ".join(words[:n])), []):
                out += [["=" + s, *rest] for rest in _shortened(words[n:])]
    return out


def written(name: str) -> list[str]:
    """The ways a reference is written, unconfused: abbreviated or not, small words left out or not, with or without accents, typed in telex."""
    words = _spaces.sub(" ", name.lower().replace("-", " ")).strip().split()
    small = [k for k, w in enumerate(words) if w in SMALL and len(words) > 2]
    lists = [words] + [words[:k] + words[k + 1 :] for k in small] + ([[w for k, w in enumerate(words) if k not in small]] if len(small) > 1 else [])
    forms = set()
    for base in lists:
        for way in _shortened(base):
            for f in (str, telex, lambda w: telex(w, False)):
                forms.add(skeleton(" ".join(w[1:] if w[0] == "=" else f(w) for w in way), confused=False))
    return sorted(forms)


def limit(length: int) -> int:
    """Edits allowed for a skeleton of some length."""
    return 0 if length < 4 else 1 if length < 7 else 2 if length < 14 else 3 if length < 18 else 4


class Reference:
    """One shard of a reference list: the trees of its skeletons and of its unconfused forms, and the names of each entry behind a skeleton."""

    def __init__(self, names: list[tuple[str, str]]) -> None:
        """names: (entry, a name of it) rows."""
        self.names: dict[str, dict[str, set[str]]] = defaultdict(lambda: defaultdict(set))
        self.plain: dict[str, str] = {}
        for entry, name in names:
            for form in written(name):
                s = skeleton(form)
                self.names[s][entry].add(name.lower())
                self.plain[form] = s
        self.tree = Tree(sorted(self.names))
        self.plain_tree = Tree(sorted(self.plain))

    def nearest(self, stems_: list[str]) -> list[list[Found]]:
        """Per stem, the nearest entries within the limit; those found by skeletons before those found unconfused."""
        skeletons = [skeleton(s) for s in stems_]
        limits = np.array([limit(len(s)) for s in skeletons], dtype=np.int64)
        found: list[list[tuple[int, str]]] = [[(0, s)] if s in self.names else [] for s in skeletons]
        slow = [k for k, hits in enumerate(found) if not hits and limits[k]]
        for k, hits in zip(slow, self.tree.within([skeletons[k] for k in slow], limits[slow]), strict=True):
            found[k] = hits
        # A typing error can make or break a confused pair; what is not found so is looked up unconfused.
        rest = [k for k in slow if not found[k]]
        bare = [skeleton(stems_[k], confused=False) for k in rest]
        for k, hits in zip(rest, self.plain_tree.within(bare, np.array([limit(len(s)) for s in bare], dtype=np.int64)), strict=True):
            found[k] = [(d, self.plain[w]) for d, w in hits]
        second = set(rest)
        out = []
        for k, hits in enumerate(found):
            best = min((d for d, _ in hits), default=None)
            out.append([(k in second, d, min(distance(stems_[k], n) for n in names), entry) for d, w in hits if d == best for entry, names in self.names[w].items()])
        return out


def least(found: list[Found]) -> tuple[tuple[bool, int, int], set[str]] | None:
    """The least distance found, and the entries at it."""
    if not found:
        return None
    best = min(found)[:3]
    return best, {f[3] for f in found if f[:3] == best}


def winner(found: list[Found]) -> str:
    """The entry of the least distance, if it is one entry's alone."""
    best = least(found)
    return next(iter(best[1])) if best and len(best[1]) == 1 else UNMATCHED


def searched(labels: list[str], shard: Reference) -> list[list[Found]]:
    """Per label, what its stems find in a shard."""
    parts = [stems(x) for x in labels]
    flat = iter(shard.nearest([s for p in parts for s in p]))
    return [[f for _ in p for f in next(flat)] for p in parts]


def resolved(labels: list[str], shards: list[Reference]) -> list[str]:
    """The entry of each label, or UNMATCHED; shard winners merge."""
    merged = zip(*(searched(labels, r) for r in shards), strict=True)
    return [winner([f for found in by_shard for f in found]) for by_shard in merged]


def mapped_to(df: DataFrame, label: str, names: DataFrame, out: str = "concept", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """df with `out`, the entry that `label` means. names: (entry, name) rows."""
    rows = names.where("entry is not null and name is not null").distinct()
    n = rows.count()
    df = df.drop(out)
    if n > shard:
        return _by_blocks(df, label, rows, out, -(-n // shard), block)
    shipped = df.sparkSession.sparkContext.broadcast(sorted((r["entry"], r["name"]) for r in rows.collect()))  # of a size just counted
    fields = df.columns
    made: dict = {}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if "shard" not in made:
            made["shard"] = Reference(shipped.value)
            made["known"] = {}
        known = made["known"]
        clean, _ = one_form(b.column(fields.index(label)))
        texts = clean.to_pylist()
        new = list(dict.fromkeys(t for t in texts if t and t not in known))
        if len(known) + len(new) > KEPT:
            known.clear()
            new = list(dict.fromkeys(t for t in texts if t))
        known.update(zip(new, resolved(new, [made["shard"]]), strict=True))
        return pa.RecordBatch.from_arrays([*b.columns, pa.array([known[t] if t else UNMATCHED for t in texts], type=pa.string())], names=[*fields, out])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{out}` string"])
    return mapped(df, run, schema)


def _by_blocks(df: DataFrame, label: str, names: DataFrame, out: str, shards: int, block: int) -> DataFrame:
    """mapped_to for a list of several shards: every block of distinct labels meets every shard, one pair in a task."""
    labels = df.where(F.col(label) != "").select(F.col(label).alias("_label")).distinct()
    blocks = max(1, -(-labels.count() // block))
    place = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    asked = labels.select("_label", place("_label", blocks).alias("_b"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_s"))
    held = names.select("entry", "name", place("name", shards).alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_b"))

    def search(asked_: pa.Table, held_: pa.Table) -> pa.Table:
        texts = asked_.column("_label").combine_chunks()
        if not len(texts) or not held_.num_rows:
            return pa.table({"_label": pa.array([], pa.string()), "_d": pa.array([], pa.list_(pa.int32())), "_entries": pa.array([], pa.list_(pa.string()))})
        clean, _ = one_form(texts)
        shard = Reference(sorted(zip(held_.column("entry").to_pylist(), held_.column("name").to_pylist(), strict=True)))
        found = [(t, least(f)) for t, f in zip(texts.to_pylist(), searched(clean.to_pylist(), shard), strict=True)]
        found = [(t, x) for t, x in found if x]
        return pa.table({"_label": pa.array([t for t, _ in found], pa.string()), "_d": pa.array([list(map(int, x[0])) for _, x in found], pa.list_(pa.int32())), "_entries": pa.array([sorted(x[1]) for _, x in found], pa.list_(pa.string()))})

    hits = asked.groupBy("_b", "_s").cogroup(held.groupBy("_b", "_s")).applyInArrow(search, "_label string, _d array<int>, _entries array<string>")
    # Per label and distance the entries unite, then the least distance wins; a label has at most a row per shard.
    by_distance = hits.groupBy("_label", "_d").agg(F.array_distinct(F.flatten(F.collect_list("_entries"))).alias("_entries"))
    won = by_distance.groupBy("_label").agg(F.min_by("_entries", "_d").alias("_entries")).where("size(_entries) = 1").select("_label", F.get("_entries", F.lit(0)).alias("_won"))
    return df.join(won, F.col(label) == F.col("_label"), "left").withColumn(out, F.coalesce("_won", F.lit(UNMATCHED))).drop("_label", "_won")


def concept_names(concepts: DataFrame) -> DataFrame:
    """(entry, name) rows of the concept list: aliases and standard names."""
    return concepts.select(F.col("concept").alias("entry"), F.explode(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("standard_name"))).alias("name"))


def unresolved(facts: DataFrame, concepts: DataFrame) -> DataFrame:
    """Facts whose concept is null or not exactly a key; the keys are joined on equality."""
    keys = concepts.select(F.col("concept").alias("_key")).where("_key is not null").distinct()
    return facts.join(keys, F.col("concept") == F.col("_key"), "left_anti")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    concepts = table(spark, d, "concept_definitions")
    facts = table(spark, d, "financial_facts").select("seq", "concept", "raw_label")
    return mapped_to(unresolved(facts, concepts).drop("concept"), "raw_label", concept_names(concepts)).select("seq", "concept")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Over all rows to be mapped: how many facts each concept won, and each label that means none with its facts (label is null for concepts won)."""
    concepts = table(spark, d, "concept_definitions")
    facts = table(spark, d, "financial_facts").select("concept", "raw_label")
    labels = unresolved(facts, concepts).groupBy("raw_label").agg(F.count("*").alias("facts"))
    won = mapped_to(labels, "raw_label", concept_names(concepts))
    return won.groupBy("concept", F.when(F.col("concept") == UNMATCHED, F.col("raw_label")).alias("label")).agg(F.sum("facts").alias("facts"))


QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
