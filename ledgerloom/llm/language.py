"""Problem 10: languages of documents and of their segments, by hierarchical discrimination.

Level one: linear support vector machines, one versus one, between language families. Level two:
within a family of several languages, one versus one between those. The features of a sentence are
its words and their character n-grams, hashed; as a linear score is a sum over words, each distinct
word is scored once per worker and sentences are sums over table rows.

Training takes a bounded sample of labelled documents (`sample` documents, the lowest by a hash of
the key), since only a classifier is fitted on it. Labels are noisy: after a first fit, sentences the
machines clearly see in another language are dropped and the fit is repeated. Sentences of languages
with accents are also given without them. Scoring covers every sentence of every document.

A sentence whose margin is small, or a piece of one, takes the language of the sentence before it (or, at the start, after
it). Neighbouring sentences of one language make a segment. Null, blank and letterless texts have no
languages and no segments; a text with letters has at least one.
"""

from __future__ import annotations

import itertools
import math
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.arrow import mapped
from ledgerloom.tables import table

# Languages by family.
FAMILIES = {"austroasiatic": ["vi"], "germanic": ["en", "de"], "romance": ["fr"]}
LANGUAGES = [x for f in FAMILIES.values() for x in f]
# Spellings of labels, in lower case; those of one word also before a region or a bracket.
LABELS = {
    "vi": ["vi", "vie", "vietnamese", "viet", "vietnamien", "vietnamesisch", "tiếng việt", "tieng viet"],
    "en": ["en", "eng", "english", "anglais", "englisch", "tiếng anh", "tieng anh"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais", "französisch", "tiếng pháp", "tieng phap"],
    "de": ["de", "deu", "ger", "german", "deutsch", "allemand", "tiếng đức", "tieng duc"],
}
# Words with a full stop that end no sentence.
ABBREVIATIONS = "mio mrd nr ca bzw vgl bzgl inkl exkl etc no inc co ltd corp st mr mrs dr prof m mme tp tr ths ts vd z.b d.h u.a e.g i.e approx fig p pp art"
DIMENSIONS = 1 << 15
#: Training takes at most so many documents, of so many characters, and so many sentences a language.
SAMPLE = 4000
SAMPLE_LENGTHS = (40, 20_000)
SENTENCES_PER_LANGUAGE = 3000
#: The least words of a sentence that decides; a whole sentence decides from fewer words on, with a larger margin.
LEAST_WORDS, LEAST_MARGIN = 4, 0.35
LEAST_WHOLE_WORDS, LEAST_WHOLE_MARGIN = 2, 0.7
_word = regex.compile(r"[\p{L}\p{M}]+")
_end = regex.compile(r"(?<=[.!?…][\"”’)\]]*)\s+(?=[\"“‘(\[]*[\p{Lu}\p{N}\-–])|\s*\n[ \t\r]*\n\s*")
_whole = regex.compile(r"[\p{Lu}“\"«(].*[.!?…][\"”»)]*$", regex.S)
_abbreviation = regex.compile(rf"(?:^|[\s(])(?:{'|'.join(a.replace('.', '[.]') for a in ABBREVIATIONS.split())})\.$", regex.I)


def canonical(label: Column) -> Column:
    """The language a label names, whatever its spelling; null for placeholders and other languages."""
    spelled = {unicodedata.normalize(form, x): lang for lang, many in LABELS.items() for x in many for form in ("NFC", "NFD")}
    known = F.create_map(*[F.lit(x) for pair in spelled.items() for x in pair])
    x = F.lower(F.regexp_replace(label, r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    return F.coalesce(known[x], known[F.regexp_extract(x, r"^[^-_\s\u00a0(]*", 0)])


def sentences(text: str) -> list[tuple[int, int]]:
    """(begin, end) of the sentences of a text; hard line breaks end none, blank lines do."""
    out, begin = [], 0
    for m in _end.finditer(text):
        if "\n" not in m.group() or m.group().count("\n") < 2:
            if _abbreviation.search(text, max(begin, m.start() - 12), m.start()):
                continue
        if m.start() > begin:
            out.append((begin, m.start()))
        begin = m.end()
    if begin < len(text):
        out.append((begin, len(text)))
    return out


def stripped(text: str) -> str:
    """Without accents."""
    return regex.sub(r"\p{M}+", "", unicodedata.normalize("NFD", text)).replace("đ", "d").replace("Đ", "D")


def features(word: str) -> list[int]:
    """Hashed features of one word, lower case: itself, and its n-grams of 1 to 4 letters with its borders."""
    w = f"<{word}>"
    grams = [f"={word}"] + [w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)]
    return [zlib.crc32(g.encode()) % DIMENSIONS for g in grams]


class Machines:
    """The trained machines: weights per feature and decision, and the decisions' two sides."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, sides: list[tuple[str, str]]) -> None:
        self.weights, self.bias, self.sides = weights, bias, sides
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, len(sides)))

    def rows_of(self, tokens: list[str]) -> np.ndarray:
        """The table rows of words; unknown words are scored once."""
        if len(self.index) > 2_000_000:  # memory of a worker; words are scored again when they return
            self.index.clear()
        get = self.index.get
        out = [get(t, -1) for t in tokens]
        for k, at in enumerate(out):
            if at < 0:
                t = tokens[k]
                at = self.index.get(t, -1)
                if at < 0:
                    at = self.index[t] = len(self.index)
                    if at >= len(self.rows):
                        self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                    x = features(unicodedata.normalize("NFC", t))
                    self.rows[at] = self.weights[x].sum(axis=0) / math.sqrt(len(x))
                out[k] = at
        return np.array(out, dtype=np.int64)

    def margins(self, batches: list[list[str]]) -> np.ndarray:
        """Margins of all decisions, a row per list of words."""
        lengths = np.array([len(b) for b in batches])
        flat = list(itertools.chain.from_iterable(batches))
        out = np.tile(self.bias, (len(batches), 1))
        if flat:
            s = self.rows_of(flat)
            some = np.flatnonzero(lengths)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[some]
            out[some] += np.add.reduceat(self.rows[s], starts, axis=0) / np.sqrt(lengths[some])[:, None]
        return out

    def decide(self, batches: list[list[str]]) -> tuple[list[str], np.ndarray]:
        """The language of each list of words, and the margin by which it won: the least of the decisions it won on both levels."""
        m = self.margins(batches)
        families = list(FAMILIES)
        pick, margin = self._vote(m, families)
        out = np.array([""] * len(batches), dtype=object)
        for f, family in enumerate(families):
            at = np.flatnonzero(pick == f)
            langs = FAMILIES[family]
            if len(langs) == 1:
                out[at] = langs[0]
            elif len(at):
                sub, by = self._vote(m[at], langs)
                out[at] = np.array(langs, dtype=object)[sub]
                margin[at] = np.minimum(margin[at], by)
        return list(out), margin

    def _vote(self, m: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        worst = np.full((len(m), len(names)), np.inf)
        votes = np.zeros((len(m), len(names)))
        for k, (a, b) in enumerate(self.sides):
            if a in names and b in names:
                i, j = names.index(a), names.index(b)
                votes[:, i] += m[:, k] > 0
                votes[:, j] += m[:, k] <= 0
                worst[:, i] = np.minimum(worst[:, i], m[:, k])
                worst[:, j] = np.minimum(worst[:, j], -m[:, k])
        pick = np.argmax(votes * 1e6 + worst, axis=1)
        return pick, worst[np.arange(len(m)), pick]


def _fit(x: list[np.ndarray], y: np.ndarray, rounds: int = 6, decay: float = 3e-3, seed: int = 7) -> tuple[np.ndarray, float]:
    """A linear support vector machine by averaged stochastic subgradient steps; y is +1 or -1, classes weigh the same."""
    rng = np.random.default_rng(seed)
    w, total, bias, total_bias = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0, 0.0
    weight = {s: len(y) / (2 * max(1, (y == s).sum())) for s in (1, -1)}
    n, scale = 0, 1.0
    for _ in range(rounds):
        for k in rng.permutation(len(y)):
            n += 1
            step = 1.0 / (1.0 + decay * n * 10)
            i, v = x[k]
            margin = y[k] * (scale * float(w[i] @ v) + bias)
            scale *= 1 - step * decay
            if margin < 1:
                g = step * weight[y[k]] * y[k]
                np.add.at(w, i, g * v / scale)
                bias += 0.1 * g
        total += scale * w
        total_bias += bias
    return total / rounds, total_bias / rounds


def _vector(tokens: list[str], known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The features of a sentence as scoring sums them; known: those of words met before."""
    for t in tokens:
        if t not in known:
            known[t] = np.array(features(unicodedata.normalize("NFC", t)))
    ids = [known[t] for t in tokens]
    i, inverse = np.unique(np.concatenate(ids), return_inverse=True)
    return i, np.bincount(inverse, weights=np.repeat([1 / math.sqrt(len(x)) for x in ids], [len(x) for x in ids])) / math.sqrt(len(tokens))


def fit(rows: list[tuple[str, str]], per_language: int = SENTENCES_PER_LANGUAGE) -> Machines:
    """Machines from (text, language) rows; labels may be wrong here and there."""
    by: dict[str, list[list[str]]] = {x: [] for x in LANGUAGES}
    seen = set()
    for text, lang in rows:
        for a, b in sentences(text):
            s = text[a:b]
            tokens = [w.lower() for w in _word.findall(s)]
            if len(tokens) >= 4 and s not in seen and len(by[lang]) < per_language:
                seen.add(s)
                by[lang].append(tokens)
    data = [(t, x) for x, many in by.items() for t in many]
    pairs = [*itertools.combinations(FAMILIES, 2), *(p for f in FAMILIES.values() for p in itertools.combinations(f, 2))]
    members = FAMILIES | {x: [x] for x in LANGUAGES}
    kept = list(range(len(data)))
    known: dict[str, np.ndarray] = {}
    vector = [_vector(t, known) for t, _ in data]
    bare = {k: _vector([stripped(w) for w in t], known) for k, (t, x) in enumerate(data) if x == "vi"}
    for _ in range(2):
        both = [(vector[k], data[k][1]) for k in kept] + [(bare[k], "vi") for k in kept if k in bare]
        vectors = [v for v, _ in both]
        weights, bias = [], []
        for a, b in pairs:
            side = np.array([1 if x in members[a] else -1 if x in members[b] else 0 for _, x in both])
            at = np.flatnonzero(side)
            if len(set(side[at])) < 2:  # a language without samples: the other side always wins
                weights.append(np.zeros(DIMENSIONS))
                bias.append(1.0 if (side[at] == 1).any() else -1.0)
                continue
            w, c = _fit([vectors[k] for k in at], side[at])
            weights.append(w)
            bias.append(c)
        m = Machines(np.stack(weights, axis=1), np.array(bias), pairs)
        said, margin = m.decide([t for t, _ in data])
        kept = [k for k, ((_, x), s, g) in enumerate(zip(data, said, margin, strict=True)) if s == x or g < 0.2]
    return m


def training_rows(docs: DataFrame, sample: int) -> list[tuple[str, str]]:
    """(text, language) of `sample` labelled documents, the lowest by a hash of the key; at most so many, whatever the table's size."""
    known = canonical(F.col("lang"))
    n = docs.agg(F.count(known)).first()[0]
    if not n:
        return []
    # Keys are taken by their hash up to a share of all labelled rows that gives a little over `sample`, so that is all that travels.
    share = min(1.0, 1.3 * sample / n + 50 / n)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    near = docs.where(place < int(share * (1 << 30))).where(F.length("text").between(*SAMPLE_LENGTHS)).select("doc_id", "text", known.alias("_known")).where("_known is not null")
    rows = near.orderBy(place, "doc_id").limit(sample).select("text", "_known")
    return [(r[0], r[1]) for r in rows.collect()]


def analysed(machines: Machines, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
    """Per text, its segments: (language, begin, end, confidence)."""
    spans, batches, bounds = [], [], [0]
    for t in texts:
        if t and _word.search(t):
            for a, b in sentences(t):
                spans.append((a, b))
                batches.append(_word.findall(t[a:b].lower()))
        bounds.append(len(spans))
    said, margin = machines.decide(batches) if batches else ([], np.empty(0))
    out = []
    for r, t in enumerate(texts):
        rows = range(bounds[r], bounds[r + 1])
        # Whole sentences decide; pieces of sentences only where there are no whole ones.
        clear = [k for k in rows if margin[k] >= LEAST_MARGIN and len(batches[k]) >= LEAST_WHOLE_WORDS]
        sure = [k for k in clear if (len(batches[k]) >= LEAST_WORDS or margin[k] >= LEAST_WHOLE_MARGIN) and _whole.match(t[spans[k][0] : spans[k][1]])]
        sure = sure or [k for k in clear if len(batches[k]) >= LEAST_WORDS]
        if not rows:
            out.append([])
            continue
        if not sure:  # nothing is clear by itself: the text as a whole decides
            whole, by = machines.decide([[w for k in rows for w in batches[k]]])
            conf = 1 / (1 + math.exp(-3 * float(by[0])))
            out.append([(whole[0], spans[rows[0]][0], spans[rows[-1]][1], conf)])
            continue
        segments: list[list] = []
        lang = said[sure[0]]
        firm = set(sure)
        for k in rows:
            if k in firm:
                lang = said[k]
            g = float(margin[k]) if k in firm else 0.0
            words_here = max(1, len(batches[k]))
            if segments and segments[-1][0] == lang:
                segments[-1][2] = spans[k][1]
                segments[-1][3] += g * words_here
                segments[-1][4] += words_here
            else:
                segments.append([lang, *spans[k], g * words_here, words_here])
        out.append([(x, a, b, 1 / (1 + math.exp(-3 * g / n))) for x, a, b, g, n in segments])
    return out


SEGMENTS = "array<struct<lang:string,begin:int,end:int,confidence:double>>"


def labelled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs (doc_id, lang, text) with `named` (the language its label names, or null) and `segments`; the text is left out."""
    m = fit(training_rows(docs, sample))
    shipped = docs.sparkSession.sparkContext.broadcast((m.weights.astype(np.float32), m.bias, m.sides))  # 0.5 MB, fixed
    kind = pa.list_(pa.struct([("lang", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())]))
    made: dict = {}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        if "m" not in made:
            w, bias, sides = shipped.value
            made["m"] = Machines(w.astype(np.float64), bias, sides)
        segments = analysed(made["m"], b.column(3).to_pylist())
        rows = [[{"lang": x, "begin": a, "end": e, "confidence": c} for x, a, e, c in s] for s in segments]
        return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(rows, type=kind)], names=["doc_id", "lang", "named", "segments"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return mapped(docs.select("doc_id", "lang", canonical(F.col("lang")).alias("named"), "text"), run, f"doc_id {key}, lang string, named string, segments {SEGMENTS}")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    out = labelled(table(spark, d, "documents")).withColumn("langs", F.array_distinct(F.col("segments.lang")))
    wrong = F.col("named").isNull() | (F.size("langs") > 1) | (F.get("langs", F.lit(0)) != F.col("named"))
    return out.where((F.size("langs") > 0) & wrong).select("doc_id", F.explode("langs").alias("lang"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of every document with its language, place and confidence."""
    out = labelled(table(spark, d, "documents"))
    return out.select("doc_id", "named", F.posexplode("segments").alias("segment", "s")).select("doc_id", "named", "segment", "s.lang", "s.begin", "s.end", F.round("s.confidence", 3).alias("confidence"))


QUERIES = {"p10_found": p10_found, "p10_segments": p10_segments}
