"""Problem 1: noise in text from scanned pages, repaired into continuous paragraphs.

Averaged perceptrons decide. The character editor goes through a word sign by sign and predicts at each
place keep, replace, delete (two signs were one), insert (one sign was two), or line-join at a line end.
What a place may become are the fixed confusions; its features are the signs around, the shape of the
word (numeral, acronym, code), and how often the best word of the corpus occurs that the choices so far and
this one lead to. A number is judged with its groups joined across '.' and ',', each sign that is no digit by
the form of the whole and its neighbours; it is repaired when all are to be replaced. A line classifier
finds running headers and page numbers by their place in the block, the page number, what is left of
the line without report words, names, codes and years, and whether the line interrupts a sentence; a
third one judges a number that ends a label.

All are trained on damage made by rule: words drawn from the commonest words of the corpus are damaged by
the fixed confusions, mistyped, or left alone; lines are running headers, page numbers, headings or text.

The lexicon counts every word of the corpus (map-side sums, one shuffle). Up to `most` words, counted
first, it is broadcast. A larger one is never gathered: texts are spread over buckets, and each bucket is
joined with the words that its texts can ask about. A word is seen when it occurs twice; beyond that only
ratios of counts and shares of all words play a part, so results are alike at every size.

Null, empty and blank texts have no damage and stay as they are. Tables are never touched.
"""

from __future__ import annotations

import functools
import random
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.arrow import mapped
from ledgerloom.llm.visual_form import one_form
from ledgerloom.tables import table

#: Words of the lexicon that are broadcast, at most; about 10 MB. Beyond it, rows of a bucket.
MOST = 200_000
BUCKET_ROWS = 20_000
#: Words that training draws, of the commonest so many.
DRAWN = 4000
LEARNT = 10_000
#: Misread places of one word, and signs of the longest run that is a word.
MOST_EDITS = 4
LONGEST = 40
# What scanning makes of signs: seen signs, and the signs they stand for.
CONFUSIONS = {
    "0": ["o"], "1": ["i", "l"], "!": ["i"], "|": ["l", "i"], "5": ["s"], "6": ["b", "g"], "7": ["t"], "8": ["b"], "9": ["g"],
    "li": ["h"], "rn": ["m"], "cl": ["d", "đ"], "vv": ["w"], "ii": ["u", "n"], "u'": ["ư"], "o'": ["ơ"], "c": ["e"], "ä": ["ă"], "ö": ["ô"], "nn": ["m"],
}
NUMERIC = {"o": "0", "O": "0", "l": "1", "I": "1", "S": "5", "B": "8", "Z": "2", "g": "9", "i": "1", "!": "1", "|": "1"}
# Words of running headers and of page numbers, without accents.
REPORT_WORDS = set("bao cao nam cua mau ky ban in noi bo phan thuyet minh kem theo annual statements report of form year internal print notes to the accompanying financial copy issue working attached b".split())
PAGE_WORDS = {"trang", "tr", "page", "p", "pg", "of", "so"}
ANY_WORDS = REPORT_WORDS | PAGE_WORDS

_hyphen = regex.compile(r"([\p{L}\p{M}0-9!|']+)([-‐¬­])[ \t]*\r?\n[ \t]*([\p{L}\p{M}0-9!|']+)")
_piece = regex.compile(r"[\p{L}\p{M}\p{N}!|'’]+")
# A run of digits and of signs that scanning makes of them; '.' and ',' join the groups of one number.
_number = regex.compile(r"(?<![\p{L}\p{M}\p{N}])[0-9OolISBZgi!|]++(?:[.,][0-9OolISBZgi!|]++(?![\p{L}\p{M}\p{N}]))*+(?![\p{L}\p{M}\p{N}])")
_sign = regex.compile(r"<[^<>\n]*>|&#?\w+;|\\\[.*?\\\]|\$[^$\n]*\\[^$\n]*\$|\\[a-zA-Z]+|\{[^{}\n]*\}|\]\([^()\s]*\)|`[^`\n]*`|'{2,}|\|")
_code = regex.compile(r"\p{Lu}{1,4}\d{1,6}|\d+|\p{L}|[IVXLivxl]+|\d+\p{L}|[a-km-z]\d{1,3}")
_ending = regex.compile(r"(?P<lead>\s*[._·…]{3,}\s*|(?:\s+[._·…]){2,}\s*|\s+)(?P<word>(?:trang|page|tr|p)\b\.?\s*)?(?P<n>\d{1,4})(?P<tail>(?=\s*$)|(?=\s*[\[(][^\[\]()]*[\])]\s*$)|(?=\s*,[^,]*$)|(?=\s+-\s+\D.*$))", regex.I)
_end = regex.compile(r"[.!?:;…][\"”’)\]]*\s*$")
_inside = regex.compile(r"(?=.{4})\p{L}[\p{Ll}\p{M}]*[0159!|678][\p{Ll}\p{M}]+")
_confusable = regex.compile("|".join(map(regex.escape, CONFUSIONS)))
_roman = regex.compile(r"[IVXLC]{2,}|[ivx]{2,}")
_accents = regex.compile(r"\p{M}+")
_alnum = regex.compile(r"[\p{L}\p{N}]+")
_named = regex.compile(r"\p{L}[\p{L}\p{N}]*")
_last = regex.compile(r"[\p{L}\p{N}]*$")
_form = regex.compile(r"b\d+")
_token = regex.compile(r"\S+")


def plain(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return _accents.sub("", unicodedata.normalize("NFD", text.lower())).replace("đ", "d")


plain_word = functools.lru_cache(200_000)(plain)


# ---- Words ------------------------------------------------------------------------------------------


Edit = tuple[int, str, str]  # place in the word, seen, meant


def variants(word: str, starts: set[str] | None = None, most: int = MOST_EDITS) -> dict[str, tuple[Edit, ...]]:
    """Words that up to `most` confusions, undone, lead to (lower case), each with the fewest edits that do. starts: beginnings of words, and no others, are followed."""
    out: dict[str, tuple[Edit, ...]] = {}
    stack: list[tuple[int, str, tuple[Edit, ...]]] = [(0, "", ())] if len(word) <= LONGEST else []
    while stack:
        at, built, edits = stack.pop()
        if at == len(word):
            if edits and (built not in out or len(edits) < len(out[built])):
                out[built] = edits
            continue
        options = [(1, word[at], edits)]
        if len(edits) < most:
            options += [(n, m, (*edits, (at, word[at : at + n], m))) for n in (1, 2) if at + n <= len(word) for m in CONFUSIONS.get(word[at : at + n], ())]
        for n, m, e in options:
            if starts is None or built + m in starts:
                stack.append((at + n, built + m, e))
    return out


class Perceptron:
    """An averaged perceptron over sets of named features."""

    def __init__(self) -> None:
        self.weights: dict[str, dict[str, float]] = {}
        self.ahead: dict[tuple[str, str], dict[str, float]] = {}

    def scores(self, features: Iterable[str]) -> dict[str, float]:
        out: dict[str, float] = defaultdict(float)
        for f in features:
            for label, w in self.weights.get(f, {}).items():
                out[label] += w
        return out

    def over(self, features: list[str], label: str, other: str) -> bool:
        """Whether one label is ahead of another; the differences of their weights are kept."""
        if (label, other) not in self.ahead:
            self.ahead[label, other] = {f: w.get(label, 0.0) - w.get(other, 0.0) for f, w in self.weights.items()}
        get = self.ahead[label, other].get
        return sum([get(f, 0.0) for f in features]) > 0

    def best(self, features: list[str], labels: Iterable[str]) -> str:
        s = self.scores(features)
        return max(labels, key=lambda x: (s.get(x, 0.0), x))

    def train(self, rows: list[tuple[list[str], str, tuple[str, ...]]], rounds: int = 5, seed: int = 5) -> Perceptron:
        """rows: features, the right label, the labels to choose from."""
        total: dict[tuple[str, str], float] = defaultdict(float)
        stamp: dict[tuple[str, str], int] = defaultdict(int)
        live: dict[tuple[str, str], float] = defaultdict(float)
        rng, n = random.Random(seed), 0
        for _ in range(rounds):
            rng.shuffle(rows)
            for features, right, labels in rows:
                n += 1
                s = {x: sum(live.get((f, x), 0.0) for f in features) for x in labels}
                said = max(labels, key=lambda x: (s[x], x))
                if said != right:
                    for f in features:
                        for x, d in ((right, 1.0), (said, -1.0)):
                            k = (f, x)
                            total[k] += (n - stamp[k]) * live[k]
                            stamp[k] = n
                            live[k] += d
        for k, w in live.items():
            mean = (total[k] + (n - stamp[k]) * w) / n
            if mean:
                self.weights.setdefault(k[0], {})[k[1]] = mean
        return self


def _bucket(ratio: float) -> str:
    return "none" if ratio <= 0 else "<1" if ratio < 1 else "<4" if ratio < 4 else "<15" if ratio < 15 else "<60" if ratio < 60 else "60+"


Candidate = tuple[str, tuple[Edit, ...], int]  # a word, the edits that lead to it, how often it occurs


class Editor:
    """The character editor with a lexicon."""

    def __init__(self, lexicon: dict[str, int], total: int | None = None) -> None:
        """total: all words of the corpus, if the lexicon is a part of it."""
        self.lexicon = lexicon
        self.total = total or max(1, sum(lexicon.values()))
        self.unaccented: dict[str, int] = {}
        for w, n in lexicon.items():
            if not w.isascii():
                p = plain(w)
                self.unaccented[p] = max(n, self.unaccented.get(p, 0))
        self.starts = {w[:k] for x in (lexicon, self.unaccented) for w in x for k in range(len(w) + 1)}
        self.model = Perceptron()
        self.known: dict[str, str | None] = {}
        self.joins: dict[tuple[str, str, str], bool] = {}
        self.numbers: dict[tuple[str, str, str], str | None] = {}

    def count(self, word: str) -> int:
        """How often a word occurs, counting it as the unaccented spelling of others, too."""
        return max(self.lexicon.get(word, 0), self.unaccented.get(word, 0))

    def share(self, count: int) -> str:
        """How common a word is among all words, in steps."""
        million = count * 1e6 / self.total
        return "none" if not count else "<1" if million < 1 else "<10" if million < 10 else "<100" if million < 100 else "<1000" if million < 1000 else "1000+"

    def candidates(self, piece: str) -> list[Candidate]:
        """The words of the corpus that confusions of this one lead to; if there are none, the word that a lone sign between its letters leaves."""
        word = piece.lower()
        out = [(v, e, self.lexicon[v]) for v, e in variants(word, self.starts).items() if v in self.lexicon]
        if not out and _inside.fullmatch(piece):
            at = next(k for k, c in enumerate(word) if not c.isalpha())
            meant = CONFUSIONS[word[at]][0]
            out = [(word[:at] + meant + word[at + 1 :], ((at, word[at], meant),), 0)]
        return out

    @staticmethod
    def shape(piece: str) -> str:
        """What a word looks like: a numeral, an acronym, a code (letters or digits with one of the other), two letters, or a word."""
        if _roman.fullmatch(piece):
            return "roman"
        if piece.isalpha():
            return "acronym" if piece.isupper() and len(piece) <= 4 else "two" if len(piece) < 3 else "word"
        if _code.fullmatch(piece):
            return f"code{'9' if piece[0].isdigit() else 'A' if piece[0].isupper() else 'a'}{min(len(piece), 4)}"
        return "mixed"

    def features(self, word: str, shape: str, at: int, seen: str, best: Candidate) -> list[str]:
        """Of one choice at one place of a word: the signs there and around, the shape of the word, and what the lexicon says of the best word that it leads to."""
        target, edits, n = best
        left = word[at - 1] if at else "^"
        right = word[at + len(seen)] if at + len(seen) < len(word) else "$"
        kind = lambda c: "a" if c.isalpha() else "9" if c.isdigit() else c if c in "^$" else "?"
        sign = not seen.isalpha()
        b, f = _bucket(n / (self.count(word) + 0.5)), self.share(n)
        return [
            "1", f"s={seen}", f"k={sign}{kind(left)}{kind(right)}", f"r={b}{sign}", f"r={b}{sign}{min(len(edits), 3)}", f"n={min(len(word), 5)}{sign}", f"known={word in self.lexicon}{b}{sign}",
            f"shape={shape}", f"shape={shape}{b}", f"shape={shape}{f}", f"short={word.isalpha()}{min(len(target), 3)}{min(len(word), 3)}", f"f={f}{sign}{min(len(word), 3)}", f"lone={n == 0}{kind(left)}{kind(right)}",
        ]

    @staticmethod
    def operation(seen: str, meant: str) -> str:
        """replace, or with it delete (two signs were one) or insert (one sign was two)."""
        return "replace" if len(seen) == len(meant) else "delete" if len(seen) > len(meant) else "insert"

    @staticmethod
    def _choices(live: list[Candidate], at: int) -> dict[Edit, Candidate]:
        """What a place may become, each with the commonest word it leads to, fewer edits counting double."""
        out: dict[Edit, Candidate] = {}
        for c in live:
            for e in c[1]:
                if e[0] == at and (e not in out or c[2] / 2 ** len(c[1]) > out[e][2] / 2 ** len(out[e][1])):
                    out[e] = c
        return out

    @staticmethod
    def _still(live: list[Candidate], at: int, edit: Edit | None) -> list[Candidate]:
        return [c for c in live if (edit in c[1] if edit else all(e[0] != at for e in c[1]))]

    def decide(self, piece: str) -> str | None:
        """The word after the operations predicted from left to right (lower case), or None when it is kept."""
        word, shape = piece.lower(), self.shape(piece)
        live = self.candidates(piece)
        chosen: tuple[Edit, ...] = ()
        at = 0
        while live and at < len(word):
            best, edit = 0.0, None
            for e, c in sorted(self._choices(live, at).items(), key=lambda x: -x[1][2]):
                s = self.model.scores(self.features(word, shape, at, e[1], c))
                margin = s.get(self.operation(e[1], e[2]), 0.0) - s.get("keep", 0.0)
                if margin > best:
                    best, edit = margin, e
            live = self._still(live, at, edit)
            if edit:
                chosen += (edit,)
            at += len(edit[1]) if edit else 1
        return next((v for v, e, _ in live if e == chosen), None) if chosen else None

    def _rows(self, piece: str, truth: str | None) -> list[tuple[list[str], str, tuple[str, ...]]]:
        """Training rows along the right choices of a word; truth: what it is damaged from, if it is."""
        word, shape = piece.lower(), self.shape(piece)
        live = self.candidates(piece)
        right = next((e for v, e, _ in live if v == truth), ())
        rows, at = [], 0
        while live and at < len(word):
            for e, c in self._choices(live, at).items():
                op = self.operation(e[1], e[2])
                rows.append((self.features(word, shape, at, e[1], c), op if e in right else "keep", ("keep", op)))
            edit = next((e for e in right if e[0] == at), None)
            live = self._still(live, at, edit)
            at += len(edit[1]) if edit else 1
        return rows

    def repaired(self, piece: str) -> str | None:
        """A repaired piece of text (a run of letters, digits and confusable signs), or None when nothing is wrong with it."""
        if piece in self.known:
            return self.known[piece]
        if len(self.known) > 400_000:
            self.known.clear()
        out = self._repaired(piece)
        self.known[piece] = out
        return out

    def _repaired(self, piece: str) -> str | None:
        bare = piece.replace("’", "'").strip("'")
        lower = bare.lower()
        letters = sum(c.isalpha() for c in lower)
        if not letters or not _confusable.search(lower):
            return None
        fixed = self.decide(bare)
        if fixed is None:
            return None
        if piece.isupper() and letters > 1:
            fixed = fixed.upper()
        elif piece[0].isupper() or piece[0] in "78" and lower[1:].isalpha():
            fixed = fixed[:1].upper() + fixed[1:]
        return fixed

    def number_features(self, number: str, at: int, before: str, after: str) -> list[str]:
        """Of one sign of a number whose groups are joined: the signs there and around, the form of the number, and what stands beside it."""
        kind = lambda c: "9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c
        beside = lambda c: c if c in "^ .,;:()[]%$-–/&'’+~" else "?"
        c, left, right = number[at], number[at - 1] if at else "^", number[at + 1 : at + 2] or "$"
        groups, digits = regex.split("[.,]", number), sum(x.isdigit() for x in number)
        meant = "".join(NUMERIC.get(x, x) for x in number)
        if len(groups) > 1:
            form = "grouped" if len(groups[0]) <= 3 and all(len(g) == 3 for g in groups[1:]) else "decimal" if len(groups) == 2 and len(groups[1]) <= 2 else "parts"
        else:
            form = "lone" if len(number) == 1 else "year" if len(number) == 4 and meant[:2] in ("19", "20") else "plain"
        code = _code.fullmatch(number) is not None
        word = len(groups) == 1 and len(number) > 1 and max((self.count(v) for v in (number.lower(), *variants(number.lower(), self.starts)) if v.isalpha()), default=0) >= self.common
        roman = any(set(g) <= {"I"} for g in groups)
        known = f"{form}{min(digits, 3)}{word}"
        return [
            "#1", f"#s={c}{form}", f"#k={kind(left)}{c}{kind(right)}", f"#k={kind(left)}{kind(c)}{kind(right)}{form}", f"#n={known}", f"#code={code}{form}", f"#code={code}{form}{c}", f"#roman={roman}{form}{digits > 0}", f"#lead={kind(number[0])}{form}{',' in number}",
            f"#before={beside(before or ' ')}{form}", f"#after={beside(after or ' ')}{form}", f"#lone={form == 'lone' and c + beside(before or ' ')}", f"#lone={form == 'lone' and c + beside(after or ' ')}", f"#only={digits == 0}{form}", f"#groups={len(groups)}{form}{digits > 0}",
            f"#shape={''.join(map(kind, number)) if len(number) < 6 else form}", f"#tail={sum(not x.isdigit() for x in number) == 1}{at == len(number) - 1}{form}{c}",
        ]

    @property
    def common(self) -> float:
        """How often a word occurs that training draws: five times in a million words."""
        return max(2.0, 5e-6 * self.total)

    def number(self, number: str, before: str = "", after: str = "") -> str | None:
        """The number that a run of digits and confusable signs stands for, or None when it is kept."""
        if not any(c in NUMERIC for c in number):
            return None
        key = (number, before, after)
        if key not in self.numbers:
            if len(self.numbers) > 400_000:
                self.numbers.clear()
            wrong = all(self.model.best(self.number_features(number, k, before, after), ("keep", "replace")) == "replace" for k, c in enumerate(number) if c in NUMERIC)
            self.numbers[key] = "".join(NUMERIC.get(c, c) for c in number) if wrong else None
        return self.numbers[key]

    def _number_rows(self, seed: int = 7, drawn: int = DRAWN) -> list[tuple[list[str], str, tuple[str, ...]]]:
        """Training numbers made by rule: grouped, decimal, years and plain ones, damaged in any place; codes, numerals and words of the same signs."""
        rng = random.Random(seed)
        back = {"0": "OOOOOo", "1": "lllllIIi!|", "2": "Z", "5": "S", "8": "B", "9": "g"}
        rows: list[tuple[list[str], str, tuple[str, ...]]] = []

        def add(number: str, before: str, after: str, label: str) -> None:
            rows.extend((self.number_features(number, k, before, after), label, ("keep", "replace")) for k, c in enumerate(number) if c in NUMERIC)

        for _ in range(drawn):
            form, sep = rng.choice(["grouped", "grouped", "grouped", "decimal", "year", "year", "plain", "lone"]), rng.choice(".,")
            before, after = rng.choice(["", "", "", "", "(", "-", "$", "/", "–", "~", "+"]), rng.choice(["", "", "", ".", ",", ")", "%", ";", ":", "/", "-", "’"])
            if form == "grouped":
                n = f"{rng.randint(1, 10 ** rng.randint(1, 3) - 1)}{''.join(f'{sep}{rng.randint(0, 999):03d}' for _ in range(rng.choice([1, 1, 1, 2, 2, 3])))}"
            elif form == "decimal":
                n, after = f"{rng.randint(0, 999)}{sep}{rng.randint(0, 99 if rng.random() < 0.5 else 9)}", rng.choice([after, "%", "%"])
            elif form == "year":
                n = str(rng.randint(1990, 2039))
            elif form == "plain":
                n = str(rng.randint(100, 99_999))
            else:
                n, before, after = rng.choice("01"), rng.choice(["", "", "^", "$"]), rng.choice(["", "", ",", "%", ";", ":"])
            places = [k for k, c in enumerate(n) if c in back]
            if places:
                v = list(n)
                for k in rng.sample(places, min(len(places), rng.choice([1, 1, 2, 2, 3, 9]))):
                    v[k] = rng.choice(back[n[k]])
                if form == "lone":
                    v = ["l" if n == "1" else "O"]
                # A plain number whose only letter is the first or the last looks like a code and is none here.
                if form != "plain" or not _code.fullmatch("".join(v)):
                    add("".join(v), before, after, "replace")
        letters, small = "OISBZ", "oligi!|"
        words = sorted(w for w, n in self.lexicon.items() if n >= self.common and len(w) > 1)
        likely = [v for w in words for v in (w, w.upper(), *(w.replace(a, b) for a, b in (("o", "0"), ("i", "1"), ("l", "1"), ("s", "5"), ("g", "9")))) if _number.fullmatch(v) and any(c in NUMERIC for c in v)]
        for _ in range(drawn):
            before, after = rng.choice(["", "", "", "(", "-", "/", ".", "’", "'", "&"]), rng.choice(["", "", "", ".", ",", ")", ":", "-", "/", "’", "'", "&"])
            a, n = rng.choice(letters), rng.randint(1, 99)
            kind = rng.random()
            if kind < 0.25:  # codes
                v = rng.choice([f"{a}{n}", f"{a}{n}", f"{a}{rng.choice(letters)}{rng.randint(0, 399):03d}", f"{a}{rng.randint(1, 9)}{a}", f"{n}{rng.choice(letters + 'gl')}", f"{a}{rng.randint(100, 999)}"])
            elif kind < 0.5:  # numbers of sections
                v = rng.choice([f"{a}.{rng.randint(1, 30)}", f"{a}.{rng.randint(1, 9)}.{rng.randint(1, 9)}", f"{a}.{'I' * rng.randint(1, 3)}", f"{'I' * rng.randint(1, 3)}.{rng.randint(1, 12)}", f"{rng.randint(1, 9)}.{a}", f"{rng.randint(1, 12)}.{'I' * rng.randint(1, 3)}", f"{a}.{rng.choice(letters)}"])
                before, after = rng.choice(["", "", "", "("]), rng.choice(["", "", ".", ")", ":"])
            elif kind < 0.75:  # one sign: numerals, names, list marks
                v = rng.choice(["I", "B", "S", "i", "o", "g", "Z", "!", "|", "l", "O", "i"])
                if v in "lO":
                    before, after = rng.choice([("(", ")"), ("", "'"), ("", "’"), ("&", ""), ("", "&"), (".", ""), ("", "."), ("-", ""), ("", "-"), ("’", ""), ("'", ""), ("", ")")])
            elif kind < 0.85:
                v = "I" * rng.randint(2, 3)
            elif kind < 0.93 or not likely:
                v = "".join(rng.choice(small) for _ in range(rng.randint(2, 3)))
            else:
                v = rng.choice(likely)
            add(v, before, after, "keep")
        return rows

    def join_features(self, a: str, sign: str, b: str) -> list[str]:
        x = self.lexicon.get
        a, b = a.lower(), b.lower()
        joined, split = x(a + b, 0), x(f"{a}-{b}", 0)
        return ["1", f"sign={sign != '-'}", f"joined={_bucket(joined)}", f"split={_bucket(split)}", f"parts={x(a, 0) > 0}{x(b, 0) > 0}{joined > 0}", f"digits={a[-1:].isdigit()}{b[:1].isdigit()}", f"more={joined > split}{split > 0}"]

    def joins_line(self, a: str, sign: str, b: str) -> bool:
        """Whether a hyphen at a line end splits one word."""
        key = (a, sign, b)
        if key not in self.joins:
            if len(self.joins) > 400_000:
                self.joins.clear()
            self.joins[key] = self.model.best(self.join_features(a, sign, b), ("keep", "line-join")) == "line-join"
        return self.joins[key]

    def fit(self, seed: int = 3, drawn: int = DRAWN) -> Editor:
        """Training on words of the lexicon, damaged by rule, mistyped, or left alone, and on numerals, acronyms and codes."""
        rng = random.Random(seed)
        words = sorted((w for w, n in self.lexicon.items() if n >= self.common and w.isalpha() and len(w) > 1), key=lambda w: (-self.lexicon[w], w))
        rows: list[tuple[list[str], str, tuple[str, ...]]] = []
        if words:
            back = defaultdict(list)
            for seen, meants in CONFUSIONS.items():
                for m in meants:
                    back[m].append(seen)
            mistyped = lambda w, k: rng.choice([w[:k] + w[k] + w[k:], w[:k] + w[k + 1 :] or w, w[:k] + w[k : k + 2][::-1] + w[k + 2 :]])

            def damaged(w: str, places: list[int], signs: bool = False) -> str:
                for k in sorted(places, reverse=True):
                    w = w[:k] + rng.choice([x for x in back[w[k]] if not signs or not x[-1].isalpha()] or back[w[k]]) + w[k + 1 :]
                return w

            cased = lambda w: rng.choice([w, w, w, w.capitalize(), w.upper()])
            for w in rng.choices(words, weights=[self.lexicon[w] ** 0.5 for w in words], k=drawn):
                kind = rng.random()
                v, truth = w, None
                if kind < 0.5:
                    places = [k for k, c in enumerate(w) if c in back]
                    if places and len(w) > 2 or any(not x[-1].isalpha() for k in places for x in back[w[k]]):
                        v, truth = damaged(w, rng.sample(places, min(len(places), rng.choice([1, 1, 1, 2]))), signs=len(w) < 3), w
                        if len(w) < 3 and v.isalpha():
                            v, truth = w, None
                elif kind < 0.75:  # typing errors: doubled, dropped and swapped letters
                    v = mistyped(w, rng.randrange(len(w)))
                elif len(w) > 3:  # a misread sign within a mistyped word
                    places = [k for k, c in enumerate(w) if 0 < k < len(w) - 1 and any(not x[-1].isalpha() for x in back.get(c, ()))]
                    if places:
                        k = rng.choice(places)
                        x = rng.choice([x for x in back[w[k]] if not x[-1].isalpha()])
                        v = mistyped(w[:k], rng.randrange(k)) + x + w[k + 1 :]
                        only = self.candidates(v)
                        truth = only[0][0] if len(only) == 1 and not only[0][2] else None
                        if truth is None:
                            continue
                if v in self.lexicon and v != w and self.lexicon[v] * 15 > self.lexicon[w]:
                    continue  # another word of the corpus
                rows += self._rows(v if len(w) < 3 else cased(v), truth)
            for w in words:  # words of the corpus that confusions would make other words of it
                if max((n for _, _, n in self.candidates(w)), default=0) < 15 * self.count(w):
                    rows += self._rows(w, None)
            letters = "ABCDEFGHIKLMNOPQRSTUVXYZ"
            for _ in range(drawn // 2):  # numerals, acronyms, codes and pairs of letters
                n, c = rng.randint(1, 9999), rng.choice(letters)
                v = rng.choice([
                    "".join(rng.choice("IVX") for _ in range(rng.randint(2, 4))), "".join(rng.choice("ivx") for _ in range(rng.randint(2, 3))), "".join(rng.choice(letters) for _ in range(rng.randint(2, 4))),
                    f"{c}{n % 10 ** rng.randint(1, 4)}", f"{c}{rng.choice(letters)}{n % 1000}", f"{n % 100}{c}", f"{n % 100}{c.lower()}", f"{rng.choice('bcdghklmtv')}{n % 100}", rng.choice(letters).lower() + rng.choice(letters).lower(), f"{c}{n % 10}{rng.choice(letters)}",
                ])
                if v.lower() not in self.lexicon or len(v) < 3 or not v.isalpha():
                    rows += self._rows(v, None)
            for w in rng.choices(words, k=drawn // 4):
                if len(w) > 2:
                    k = rng.randrange(1, len(w))
                    rows.append((self.join_features(w[:k], rng.choice("-‐¬­"), w[k:]), "line-join", ("keep", "line-join")))
                other = rng.choice(words)
                if w + other not in self.lexicon:
                    rows.append((self.join_features(w, "-", other), "keep", ("keep", "line-join")))
            for w in sorted(x for x in self.lexicon if "-" in x):
                a, _, b = w.partition("-")
                rows.append((self.join_features(a, "-", b), "keep", ("keep", "line-join")))
        self.model.train(rows)
        self.model.train(self._number_rows())  # no feature is shared with words
        return self


# ---- Lines ------------------------------------------------------------------------------------------


def ended(line: str) -> bool:
    """Whether a line ends a sentence or clause, before closing quotes and brackets."""
    return line.rstrip().rstrip("\"”’)]")[-1:] in tuple(".!?:;…")


@functools.lru_cache(10_000)
def _spared_words(name: str) -> set[str]:
    """Words of running headers that may be in small letters: those of reports, of kinds of companies, and of a name."""
    return REPORT_WORDS | set(name.split()) | {"cong", "ty", "doan", "tap", "tong", "co", "phan"}


def line_features(lines: list[str], k: int, page: int | None, code: str, year: str, name: str) -> list[str]:
    """Of line k of a block: its place, its numbers, and what is left of it without report words, names, codes and years."""
    line = lines[k].strip()
    own = code.lower()
    f = plain(line)
    had_name = bool(name) and name in f
    had_code = bool(own) and own in f
    had_year = bool(year) and year in f
    tokens = _alnum.findall(f.replace(name, " ") if had_name else f)
    numbers = [t for t in tokens if t.isdigit()]
    named = [t for t in tokens if not t.isdigit()] if numbers else tokens
    reported = sum([t in REPORT_WORDS for t in named])
    rest = [t for t in named if t not in ANY_WORDS and not (had_code and own in t) and not (t[0] == "b" and _form.fullmatch(t))]
    originals = _named.findall(line)
    small = [t for t in originals if t[0].islower()]
    capitals = len(originals) > 2 and sum([t[0].isupper() for t in originals]) >= 0.6 * len(originals)
    spared, low = _spared_words(name), 0
    for t in small:
        if plain_word(t) not in spared:
            low += 1
            if low == 3:  # no feature tells more
                break
    dash = " – " in line or " | " in line or " - " in line
    page_only = bool(numbers) and len(tokens) <= 4 and not had_name and all(t in PAGE_WORDS for t in named)
    before, after = (lines[k - 1].strip() if k else ""), (lines[k + 1].strip() if k + 1 < len(lines) else "")
    cut = bool(before) and not ended(before)
    goes_on = bool(after) and (after[0].islower() or after[0].isdigit() or cut)
    place = "only" if len(lines) == 1 else "first" if not k else "last" if k == len(lines) - 1 else "middle"
    mine = page is not None and str(page) in numbers
    closed = ended(line) and not line.endswith(":") and not page_only
    marks = had_name + had_code + had_year
    return [
        "1", f"place={place}", f"page={page_only}{mine}", f"page={page_only}{mine}{place}", f"rest={min(len(rest), 3)}{marks > 0}", f"marks={marks}", f"marks={marks}{min(len(rest), 3)}{closed}",
        f"closed={closed}{page_only}", f"cut={cut and goes_on}{page_only}{marks > 0}", f"all={not rest and marks > 0 and not closed}", f"numbers={min(len(numbers), 3)}{page_only}", f"named={had_name}{had_year}{had_code}",
        f"words={min(len(named), 12) // 3}", f"caps={capitals}{dash}{closed}{min(marks, 2)}", f"table={line[:1] in '|{!`<' or (line[:2] in ('- ', '* ') and not page_only)}{page_only}", f"parts={dash}{had_year}{closed}{reported >= 2}", f"low={min(low, 3)}{min(marks, 2)}", f"core={min(len(rest), 3)}{min(low, 3)}{had_name}{had_year}{had_code}{closed}{page_only}", f"low={min(low, 3)}{dash}{closed}", f"clean={low == 0 and marks > 1 and not closed}{dash}", f"short={len(rest) <= 2}{min(marks, 2)}{dash}{closed}", f"sure={had_name}{had_year}{had_code}{dash}{goes_on}", f"report={reported >= 2}{marks > 0}{not rest}",
    ]


def _line_rows(seed: int = 9, blocks: int = 3000) -> list[tuple[list[str], str, tuple[str, ...]]]:
    """Training lines made by rule: text wrapped at some width, with headings, running headers and page numbers in some places."""
    rng = random.Random(seed)
    syllables = "chi phí bán hàng tồn kho năm vốn động the cost sales group under note plan được ghi nhận tháng quý với trong and was total báo cáo của phần theo report statements".split()
    names = "Lưu Trúc Mộc Sa Hồ Đà Khê Minh Điền Ngọc Tú Cẩm".split()
    rows = []
    for _ in range(blocks):
        code = "".join(rng.choice("HJKQVWXZ") for _ in range(2)) + f"{rng.randint(0, 399):03d}"
        year, page = str(rng.randint(2010, 2025)), rng.randint(1, 60)
        name = rng.choice(["Công ty Cổ phần", "Công ty TNHH", "Tập đoàn", "Tổng Công ty"]) + " " + " ".join(rng.sample(names, 3))
        known = plain(name) if rng.random() < 0.8 else ""  # some names are in no list
        words: list[str] = []
        for _ in range(rng.randint(2, 6)):
            s = [rng.choice(syllables) if rng.random() < 0.8 else str(rng.choices([page, year, rng.randint(1, 99999)], weights=[1, 1, 12])[0]) for _ in range(rng.randint(8, 25))]
            if rng.random() < 0.4:
                s[rng.randrange(len(s)) : 0] = [*name.split()]
            if rng.random() < 0.2:
                s += [rng.choice(["năm", "in", "trang", "page"]), rng.choice([year, str(page), str(rng.randint(1, 40))])]
            if not words and rng.random() < 0.2:  # a name soon after the beginning, where lines may end
                s[rng.randint(2, 5) : 0] = [*name.split()]
            s[0] = s[0].capitalize()
            s[-1] += "."
            words += s
        width, lines = rng.choice([58, 66, 76, 82, 10_000]), [""]
        for w in words:
            if len(lines[-1]) + len(w) > width:
                lines.append(w)
            else:
                lines[-1] = f"{lines[-1]} {w}".strip()
        label = ["text"] * len(lines)
        if rng.random() < 0.3:
            h = " ".join(rng.choice(syllables) for _ in range(rng.randint(2, 6)))
            lines.insert(0, rng.choice([h.upper(), f"{rng.randint(1, 30)}. {h.capitalize()}", h.capitalize()]))
            label.insert(0, "text")
        if rng.random() < 0.25:  # tables, lists and code are text, too
            at = rng.choice([0, len(lines)])
            h = " ".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
            more = rng.choice([[f"| {h} | vi |", "|---|---:|", f"| {h} | {rng.randint(1, 90)} |"], [f"- {h}", f"* {h} {page}"], ["```", f"total = a + b - {page}", "```"], [f"<h3>{h}</h3>"], ["{| class=wikitable", f"! {h}", "|-", f"| {page} {h}", "|}"]])
            lines[at:at] = more
            label[at:at] = ["text"] * len(more)
        if rng.random() < 0.15:  # a label, alone or under a running header
            lines, label = [rng.choice(["A - ", "II. ", "1. ", "- ", ""]) + " ".join(rng.choice(syllables) for _ in range(rng.randint(2, 7))).capitalize() + rng.choice(["", "", " - đơn vị đồng", " (TM 5)", ":"])], ["text"]
            if rng.random() < 0.7:
                lines.insert(0, _header(rng, name, code, year, page))
                label.insert(0, "furniture")
            rows += [(line_features(lines, k, page, code, year, known), x, ("text", "furniture")) for k, x in enumerate(label)]
            continue
        for make, chance in ((_header, 0.35), (_page_number, 0.35)):
            if rng.random() < chance:
                at = rng.choice([0, len(lines), rng.randint(0, len(lines))])
                lines.insert(at, make(rng, name, code, year, page))
                label.insert(at, "furniture")
        for k, x in enumerate(label):
            rows.append((line_features(lines, k, page, code, year, known), x, ("text", "furniture")))
    return rows


def ending_features(text: str, m: regex.Match, page: int | None) -> list[str]:
    """Of a number that ends a label: what leads to it, what follows it, and whether it is the page's or a year."""
    lead = "dots" if any(c in "._·…" for c in m["lead"]) else "space"
    word = m["word"] is not None
    last = _last.search(text[: m.start()])[0]
    tail = text[m.end() :].strip()[:1] or "$"
    n = m["n"]
    return ["1", f"lead={lead}", f"word={word}", f"lead={lead}{word}", f"tail={tail}{lead}", f"page={page is not None and n == str(page)}{lead}{word}", f"size={len(n)}{lead}{word}", f"year={len(n) == 4 and n[:2] in ('19', '20')}{lead}", f"last={last.isdigit()}{last == ''}{lead}{word}"]


def _ending_rows(seed: int = 13, labels: int = 1500) -> list[tuple[list[str], str, tuple[str, ...]]]:
    """Training labels made by rule: page numbers after leaders or the word for page; years, notes and other numbers after a space."""
    rng = random.Random(seed)
    rows = []
    for _ in range(labels):
        page = rng.randint(1, 60)
        text = " ".join(rng.choice("chi phí bán hàng tồn kho vốn the cost sales group note plan".split()) for _ in range(rng.randint(1, 6)))
        tail = rng.choice(["", "", "", " (ĐVT: đ)", " [tr.đ]", ", đồng", " - triệu đồng"])
        n = rng.choice([page, rng.randint(1, 99), rng.randint(1, 300)])
        if rng.random() < 0.5:
            lead, label = rng.choice([" ..... ", "......", " . . . . ", " … … … ", " ____ ", " ···· ", " trang ", " tr. ", " p. ", " page ", " .... trang ", " ... p."]), "page"
        else:
            lead, label, n = " ", "text", rng.choice([rng.randint(1990, 2030), n, n, f"{rng.randint(1, 9)}", rng.randint(100, 400)])
            text += rng.choice(["", "", " năm", " mục", " TM", " số", " note", " form", " 12", " I"])
        full = f"{text}{lead}{n}{tail}"
        m = _ending.search(full)
        if m:
            rows.append((ending_features(full, m, page), label, ("text", "page")))
    return rows


# Words that no list of report words has, for headers in training.
_STRANGE = ["Gamma alpha", "Delta", "Omega beta gamma", "Sigma theta", "Lambda"]


def _header(rng: random.Random, name: str, code: str, year: str, page: int) -> str:
    n = rng.choice([name, name.upper()])
    s = rng.choice([f"{n} – Báo cáo năm {year}", f"{n} – Annual statements {year}", f"Báo cáo năm {year} của {n}", f"Annual statements {year} of {n}", f"{code} | Bản in nội bộ {year}", f"Mẫu B{rng.randint(1, 60)}-{code} kỳ {year}", f"Form B{rng.randint(1, 60)}-{code} year {year}", f"Phần thuyết minh kèm theo – {n}", f"Notes to the statements – {n}", f"{code} | Internal print {year}", f"{code} | {rng.choice(_STRANGE)} {year}", f"{rng.choice(_STRANGE)} – {n}"])
    s = s.upper() if rng.random() < 0.2 else s
    return rng.choice(["", "", "  "]) + s + (f" | {page}" if rng.random() < 0.3 else "")


def _page_number(rng: random.Random, name: str, code: str, year: str, page: int) -> str:
    total = page + rng.randint(0, 60)
    return rng.choice([f"{page}", f"- {page} -", f"[{page}]", f"~ {page} ~", f"{page} | {total}", f"Page {page} of {total}", f"Trang {page}/{total}", f"Trang {page}", f"P. {page}", f"{page}/{total}", f"tr. {page}"])


# ---- Texts ------------------------------------------------------------------------------------------


class Repairer:
    def __init__(self, lexicon: dict[str, int], total: int | None = None, models: tuple[Perceptron, ...] | None = None, names: dict[str, str] | None = None) -> None:
        self.editor = Editor(lexicon, total)
        if models is None:
            models = (self.editor.fit().model, Perceptron().train(_line_rows(), rounds=8), Perceptron().train(_ending_rows()))
        self.models = models
        self.editor.model, self.furniture, self.endings = models
        self.names = names or {}
        self.clean: set[str] = set()
        self.labels: dict = {}  # labels judged before
        self.text_bound: dict[tuple, bool] = {}

    def is_furniture(self, lines: list[str], k: int, page: int | None, code: str, year: str) -> bool:
        name = self.names.get(code, "")
        if not lines[k].strip() or self.surely_text(lines, k, code, year, name):
            return False
        return self.furniture.over(line_features(lines, k, page, code, year, name), "furniture", "text")

    def surely_text(self, lines: list[str], k: int, code: str, year: str, name: str) -> bool:
        """Whether a line without marks of the report, with three words of its own in small letters, is text whatever its other features: their largest weights are not enough. An exact bound, so no answer changes."""
        line = lines[k].strip()
        f = plain(line[:100]) if len(line) > 100 else plain(line)
        if (year and year in line) or (code and code.lower() in (f if len(line) <= 100 else plain(line))) or (name and name in (f if len(line) <= 100 else plain(line))):
            return False
        tokens, originals = _alnum.findall(f), _named.findall(line[:100])
        if len(line) > 100:  # the last ones may be cut
            tokens, originals = tokens[:-1], originals[:-1]
        spared = _spared_words(name)
        if sum([t not in ANY_WORDS and not t.isdigit() and not (t[0] == "b" and _form.fullmatch(t)) for t in tokens]) < 3 or sum([t[0].islower() and plain_word(t) not in spared for t in originals]) < 3:
            return False
        dash = " – " in line or " | " in line or " - " in line
        before, after = (lines[k - 1].strip() if k else ""), (lines[k + 1].strip() if k + 1 < len(lines) else "")
        cut = bool(before) and not ended(before)
        goes_on = bool(after) and (after[0].islower() or after[0].isdigit() or cut)
        key = (dash, ended(line) and not line.endswith(":"), "only" if len(lines) == 1 else "first" if not k else "last" if k == len(lines) - 1 else "middle", cut and goes_on, goes_on, line[:1] in "|{!`<" or line[:2] in ("- ", "* "))
        if key not in self.text_bound:
            self.text_bound[key] = self._text_bound(*key) <= 0
        return self.text_bound[key]

    def _text_bound(self, dash: bool, closed: bool, place: str, cut: bool, goes_on: bool, table: bool) -> float:
        """The most that the features of such a line can sum to, over what is not known of it."""
        self.furniture.over([], "furniture", "text")
        get = self.furniture.ahead["furniture", "text"].get
        no = [False, True]
        fixed = [
            "1", f"place={place}", "rest=3False", "marks=0", f"marks=03{closed}", f"closed={closed}False", f"cut={cut}FalseFalse", "all=False", "named=FalseFalseFalse", f"table={table}False",
            "low=30", f"core=33FalseFalseFalse{closed}False", f"low=3{dash}{closed}", f"clean=False{dash}", f"short=False0{dash}{closed}", f"sure=FalseFalseFalse{dash}{goes_on}",
        ]
        unknown = [
            [(f"page=False{m}", f"page=False{m}{place}") for m in no], [(f"numbers={n}False",) for n in range(4)], [(f"words={n}",) for n in range(5)],
            [(f"caps={c}{dash}{closed}0",) for c in no], [(f"parts={dash}False{closed}{r}", f"report={r}FalseFalse") for r in no],
        ]
        return sum(get(f, 0.0) for f in fixed) + sum(max(sum(get(f, 0.0) for f in group) for group in groups) for groups in unknown)

    @staticmethod
    def spared(text: str) -> str:
        """A text with blanks in place of markup, as long as before."""
        if not ("<" in text or "\\" in text or "{" in text or "`" in text or "](" in text or "''" in text or "|" in text or "!" in text or "&" in text):
            return text
        alone = text.count("|") == 1  # a sign for a letter, not one of a table or link

        def blank(m: regex.Match) -> str:
            if m.group() == "|":
                a, b = m.span()
                if a and text[a - 1].isalpha() and (alone or b < len(text)) or text[b : b + 1].isalpha():
                    return "|"
            return " " * len(m.group())

        return _sign.sub(blank, text)

    def words(self, spared: str) -> tuple[dict[str, str], dict[str, str]]:
        """The damaged pieces of a text without markup and what they become, and its tokens with damaged numbers and what they become."""
        out, numbers = {}, {}
        clean = self.clean
        for token in set(spared.split()):
            if token in clean:
                continue
            rest, whole = token, token
            for m in _number.finditer(token):
                fixed = self.editor.number(m.group(), token[m.start() - 1 : m.start()] if m.start() else "", token[m.end() : m.end() + 1])
                if fixed is not None:  # as long as before
                    whole = whole[: m.start()] + fixed + whole[m.end() :]
                    rest = rest[: m.start()] + " " * len(fixed) + rest[m.end() :]
            if whole != token:
                numbers[token] = whole
            found = False
            for p in _piece.findall(rest):
                fixed = self.editor.repaired(p)
                if fixed is not None:
                    out[p] = fixed
                    found = True
            if not found and whole == token:
                if len(clean) > 400_000:
                    clean.clear()
                clean.add(token)
        return out, numbers

    def repair(self, text: str, page: int | None = None, code: str = "", year: str = "", label: bool = False, write: bool = True) -> tuple[str, list[str]]:
        """The repaired text and the kinds of damage found."""
        kinds = []
        lines = text.split("\n")
        if len(lines) > 1 or not label:
            gone = [k for k in range(len(lines)) if self.is_furniture(lines, k, page, code, year)]
            if gone and len(gone) < len(lines) + (not label):
                kinds.append("furniture")
                lines = [x for k, x in enumerate(lines) if k not in gone]
                text = "\n".join(lines)
        if label and (m := _ending.search(text)) and self.endings.best(ending_features(text, m, page), ("text", "page")) == "page":
            kinds.append("page number")
            text = text[: m.start()] + text[m.end() :]
        if "\n" in text and _hyphen.search(text):
            done = []

            def join(m: regex.Match) -> str:
                if self.editor.joins_line(m[1], m[2], m[3]):
                    done.append(1)
                    return m[1] + m[3]
                return m.group()

            text = _hyphen.sub(join, text)
            if done:
                kinds.append("line-join")
        spared = self.spared(text)
        edits, numbers = self.words(spared)
        if edits or numbers:
            kinds.append("character")
        if not write:
            return text, kinds
        if numbers:
            for m in _token.finditer(spared):
                if m.group() in numbers:
                    text = text[: m.start()] + numbers[m.group()] + text[m.end() :]
        if edits:
            text = _piece.sub(lambda m: edits.get(m.group(), m.group()), text)
        return self.paragraphs(text), kinds

    @staticmethod
    def paragraphs(text: str) -> str:
        """Lines that go on are joined; headings, list items, table rows and blank lines keep theirs."""
        out: list[str] = []
        for line in text.split("\n"):
            s = line.strip()
            goes_on = out and out[-1] and s and (s[0].islower() or s[0].isdigit() or len(out[-1]) > 50) and not _end.search(out[-1].rstrip()) and s[0] not in "|-*#>" and out[-1][0] not in "|#"
            if goes_on or (out and out[-1] and s and len(out[-1]) > 50 and s[0] not in "|-*#>" and out[-1][0] not in "|#"):
                out[-1] = f"{out[-1]} {s}"
            else:
                out.append(s)
        return "\n".join(out).strip()


def lexicon(texts: DataFrame, column: str) -> DataFrame:
    """(word, n, bare): how often each word of a text column occurs that occurs twice or more, lower case, in one form, hyphenated ones too; bare: without accents, if it has any."""

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        c: Counter = Counter()
        for t in b.column(0).to_pylist():
            if t:
                c.update(t.lower().split())
        words: Counter = Counter()
        for token, n in c.items():
            w = token.strip(".,;:()[]{}\"“”'!?%*_~`<>=|")
            if w and len(w) <= LONGEST and w.replace("-", "").isalpha():
                words[unicodedata.normalize("NFC", w)] += n
        bare = [None if w.isascii() else plain(w) for w in words]
        return pa.RecordBatch.from_arrays([pa.array(list(words), type=pa.string()), pa.array(bare, type=pa.string()), pa.array(list(words.values()), type=pa.int64())], names=["word", "bare", "n"])

    counted = mapped(texts.select(column), count, "word string, bare string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.first("bare").alias("bare")).where("n > 1")


def asked(text: str) -> set[str]:
    """Every word whose count the repair of a text can depend on."""
    out = set()
    for m in _hyphen.finditer(text):
        a, b = m[1].lower(), m[3].lower()
        out |= {a, b, a + b, f"{a}-{b}"}
    joined = _hyphen.sub(lambda m: m[1] + m[3] + " " + m[1] + " " + m[3], text)
    for token in set((text + " " + joined).split()):
        for p in {*_piece.findall(token), *_number.findall(token)}:
            lower = p.lower().replace("’", "'").strip("'")
            if _confusable.search(lower) or any(c.isdigit() for c in lower):
                out |= {lower, *variants(lower)}
    return out


def _items(spark: SparkSession, d: str, blocks: bool, labels: bool) -> DataFrame:
    parts = []
    if blocks:
        b = table(spark, d, "blocks").where("block_type = 'text' and content is not null")
        parts.append(b.select(F.lit("blocks.content").alias("field"), F.concat("doc_id", F.lit("/"), "block_id").alias("record_key"), F.col("content").alias("text"), "doc_id", "page"))
    if labels:
        f = table(spark, d, "financial_facts").where("raw_label is not null")
        parts.append(f.select(F.lit("financial_facts.raw_label").alias("field"), F.col("seq").cast("string").alias("record_key"), F.col("raw_label").alias("text"), "doc_id", "page"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def repaired(items: DataFrame, companies: DataFrame, write: bool = True, most: int = MOST) -> DataFrame:
    """items (field, record_key, text, doc_id, page) with `clean` (null unless `write`) and `damage`, the kinds found.

    doc_id begins with the company's code and the year, as report keys do; without them, lines are
    judged by the rest. Company names are joined by code, the least of a code's names.
    """
    spark = items.sparkSession
    counted = lexicon(items, "text").persist()
    try:
        size, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        commonest = {r[0]: r[1] for r in counted.orderBy(F.desc("n"), "word").limit(LEARNT).select("word", "n").collect()}
        words = {r[0]: r[1] for r in counted.select("word", "n").collect()} if size <= most else {}  # of a size just counted
    finally:
        counted.unpersist()
    names = companies.where("code is not null and name is not null").groupBy(F.col("code").alias("_code")).agg(F.min("name").alias("_name"))
    named = items.withColumn("_code", F.substring_index("doc_id", "_", 1)).join(names, "_code", "left").select("field", "record_key", "text", "doc_id", "page", "_name")
    shipped = spark.sparkContext.broadcast((words, total, Repairer(commonest, total).models))
    made: dict = {}
    kind = pa.list_(pa.string())

    def run(b: pa.RecordBatch, r: Repairer) -> pa.RecordBatch:
        cache = r.labels
        form, _ = one_form(b.column(2))
        clean, damage = [], []
        for field, text, doc, page, name in zip(b.column(0).to_pylist(), form.to_pylist(), *(b.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
            if not text or text.isspace():
                clean.append(text)
                damage.append([])
                continue
            label = field.endswith("raw_label")
            parts = (doc or "").split("_")
            code, year = parts[0], parts[1] if len(parts) > 1 else ""
            if name is not None and code not in r.names:
                if len(r.names) > 300_000:
                    r.names.clear()
                r.names[code] = plain(name)
            key = (text, page if _ending.search(text) else None) if label and "\n" not in text else None
            hit = cache.get(key) if key is not None else None
            if hit is None:
                hit = r.repair(text, page, code, year, label, write)
                if key is not None:
                    if len(cache) > 300_000:
                        cache.clear()
                    cache[key] = hit
            clean.append(hit[0] if write else None)
            damage.append(hit[1])
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(clean, type=pa.string()), pa.array(damage, type=kind)], names=["field", "record_key", "clean", "damage"])

    schema = "field string, record_key string, clean string, damage array<string>"

    def whole(b: pa.RecordBatch) -> pa.RecordBatch:
        if "r" not in made:
            made["r"] = Repairer(*shipped.value)
        return run(b, made["r"])

    if size <= most:
        return mapped(named, whole, schema)

    def questions(b: pa.RecordBatch) -> pa.RecordBatch:
        form, _ = one_form(b.column(1))
        by: dict[int, set[str]] = defaultdict(set)
        for bucket, text in zip(b.column(0).to_pylist(), form.to_pylist(), strict=True):
            if text:
                by[bucket] |= asked(text)
        return pa.RecordBatch.from_arrays([pa.array([k for k, x in by.items() for _ in x], type=pa.int32()), pa.array([w for x in by.values() for w in sorted(x)], type=pa.string())], names=["_b", "_w"])

    def answers(texts: pa.Table, known: pa.Table) -> pa.Table:
        _, all_words, models = shipped.value
        r = Repairer(dict(zip(known.column("word").to_pylist(), known.column("n").to_pylist(), strict=True)), all_words, models)
        out = [run(b, r) for b in texts.select(["field", "record_key", "text", "doc_id", "page", "_name"]).combine_chunks().to_batches(max_chunksize=10_000) if b.num_rows]
        return pa.Table.from_batches(out, schema=pa.schema([("field", pa.string()), ("record_key", pa.string()), ("clean", pa.string()), ("damage", kind)]))

    buckets = max(1, -(-items.count() // BUCKET_ROWS))
    spread = named.withColumn("_b", F.pmod(F.xxhash64("field", "record_key", "text"), F.lit(buckets)).cast("int"))
    wanted = mapped(spread.select("_b", "text"), questions, "_b int, _w string").distinct()
    exact = wanted.join(counted, F.col("_w") == F.col("word")).select("_b", "word", "n")
    accented = wanted.join(counted, F.col("_w") == F.col("bare")).select("_b", "word", "n")
    return spread.groupBy("_b").cogroup(exact.unionByName(accented).distinct().groupBy("_b")).applyInArrow(answers, schema)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    out = repaired(_items(spark, d, True, True), table(spark, d, "companies"), write=False)
    return out.where(F.size("damage") > 0).select("field", "record_key").distinct()


def p1_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every text block and label, repaired, with the kinds of damage found."""
    out = repaired(_items(spark, d, True, True), table(spark, d, "companies"))
    return out.select("field", "record_key", "clean", F.array_join("damage", ",").alias("damage"))


QUERIES = {"p1_found": p1_found, "p1_repaired": p1_repaired}
