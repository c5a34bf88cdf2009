"""Problem 2: markup residue in text documents, removed while headings, lists, tables, code and formulas stay.

A text is read into candidate nodes: HTML tags, comments and entities; Markdown, wiki and LaTeX
constructs. Nodes nest by their places into a tree. Gradient-boosted trees judge each node from its
features: kind, depth, partner, density of letters in its subtree, attribute tokens, statistics of its
siblings, the characters around it. Decoding goes down the tree, so no choice contradicts that of an
ancestor: inside code nothing is markup, and items, cells and rows are markup only within an accepted
list or table. Accepted nodes' delimiters are then replaced, innermost text staying.

The trees are trained on texts made by rule (`examples` of them, fixed seed): sentences of made-up
words with markup of the four families and with lone signs of prose.

A search payload's own frame ("[code]", " | ", " > ") is set apart before reading. Null and empty
texts have no markup and stay as they are.
"""

from __future__ import annotations

import functools
import html
import random

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import boosting
from ledgerloom.llm.arrow import mapped
from ledgerloom.tables import table

FAMILY_NAMES = ["html", "markdown", "wiki", "latex"]
EXAMPLES = 2500
# Names of tags, and of commands whose argument stays.
TAGS = set("a abbr b big blockquote body br center cite code col dd del div dl dt em font h1 h2 h3 h4 h5 h6 head hr html i img ins kbd li link meta nowiki ol p pre q ref s script small span strike strong style sub sup table tbody td tfoot th thead title tr tt u ul var".split())
COMMANDS = set("section subsection subsubsection chapter paragraph title textbf textit texttt emph underline footnote caption cite ref label item begin end frac sqrt sum int times cdot leq geq alpha beta gamma delta ldots quad qquad newline centering hline text mathrm mathbf left right textsc href url includegraphics".split())
# Kinds of nodes: name, family, pattern with the parts `o` (opening), `c` (closing); what lies between is inner text.
_KINDS = [
    ("comment", 0, r"(?P<o><!--.*?-->)"),
    ("tag", 0, r"(?P<o></?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>)"),
    ("entity", 0, r"(?P<o>&(?:amp;)*(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)"),
    ("fence", 1, r"(?m)(?P<o>^[ \t]*(?:```|~~~)[^\n`]*\n)(?:.*?\n)??(?P<c>[ \t]*(?:```|~~~)[ \t]*$)"),
    ("tick", 1, r"(?P<o>(?<!`)`(?!`))[^`\n]+(?P<c>`(?!`))"),
    ("heading", 1, r"(?m)(?P<o>^[ \t]*#{1,6}[ \t]+)(?=\S)[^\n]*$"),
    ("bold", 1, r"(?P<o>\*\*)(?=\S)(?:(?!\*\*)[^\n]|\n(?!\n))+?(?<=\S)(?P<c>\*\*)"),
    ("under", 1, r"(?P<o>(?<![\p{L}\p{N}_])__)(?=\S)[^\n]+?(?<=\S)(?P<c>__(?![\p{L}\p{N}_]))"),
    ("strike", 1, r"(?P<o>~~)(?=\S)[^\n]+?(?<=\S)(?P<c>~~)"),
    ("star", 1, r"(?P<o>(?<![*\p{L}\p{N}])\*)(?=[^\s*])[^\n*]+?(?<=[^\s*])(?P<c>\*(?![*\p{L}\p{N}]))"),
    ("bar", 1, r"(?P<o>(?<![_\p{L}\p{N}])_)(?=[^\s_])[^\n_]+?(?<=[^\s_])(?P<c>_(?![_\p{L}\p{N}]))"),
    ("link", 1, r"(?P<o>!?\[)[^\[\]\n]*(?P<c>\]\([^()\s]*(?:\s\"[^\"\n]*\")?\))"),
    ("bullet", 1, r"(?m)(?P<o>^[ \t]*[-*+][ \t]+)(?=\S)[^\n]*$"),
    ("quote", 1, r"(?m)(?P<o>^[ \t]*>[ \t]?)(?=\S)[^\n]*$"),
    ("row", 1, r"(?m)(?P<o>^[ \t]*\|)(?![-}+])[^\n]*(?P<c>\|[ \t]*$)"),
    ("rule", 1, r"(?m)(?P<o>^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*$\n?)"),
    ("bold3", 2, r"(?P<o>(?<!')'''(?!'))(?=\S)[^\n]+?(?P<c>'''(?!'))"),
    ("italic2", 2, r"(?P<o>(?<!')''(?!'))[^\n']+?(?P<c>(?<!')''(?!'))"),
    ("page", 2, r"(?P<o>\[\[(?:[^\[\]|\n]*\|)?)[^\[\]|\n]*(?P<c>\]\])"),
    ("outside", 2, r"(?P<o>\[https?://\S+[ \t]*)[^\]\n]*(?P<c>\])"),
    ("template", 2, r"(?P<o>\{\{[^{}|\n]*\|?)[^{}\n]*(?P<c>\}\})"),
    ("title", 2, r"(?m)(?P<o>^[ \t]*={2,6}[ \t]*)(?=[^=\s])[^\n=]+?(?P<c>[ \t]*={2,6}[ \t]*$)"),
    ("grid", 2, r"(?m)(?P<o>^[ \t]*\{\|[^\n]*$\n?)(?:.*?\n)??(?P<c>[ \t]*\|\}[ \t]*$)"),
    ("gridrow", 2, r"(?m)(?P<o>^[ \t]*\|-[^\n]*$\n?)"),
    ("gridcell", 2, r"(?m)(?P<o>^[ \t]*[!|](?![-}])[ \t]*)(?=\S)[^\n]*$"),
    ("environment", 3, r"(?P<o>\\begin\{[a-zA-Z*]+\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?[ \t]*\n?)"),
    ("leave", 3, r"(?P<o>\\end\{[a-zA-Z*]+\})"),
    ("display", 3, r"(?P<o>\\\[)[^\n]*?(?P<c>\\\])"),
    ("inline", 3, r"(?P<o>\\\()[^\n]*?(?P<c>\\\))"),
    ("dollar", 3, r"(?P<o>(?<!\\)\$\$?)(?=[^\s$])[^$\n]+?(?<=[^\s$])(?P<c>\$\$?)"),
    ("command", 3, r"(?P<o>\\(?!begin\b|end\b)[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{)(?:[^{}\n]|\{[^{}\n]*\})*(?P<c>\})"),
    ("word", 3, r"(?P<o>\\[a-zA-Z]+)(?![a-zA-Z{])"),
    ("escape", 3, r"(?P<o>\\)(?=[%$&#_{}])."),
    ("break", 3, r"(?P<o>\\\\[ \t]*\n?)"),
    ("cell", 3, r"(?P<o>[ \t]&[ \t])"),
]
KINDS = [(n, f, regex.compile(p, regex.S if n in ("comment", "fence", "grid") else 0)) for n, f, p in _KINDS]  # those of PAIRED say the same, for reading
KIND = {n: k for k, (n, _, _) in enumerate(_KINDS)}
#: Kinds that may span lines, as opening and closing: they are paired in one scan, however many are never closed.
PAIRED = {
    "comment": (regex.compile(r"<!--"), regex.compile(r"-->")),
    "fence": (regex.compile(r"(?m)^[ \t]*(?:```|~~~)[^\n`]*\n"), regex.compile(r"(?m)^[ \t]*(?:```|~~~)[ \t]*$")),
    "grid": (regex.compile(r"(?m)^[ \t]*\{\|[^\n]*$\n?"), regex.compile(r"(?m)^[ \t]*\|\}[ \t]*$")),
}
#: A text without any of these signs has no candidate node; for the JVM, before Python.
SIGNS = r"[<`~\\{$*]|&[#A-Za-z0-9]+;|__|\]\(|\[\[|''|\[http|(?m)^[ \t]*[#>=|+!_-]|[ (]_\S"
#: Code, in which nothing is markup, and parts that need a parent of a kind.
LITERAL = {"fence", "tick"}
MATH = {"display", "inline", "dollar"}
NEEDS = {"gridrow": {"grid"}, "gridcell": {"grid"}, "cell": {"environment"}, "break": {"environment"}}
FEATURES = 22
_letters = regex.compile(r"\p{L}")
_frame = regex.compile(r"^\[[^\]\n]*\] \| .*?(?:Mô tả: |$)", regex.S)


class Node:
    __slots__ = ("kind", "begin", "end", "inner", "close", "parent", "depth", "partner", "name", "kept", "until")

    def __init__(self, kind: int, begin: int, end: int, inner: int, close: int) -> None:
        self.kind, self.begin, self.end, self.inner, self.close = kind, begin, end, inner, close
        self.parent, self.depth, self.partner, self.name, self.kept = -1, 0, -1, "", False
        self.until = end


def paired(name: str, text: str) -> list[tuple[int, int, int, int]]:
    """(begin, end, inner, close) of each opening with the first closing after it; openings within one are none."""
    opening, closing = PAIRED[name]
    closings = [m.span() for m in closing.finditer(text)]
    out, last, k = [], 0, 0
    for m in opening.finditer(text) if closings else ():
        if m.start() < last:
            continue
        while k < len(closings) and closings[k][0] < m.end():
            k += 1
        if k == len(closings):
            break
        begin, last = closings[k]
        out.append((m.start(), last, last, last) if name == "comment" else (m.start(), last, m.end(), begin))
    return out


def nodes_of(text: str) -> list[Node]:
    """Candidate nodes in order of place, nested: each with its parent and depth."""
    out = []
    for kind, (name, _, pattern) in enumerate(KINDS):
        if name in PAIRED:
            out += [Node(kind, *span) for span in paired(name, text)]
            continue
        for m in pattern.finditer(text):
            has_close = "c" in pattern.groupindex
            out.append(Node(kind, m.start(), m.end(), m.end("o"), m.start("c") if has_close else m.end()))
    out.sort(key=lambda x: (x.begin, -x.end))
    # Tags and environments span from opening to closing; partners are found with a stack per name.
    stacks: dict[str, list[int]] = {}
    for i, x in enumerate(out):
        kind = _KINDS[x.kind][0]
        source = text[x.begin : x.end]
        if kind == "tag":
            x.name = regex.match(r"</?([A-Za-z0-9]+)", source)[1].lower()
            key = "h" if regex.fullmatch(r"h[1-6]", x.name) else x.name
            if source.startswith("</"):
                if stacks.get(key):
                    j = stacks[key].pop()
                    x.partner, out[j].partner, out[j].until = j, i, x.begin
            elif not source.endswith("/>"):
                stacks.setdefault(key, []).append(i)
        elif kind in ("environment", "leave"):
            x.name = "\\" + regex.search(r"\{([a-zA-Z*]+)", source)[1]
            if kind == "environment":
                stacks.setdefault(x.name, []).append(i)
            elif stacks.get(x.name):
                j = stacks[x.name].pop()
                x.partner, out[j].partner, out[j].until = j, i, x.begin
        elif kind in ("command", "word"):
            x.name = regex.match(r"\\([a-zA-Z]+)", source)[1]
    open_: list[int] = []
    for i, x in enumerate(out):
        while open_ and max(out[open_[-1]].until, out[open_[-1]].end) <= x.begin:
            open_.pop()
        x.parent = open_[-1] if open_ else -1
        x.depth = len(open_)
        if x.until > x.inner or x.close > x.inner:
            open_.append(i)
    return out


@functools.cache
def _classes() -> np.ndarray:
    """By code point, one bit each: letter, digit, sign of formulas, '=', '|'."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out[[ord(c) for c in _letters.findall(every)]] |= 1
    out[[ord(c) for c in every if c.isdigit()]] |= 2
    for bit, signs in ((4, "\\^{}="), (8, "="), (16, "|")):
        out[[ord(c) for c in signs]] |= bit
    return out


def _sums(text: str) -> list[list[int]]:
    """For each class of signs, how many stand before each place of a text."""
    kinds = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return [[0, *np.cumsum(kinds & bit != 0).tolist()] for bit in (1, 2, 4, 8, 16)]


def features_of(text: str, nodes: list[Node]) -> np.ndarray:
    """The features of each node."""
    x = np.zeros((len(nodes), FEATURES))
    same: dict[tuple[int, int], int] = {}
    family: dict[int, int] = {}
    children: dict[int, int] = {}
    for n in nodes:
        same[n.parent, n.kind] = same.get((n.parent, n.kind), 0) + 1
        f = _KINDS[n.kind][1]
        family[f] = family.get(f, 0) + 1
        children[n.parent] = children.get(n.parent, 0) + 1
    sums = _sums(text)
    for k, n in enumerate(nodes):
        a, b = n.inner, max(n.inner, n.close, n.until)
        size, source = b - a, text[n.begin : n.end] if _KINDS[n.kind][0] == "entity" else ""
        before = text[n.begin - 1] if n.begin else "\n"
        after = text[n.end] if n.end < len(text) else "\n"
        letters, digits, signs = (s[b] - s[a] for s in sums[:3])
        equals, bars = (s[n.end] - s[n.begin] for s in sums[3:])
        x[k] = (
            n.kind, _KINDS[n.kind][1], n.depth, n.partner >= 0, size, letters / (size + 1), digits / (size + 1),
            size > 0 and (text[a].isspace() or text[b - 1].isspace()), before == "\n", after == "\n", before.isalnum(), after.isalnum(),
            same[n.parent, n.kind], family[_KINDS[n.kind][1]], letters / (n.end - n.begin), equals,
            n.name in TAGS or n.name in COMMANDS or n.name[:1] == "\\" or (_KINDS[n.kind][0] == "entity" and html.unescape(source) != source),
            signs > 0, children.get(k, 0), bars, size > 0 and text[a].isdigit(), n.end - n.begin,
        )
    return x


def decoded(nodes: list[Node], probable: np.ndarray, text: str) -> None:
    """Marks the nodes kept as markup, from the root down; an ancestor's choice binds its descendants."""
    literal_until = -1
    for k, n in enumerate(nodes):
        kind = _KINDS[n.kind][0]
        n.kept = bool(probable[k] > 0)
        if n.begin < literal_until:
            n.kept = n.kept and kind == "tag" and n.name in ("code", "pre") and text.startswith("</", n.begin)
            continue
        p = n.parent
        while p >= 0 and nodes[p].kept and _KINDS[nodes[p].kind][0] in MATH:
            n.kept = False
            break
        if kind == "bullet" and not _letters.search(text, n.inner, n.end) and text[n.inner : n.end].rstrip().endswith(("-", "*")):
            n.kept = False  # a page number between dashes
        needs = NEEDS.get(kind)
        if needs:
            while p >= 0 and _KINDS[nodes[p].kind][0] not in needs:
                p = nodes[p].parent
            n.kept = p >= 0 and nodes[p].kept
        if n.kept and kind in LITERAL:
            literal_until = n.close
        elif n.kept and kind == "tag" and n.name in ("code", "pre") and n.partner > k and not (n.name == "pre" and text.startswith("<code", n.end)):
            literal_until = nodes[n.partner].begin


# What an opening or closing tag leaves in clean text.
_BREAKS = set("p div br h1 h2 h3 h4 h5 h6 ul ol table tr pre blockquote hr dl dt dd title body head center".split())


def _replacement(n: Node, text: str) -> tuple[str, str]:
    """What an accepted node's opening and closing leave."""
    kind = _KINDS[n.kind][0]
    if kind == "tag":
        closing = text.startswith("</", n.begin)
        if n.name == "li":
            return ("" if closing else "\n- "), ""
        if n.name in ("td", "th"):
            return (" | " if closing else ""), ""
        return ("\n" if n.name in _BREAKS else ""), ""
    if kind == "entity":
        return html.unescape(html.unescape(text[n.begin : n.end])).replace("\xa0", " "), ""
    if kind == "comment":
        return "", ""
    if kind in ("bullet",):
        indent = regex.match(r"[ \t]*", text[n.begin : n.end])[0]
        return f"{indent}- ", ""
    if kind == "word":
        return ("-" if n.name == "item" else text[n.begin : n.end] if n.name in ("times", "frac", "sum", "int", "cdot") else ""), ""
    if kind == "command":
        if n.name == "footnote":
            return " (", ")"
        return ("", "\n") if n.name in ("section", "subsection", "subsubsection", "chapter", "title") else ("", "")
    if kind in ("break", "gridrow", "rule"):
        return ("\n" if kind == "break" else ""), ""
    if kind == "cell":
        return " | ", ""
    return "", ""


def cleaned(text: str, nodes: list[Node]) -> str:
    """The text with the delimiters of kept nodes replaced."""
    edits: list[tuple[int, int, str]] = []
    for n in nodes:
        if n.kept:
            a, b = _replacement(n, text)
            edits.append((n.begin, n.inner, a))
            if n.close < n.end and n.close >= n.inner:
                edits.append((n.close, n.end, b))
    edits.sort()
    out, last = [], 0
    for a, b, s in edits:
        if a < last:
            continue
        out += [text[last:a], s]
        last = b
    out.append(text[last:])
    joined = regex.sub(r"[ \t]+\n", "\n", "".join(out))
    return regex.sub(r"\n{3,}", "\n\n", joined).strip("\n")


class Reader:
    """Reads texts with trained trees."""

    def __init__(self, trees: boosting.Trees) -> None:
        self.trees = trees

    def read(self, texts: list[str]) -> list[list[Node]]:
        """The nodes of each text, decoded. The trees score all texts' nodes at once."""
        found = [nodes_of(t) for t in texts]
        x = [features_of(t, n) for t, n in zip(texts, found, strict=True) if n]
        if not x:
            return found
        scores = self.trees.score(np.concatenate(x))
        at = 0
        for t, n in zip(texts, found, strict=True):
            decoded(n, scores[at : at + len(n)], t)
            at += len(n)
        return found


# ---- Training texts, by rule ------------------------------------------------------------------------

_SYLLABLES = "chi phí bán hàng tồn kho năm vốn lưu động the cost of sales group under note plan Công ty Lưu Trúc quý total margin net über Vorräte société recettes Mộc R&D P&L EBITDA 2019 7,4% 12.767".split()


def _words(rng: random.Random, a: int, b: int) -> str:
    return " ".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(a, b)))


def _marked(rng: random.Random) -> str:
    """A construct of one of the families."""
    w, n = lambda a=1, b=4: _words(rng, a, b), rng.randint(1, 99)
    tag = rng.choice(["b", "i", "em", "strong", "span", "u", "sup", "sub", "code", "font", "small"])
    attribute = rng.choice(["", "", ' class="x"', f' style="margin:{n}"', ' id="a" lang="vi"', f" data-k='{n}'"])
    h = rng.randint(1, 6)
    level = "#" * h
    eq = "=" * rng.randint(2, 5)
    return rng.choice([
        lambda: f"<{tag}{attribute}>{w()}</{tag}>", lambda: f"<h{h}>{w()}</h{rng.choice([h, h % 6 + 1])}>\n<p>{w(4, 20)}</p>",
        lambda: f"{w(3, 8)}<br{rng.choice(['', '/', ' /'])}>{w(3, 8)}", lambda: f"<ul><li>{w()}</li><li>{w()}\n<li>{w()}</ul>",
        lambda: f"<table{attribute}><tr><th>{w()}</th></tr><tr><td>{w()}</td></tr></table>", lambda: f"<div{attribute}><span>{w(4, 20)}</span></div>",
        lambda: f"<!-- {w()} -->", lambda: f"{w(1, 2)}&nbsp;{w(1, 2)}&amp;{w(1, 1)}", lambda: f"&lt;b&gt;{w()}&lt;/b&gt; &amp;amp; &#{rng.randint(33, 900)};",
        lambda: f"<PRE><code>SUM(a, b) * {n}</code></PRE>", lambda: f"<a href=\"http://a.b/{n}\">{w()}</a>", lambda: f"<p>{w(4, 12)}",
        lambda: f"\n{level} {w()}\n\n", lambda: f"**{w()}** {w(2, 5)}", lambda: f"{w()} __{w()}__ {w()}", lambda: f"~~{w()}~~ `x = {n}`", lambda: f"*{w(1, 3)}*", lambda: f"_{w(1, 3)}_",
        lambda: f"\n\n* **{w()}**\n* __{w()}__\n  * {w()}", lambda: f"\n- {w()}\n- {w()}\n- {w()}\n", lambda: f"\n+ {w(2, 6)}\n+ {w(2, 6)}\n", lambda: f"\n> **{w()}**\n> {w(5, 140)}", lambda: f"\n> {w(5, 110)}\n",
        lambda: f"[{w()}](notes/{n}.md)", lambda: f"![{w()}](img/{n}.png)", lambda: f"\n```\ntotal = a * b - {n}\n```\n", lambda: f"\n| {w()} | {w()} |\n|---|---:|\n| {w()} | {n} |\n",
        lambda: f"'''{w()}''' {w()}", lambda: f"'' {w()} ''", lambda: f"''{w()}''", lambda: f"[[{w()}]]", lambda: f"[[{w(1, 2)}|{w()}]]: {w()}", lambda: f"{{{{cite|{w()}|p={n}}}}}", lambda: f"{{{{{w(1, 1)}}}}}",
        lambda: f"\n{eq} {w()} {eq}\n", lambda: f"\n{{| class=wikitable\n! {w()}\n|-\n| {w()}\n|}}\n", lambda: f"[http://a.b/{n} {w()}]",
        lambda: f"\\section{{{w()}}}\n", lambda: f"\\textbf{{{w()}}}", lambda: f"\\emph{{{w()}}}\\footnote{{{w()}}}", lambda: f"{n}\\% {w()}", lambda: f"\\begin{{itemize}}\n\\item {w()}\n\\item {w()}\n\\end{{itemize}}",
        lambda: f"\\begin{{tabular}}{{lr}}\n{w()} & {n} \\\\\n\\end{{tabular}}", lambda: f"$r = \\frac{{a_{{{n}}}}}{{b}}$", lambda: f"$x^{n} + y$", lambda: f"\\[ x_{{t}} = x_{{t-1}} \\times (1 + g)^{{{n}}} \\]", lambda: f"\\( a = {n} \\)",
    ])()


def _plain(rng: random.Random) -> str:
    """Lone signs of prose, and what scanning leaves, that are no markup."""
    w, n, m = lambda a=1, b=4: _words(rng, a, b), rng.randint(1, 999), rng.randint(1, 99)
    return rng.choice([
        lambda: f"{w()} {n} * {m} = {n * m} {w()} * {m}", lambda: f"{w()} ${m} {w(2, 5)} ${n} {w()}", lambda: f"{w()} [{m}] {w()}", lambda: f"{w()} #{n} {w()} TK_{n} (*) TK_{m}", lambda: f"{w()} < {m}% {w(1, 2)} > {m}%",
        lambda: f"a <{m} and b> {n}", lambda: f"\n- {m} -\n", lambda: f"\n~ {m} ~\n", lambda: f"\n{m} | {n}\n", lambda: f"\n{m}. {w()}\n", lambda: f"{w()} (*) {w()} (**) {w()}", lambda: f"{w()} a_b_{m} {w()} c_d_{n}", lambda: f"C:\\{rng.choice(['temp', 'data', 'new'])}\\{rng.choice(['x', 'ab'])} {w()}",
        lambda: f"{{{w()}}} {w()}", lambda: f"{w()} <{rng.choice('abc')}@{rng.choice(['mail', 'web'])}.vn>", lambda: f"\n{w()} | {n}\n{w(3, 6)}", lambda: f"R&D; P&L; {w()}", lambda: f"{w()} == {n}", lambda: f"\n----- {m} -----\n", lambda: f"\n{'-' * rng.randint(5, 30)}\n{w()}", lambda: f"{w()} * {w()} * {w()}", lambda: f"{w()}^{m} ~ {n} {w()}", lambda: f"{w()} '{w()}' {w()}", lambda: f"\n> {m}% {w(1, 2)}", lambda: f"\n- {n}\n",
        lambda: f"VND $ {n} {w()} US$ {m}", lambda: f"{w()} & {w()}", lambda: f"{w()} \\ {w()}", lambda: f"\n* {w(2, 4)}*\n{w(3, 6)}", lambda: f"\n# {n}\n", lambda: f"\n= {m}\n",
        lambda: f"{w()} {n}\n* {m} = {n * m} {w(2, 8)}", lambda: f"{w()} {n}\n+ {m} {w(2, 8)}", lambda: f"{w()} {m}\n- {n} {w(1, 6)}", lambda: f"{w()} < {m}% {w(1, 2)}\n> {n}%. {w(2, 8)}",
    ])()


def trained(examples: int = EXAMPLES, seed: int = 11) -> boosting.Trees:
    """Trees fitted on texts made by rule; a node is markup when it lies in a part made as markup."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(examples):
        text, spans = "", []
        for _ in range(rng.randint(1, 4)):
            text += rng.choice(["", " ", "\n"]) + _words(rng, 3, 20) + rng.choice([". ", ".\n", " ", "."])
            make = rng.choice([_marked, _plain])
            part = make(rng)
            if part.startswith("\n") or not rng.random() < 0.3:
                part = part if text.endswith("\n") or part.startswith("\n") else rng.choice([" ", "\n"]) + part
            if make is _marked:
                spans.append((len(text), len(text) + len(part)))
            text += part
        nodes = nodes_of(text)
        if nodes:
            xs.append(features_of(text, nodes))
            ys += [any(a <= n.begin and n.end <= b for a, b in spans) for n in nodes]
    return boosting.fit(np.concatenate(xs), np.array(ys, dtype=float))


def parts(text: str) -> tuple[str, str]:
    """A search payload's frame and its body; other texts have no frame."""
    m = _frame.match(text)
    return (text[: m.end()], text[m.end() :]) if m else ("", text)


def without_markup(df: DataFrame, column: str, payload: bool = False) -> DataFrame:
    """df with `clean`, the text of `column` without markup, and `families`, those found, in fixed order.

    Only texts with a sign of markup go to Python. payload: whether the texts are search payloads.
    """
    shipped = df.sparkSession.sparkContext.broadcast(trained())  # some kB, fixed
    kind = pa.struct([("clean", pa.string()), ("families", pa.list_(pa.string()))])
    made: dict = {}

    @F.arrow_udf("struct<clean:string,families:array<string>>")
    def read(texts: pa.Array) -> pa.Array:
        if "r" not in made:
            made["r"] = Reader(shipped.value)
        given = texts.to_pylist()
        some = [k for k, t in enumerate(given) if t is not None]
        split = [parts(given[k]) if payload else ("", given[k]) for k in some]
        out: list = [None] * len(given)
        for k, (frame, body), nodes in zip(some, split, made["r"].read([b for _, b in split]), strict=True):
            families = sorted({_KINDS[n.kind][1] for n in nodes if n.kept})
            out[k] = {"clean": frame + cleaned(body, nodes) if families else given[k], "families": [FAMILY_NAMES[f] for f in families]}
        return pa.array(out, type=kind)

    has = F.col(column).rlike(SIGNS)
    return (
        df.drop("clean", "families")
        .withColumn("_m", F.when(has, read(F.when(has, F.col(column)))))
        .withColumn("clean", F.coalesce("_m.clean", column))
        .withColumn("families", F.coalesce("_m.families", F.array().cast("array<string>")))
        .drop("_m")
    )


def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Text blocks once per key; whole-row repeats count once, before any text is read."""
    b = table(spark, d, "blocks").where("block_type = 'text' and content is not null")
    return b.select(F.lit("blocks.content").alias("field"), F.concat("doc_id", F.lit("/"), "block_id").alias("record_key"), F.col("content").alias("text"))


def payloads(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("search_payload is not null")
    return c.select(F.lit("chunks.search_payload").alias("field"), F.col("chunk_id").alias("record_key"), F.col("search_payload").alias("text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    a = without_markup(text_blocks(spark, d), "text").select("field", "record_key", "families")
    b = without_markup(payloads(spark, d), "text", payload=True).select("field", "record_key", "families")
    # Repeated rows of a block are rare; only rows with markup, keys alone, are compared.
    return a.unionByName(b).select("field", "record_key", F.explode("families").alias("markup")).distinct()


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every text block and payload as clean text, with the families found."""
    a = without_markup(text_blocks(spark, d), "text")
    b = without_markup(payloads(spark, d), "text", payload=True)
    return a.unionByName(b).select("field", "record_key", "clean", F.array_join("families", ",").alias("markup"))


QUERIES = {"p2_found": p2_found, "p2_clean": p2_clean}
