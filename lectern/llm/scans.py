"""Texts that came from scanned pages: finding them, and repairing them into continuous paragraphs.

Three averaged perceptrons are trained here, on examples made from the corpus itself:
  - an editor of words, character by character: keep, replace, delete, insert. It learns from frequent words that are
    misread by known confusions, and from pairs of words that only marked documents have and the frequent words next to
    them. An edit is made if it leads from a word that clean text doesn't have to one that it has, and if the editor doesn't find it too unlikely.
  - the fifth operation, the join of a word broken at a line end, by the sign at the break, the case of both halves, and which of both
    halves, the joined and the hyphened word are known.
  - a judge of lines, by their place on the page: page numbers and running headers against text, headings and figures.
    It learns from clean documents that are set into pages with numbers and headers of many kinds.

What clean text has is counted over all documents, apart for those that bear marks at first sight and those that don't:
a misread word is common only among the former. Null, empty and blank texts are no case. Lines that are only wrapped,
lists, tables and figures stay. Repeated rows give equal rows; other columns are not read.
"""

from __future__ import annotations

import random
import re
import textwrap
from collections import Counter, defaultdict
from collections.abc import Callable, Container, Iterable, Iterator
from itertools import pairwise, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import cut, lookup, spread

#: Share of the clean documents that must have a word for it to be known, and least number; times its rate in marked ones.
LEAST_SHARE, LEAST_DOCS, LEAST_RATIO = 5e-5, 2, 0.15
#: Documents that the judge of lines is trained on, and words and pairs that the editor is, at most.
TRAIN_DOCS, TRAIN_WORDS, TRAIN_PAIRS = 400, 1500, 1500
#: Code points from which on a token is a run and no word.
LONGEST = 60
#: Misread words that mark a document without other marks, and their share of its words.
LEAST_MISREAD, LEAST_MISREAD_SHARE = 3, 0.004
#: One in so many of the right edits of the examples may score under what an edit must reach.
LEFT_EDITS = 200
#: Words that are sent to the workers as a whole.
TABLE_WORDS = 500_000

_HYPHENS = "-\xad‐¬"
_BREAK = re.compile(rf"[{_HYPHENS}][ \t]*\n[ \t]*")
_LEFT, _RIGHT = re.compile(r"[^\W\d_]+(?:[|'·~^`][^\W\d_]+)*$"), re.compile(r"[^\W\d_]{2,}")
_OUTER = ".,;:!?()[]{}\"«»“”‘’'¿¡…–—•*<>/\\+=%°®™€#&_-"
_NOISE = "|'·~^`"
#: A line that is a page number: bare, or in one of the usual forms. The first group holds the number.
_PAGE = re.compile(r"^[^\S\n]*(?:(?P<lone>\d{1,4})|(?:p[áa]g(?:ina)?\.?|page|p\.|folio|fol\.)[^\S\n]*(?P<word>\d{1,4})(?:[^\S\n]*(?:de|of|sur|/)[^\S\n]*\d{1,4})?|(?P<frac>\d{1,4})[^\S\n]*/[^\S\n]*\d{1,4}|[-–—][^\S\n]*(?P<dash>\d{1,4})[^\S\n]*[-–—]|[\[(][^\S\n]*(?P<box>\d{1,4})[^\S\n]*[\])])[^\S\n]*\x0c?$", re.I | re.M)
_CODE = re.compile(r"\b[A-Z]{1,4}-\d{2,}")
#: Usual misreadings, right to wrong.
CONFUSIONS = {"l": "1|I!i", "i": "ílj1", "o": "0cóe", "e": "cé", "n": "rirñuh", "m": "rn", "d": "cl", "h": "li", "b": "6h", "s": "5", "g": "9q", "t": "fl", "u": "ü", "ó": "oó", "a": "áo", "f": "t", "v": "y", "r": "n", "z": "2", "O": "0", "S": "5", "B": "8", "I": "l1"}
_MULTI = {"n": ("ri",), "m": ("rn", "ni"), "d": ("cl",), "h": ("li",), "u": ("ii",), "w": ("vv",)}


class Perceptron:
    """Averaged, over sparse features; one weight for each feature and class."""

    def __init__(self):
        self.w: dict[tuple, float] = defaultdict(float)
        self.total: dict[tuple, float] = defaultdict(float)
        self.at: dict[tuple, int] = defaultdict(int)
        self.step = 0

    def score(self, features: list, label) -> float:
        w = self.w
        return sum(w.get((f, label), 0.0) for f in features)

    def best(self, features: list, labels: list):
        return max(labels, key=lambda x: self.score(features, x))

    def _add(self, key: tuple, by: float) -> None:
        self.total[key] += (self.step - self.at[key]) * self.w[key]
        self.at[key] = self.step
        self.w[key] += by

    def learn(self, features: list, right, labels: list) -> None:
        self.step += 1
        guess = self.best(features, labels)
        if guess != right:
            for f in features:
                self._add((f, right), 1.0)
                self._add((f, guess), -1.0)

    def average(self) -> Perceptron:
        for k in self.w:
            self.total[k] += (self.step - self.at[k]) * self.w[k]
        self.w = {k: v / max(1, self.step) for k, v in self.total.items() if v}
        self.total = self.at = None
        return self


# --- words


def token_core(token: str) -> str | None:
    """The word in a token of letters, perhaps with misread signs and figures among them; None for figures, codes and addresses."""
    w = token.strip(_OUTER)
    if len(w) < 2 or len(w) > LONGEST:
        return None
    letters = sum(c.isalpha() for c in w)
    if letters == len(w):
        return w.lower()
    if letters < 2 or 2 * letters <= len(w) or _CODE.search(w):
        return None
    if any(not (c.isalnum() or c in _NOISE or c in "-’") for c in w):
        return None
    return w.lower()


#: What misread words of these languages consist of; others are wrongly decoded, not misread.
_READ = re.compile(r"[a-z0-9áéíóúñüãõâêôçàèùîûëïœöä|'’·~^`-]+")


def cores(text: str) -> set[str]:
    """The words of a text that begin in lower case (or with a sign): names and codes stay out, as no lexicon has them all."""
    out = set()
    for t in set(text.split()):
        c = t[0]
        if c.isupper():
            continue
        if t.isalpha():
            w = t
        elif t[:-1].isalpha() and t[-1] in ",.;:)":
            w = t[:-1]
        else:
            inner = t.lstrip(_OUTER)
            if not inner or inner[0].isupper() or (w := token_core(t)) is None:
                continue
        if len(w) > 1:
            out.add(w.lower())
    return out


def alignment(wrong: str, right: str) -> list[tuple[str, str]] | None:
    """(operation, argument) for each character of wrong that make it right; None if more than three edits."""
    n, m = len(wrong), len(right)
    if abs(n - m) > 2:
        return None
    d = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i == 0 or j == 0:
                d[i][j] = i + j
            else:
                d[i][j] = min(d[i - 1][j - 1] + (wrong[i - 1] != right[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    if d[n][m] > 3:
        return None
    ops: list[tuple[str, str]] = [("keep", "")] * n
    i, j = n, m
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (wrong[i - 1] != right[j - 1]):
            if wrong[i - 1] != right[j - 1]:
                ops[i - 1] = ("replace", right[j - 1])
            i, j = i - 1, j - 1
        elif i and d[i][j] == d[i - 1][j] + 1:
            ops[i - 1] = ("delete", "")
            i -= 1
        else:
            if i == 0 or ops[i - 1][0] != "keep":
                return None
            ops[i - 1] = ("insert", right[j - 1])
            j -= 1
    return ops


def around(w: str, i: int) -> list:
    p, q, c, n, o = w[i - 2 : i - 1] if i > 1 else "", w[i - 1] if i else "^", w[i], w[i + 1] if i + 1 < len(w) else "$", w[i + 2] if i + 2 < len(w) else ""
    return ["*", ("c", c), ("l", q, c), ("r", c, n), ("b", q, c, n), ("rr", c, n, o), ("ll", p, q, c)]


def merged(w: str) -> Iterator[str]:
    """w with one pair of signs read as the one that it often stands for."""
    for right, wrongs in _MULTI.items():
        for wrong in wrongs:
            at = w.find(wrong)
            while at >= 0:
                yield w[:at] + right + w[at + len(wrong) :]
                at = w.find(wrong, at + 1)


class Models:
    """The three perceptrons and what goes with them: edits of characters, joins of lines, furniture of pages."""

    def __init__(self, words: list[str], hyphened: list[str], pairs: list[tuple[str, str]], samples: list[str], seed: int = 4):
        self.edits, self.options, self.margin = train_edits(words, pairs, seed)
        self.joins = train_joins(words, hyphened, seed)
        self.judge = train_judge(samples, seed)


def train_edits(words: list[str], pairs: list[tuple[str, str]], seed: int = 4) -> tuple[Perceptron, dict[str, list], float]:
    """(perceptron, edits by character, margin) from frequent words, misread by usual confusions, and pairs of misread and right words.

    margin: the score over keeping a character that all but one in LEFT_EDITS of the right edits of the examples reach; others are not made.
    """
    model, r = Perceptron(), random.Random(seed)
    options: dict[str, set[tuple[str, str]]] = defaultdict(lambda: {("keep", ""), ("delete", "")})
    made = list(pairs)
    for w in words:
        made.append((w, w))
        i = r.randrange(len(w))
        wrong = r.choice([*CONFUSIONS.get(w[i], ""), *_MULTI.get(w[i], ()), w[i] + r.choice(_NOISE), w[i]])
        made.append((w[:i] + wrong + w[i + 1 :], w))
    examples = [(a, ops) for a, b in made if (ops := alignment(a, b))]
    for (c, op), n in Counter((c, op) for a, ops in examples for c, op in zip(a, ops)).items():
        if n > 1:
            options[c].add(op)
    examples = [(a, ops) for a, ops in examples if all(op in options[c] for c, op in zip(a, ops))]
    for _ in range(2):
        r.shuffle(examples)
        for a, ops in examples:
            for i, op in enumerate(ops):
                model.learn(around(a, i), op, sorted(options[a[i]]))
    model.average()
    lead = sorted(model.score(f, op) - model.score(f, ("keep", "")) for a, ops in examples for i, op in enumerate(ops) if op[0] != "keep" for f in [around(a, i)])
    return model, {c: sorted(o) for c, o in options.items()}, lead[len(lead) // LEFT_EDITS] if lead else 0.0


class Editor:
    """Proposes known words for unknown ones by at most two edits, the ones that the perceptron finds likeliest first, and none that it finds too unlikely."""

    def __init__(self, models: Models, known: Container[str] = frozenset()):
        self.models, self.known = models, known

    def edit(self, w: str, among: Container[str] | None = None) -> str | None:
        """The word that w was, among the known ones or those given; None if there is none or w is one of them."""
        ok = (self.known if among is None else among).__contains__
        if ok(w):
            return None
        score, options, steps = self.models.edits.score, self.models.options, []
        for i, c in enumerate(w):
            f = around(w, i)
            keep = score(f, ("keep", ""))
            for op in options.get(c, (("keep", ""), ("delete", ""))):
                if op[0] != "keep" and (lead := score(f, op) - keep) >= self.models.margin:
                    steps.append((lead, i, op))
        steps.sort(key=lambda s: -s[0])
        for _, i, op in steps:
            if ok(x := self._apply(w, [(i, op)])):
                return x
        # two signs that were one: a replacement and a deletion side by side
        if (x := next(filter(ok, merged(w)), None)) is not None:
            return x
        # two edits: only of characters that the model would rather change
        top = [s for s in steps if s[0] > -1.0]
        for k, (_, i, op) in enumerate(top):
            for _, j, other in top[k + 1 :]:
                if i != j and ok(x := self._apply(w, [(i, op), (j, other)])):
                    return x
        return None

    @staticmethod
    def _apply(w: str, edits: list) -> str:
        s = list(w)
        for i, (kind, arg) in edits:
            s[i] = {"replace": arg, "delete": "", "insert": s[i] + arg}[kind]
        return "".join(s)


def halves(a: str, b: str) -> tuple[str, str, str, str]:
    """The words whose being known tells of a break: with the hyphen, joined, and both halves."""
    a, b = a.lower(), b.lower()
    return f"{a}-{b}", a + b, a, b


def join_features(a: str, sign: str, b: str, known: Callable[[str], bool]) -> list:
    whole, joined, left, right = map(known, halves(a, b))
    plain, case = sign == "-", (b[0].islower(), a.isupper() and b.isupper())
    return ["*", ("s", plain), ("w", whole), ("j", joined), ("h", left, right), ("case", case), ("sc", plain, case), ("wj", plain, whole, joined), ("jh", plain, joined, left, right), ("all", plain, whole, joined, left, right, case)]


def train_joins(words: list[str], hyphened: list[str], seed: int = 4) -> Perceptron:
    """Whether a word broken at a line end is joined: from words broken within, known or not, against words with a hyphen of their own and two words with one between."""
    r, model, known = random.Random(seed), Perceptron(), {*words, *hyphened}
    odd, examples = _HYPHENS[1:], []

    def add(a: str, sign: str, b: str, has: Callable[[str], bool], join: bool) -> None:
        examples.append((join_features(a, sign, b, has), join))

    for w in words:
        if len(w) < 5:
            continue
        i = r.randrange(2, len(w) - 1)
        a, b, unknown = w[:i], w[i:], known - {w}
        for has in (known.__contains__, unknown.__contains__):
            if not (has(a) and has(b)) or has(w):
                add(a, "-", b, has, True)
                add(a.upper(), "-", b.upper(), has, True)
                add(a.capitalize(), "-", b, has, True)
            add(a, r.choice(odd), b, has, True)
        other = r.choice(words)
        add(w, "-", other, lambda x, o=other, w=w: x in (o, w), False)
        add(w, r.choice(odd), other, lambda x, o=other, w=w: x in (o, w), True)
        for has in ((lambda x, o=other, w=w: x in (o, w)), lambda x: False):
            add(w.capitalize(), "-", other.capitalize(), has, False)
        add(a, "-", b.capitalize(), known.__contains__, False)
        compound = f"{w}-{other}"
        for has in ((lambda x, c=compound: x == c), (lambda x, c=compound, o=other, w=w: x in (c, o, w))):
            add(w, "-", other, has, False)
    for w in hyphened:
        a, _, b = w.partition("-")
        if a and b:
            add(a, "-", b, known.__contains__, False)
    for _ in range(6):
        r.shuffle(examples)
        for f, y in examples:
            model.learn(f, y, [False, True])
    return model.average()


# --- lines


def _shape(m: re.Match | None) -> tuple[str, int]:
    if not m:
        return "text", -1
    return (kind := m.lastgroup), int(m.group(kind))


def line_features(lines: list[str]) -> dict[int, list]:
    """Features of the lines that could be furniture, by their place: short ones with a page number, a code, repeated or in capitals near a page's edge."""
    stripped = [x.strip() for x in lines]
    shapes = [_shape(_PAGE.match(x)) for x in lines]
    forms = Counter(re.sub(r"\d+", "0", x) for x in stripped if x)
    filled = [i for i, x in enumerate(stripped) if x]
    place = {i: k for k, i in enumerate(filled)}
    typical = sorted(len(stripped[i]) for i in filled)[len(filled) // 2] if filled else 0
    by_kind = defaultdict(list)
    for i in filled:
        if shapes[i][1] >= 0:
            by_kind[shapes[i][0]].append(i)
    listed = {i for i in filled if shapes[i][0] == "lone" and any(0 <= place[i] + d < len(filled) and shapes[j := filled[place[i] + d]][0] == "lone" and abs(j - i) == 1 for d in (-1, 1))}
    rising = set()
    for kind, at in by_kind.items():
        at = [i for i in at if kind != "lone" or i not in listed]
        for a, b in pairwise(at):
            if shapes[b][1] == shapes[a][1] + 1:
                rising |= {a, b}
    edges = {i for i in range(len(lines)) if "\x0c" in lines[i]}
    number = {i for i in filled if shapes[i][1] >= 0 and i not in listed and (shapes[i][0] != "lone" or i in rising)}
    out = {}
    for i in filled:
        x, (kind, _) = stripped[i], shapes[i]
        if len(x) > 60:
            continue
        after_page = any(j in number or j in edges for j in range(max(0, i - 3), i)) or "\x0c" in lines[i]
        before_page = any(j in number or j in edges for j in range(i + 1, min(len(lines), i + 3)))
        repeated = min(3, forms[re.sub(r"\d+", "0", x)])
        if kind == "text" and not ((after_page or i == filled[0]) and (repeated > 1 or _CODE.search(x) or x.isupper() or len(x) < 40)) and not (repeated > 1 and _CODE.search(x)):
            continue
        before = stripped[filled[place[i] - 1]] if place[i] else ""
        follow = stripped[filled[place[i] + 1]] if place[i] + 1 < len(filled) else ""
        opened = bool(before) and before[-1:] not in ".!?:…”»)"
        goes_on = follow[:1].islower()
        base = [("kind", kind), ("rising", i in rising), ("listed", i in listed), ("repeated", repeated), ("after", after_page), ("before", before_page), ("edge", i in edges or i + 1 in edges), ("blank", i + 1 < len(lines) and not stripped[i + 1]), ("blank before", i > 0 and not stripped[i - 1]), ("last", i == filled[-1]), ("first", i == filled[0]), ("opened", opened), ("on", goes_on), ("short", len(x) * 10 < typical * 7), ("code", bool(_CODE.search(x))), ("upper", x.isupper()), ("stop", x[-1:] in ".!?"), ("sign", any(s in x for s in "·/|"))]
        d = dict(base)
        out[i] = ["*", *base, ("kr", kind, i in rising, i in listed), ("ke", kind, d["edge"], d["blank"]), ("kp", kind, repeated, after_page), ("ko", kind, opened, goes_on), ("tc", kind, d["code"], d["sign"], after_page), ("tu", kind, d["upper"], after_page, repeated), ("ts", kind, d["stop"])]
    return out


def paged(text: str, r: random.Random) -> tuple[list[str], set[int]]:
    """A clean text set into pages: lines, and which of them are furniture."""
    lines = text.split("\n")
    if max(map(len, lines)) > 120:
        lines = [y for x in lines for y in (textwrap.wrap(x, r.randrange(44, 90)) or [""])]
    code = f"{''.join(r.choices('ABCDEFGHJKLMNPQRSTVWXYZ', k=2))}-{r.randrange(1000, 99999)}"
    word = next((w for w in re.findall(r"[A-Z][a-z]{5,}", text)), "Doc")
    header = r.choice([f"{word} · {code}", f"Rev. {code} / {word}", word.upper(), f"{word.upper()}   {code}", f"{word} {word.upper()}", f"{code} {word}", ""])
    n, height = r.randrange(1, 60), r.randrange(6, 40)
    total = n + len(lines) // height + r.randrange(0, 3)
    # left and right pages may have headers of their own
    other = r.choice([f"{word}   {code}", f"INFO   {code}", word.upper()]) if header and r.random() < 0.3 else header
    form = r.choice(["{n}", "- {n} -", "[{n}]", "{n}/{t}", "Pág. {n} de {t}", "página {n}", "Page {n}", "page {n} of {t}", "({n})", f"{code}      {{n}}", f"{word}   {{n}}", f"{{n}}   {code}", ""])
    if not form and not header:
        form = "{n}"
    out, marks = [], set()
    feed = r.random() < 0.5

    def add(x: str, furniture: bool) -> None:
        if furniture:
            marks.add(len(out))
        out.append(x)

    for at in range(0, len(lines), height):
        if header:
            add(other if n % 2 else header, True)
            if r.random() < 0.3:
                add("", False)
        for x in lines[at : at + height]:
            add(x, False)
        if form:
            add(form.format(n=n, t=max(total, n)), True)
        n += 1
        if at + height < len(lines):
            add("\x0c" if feed else "", False)
    return out, marks


def train_judge(texts: list[str], seed: int = 4) -> Perceptron:
    r, model = random.Random(seed), Perceptron()
    examples = []
    for t in texts:
        examples += [(f, False) for f in line_features(t.split("\n")).values()]
        lines, marks = paged(t, r)
        examples += [(f, i in marks) for i, f in line_features(lines).items()]
    for _ in range(4):
        r.shuffle(examples)
        for f, y in examples:
            model.learn(f, y, [False, True])
    return model.average()


def breaks(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(from, to, left, sign, right) of the words that a hyphen at a line end parts."""
    for m in _BREAK.finditer(text):
        at = max(0, m.start() - 32)
        left, right = _LEFT.search(text[at : m.start()]), _RIGHT.match(text, m.end())
        if left and right:
            yield at + left.start(), right.end(), left.group(), text[m.start()], right.group()


def simple_marks(text: str) -> bool:
    """Marks at first sight: a soft or odd hyphen within a word at a line end, or page numbers in order."""
    if any(sign != "-" and right[0].islower() for _, _, _, sign, right in breaks(text)):
        return True
    if "\x0c" in text:
        return True
    at = [_shape(m) for m in _PAGE.finditer(text)]
    return any(a[0] == b[0] and a[0] != "lone" and b[1] == a[1] + 1 for a, b in pairwise(at))


class Reader:
    """Finds and repairs. table: {word: what it was, or None for a word that is known}, of the words that texts ask for; texts ask for no others."""

    def __init__(self, models: Models, table: dict[str, str | None]):
        self.models, self.table = models, table
        self.editor = Editor(models)

    def known(self, w: str) -> bool:
        return self.table.get(w, "") is None

    def joins(self, a: str, sign: str, b: str) -> str | None:
        """The joined word, or None where the hyphen belongs to it."""
        f = join_features(a, sign, b, self.known)
        return a + b if self.models.joins.score(f, True) > self.models.joins.score(f, False) else None

    def furniture(self, text: str) -> set[int]:
        # a page leaves a number, a form feed or a header that comes again; without any there is nothing to judge
        lines = text.split("\n")
        if len(lines) < 3:
            return set()
        if "\x0c" not in text and not _PAGE.search(text):
            seen = Counter(x for x in lines if _CODE.search(x) and len(x) <= 60)
            if not seen or max(seen.values()) < 2:
                return set()
        return {i for i, f in line_features(lines).items() if self.models.judge.score(f, True) > self.models.judge.score(f, False)}

    def pages(self, text: str) -> bool:
        """Whether there is furniture beyond doubt: a page number, or a header that comes again."""
        lines = text.split("\n")
        found = self.furniture(text)
        forms = Counter(re.sub(r"\d+", "0", lines[i].strip()) for i in found)
        return any(_PAGE.match(lines[i]) for i in found) or max(forms.values(), default=0) > 1

    def scanned(self, text: str) -> bool:
        if any(self.joins(*x[2:]) is not None for x in breaks(text)) or self.pages(text):
            return True
        words = cores(text)
        return sum(self.table.get(w) is not None for w in words) >= max(LEAST_MISREAD, LEAST_MISREAD_SHARE * len(words))

    @staticmethod
    def names(text: str) -> set[str]:
        """Words of letters that a text has more than once, by which its own rare ones may be told."""
        return {w for w, n in Counter(filter(None, map(token_core, text.split()))).items() if n > 1 and w.isalpha()}

    def asked(self, text: str) -> set[str]:
        """The words that a repair looks up beyond those of finding: halves that stand on both sides of furniture, and what would be taken for a word of the text's own if it isn't known."""
        bare = self.without_furniture(text)
        whole = _BREAK.sub("", bare)
        out = {w for _, _, a, _, b in breaks(bare) for w in halves(a, b)}
        names = self.names(bare) | self.names(whole)
        rest = {w for t in (bare, whole) for w in map(token_core, t.split()) if w and len(w) > 5}
        return out | {w for w in rest if self.table.get(w) is None and self.editor.edit(w, names - {w}) is not None}

    def without_furniture(self, text: str) -> str:
        lines = text.split("\n")
        out = self.furniture(text)
        kept: list[str] = []
        for i, x in enumerate(lines):
            x = x.replace("\x0c", "")
            if i in out or (not x.strip() and kept and i and i - 1 in out and kept[-1].strip() and kept[-1].strip()[-1] not in ".!?:"):
                continue
            kept.append(x)
        return "\n".join(kept)

    def joined(self, text: str) -> str:
        """The text with its broken words joined."""
        at, parts = 0, []
        for start, end, *word in breaks(text):
            if start >= at and (j := self.joins(*word)) is not None:
                parts += [text[at:start], j]
                at = end
        return "".join([*parts, text[at:]])

    def repair(self, text: str) -> str:
        """Continuous paragraphs: furniture out, broken words joined, lines of a paragraph put together, misread words restored."""
        text = self.joined(self.without_furniture(text))
        names = self.names(text)

        def fix(m: re.Match) -> str:
            token = m.group()
            w = token_core(token)
            if w is None or w in names or self.known(w):
                return token
            x = self.table.get(w) or (self.editor.edit(w, names) if len(w) > 5 else None)
            if x is None:
                return token
            inner = token.strip(_OUTER)
            x = x.capitalize() if inner[0].isupper() and not inner.isupper() else x.upper() if inner.isupper() else x
            return token.replace(inner, x, 1)

        paragraphs = []
        for p in re.split(r"\n\s*\n", text):
            rows = [x for x in p.split("\n") if x.strip()]
            # not the widest, as joined words have made some lines longer
            widest = sorted(map(len, rows))[2 * len(rows) // 3] if rows else 0
            joined = ""
            for x in rows:
                # a line that fills its width runs on into the next
                follows = joined and len(last) >= 0.7 * widest and not re.match(r"\s*(?:[-•*–]|\d+[.)])\s", x)
                joined += (" " if follows else "\n" if joined else "") + x.strip()
                last = x
            paragraphs.append(joined)
        return re.sub(r"\S+", fix, "\n\n".join(x for x in paragraphs if x))


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, clean, marked): documents with a word among those without and with marks at first sight, '' for all of them; and (word, null, null): words that breaks ask for."""
    two: tuple[Counter, Counter] = (Counter(), Counter())
    asked: set[str] = set()

    def told() -> pa.RecordBatch:
        words, none = list(two[0].keys() | two[1].keys()), [None] * len(asked)
        out = pa.RecordBatch.from_arrays([pa.array([*words, *asked], pa.string()), *[pa.array([*[c[w] for w in words], *none], pa.int64()) for c in two]], names=["word", "clean", "marked"])
        two[0].clear(), two[1].clear(), asked.clear()
        return out

    for batch in batches:
        for t in batch.column(0).to_pylist():
            if t and not t.isspace():
                c = two[simple_marks(t)]
                c.update(cores(t))
                c[""] += 1
                for _, _, left, _, right in breaks(t):
                    asked.update(halves(left, right))
        if len(two[0]) + len(asked) > 200_000:
            yield told()
    yield told()


def variants(word: str, misread: bool) -> set[str]:
    """Keys by which a misread word and the one that it was meet: the word, itself less a character, and for a misread one with two signs read as one."""
    out = {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}
    # single letters only between words of two
    return {x for x in ({*out, *merged(word)} if misread else out) if len(x) > 1 or len(word) == 2}


def _with_variants(words: DataFrame, misread: bool) -> DataFrame:
    """(v, word, n) of words (word, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(v, w, n) for w, n in zip(*[c.to_pylist() for c in batch.columns]) for v in variants(w, misread)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["v", "word", "n"])

    return words.mapInArrow(run, "v string, word string, n bigint")


class Fitted:
    """What a corpus tells: the models, the known words (word, n), and the table of the words that its texts ask for (word, restored).

    Misread words are told word by word: an unknown one meets the known ones that it may have been in a join, so no table of words is
    held as a whole anywhere. Only the training samples come to the driver; they are bounded by the parameters above.
    """

    def __init__(self, documents: DataFrame, text: str = "text"):
        src = spread(documents.select(F.col(text).cast("string").alias("_t")))
        first = cut(src.mapInArrow(_first_pass, "word string, clean bigint, marked bigint"))
        counts = cut(first.filter("clean is not null").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("marked").alias("marked")))
        n, m = next(((r["clean"], r["marked"]) for r in counts.filter("word = ''").collect()), (0, 0))
        least = max(LEAST_DOCS, int(LEAST_SHARE * n))
        rate = f"(clean / {max(n, 1)}) >= {LEAST_RATIO} * (marked / {max(m, 1)})"
        words = counts.filter("word <> ''")
        self.known = words.filter(f"clean >= {least} and ({rate})").select("word", F.col("clean").alias("n"))
        unknown = words.filter(f"not (clean >= {least} and ({rate}))").filter(F.col("word").rlike(f"^(?:{_READ.pattern})$"))

        near = cut(self._near(unknown))

        letters, top = r"^\p{L}+$", lambda df: df.orderBy(F.desc("n"), "word").limit(TRAIN_WORDS).collect()
        often = [r["word"] for r in top(self.known.filter(F.col("word").rlike(letters) & (F.length("word") > 2)))]
        hyphened = [r["word"] for r in top(self.known.filter(F.col("word").rlike(r"^\p{L}+-\p{L}+$")))]
        wrong = words.filter(f"marked >= 2 and length(word) > 2 and not ({rate})").orderBy(F.desc("marked"), "word").limit(TRAIN_PAIRS).select(F.col("word").alias("wrong"), "marked")
        pairs = []
        for r in sorted(F.broadcast(wrong).join(near, "wrong").collect() if m else [], key=lambda r: (-r["marked"], r["wrong"])):
            found = [(x["n"], x["word"]) for x in r["near"] if x["word"].isalpha() and (ops := alignment(r["wrong"], x["word"])) and sum(o[0] != "keep" for o in ops) <= 2]
            if found:
                pairs.append((r["wrong"], max(found)[1]))
        # thinned by a hash first, so that no partition sends more than its share of the sample
        thin = F.pmod(F.xxhash64("t", F.lit("sample")), F.lit(max(1, (n + m) // (8 * TRAIN_DOCS)))) == 0
        sample = documents.select(F.col(text).alias("t")).filter("length(t) between 300 and 6000").filter(thin).orderBy(F.xxhash64("t")).limit(2 * TRAIN_DOCS)
        samples = [r["t"] for r in sample.collect() if not simple_marks(r["t"])][:TRAIN_DOCS]
        self.models = Models(often, hyphened, pairs, samples)

        asked = first.filter("clean is null").select("word").distinct()
        self.table = cut(self._decided(near).unionByName(self._known_among(asked)))

    def _near(self, words: DataFrame) -> DataFrame:
        """(wrong, near): the known words, with their documents, that each unknown one may have been."""
        met = _with_variants(words.select("word", F.lit(0).cast("bigint").alias("n")), True).select("v", F.col("word").alias("wrong"))
        may = met.join(_with_variants(self.known, False), "v").select("wrong", "word", "n").distinct()
        return may.groupBy("wrong").agg(F.collect_list(F.struct("word", "n")).alias("near"))

    def _decided(self, near: DataFrame) -> DataFrame:
        shared = near.sparkSession.sparkContext.broadcast(self.models)

        def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for w, near in zip(*[c.to_pylist() for c in batch.columns]):
                    if (x := Editor(shared.value, {k["word"] for k in near}).edit(w)) is not None:
                        rows.append((w, x))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["word", "restored"])

        return near.mapInArrow(decide, "word string, restored string")

    def told(self, words: DataFrame) -> DataFrame:
        """(word, restored) of those among words that aren't known and were misread."""
        unknown = words.join(self.known, "word", "left_anti").filter(F.col("word").rlike(f"^(?:{_READ.pattern})$"))
        return self._decided(self._near(unknown))

    def _known_among(self, words: DataFrame) -> DataFrame:
        return self.known.select("word").join(words, "word", "left_semi").withColumn("restored", F.lit(None).cast("string"))


def _asks(text: str, models: Models) -> set[str]:
    """The words that a reader looks up for a text, with or without its furniture."""
    every = {text}
    if "\n" in text:
        bare = Reader(models, {}).without_furniture(text)
        every |= {bare, _BREAK.sub("", bare)}
    return cores(text) | {w for t in every for w in map(token_core, t.split()) if w} | {w for t in every for _, _, a, _, b in breaks(t) for w in halves(a, b)}


def _reading(src: DataFrame, models: Models, table: DataFrame, bound: int, run: Callable, schema: str) -> DataFrame:
    """run(keys, texts, readers) over the rows (_k, _t) of src. A table of at most `bound` words, counted first, goes to the workers; of a larger one each text is joined with what it asks for."""
    few = table.limit(bound + 1).collect()
    shared = src.sparkSession.sparkContext.broadcast((models, {r["word"]: r["restored"] for r in few} if len(few) <= bound else None))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*shared.value)
        for batch in batches:
            yield run(batch.column(0), batch.column(1).to_pylist(), repeat(reader))

    if len(few) <= bound:
        return src.mapInArrow(same, schema)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value[0]
        for batch in batches:
            rows = [(h, w) for h, t in zip(*[c.to_pylist() for c in batch.columns]) if t for w in _asks(t, models)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["_h", "word"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value[0]
        for batch in batches:
            yield run(batch.column(0), batch.column(1).to_pylist(), (Reader(models, {x["word"]: x["restored"] for x in w or ()}) for w in batch.column(2).to_pylist()))

    # equal texts are read alike, so a text's hash stands for it
    texts = src.withColumn("_h", F.xxhash64("_t"))
    words = lookup(texts.select("_h", "_t").mapInArrow(asked, "_h bigint, word string").distinct(), table, "word", bound=bound).groupBy("_h").agg(F.collect_list(F.struct("word", "restored")).alias("_w"))
    return texts.join(words, "_h", "left").select("_k", "_t", "_w").mapInArrow(own, schema)


def _some(keys: pa.Array, at: list[int], *columns: list) -> list[pa.Array]:
    return [keys.take(pa.array(at, pa.int64())), *[pa.array(c, pa.string()) for c in columns]]


def read_scans(documents: DataFrame, key: str = "doc_id", text: str = "text", repair: bool = True, fitted: Fitted | None = None, bound: int = TABLE_WORDS) -> DataFrame:
    """(key, text) of the scanned documents, repaired; without repair only (key)."""
    fitted = fitted or Fitted(documents, text)
    src = spread(documents.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t")))
    kind = src.schema["_k"].dataType.simpleString()

    def find(keys: pa.Array, texts: list, readers: Iterable[Reader]) -> pa.RecordBatch:
        at = [i for i, (t, r) in enumerate(zip(texts, readers)) if t and not t.isspace() and r.scanned(t)]
        return pa.RecordBatch.from_arrays(_some(keys, at, *[[texts[i] for i in at]] * repair), names=["_k", "_t"][: 1 + repair])

    found = _reading(src, fitted.models, fitted.table, bound, find, f"_k {kind}" + ", _t string" * repair)
    if not repair:
        return found.withColumnRenamed("_k", key)
    # of the words that would be taken for a text's own the known ones are told apart
    found = cut(found)

    def like(keys: pa.Array, texts: list, readers: Iterable[Reader]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sorted({w for t, r in zip(texts, readers) for w in r.asked(t)}), pa.string())], names=["word"])

    asked = cut(_reading(found, fitted.models, fitted.table, bound, like, "word string").distinct())
    table = cut(fitted.table.unionByName(fitted._known_among(asked)).dropDuplicates(["word"]))

    def mend(keys: pa.Array, texts: list, readers: Iterable[Reader]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(_some(keys, list(range(len(texts))), [r.repair(t) for t, r in zip(texts, readers)]), names=[key, "text"])

    return _reading(found, fitted.models, table, bound, mend, f"`{key}` {kind}, text string")


def noisy(text: str, r: random.Random) -> str:
    """A clean text as if it had been scanned: set into pages, words broken at line ends, characters misread."""
    out = []
    for x in paged(text, r)[0]:
        x = "".join(r.choice(CONFUSIONS[c]) if c in CONFUSIONS and r.random() < 0.01 else c for c in x)
        if out and (m := re.match(r"\s*([^\W\d_]{6,})", x)) and out[-1].strip() and out[-1][-1].isalpha() and r.random() < 0.4:
            i = m.start(1) + r.randrange(2, len(m.group(1)) - 2)
            out[-1] += " " + x[m.start(1) : i] + r.choice("--\xad¬")
            x = x[i:]
        out.append(x)
    return "\n".join(out)


def repair_accuracy(documents: DataFrame, text: str = "text", seed: int = 4) -> DataFrame:
    """(documents, words, wrong_before, wrong_after, share_mended), one row: clean texts are made noisy, and repaired by a reader of the whole corpus, made of it and them.

    Of the words of each clean text those count as wrong that the other doesn't have as often. All texts without marks take part that the reader doesn't find.
    """
    fitted = Fitted(documents, text)
    src = spread(documents.select(F.xxhash64(text).alias("_k"), F.col(text).cast("string").alias("_t")).filter("_t is not null").dropDuplicates(["_k"]))

    def score(keys: pa.Array, texts: list, readers: Iterable[Reader]) -> pa.RecordBatch:
        total = [0] * 4
        for k, t, r in zip(keys.to_pylist(), texts, readers):
            if t.isspace() or len(t) < 200 or simple_marks(t) or r.scanned(t):
                continue
            bad, want = noisy(t, random.Random(k + seed)), Counter(t.split())
            wrong = [(want - Counter(x.split())).total() for x in (bad, r.repair(bad))]
            total = [a + b for a, b in zip(total, (1, want.total(), *wrong))]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in total], names=["documents", "words", "wrong_before", "wrong_after"])

    def asked(keys: pa.Array, texts: list, readers: Iterable[Reader]) -> pa.RecordBatch:
        words: set[str] = set()
        for k, t, r in zip(keys.to_pylist(), texts, readers):
            if not t.isspace() and len(t) >= 200:
                bad = noisy(t, random.Random(k + seed))
                words |= _asks(bad, r.models) | r.asked(bad)
        return pa.RecordBatch.from_arrays([pa.array(sorted(words), pa.string())], names=["word"])

    # the words of the noisy texts are told as those of the corpus are
    words = cut(_reading(src, fitted.models, fitted.table, TABLE_WORDS, asked, "word string").distinct())
    table = cut(fitted.table.unionByName(fitted.told(words)).unionByName(fitted._known_among(words)).dropDuplicates(["word"]))
    each = _reading(src, fitted.models, table, TABLE_WORDS, score, "documents bigint, words bigint, wrong_before bigint, wrong_after bigint")
    return each.agg(*[F.sum(c).alias(c) for c in each.columns]).withColumn("share_mended", F.round(1 - F.try_divide("wrong_after", "wrong_before"), 3))
