"""Repair of text from scanned pages (problem 5).

An averaged-perceptron character editor predicts for each character to keep, replace,
delete or insert, and for each line end to keep it or join the word broken over it.  It
is trained here, on words of unscanned pages with noise of a fixed visual channel put
in and letters lost.  It reads every word in doubt: one that unscanned pages do not attest, or not next to its
neighbours.  All readings that the editor's operations lead to and that are attested words are
found, guided by the attested words' beginnings; the best by the editor's score and the neighbours stands,
if it is better than what is written.  A second perceptron removes running headers, footers and page numbers
by position on the page, shape, and what recurs at page edges, wherever it then stands.

Counts of words, neighbours and edge lines cover all pages.  What is attested is a matter of share, at every size: a
word of WORD_SHARE of all words (and three of them), a pair of PAIR_SHARE (and two), a form of EDGE_SHARE of all edge lines (and
three).  There can be no more than 1 / share of each, which bounds what is broadcast.
The models alone are fitted on samples: words of at most SAMPLE_PAGES pages, SAMPLE_WORDS in all, and lines of at most
SAMPLE_LINE_PAGES pages, SAMPLE_LINES in all.

Defined cases: a page that is known not to be scanned stays as it is; null text gives
null, no mark; an empty page is clean; without unscanned pages nothing is attested and
only furniture is found; repeated rows give repeated rows; columns with the names of the
result give way, others pass through.
"""

from __future__ import annotations

import random
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.syllables import LETTERS
from lamina.session import cut_lineage

SAMPLE_PAGES, SAMPLE_WORDS, SAMPLE_LINE_PAGES, SAMPLE_LINES = 600, 6000, 3000, 20_000
WORD_SHARE, PAIR_SHARE, EDGE_SHARE = 1e-6, 5e-7, 1e-5
EDGE_TOP, EDGE_BOTTOM = 2, 3
EDIT, NEIGHBOUR, CONVINCED = 0.5, 4.0, 3.0
WIDE = 8  # words of a full line that is content whatever stands in it

# Characters and what a recogniser takes them for.
CHANNEL = "n>ri h>b t>f g>9 i>í c>e u>ii đ>d o>0 l>1 m>rn rn>m B>8 I>l I>| l>I O>0 0>O 1>l 5>S 8>B d>cl e>c b>h f>t a>o v>y s>5 q>g ri>n cl>d Đ>D D>Đ T>F C>G E>F w>vv".split()
_MARKED = sorted(LETTERS)
_HYPHEN = "-¬\xad‐"
_WORD = re.compile(r"[^\W_](?:[^\W_]|[|](?=[^\W_]))*")


def _tone_slips() -> dict[str, list[str]]:
    """By rule: a marked letter may lose a mark or get another mark of its base letter."""
    by_base = defaultdict(set)
    for c in _MARKED:
        parts = unicodedata.normalize("NFD", c)
        by_base[parts[0]].add(c)
        by_base[parts[0]].add(parts[0])
    near = defaultdict(list)
    for group in by_base.values():
        for a in group:
            for b in group:
                x, y = set(unicodedata.normalize("NFD", a)), set(unicodedata.normalize("NFD", b))
                if a != b and len(x ^ y) <= 2:
                    near[a].append(b)
    return {k: sorted(v) for k, v in near.items()}


SLIPS = _tone_slips()


class Perceptron:
    """Averaged multi-class perceptron over string features."""

    def __init__(self) -> None:
        self.weights: dict[str, dict[str, float]] = {}
        self._sums: dict[tuple[str, str], float] = defaultdict(float)
        self._stamps: dict[tuple[str, str], int] = defaultdict(int)
        self._step = 0

    def scores(self, features: Iterable[str], labels: Iterable[str]) -> dict[str, float]:
        out = dict.fromkeys(labels, 0.0)
        for f in features:
            w = self.weights.get(f)
            if w:
                for label in out:
                    out[label] += w.get(label, 0.0)
        return out

    def learn(self, features: list[str], truth: str, labels: list[str]) -> bool:
        self._step += 1
        s = self.scores(features, labels)
        guess = max(labels, key=lambda x: (s[x], x == "K", x))
        if guess == truth:
            return True
        for f in features:
            w = self.weights.setdefault(f, {})
            for label, change in ((truth, 1.0), (guess, -1.0)):
                key = (f, label)
                self._sums[key] += (self._step - self._stamps[key]) * w.get(label, 0.0)
                self._stamps[key] = self._step
                w[label] = w.get(label, 0.0) + change
        return False

    def average(self) -> None:
        for f, w in self.weights.items():
            for label in w:
                key = (f, label)
                total = self._sums[key] + (self._step - self._stamps[key]) * w[label]
                w[label] = total / max(1, self._step)
        self._sums.clear()
        self._stamps.clear()


@dataclass
class Model:
    """What the repair is given: attested words in order and pairs ("a b"), edge lines, and the two perceptrons."""

    words: frozenset[str] = frozenset()
    pairs: frozenset[str] = frozenset()
    edges: frozenset[str] = frozenset()
    editor: Perceptron = field(default_factory=Perceptron)
    furniture: Perceptron = field(default_factory=Perceptron)
    labels: dict[str, list[str]] = field(default_factory=dict)
    known: frozenset[str] = frozenset()
    ordered: list[str] = field(default_factory=list)
    breaks: dict[tuple[str, ...], bool] = field(default_factory=dict)  # what the editor says of features seen before

    def begins(self, text: str) -> bool:
        """Whether some attested word begins with the text."""
        i = bisect_left(self.ordered, text)
        return i < len(self.ordered) and self.ordered[i].startswith(text)


def features_at(word: str, i: int) -> list[str]:
    w = "^^" + word + "$$$"
    j = i + 2
    a, b, c, d, e = w[j - 2], w[j - 1], w[j], w[j + 1], w[j + 2]
    return [c, b + c, c + d + ">", a + b + c, c + d + e + ">", b + c + d, f"{c}@{min(i, 2)}", f"{c}@-{min(len(word) - i, 3)}", f"{c}{'9' if any(x.isdigit() for x in word) else ''}#"]


END = "$"


def corrupt(word: str, rng: random.Random) -> tuple[str, list[str]]:
    """The word with noise of the channel and letters lost, and for each character, and the end, the edit that undoes it.

    R<text> replaces the character, D deletes it, I<letter> inserts a letter before it, K keeps it."""
    out, ops, i, lost = [], [], 0, ""
    while i < len(word):
        options = [x.split(">") for x in CHANNEL if word.startswith(x.split(">")[0], i)]
        slips = SLIPS.get(word[i], [])
        chance = rng.random()
        if lost:
            out.append(word[i])
            ops.append("I" + lost)
            lost, i = "", i + 1
        elif (options or slips) and chance < 0.28:
            if options and (not slips or rng.random() < 0.7):
                good, bad = rng.choice(options)
            else:
                good, bad = word[i], rng.choice(slips)
            out.append(bad)
            ops += [f"R{good}"] + ["D"] * (len(bad) - 1)
            i += len(good)
        elif chance > 0.96 and i and len(word) > 3 and word[i].isalpha():
            lost, i = word[i], i + 1
        else:
            out.append(word[i])
            ops.append("K")
            i += 1
    return "".join(out), [*ops, "I" + lost if lost else "K"]


def train_editor(words: list[str], seed: int = 5, epochs: int = 3) -> tuple[Perceptron, dict[str, list[str]]]:
    """The character editor and the edits it knows for each character.  Words come in a fixed order."""
    rng = random.Random(seed)
    data = [corrupt(w, rng) for w in words[:SAMPLE_WORDS]]
    labels: dict[str, set[str]] = defaultdict(lambda: {"K"})
    for x in CHANNEL:
        good, bad = x.split(">")
        labels[bad[0]].add(f"R{good}")
        for c in bad[1:]:
            labels[c].add("D")
    for good, others in SLIPS.items():
        for bad in others:
            labels[bad].add(f"R{good}")
    inserts = Counter((c, op) for bad, ops in data for c, op in zip(bad + END, ops, strict=True) if op[0] == "I")
    for (c, op), n in inserts.items():
        if n >= 2:
            labels[c].add(op)
    known = {c: sorted(x) for c, x in labels.items()}
    model = Perceptron()
    for _ in range(epochs):
        rng.shuffle(data)
        for bad, ops in data:
            for i, op in enumerate(ops):
                choice = known.get(bad[i] if i < len(bad) else END)
                if choice and op in choice:
                    model.learn(features_at(bad, i), op, choice)
    model.average()
    return model, known


def readings(word: str, model: Model) -> list[tuple[float, str]]:
    """All attested words, other than the word itself, that the editor's operations make of it, with their least cost.

    A cost is how far the editor's score for an edit falls behind that for keeping the character, plus EDIT; at most two
    thirds of the characters are edited (two in a short word).  The walk keeps to beginnings of attested words."""
    most = max(2, 2 * len(word) // 3)
    plans = []
    for i in range(len(word) + 1):
        choice = model.labels.get(word[i] if i < len(word) else END)
        if not choice:
            plans.append((("K", 0.0),))
            continue
        s = model.editor.scores(features_at(word, i), choice)
        keep = s["K"]
        plans.append(tuple((op, 0.0 if op == "K" else max(0.0, keep - v) + EDIT) for op, v in s.items()))
    best: dict[str, float] = {}
    seen: dict[tuple[int, str, bool], tuple[float, int]] = {}
    todo = [(0.0, 0, "", 0, False)]
    while todo:
        cost, i, text, n, inserted = todo.pop()
        old = seen.get((i, text, inserted))
        if old is not None and old[0] <= cost and old[1] <= n:
            continue
        seen[i, text, inserted] = (cost, n)
        low = text.lower()
        if i == len(word) and low in model.words and n and low != word.lower() and cost < best.get(text, 1e9):
            best[text] = cost
        for op, extra in plans[i]:
            kind, made = op[0], op[1:]
            if kind == "I":
                if not inserted and n < most and model.begins(low + made.lower()):
                    todo.append((cost + extra, i, text + made, n + 1, True))
            elif i < len(word):
                new = text + word[i] if kind == "K" else text if kind == "D" else text + made
                if (kind == "K" or n < most) and model.begins(new.lower()):
                    todo.append((cost + extra, i + 1, new, n + (kind != "K"), False))
    return sorted((c, t) for t, c in best.items())


_MEMORY: dict = {}


def _readings(word: str, model: Model) -> list[tuple[float, str]]:
    """Readings remembered per worker, as slips recur."""
    if _MEMORY.get("model") is not model or len(_MEMORY) > 200_000:
        _MEMORY.clear()
        _MEMORY["model"] = model
    if word not in _MEMORY:
        _MEMORY[word] = readings(word, model)
    return _MEMORY[word]


_WORDS = re.compile(f"({_WORD.pattern})")
_LINKS = frozenset(a + n + b for a in ("", " ") for n in ("", "\n") for b in ("", " "))


def fix_words(text: str, model: Model) -> tuple[str, int]:
    """The text with doubtful words read anew, and how many were.

    A reading's score is NEIGHBOUR for each neighbour with which it is attested, less its cost; it must be above
    -CONVINCED.  A word that is itself attested gives way only to a reading that all its neighbours attest, more of
    them than attest the word, and that costs no more than CONVINCED."""
    if not model.words:
        return text, 0
    parts = _WORDS.split(text)  # gaps at even places, words between them
    raw, gaps = parts[1::2], parts[2:-1:2]
    lows = ["#" if w.isdigit() else w for w in map(str.lower, raw)]
    known = list(map(model.known.__contains__, lows))
    paired = list(map(model.pairs.__contains__, map(" ".join, zip(lows, lows[1:], strict=False))))
    linked = list(map(_LINKS.__contains__, gaps))
    # a gap between two known words that are linked but not attested together puts both in doubt
    odd = [link and not pair and a and b for link, pair, a, b in zip(linked, paired, known, known[1:], strict=False)]
    doubtful = [i for i, (k, a, b) in enumerate(zip(known, [False, *odd], [*odd, False], strict=True)) if not k or a or b]
    n = 0
    for i in doubtful:
        w, low = raw[i], lows[i]
        if low == "#":
            continue
        left = lows[i - 1] if i and linked[i - 1] else None
        right = lows[i + 1] if i + 1 < len(lows) and linked[i] else None
        here = low in model.words
        sides = [(a, b) for a, b in ((left, low), (low, right)) if a is not None and b is not None and a in model.known and b in model.known]
        attested = sum(f"{a} {b}" in model.pairs for a, b in sides)
        if here and attested == len(sides):
            continue
        best, score = None, -CONVINCED
        for cost, t in _readings(w, model):
            tl = t.lower()
            fit = sum(f"{a} {b}" in model.pairs for a, b in ((left, tl), (tl, right)) if a is not None and b is not None)
            if here and (cost > CONVINCED or fit <= attested or fit < len(sides)):
                continue
            if NEIGHBOUR * fit - cost > score:
                best, score = t, NEIGHBOUR * fit - cost
        if best is None:
            continue
        parts[2 * i + 1], lows[i], n = best, best.lower(), n + 1
    return "".join(parts) if n else text, n


_TAIL = re.compile(rf"([^\W\d_]+)([{_HYPHEN}]?)$")
_HEAD = re.compile(r"[^\W\d_]+")


def fix_breaks(text: str, model: Model) -> tuple[str, int]:
    """Line ends at which a broken word is joined, decided by the editor's line-join operation; a joined line may be joined again."""
    lines = text.split("\n")
    out, held, n = [], lines[0], 0
    for line in lines[1:]:
        open_end, rest = held.rstrip(" \t"), line.lstrip(" \t")
        tail = _TAIL.search(open_end.split()[-1]) if open_end and (open_end[-1].isalpha() or open_end[-1] in _HYPHEN) else None
        head = _HEAD.match(rest) if tail else None
        if head and _joins(tail.group(1), tail.group(2), head.group(), model):
            held, n = open_end[: len(open_end) - len(tail.group(2))] + rest, n + 1
        else:
            out.append(held)
            held = line
    return "\n".join([*out, held]), n


def _joins(a: str, hyphen: str, b: str, model: Model) -> bool:
    if not hyphen and (a + b).lower() not in model.words:
        return False
    f = tuple(break_features(a, hyphen, b, model))
    if f not in model.breaks:
        s = model.editor.scores(f, ("J", "K"))
        model.breaks[f] = s["J"] > s["K"]
    return model.breaks[f]


def break_features(a: str, hyphen: str, b: str, model: Model) -> list[str]:
    known = [w.lower() in model.words for w in (a, b, a + b)]
    return [f"h{bool(hyphen)}", f"h{bool(hyphen)}k{known}", f"k{known}", f"u{b[:1].isupper()}h{bool(hyphen)}", f"p{a.lower() + ' ' + b.lower() in model.pairs}"]


def train_breaks(model: Model, words: list[str], seed: int = 6) -> None:
    """Adds the line-join operation: broken words with and without hyphen against line ends between words."""
    rng = random.Random(seed)
    data = []
    some = [w for w in words[: SAMPLE_WORDS // 2] if len(w) > 2 and w.isalpha()]
    for w, v in zip(some, some[1:], strict=False):
        at = rng.randint(1, len(w) - 1)
        hyphen = "-" if rng.random() < 0.85 else ""
        data.append((break_features(w[:at], hyphen, w[at:], model), "J"))
        data.append((break_features(w, "", v, model), "K"))
        if rng.random() < 0.2:
            data.append((break_features(w, "-", v.capitalize(), model), "K"))
    p = Perceptron()
    for _ in range(3):
        rng.shuffle(data)
        for f, label in data:
            p.learn(f, label, ["J", "K"])
    p.average()
    model.editor.weights.update(p.weights)


_DIGITISH = re.compile(r"(?<![^\W_])[0-9lOoI|S]*[0-9lOI|][0-9lOoI|S]*(?![^\W_])")


_CODE = re.compile(r"#/#/[a-zđ-]+")


def mask_line(line: str) -> str:
    """The line with numbers (misread digits too) and document codes masked, spaces run together, in lower case."""
    return _CODE.sub("#/#/@", re.sub(r"\s+", " ", _DIGITISH.sub("#", line)).strip().lower())


def edge_forms(mask: str) -> list[str]:
    """Forms under which a line may recur: whole, without what follows its words, and its beginning."""
    stem = re.sub(r"[\s#.]+$", "", mask)
    words = stem.split()
    return list(dict.fromkeys([mask, *([stem] if stem else []), *(["^" + " ".join(words[:2])] if len(words) > 2 else ["^" + words[0]] if words[:1] == ["#/#/@"] else [])]))


def closed(line: str) -> bool:
    """Whether the line ends as a sentence or clause does."""
    return line.rstrip()[-1:] in ".;:,!?"


def line_features(line: str, top: int, bottom: int, page: int | None, width: int, model: Model, hide: bool = False) -> list[str]:
    """Position on the page, shape, width and recurrence of a line; top and bottom count non-blank lines from each edge."""
    mask = mask_line(line)
    edge = "T" if top < EDGE_TOP else "B" if bottom < EDGE_BOTTOM else "M"
    where = f"{edge}{min(top, 3)}{min(bottom, 3)}" if edge != "M" else "M"
    words = mask.split()
    shape = re.sub(r"[^\W\d_]+", "a", mask)
    numbers = [int(x) for x in re.findall(r"\d+", line) if len(x) < 6]
    hits = [i for i, form in enumerate(edge_forms(mask)) if form in model.edges]
    narrow = len(line.strip()) < 0.75 * width
    known = "?" if hide else f"{hits[:1]}{narrow}{closed(line)}"
    close = "p" if page is not None and page in numbers else "n" if numbers else "-"
    return [
        f"{edge}known{known}", f"{where}known{known}", f"{edge}len{min(len(words), 8)}{narrow}", f"{edge}shape{shape if len(shape) < 12 else 'long'}", f"{edge}page{close}{len(words) <= 3}",
        f"{edge}end{closed(line)}{narrow}", f"{edge}first{' '.join(words[:2])}", f"{edge}upper{line.isupper()}", "bias" + edge,
    ]


def evident(line: str, page: int | None, width: int, model: Model) -> bool:
    """Whether a short line speaks for furniture wherever it stands: it has the page's number, or a form that recurs at edges."""
    text = line.strip()
    if len(text) >= 0.75 * width and len(text.split()) > 3:
        return False
    if page is not None and len(text.split()) <= 3 and page in [int(x) for x in re.findall(r"\d+", text) if len(x) < 6]:
        return True
    return any(form in model.edges for form in edge_forms(mask_line(text)))


def is_furniture(line: str, top: int, bottom: int, page: int | None, width: int, model: Model) -> bool:
    """Lines at an edge are scored unless they are as wide as the page, those inside the page where there is evidence."""
    if len(line) >= 0.75 * width and len(line.split()) > WIDE:
        return False
    if top >= EDGE_TOP and bottom >= EDGE_BOTTOM and not evident(line, page, width, model):
        return False
    s = model.furniture.scores(line_features(line, top, bottom, page, width, model), ("F", "K"))
    return s["F"] > s["K"]


def train_furniture(model: Model, lines: list[tuple[str, int, int, int | None, bool, int]], seed: int = 7) -> None:
    """Lines of unscanned pages are content; lines whose form recurs at edges are furniture, inside the page if the whole line does."""
    rng = random.Random(seed)
    data = []
    for line, top, bottom, page, scanned, width in lines[:SAMPLE_LINES]:
        edge = top < EDGE_TOP or bottom < EDGE_BOTTOM
        forms = [form for form in edge_forms(mask_line(line)) if edge or not form.startswith("^")]
        recurs = any(form in model.edges for form in forms)
        truth = "F" if scanned and recurs and not closed(line) and len(line.strip()) < 0.75 * width else "K"
        data.append((line_features(line, top, bottom, page, width, model), truth))
        if truth == "F" and rng.random() < 0.4:
            data.append((line_features(line, top, bottom, page, width, model, hide=True), truth))
    p = Perceptron()
    for _ in range(4):
        rng.shuffle(data)
        for f, label in data:
            p.learn(f, label, ["F", "K"])
    p.average()
    model.furniture = p


def repair_page(text: str, page: int | None, model: Model) -> tuple[str, int, int, int]:
    """Continuous paragraphs of the page's content, and the numbers of joins, words and lines changed.

    Furniture goes first, so that what it says is not read anew; lines that are known for it only
    once their words are repaired go in a second look."""
    kept, dropped = _without_furniture(text.split("\n"), page, model)
    broken, joins = fix_breaks("\n".join(kept), model)
    fixed, words = fix_words(broken, model)
    lines = fixed.split("\n")
    if words:
        lines, more = _without_furniture(lines, page, model)
        dropped += more
    return unwrap([x.rstrip() for x in lines]), joins, words, dropped


def _without_furniture(lines: list[str], page: int | None, model: Model) -> tuple[list[str], int]:
    """The lines that are content, and how many went; looked at again as long as lines go, since others then stand at the edge."""
    n = 0
    while True:
        full = [i for i, x in enumerate(lines) if x.strip()]
        width = max((len(lines[i]) for i in full), default=0)
        dropped = {i for k, i in enumerate(full) if is_furniture(lines[i], k, len(full) - 1 - k, page, width, model)}
        if not dropped:
            return lines, n
        lines, n = [x for i, x in enumerate(lines) if i not in dropped], n + len(dropped)


def unwrap(lines: list[str]) -> str:
    """Lines of a paragraph made one; a line that ends a sentence well short of the page's width ends its paragraph."""
    widths = sorted(len(x) for x in lines if x.strip())
    width = widths[int(len(widths) * 0.8)] if widths else 0
    out: list[str] = []
    open_line = False
    for line in lines:
        text = line.strip()
        if not text:
            open_line = False
            continue
        if open_line and not re.match(r"(?:[-•*–]|\d+[.)]|Điều \d|Chương |Mục \d|Article )\s*", text):
            out[-1] += " " + text
        else:
            out.append(text)
        open_line = not (re.search(r"[.:;!?]$", text) and len(line) < 0.85 * width)
    return "\n".join(out)


def _scanned(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(True))


def fit(pages: DataFrame) -> Model:
    """The model of a table of pages (source, page, ocr_used, text).

    All counts are made by Spark over all pages, words and their neighbours in one pass; the driver gets what reaches the shares
    only, and the bounded samples."""
    has = pages.filter(F.col("text").isNotNull())
    clean = has.filter(~_scanned("ocr_used"))
    words = lambda c: F.expr(f"transform(regexp_extract_all({c}, '[\\\\p{{L}}\\\\p{{N}}]+', 0), x -> if(x rlike '^[0-9]+$', '#', x))")
    # pairs do not reach over punctuation; the last word of a run has no neighbour
    runs = clean.select(F.explode(F.split(F.lower("text"), "[^\\p{L}\\p{N}\\s]+|\\n\\s*\\n")).alias("run")).select(words("run").alias("w")).filter(F.size("w") > 0)
    couples = runs.select(F.explode(F.arrays_zip(F.col("w").alias("a"), F.concat(F.slice("w", 2, F.size("w")), F.array(F.lit(None).cast("string"))).alias("b"))).alias("p"))
    counted = cut_lineage(couples.groupBy("p.a", "p.b").agg(F.count("*").alias("n")))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    lexicon = [r["a"] for r in counted.filter("a <> '#'").groupBy("a").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(3.0, WORD_SHARE * total)).orderBy("a").collect()]
    pairs = [f"{r['a']} {r['b']}" for r in counted.filter(F.col("b").isNotNull() & (F.col("n") >= max(2.0, PAIR_SHARE * total))).collect()]
    edge = (F.col("top") < EDGE_TOP) | (F.col("bottom") < EDGE_BOTTOM)
    masks = has.select("source", _scanned("ocr_used").alias("scanned"), F.explode(_forms_batch("text", "page", _scanned("ocr_used"))).alias("f")).select("source", "scanned", "f.*")
    recur = masks.groupBy("form").agg(
        F.countDistinct(F.when(F.col("scanned") & F.col("edge") & F.col("short"), F.col("source"))).alias("sources"),
        F.count_if(F.col("scanned") & ~F.col("edge") & F.col("short") & ~F.col("numbered")).alias("inside"),
        F.count_if(F.col("scanned") & F.col("edge") & F.col("short")).alias("n_edge"),
        F.count_if(~F.col("scanned") & ~F.col("form").startswith("^")).alias("clean"),
    )
    recur = cut_lineage(recur.filter("n_edge >= 3").select("form", "n_edge", (F.expr("sources >= 2 AND clean = 0 AND inside * 4 <= n_edge")).alias("fair")))
    at_edges = recur.agg(F.coalesce(F.sum("n_edge"), F.lit(0)).alias("n")).first()["n"]
    edges = [r["form"] for r in recur.filter(F.col("fair") & (F.col("n_edge") >= max(3.0, EDGE_SHARE * at_edges))).collect()]
    tokens = clean.select(F.xxhash64("source", "page").alias("h"), F.lower("text").alias("t")).orderBy("h").limit(SAMPLE_PAGES).select(F.posexplode(words("t")).alias("i", "w"), "h")
    sample = [r["w"] for r in tokens.filter("w <> '#'").orderBy("h", "i").limit(SAMPLE_WORDS).collect()]
    some = _page_lines(has.orderBy(F.xxhash64("source", "page")).limit(SAMPLE_LINE_PAGES))
    shown = some.filter(edge | (F.pmod("h", F.lit(7)) == 0)).orderBy("h", "top").limit(SAMPLE_LINES)
    rows = [(r["line"], r["top"], r["bottom"], r["page"], r["scanned"], r["width"]) for r in shown.collect()]
    return build(lexicon, pairs, edges, sample, rows)


def build(lexicon: Iterable[str], pairs: Iterable[str], edges: Iterable[str], sample: list[str], lines: list) -> Model:
    lexicon = frozenset(lexicon)
    model = Model(lexicon, frozenset(pairs), frozenset(edges), known=lexicon | {"#"}, ordered=sorted(lexicon))
    rng = random.Random(3)
    cased = [w.capitalize() if rng.random() < 0.12 else w.upper() if rng.random() < 0.04 else w for w in sample]
    model.editor, model.labels = train_editor(cased)
    train_breaks(model, sample)
    train_furniture(model, lines)
    return model


def _page_lines(pages: DataFrame) -> DataFrame:
    full = F.filter(F.split("text", "\\r?\\n"), lambda x: F.trim(x) != "")
    rows = pages.select("source", "page", F.xxhash64("source", "page").alias("h"), _scanned("ocr_used").alias("scanned"), full.alias("full"))
    width = F.coalesce(F.array_max(F.transform("full", F.length)), F.lit(0))
    rows = rows.select("source", "page", "h", "scanned", width.alias("width"), F.size("full").alias("n"), F.posexplode("full").alias("top", "line"))
    return rows.withColumn("bottom", F.col("n") - 1 - F.col("top")).drop("n")


FORM = T.StructType().add("form", T.StringType()).add("edge", T.BooleanType()).add("short", T.BooleanType()).add("numbered", T.BooleanType())


def page_forms(text: str, page: int | None, scanned: bool) -> list[tuple[str, bool, bool, bool]]:
    """The forms of a page's lines, and of each whether its line stands at an edge, is short and open, and is the page's number.

    Long lines of scanned pages are no furniture and left out; so are the beginnings of lines of unscanned pages."""
    full = [x for x in text.splitlines() if x.strip()]
    width = max(map(len, full), default=0)
    out = []
    for top, line in enumerate(full):
        short = len(line.strip()) < 0.75 * width and not closed(line)
        if scanned and not short and len(line) >= 60:
            continue
        edge = top < EDGE_TOP or len(full) - 1 - top < EDGE_BOTTOM
        numbered = page is not None and len(line.split()) <= 3 and str(page) in re.findall(r"\d+", line)
        out += [(f, edge, short, numbered) for f in edge_forms(mask_line(line)) if scanned or f[0] != "^"]
    return out


@F.pandas_udf(T.ArrayType(FORM))
def _forms_batch(texts: pd.Series, pages: pd.Series, scanned: pd.Series) -> pd.Series:
    rows = zip(texts, pages, scanned, strict=True)
    return pd.Series([[dict(zip(FORM.names, x, strict=True)) for x in page_forms(t, None if pd.isna(p) else int(p), bool(s))] for t, p, s in rows], dtype=object)


RESULT = T.StructType().add("text", T.StringType()).add("joins", T.IntegerType()).add("words", T.IntegerType()).add("furniture", T.IntegerType())


def repair_scans(pages: DataFrame, model: Model) -> DataFrame:
    """Every page with repaired (its content as paragraphs), joins, words, furniture (counts) and noisy."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def repair(texts: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        m = shared.value
        rows = [(None, 0, 0, 0) if not t else repair_page(t, None if pd.isna(p) else int(p), m) for t, p in zip(texts, numbers, strict=True)]
        return pd.DataFrame(rows, columns=["text", "joins", "words", "furniture"])

    sent = F.when(_scanned("ocr_used"), F.col("text"))
    out = pages.withColumn("__r", repair(sent, F.col("page")))
    out = out.withColumn("repaired", F.coalesce("__r.text", "text"))
    for c in ("joins", "words", "furniture"):
        out = out.withColumn(c, F.coalesce(f"__r.{c}", F.lit(0)))
    return out.withColumn("noisy", F.col("joins") + F.col("words") + F.col("furniture") > 0).drop("__r")
