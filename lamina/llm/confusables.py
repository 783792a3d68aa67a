"""Bringing visually identical text to one consistent form (problem 3).

Look-alike classes are the transitive closure, by union-find, over strings and code
points: compatibility forms (full-width, mathematical letters, ligatures), spaces,
unseen characters, decomposed letters, letters of other scripts drawn alike, and what the corpus itself shows: a letter that is
no ordinary one joins the ordinary letter with which most of its words become words of the corpus.
The representative of a class is its most frequent member in the corpus among the ordinary ones, or where there is none among
those that are no compatibility form of another.  Texts are
rewritten greedily, longest match first, by a multi-pattern automaton; a match
inside a genuine word of another script, and typographic or mathematical signs,
stay as they are.

Defined cases: null stays null, empty stays empty; columns with the names of the result
give way, others pass through; texts of any length are processed
whole; a tie in frequency is won by the member that is plain ASCII, then composed
Vietnamese, then the smallest string; a letter that stands for two ordinary ones about equally often joins neither.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.encoding import restore
from lamina.llm.syllables import LETTERS, char_class, is_syllable
from lamina.session import cut_lineage

# Letters of other scripts and their Latin look-alikes, in pairs.
CYRILLIC = "АA ВB ЕE ЅS ІI ЇÏ ЈJ КK МM НH ОO РP СC ТT УY ХX ԌG ԚQ ԜW ҮY ӀI аa еe ѕs іi їï јj оo рp сc уy хx һh ԁd ԛq ԝw ӏl ѵv"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ιi κk αa ρp υu ϲc ϳj"
OTHER = "օo սu հh ոn ցg զq ᎠD ᎪA ᏴB ᏟC ᎬE ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᏚS ᎢT ᏙV ᏃZ"
LATIN = "ɖđ ƉĐ ðđ ÐĐ ɑa ɡg ıi ɩi ǃ! ƿp ǎă ǍĂ ꞌ'"
SIGNS = "․. ‚, ‐- ‑- ‒- ꓸ. ꓹ, ՚' ՝' ː: ꞉: ׃: ։: ٪% ⁎* ∗* ﹡*"
_TAGS = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<small>")
_UNSEEN_EXTRA = "͏ᅟᅠ឴឵᠋᠌᠍᠎᠏ㅤﾠ︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️"
LEAST_WORDS, CLEARLY = 3, 2  # words that must speak for an edge the corpus shows, and how many times those for the next letter
_HOLE = "\ue000"
_SPACES = "               　  "


class UnionFind:
    """Disjoint sets of strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def classes(self) -> list[list[str]]:
        groups: dict[str, list[str]] = {}
        for x in self.parent:
            groups.setdefault(self.find(x), []).append(x)
        return [sorted(g) for g in groups.values() if len(g) > 1]


def _pairs(listing: str) -> list[tuple[str, str]]:
    flat = re.findall(r"(\S)(\S)", listing)
    return [(a, b) for a, b in flat]


@lru_cache(maxsize=1)
def unseen() -> str:
    """Characters without any mark on the page: format controls, soft hyphen, fillers, variation selectors."""
    formats = "".join(chr(c) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Cf" and not 0x600 <= c <= 0x8E2 and not 0x110BD <= c <= 0x1D17A)
    controls = "".join(chr(c) for c in (*range(0, 9), *range(14, 32), 127))
    tags = "".join(map(chr, range(0xE0000, 0xE0080)))
    return "".join(sorted(set(formats + controls + tags + _UNSEEN_EXTRA)))


@lru_cache(maxsize=8)
def look_alikes(shown: tuple[tuple[str, str], ...] = ()) -> list[list[str]]:
    """The look-alike classes, with the edges that a corpus shows; their number is bounded by the Unicode tables."""
    uf = UnionFind()
    for a, b in shown:
        uf.join(a, b)
    for listing in (CYRILLIC, GREEK, OTHER, LATIN, SIGNS):
        for a, b in _pairs(listing):
            uf.join(a, b)
    for c in range(0x80, 0x1F000):
        ch = chr(c)
        form = unicodedata.decomposition(ch)
        if not form:
            continue
        tag = form.split()[0] if form[0] == "<" else ""
        plain = unicodedata.normalize("NFKC", ch)
        latin_letters = plain.isascii() and plain.isalpha()
        if tag in _TAGS and not ch.isspace() and (plain.isascii() or 0x370 <= ord(plain[0]) < 0x400):
            uf.join(ch, plain)
        elif tag == "<compat>" and latin_letters and len(plain) > 1 and (0xFB00 <= c <= 0xFB06 or 0x2160 <= c <= 0x217F or 0x1C4 <= c <= 0x1F3 or c in (0x132, 0x133)):
            uf.join(ch, plain)
        elif tag == "<compat>" and latin_letters and 0x2160 <= c <= 0x217F:
            uf.join(ch, plain)
        elif not tag:
            whole = unicodedata.normalize("NFC", ch)
            if whole != ch and not 0xF900 <= c < 0xFB00:
                uf.join(ch, whole)
    for letter in LETTERS | frozenset("ïÏ"):
        parts = unicodedata.normalize("NFD", letter)
        for i in range(1, len(parts)):
            head = unicodedata.normalize("NFC", parts[:i])
            if len(head) == 1:
                uf.join(head + parts[i:], letter)
        swapped = parts[0] + parts[:0:-1]
        if len(parts) > 2:  # marks typed in the other order
            uf.join(swapped, letter)
            uf.join(unicodedata.normalize("NFC", swapped), letter)
    for space in _SPACES:
        uf.join(space, " ")
    return uf.classes()


def representatives(counts: dict[str, int], shown: tuple[tuple[str, str], ...] = ()) -> dict[str, str]:
    """Member to representative, for members that are not their class's representative.

    A string's frequency is that of its rarest code point."""

    def rank(member: str) -> tuple:
        seen = min((counts.get(c, 0) for c in member), default=0)
        made = unicodedata.normalize("NFKC", member) != member
        return (made, -seen, not member.isascii(), not (member in LETTERS), len(member), member)

    rules = {}
    for members in look_alikes(shown):
        plain = [m for m in members if m.isascii() or m in LETTERS]
        best = min(plain or members, key=rank)
        rules |= {m: best for m in members if m != best}
    return rules | {c: "" for c in unseen()}


def _script(ch: str) -> str:
    c = ord(ch)
    if c < 0x250 or 0x1E00 <= c < 0x1F00:
        return "latin" if ch.isalpha() else ""
    if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000:
        return "greek"
    if 0x400 <= c < 0x530:
        return "cyrillic"
    if 0x530 <= c < 0x590:
        return "armenian"
    if 0x13A0 <= c < 0x1400:
        return "cherokee"
    if 0x2E80 <= c < 0xA000 or 0xAC00 <= c < 0xD7B0 or 0xF900 <= c < 0xFB00:
        return "cjk"
    if 0x590 <= c < 0x8FF or 0x900 <= c < 0x1200:
        return "other"
    return ""


_FOREIGN = ("greek", "cyrillic", "armenian", "cherokee")
_WORD = re.compile(r"[^\W_]+(?:[̀-ͯ]+[^\W_]*)*")


def _word_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text)]


class Rewriter:
    """Greedy longest-match rewriting with the context rules for genuine words."""

    def __init__(self, rules: dict[str, str]) -> None:
        self.rules = rules
        self.automaton = ahocorasick.Automaton()
        for member, best in rules.items():
            self.automaton.add_word(member, (member, best))
        self.automaton.make_automaton()
        self.confusable = frozenset(m for m in rules if len(m) == 1)

    def _genuine(self, text: str) -> list[tuple[int, int]]:
        """Spans of words written in another script: words that hold a letter no Latin word could show,
        and, next to such a word, words of the same script; single Greek letters are symbols."""
        spans = _word_spans(text)
        kinds = []
        for a, b in spans:
            word = text[a:b]
            scripts = {_script(c) for c in word} - {""}
            foreign = next((s for s in _FOREIGN if s in scripts), None)
            if foreign is None or len(scripts) > 1 or any(c.isdigit() for c in word):
                kinds.append(("", False))
            else:
                kinds.append((foreign, any(c not in self.confusable for c in word) or (foreign == "greek" and b - a == 1)))
        keep = []
        for i, (kind, sure) in enumerate(kinds):
            if kind and (sure or any(kinds[j][0] == kind and kinds[j][1] and self._near(spans, i, j) for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < len(kinds))):
                keep.append(spans[i])
        return keep

    @staticmethod
    def _near(spans: list[tuple[int, int]], i: int, j: int) -> bool:
        a, b = sorted((i, j))
        return spans[b][0] - spans[a][1] <= 12

    def rewrite(self, text: str) -> str:
        """The text in its consistent form: rewritten until nothing changes, or until a form comes again."""
        seen = set()
        while text not in seen:
            seen.add(text)
            text = self._once(text)
        return text

    def _once(self, text: str) -> str:
        genuine = None
        out, at = [], 0
        for end, (member, best) in self.automaton.iter_long(text):
            start = end - len(member) + 1
            if start < at:
                continue
            ch = member[0]
            kind = _script(ch)
            if len(member) == 1 and kind in _FOREIGN:
                if genuine is None:
                    genuine = self._genuine(text)
                if any(a <= start < b for a, b in genuine):
                    continue
            elif not self._stands_in(text, start, end, member, best, kind):
                continue
            out += (text[at:start], best)
            at = end + 1
        text = "".join([*out, text[at:]]) if out else text
        composed = unicodedata.normalize("NFC", text)
        return composed

    def _stands_in(self, text: str, start: int, end: int, member: str, best: str, kind: str) -> bool:
        around = text[max(0, start - 1) : start] + text[end + 1 : end + 2]
        if member in ("‍", "‌", "️", "︎", "‎", "‏"):
            return not any(_script(c) in ("other",) or ord(c) > 0x1F000 or unicodedata.category(c) == "So" for c in around)
        if "＀" <= member[0] <= "￯" or member == "　":
            return not any(_script(c) == "cjk" or "　" <= c <= "〿" for c in around)
        if member in ("‐", "‑", "‒"):
            return False
        if kind == "latin" and member in ("ð", "Ð", "ɖ", "Ɖ", "ı", "ǎ", "Ǎ", "ƿ", "ɑ", "ɡ", "ɩ"):
            a, b = start, end + 1
            while a > 0 and text[a - 1].isalpha():
                a -= 1
            while b < len(text) and text[b].isalpha():
                b += 1
            word = text[a:b]
            plain = "".join(self.rules.get(c, c) if len(self.rules.get(c, c)) == 1 else c for c in unicodedata.normalize("NFC", word))
            return is_syllable(plain) or plain.isupper() or plain.isascii()
        return True


def disguised(text: str, rewriter: Rewriter) -> bool:
    return rewriter.rewrite(text) != text


#: Texts that hold anything but ASCII, composed Vietnamese letters and common typographic signs.  The class is a bit table in
#: Python's engine, which is several times faster than the JVM's chain of ranges, the way to Python included.
_ODD = re.compile("[^" + re.escape("".join(map(chr, (9, 10, 13, *range(0x20, 0x7F)))) + "".join(sorted(LETTERS)) + "–—‘’“”…«»•§©°²³½×") + "]")


def gated(df: DataFrame, column: str) -> DataFrame:
    """The rows whose text holds a character out of the ordinary."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield frame[[bool(t) and _ODD.search(t) is not None for t in frame[column]]]

    return df.mapInPandas(keep, df.schema)


_ORDINARY = "A-Za-z" + char_class("".join(LETTERS))


_LETTERS = re.compile(r"[^\W\d_]+")


def word_counts(sources: list[tuple[DataFrame, str]]) -> DataFrame:
    """(w, n) over all texts of the columns.  Digits and signs part words.

    Counts are made per task before they are shuffled, so the shuffle carries different words, not tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for frame in batches:
            for text in frame["t"]:
                if text:
                    total.update(_LETTERS.findall(text))
            if len(total) > 200_000:
                yield pd.DataFrame({"w": list(total), "n": list(total.values())})
                total = Counter()
        if total:
            yield pd.DataFrame({"w": list(total), "n": list(total.values())})

    parts = [df.select(F.col(column).alias("t")).mapInPandas(count, "w string, n long") for df, column in sources]
    words = parts[0]
    for part in parts[1:]:
        words = words.unionByName(part)
    return words.groupBy("w").agg(F.sum("n").alias("n"))


def shown_edges(odd_words: DataFrame, sources: list[tuple[DataFrame, str]]) -> list[tuple[str, str]]:
    """Edges between letters that the words of a corpus show: (letter that is none of ordinary writing, ordinary letter).

    Words are brought to known forms first; one that then holds a single strange letter, and two others or more, is a pattern
    with a hole, and the ordinary words that fill the hole vote for their letters.  The words of all texts are counted
    only where there is a pattern.  A letter that has a class already (a ligature) is none.  For each strange letter the two letters with most votes reach the driver, so no more
    rows than twice the letters of Unicode."""
    rules = representatives({})
    known = {m: r for m, r in rules.items() if len(m) == 1 and len(r) == 1}
    plain = F.translate("w", "".join(known), "".join(known.values()))
    strange = f"[^\\x{{0}}-\\x{{24f}}\\x{{1e00}}-\\x{{1eff}}\\P{{L}}\\p{{IsHan}}\\p{{IsHiragana}}\\p{{IsKatakana}}\\p{{IsHangul}}]"
    odd = odd_words.filter(F.col("w").rlike(strange)).select(plain.alias("w")).filter(F.col("w").rlike(f"^[{_ORDINARY}]*{strange}[{_ORDINARY}]*$") & (F.length("w") >= 3)).distinct()
    odd = odd.select(F.regexp_replace("w", strange, _HOLE).alias("pattern"), F.regexp_extract("w", f"({strange})", 1).alias("odd"))
    odd = cut_lineage(odd)
    if odd.isEmpty():
        return []
    whole = word_counts(sources).filter(F.col("w").rlike(f"^[{_ORDINARY}]{{3,}}$"))
    at = F.explode(F.sequence(F.lit(1), F.length("w")))
    holes = whole.select("w", "n", at.alias("i")).select(F.concat(F.expr("substring(w, 1, i - 1)"), F.lit(_HOLE), F.expr("substring(w, i + 1)")).alias("pattern"), F.expr("substring(w, i, 1)").alias("letter"), "n")
    votes = odd.join(holes, "pattern").groupBy("odd", "letter").agg(F.count_distinct("pattern").alias("words"), F.sum("n").alias("n"))
    best = Window.partitionBy("odd").orderBy(F.desc("words"), F.desc("n"), "letter")
    top = votes.withColumn("r", F.row_number().over(best)).filter("r <= 2").collect()
    first = {r["odd"]: (r["letter"], r["words"]) for r in top if r["r"] == 1}
    second = {r["odd"]: r["words"] for r in top if r["r"] == 2}
    return sorted((c, letter) for c, (letter, n) in first.items() if c not in rules and n >= LEAST_WORDS and n >= CLEARLY * second.get(c, 0))


def learn_rules(sources: list[tuple[DataFrame, str]], odd: list[tuple[DataFrame, str]] | None = None) -> dict[str, str]:
    """Representatives by frequency over all rows of all given columns, for classes with the edges these show.

    `odd` are the texts of the sources that pass the gate, where these are known already: no other text holds a letter
    that is counted.  Besides the edges, only counts of the code points of look-alike classes reach the driver; their
    number is fixed by the Unicode tables (a few thousand), whatever the corpus."""
    odd = odd or [(gated(df.select(column), column), column) for df, column in sources]
    words = cut_lineage(word_counts(odd).filter(F.col("w").rlike(f"[^\\x00-\\x7f{_ORDINARY}]")))
    shown = tuple(shown_edges(words, sources))
    members = sorted({c for group in look_alikes(shown) for m in group for c in m if not c.isascii()})
    letters = words.select(F.explode(F.split("w", "")).alias("ch"), "n")
    known = letters.groupBy("ch").agg(F.sum("n").alias("n")).filter(F.col("ch").isin(members))
    return representatives({r["ch"]: r["n"] for r in known.collect()}, shown)


RESULT = T.StructType().add("form", T.StringType()).add("disguised", T.BooleanType())


def unify(df: DataFrame, column: str, rules: dict[str, str], garbled_too: bool = True) -> DataFrame:
    """Adds <column>_form, the consistent form, and <column>_disguised, whether it differs from the stored text.

    With garbled_too, a text that was decoded with the wrong encoding is first restored and is not
    called disguised: what it shows are no look-alikes."""
    shared = df.sparkSession.sparkContext.broadcast(rules)

    @F.pandas_udf(RESULT)
    def rewrite(texts: pd.Series) -> pd.DataFrame:
        rewriter = _rewriter(shared)
        rows = []
        for text in texts:
            if not text or not _ODD.search(text):
                rows.append((None, False))
                continue
            garbled, source, _ = restore(text) if garbled_too else (False, text, "")
            form = rewriter.rewrite(source)
            rows.append((form, not garbled and form != text))
        return pd.DataFrame(rows, columns=["form", "disguised"])

    text = F.col(column)
    out = df.withColumn("__form", rewrite(text))
    return (
        out.withColumn(f"{column}_form", F.coalesce("__form.form", text))
        .withColumn(f"{column}_disguised", F.coalesce("__form.disguised", F.lit(False)))
        .drop("__form")
    )


_CACHE: list = []


def _rewriter(shared) -> Rewriter:
    """One automaton per worker process and rule set."""
    rules = shared.value
    if not _CACHE or _CACHE[0] is not rules:
        _CACHE[:] = [rules, Rewriter(rules)]
    return _CACHE[1]
