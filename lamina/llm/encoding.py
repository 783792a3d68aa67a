"""Detection and repair of text that was decoded with the wrong character encoding.

Characters are mapped back to the bytes of a legacy code page, a byte-structure
automaton (a regular language over those bytes) finds the maximal well-formed
UTF-8 spans, and only those spans are decoded.  Rounds repeat, so text garbled
twice is restored too.  Vietnamese single-byte and base-plus-modifier fonts have
no multibyte structure; for them runs of tokens are converted by table and kept
only where the result is well-formed syllables and the stored text is not.

Defined cases: null text gives null text, no mark; empty text is clean; columns with the
names of the result give way, others pass through; text of
any length is processed whole; a U+FFFD, or a question mark inside words, marks
the row as garbled with nothing to restore.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm.syllables import LETTERS, is_syllable

# Code pages through which UTF-8 bytes are commonly misread.
CODE_PAGES = (
    "cp1252", "latin-1", "cp1258", "mac_roman", "cp437", "cp850", "cp1251", "cp1250",
    "cp1253", "cp1254", "cp1257", "iso8859-2", "iso8859-15", "koi8-r", "cp866", "cp874",
)

# The TCVN 5712-3 (ABC) font table; pairs of code-page-1252 text and letter.
TCVN3 = dict(
    zip(
        "µ¶·¸¹¨»¼½¾Æ©ÇÈÉÊËÌÎÏÐÑªÒÓÔÕÖ×ØÜÝÞßáâãä«åæçèé¬êëìíîïñòóô­õö÷øùúûüýþ®¡¢£¤¥¦§",
        "àảãáạăằẳẵắặâầẩẫấậèẻẽéẹêềểễếệìỉĩíịòỏõóọôồổỗốộơờởỡớợùủũúụưừửữứựỳỷỹýỵđĂÂÊÔƠƯĐ",
        strict=True,
    )
)
# The VNI font table; what follows a base letter, and the marks it adds.
VNI_MARKS = {
    "ø": "̀", "ù": "́", "û": "̉", "õ": "̃", "ï": "̣",
    "â": "̂", "à": "̂̀", "á": "̂́", "å": "̂̉", "ã": "̂̃", "ä": "̣̂",
    "ê": "̆", "è": "̆̀", "é": "̆́", "ú": "̆̉", "ü": "̆̃", "ë": "̣̆",
}
VNI_SINGLE = {"ô": "ơ", "ö": "ư", "ñ": "đ", "í": "í", "ì": "ì", "æ": "ỉ", "ó": "ĩ", "ò": "ị", "î": "ỵ"}
# The VISCII table from byte 0x80 to byte 0xFF.
VISCII = (
    "ẠẮẰẶẤẦẨẬẼẸẾỀỂỄỆỐỒỔỖỘỢỚỜỞỊỎỌỈỦŨỤỲÕắằặấầẩậẽẹếềểễệốồổỗỠƠộờởịỰỨỪỬơớƯ"
    "ÀÁÂÃẢĂẳẵÈÉÊẺÌÍĨỳĐứÒÓÔạỷừửÙÚỹỵÝỡưàáâãảăữẫèéêẻìíĩỉđựòóôõỏọụùúũủýợỮ"
)

_UTF8 = re.compile(
    "(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}"
    "|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3})+"
)
_WORD = re.compile(r"\S+")
_OUTSIDE = "￿"
_CLOSERS = "”’»…–—"
_TYPOGRAPHIC = "–—‘’“”…•«» \xa0"


@lru_cache(maxsize=None)
def _byte_of(page: str) -> dict[int, str]:
    """Character to byte (as a Latin-1 character); bytes the page leaves undefined stay control characters."""
    table: dict[int, str] = {}
    for b in range(0x80, 0x100):
        table.setdefault(b, chr(b)) if page in ("cp1252", "latin-1") or b < 0xA0 else None
    for b in range(0x80, 0x100):
        try:
            table[ord(bytes([b]).decode(page))] = chr(b)
        except (UnicodeDecodeError, TypeError):
            table[b] = chr(b)
    return table


class _ToBytes(dict):
    """str.translate table: ASCII stays, characters outside the page become a mark no rule accepts."""

    def __init__(self, page: str) -> None:
        super().__init__({k: chr(k) for k in range(0x80)} | _byte_of(page))

    def __missing__(self, key: int) -> str:
        self[key] = _OUTSIDE
        return _OUTSIDE


@lru_cache(maxsize=None)
def _translator(page: str) -> _ToBytes:
    return _ToBytes(page)


@lru_cache(maxsize=None)
def _page_characters() -> frozenset[str]:
    """Every character some code page shows for a byte above 0x7F."""
    return frozenset(chr(k) for page in CODE_PAGES for k in _byte_of(page))


@lru_cache(maxsize=None)
def _stage_characters() -> frozenset[str]:
    """Characters that the first of two misreadings leaves behind."""
    return frozenset(chr(k) for page in ("cp1252", "mac_roman") for k in _byte_of(page))


def _clear(decoded: str) -> bool:
    return any(c in LETTERS or c in _TYPOGRAPHIC or unicodedata.combining(c) for c in decoded)


@lru_cache(maxsize=None)
def _gate() -> re.Pattern:
    """Misread UTF-8 holds at least one of these: Vietnamese letters and typographic signs alone never result from it."""
    return re.compile("[" + re.escape("".join(sorted(_page_characters() - LETTERS - frozenset(_TYPOGRAPHIC)))) + "]")


def _believable(decoded: str) -> bool:
    """Decoded text that Vietnamese or English writing holds, or another garbled stage of it."""
    for ch in decoded:
        if ch in _stage_characters():
            continue
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Co", "Cs") or (cat == "Cc" and ord(ch) < 0x80):
            return False
        if 0x0180 <= ord(ch) < 0x02B0 and ch not in LETTERS:
            return False
        if 0x0500 <= ord(ch) < 0x0E00:
            return False
    return True


_RUN = re.compile("[^\x00-\x7f]{2,}")


def _runs_of(text: str) -> tuple[str, list[int], list[int]]:
    """The runs of two or more characters outside ASCII, which hold every multibyte span, joined by spaces,
    with each run's place in the joined string and in the text."""
    joined, here, there, at = [], [], [], 0
    for m in _RUN.finditer(text):
        joined.append(m.group())
        here.append(at)
        there.append(m.start())
        at += len(m.group()) + 1
    return " ".join(joined), here, there


def _spans(text: str, page: str, runs: tuple[str, list[int], list[int]] | None = None) -> list[tuple[int, int, str]]:
    """Maximal well-formed multibyte spans of the text under one code page, decoded."""
    joined, here, there = runs or _runs_of(text)
    found = []
    for m in _UTF8.finditer(joined.translate(_translator(page))):
        try:
            decoded = m.group().encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        run = bisect_right(here, m.start()) - 1
        start = there[run] + m.start() - here[run]
        stored = joined[m.start() : m.end()]
        if not _believable(decoded) or (len(decoded) == 1 and not _clear(decoded) and decoded not in _stage_characters()):
            continue
        if len(decoded) == 1 and len(stored) == 2 and stored[1] in _CLOSERS and stored[0].isalpha() and _quoted(text, start, stored):
            continue
        found.append((start, start + len(stored), decoded))
    return found if any(_clear(d) for _, _, d in found) else []


def _quoted(text: str, start: int, stored: str) -> bool:
    """A letter before a closing quotation mark or dash is writing, not a garbled letter."""
    before = text[max(0, start - 1) : start]
    return before.isupper() or stored[1] in "…–—" or any(text.count(a, 0, start) > text.count(b, 0, start) for a, b in ("“”", "«»"))


def _outside(text: str, spans: list[tuple[int, int, str]]) -> str:
    edges = [0, *(x for a, b, _ in spans for x in (a, b)), len(text)]
    return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


@lru_cache(maxsize=None)
def _page_set(page: str) -> frozenset[str]:
    return frozenset(map(chr, _byte_of(page)))


def _weight(spans: list[tuple[int, int, str]]) -> float:
    total = 0.0
    for a, b, decoded in spans:
        good = sum(1 for ch in decoded if ch in LETTERS or ch in "–—‘’“”…• ")
        total += (b - a) * (0.2 + good / len(decoded))
    return total


def undo_utf8(text: str) -> tuple[str, int]:
    """Text with its misread UTF-8 spans decoded, however often it was misread, and how many spans there were.

    A decoded span is shorter than what is stored, so the rounds end."""
    n = 0
    while _gate().search(text):
        odd = {c for c in text if ord(c) > 0x7F and (c not in LETTERS or c in "ÂÃ")}
        best, score = [], 0.0
        runs = _runs_of(text)
        if not runs[0]:
            break
        for page in sorted(CODE_PAGES, key=lambda p: -len(odd & _page_set(p))):
            spans = _spans(text, page, runs)
            if spans and (w := _weight(spans)) > score:
                best, score = spans, w
                if not _gate().search(_outside(text, spans)):
                    break  # this page explains every odd character
        if not best:
            break
        out, at = [], 0
        for a, b, decoded in best:
            out += (text[at:a], decoded)
            at = b
        text = "".join([*out, text[at:]])
        n += len(best)
    return text, n


def _cased(token: str, new: str) -> str:
    """The fonts draw capitals with the bytes of small letters; the plain letters around tell the case."""
    plain = [c for c in token if c.isascii() and c.isalpha()]
    return new.upper() if plain and all(c.isupper() for c in plain) else new


def _from_tcvn3(token: str) -> str:
    return _cased(token, "".join(TCVN3.get(c, c) for c in token))


def _from_vni(token: str) -> str:
    out: list[str] = []
    for ch in token:
        low = ch.lower()
        if out and low in VNI_MARKS and unicodedata.normalize("NFD", out[-1])[0].lower() in "aeiouy" and len(out[-1]) == 1:
            merged = unicodedata.normalize("NFC", out[-1] + VNI_MARKS[low])
            if len(merged) == 1:
                out[-1] = merged
                continue
        if low in VNI_SINGLE:
            out.append(VNI_SINGLE[low] if ch == low else VNI_SINGLE[low].upper())
        else:
            out.append(ch)
    return _cased(token, "".join(out))


@lru_cache(maxsize=None)
def _viscii_table() -> dict[str, str]:
    table = {}
    for i, letter in enumerate(VISCII):
        byte = bytes([0x80 + i])
        for page in ("latin-1", "cp1252"):
            try:
                table[byte.decode(page)] = letter
            except UnicodeDecodeError:
                pass
    return table


def _from_viscii(token: str) -> str:
    table = _viscii_table()
    return "".join(table.get(c, c) for c in token)


def _from_cp1258(token: str) -> str:
    try:
        return unicodedata.normalize("NFC", token.encode("cp1252").decode("cp1258"))
    except UnicodeError:
        return token


FONTS = {"tcvn3": _from_tcvn3, "vni": _from_vni, "viscii": _from_viscii, "cp1258": _from_cp1258}
_PUNCT = ".,;:!?()[]\"'“”‘’/-–%0123456789"


@lru_cache(maxsize=100_000)
def _font_votes(token: str) -> dict[str, str]:
    """Fonts under which a token that is no syllable becomes one."""
    core = token.strip(_PUNCT)
    if not core or core.isascii() or is_syllable(core):
        return {}
    votes = {}
    for font, convert in FONTS.items():
        new = convert(core)
        if new in (core, core.replace("ð", "đ").replace("Ð", "Đ")):
            continue  # the letter eth alone is a look-alike, not an encoding
        if is_syllable(new) and any(c in LETTERS for c in new):
            votes[font] = token.replace(core, new, 1)
    return votes


def undo_fonts(text: str, least: int = 3) -> tuple[str, int]:
    """Text whose runs in a legacy Vietnamese font are converted, and the number of converted tokens.

    A font is believed from `least` different tokens on, and in a shorter text from two if all its words outside ASCII are such tokens; between the
    first and last such token of a line every token that the font turns into a syllable is converted."""
    if not _gate().search(text):
        return text, 0
    words = list(_WORD.finditer(text))
    counts: dict[str, set[str]] = {}
    for m in words:
        for font in _font_votes(m.group()):
            counts.setdefault(font, set()).add(m.group())
    if not counts:
        return text, 0
    font = max(counts, key=lambda f: len(counts[f]))
    if len(counts[font]) < least and not (len(counts[font]) == least - 1 and all(w.group() in counts[font] for w in words if not w.group().isascii() and any(c.isalpha() for c in w.group()))):
        return text, 0
    convert, out, at, n = FONTS[font], [], 0, 0
    voters = [m for m in words if font in _font_votes(m.group())]
    hot = _runs(words, voters)
    for m in hot:
        token = m.group()
        new = convert(token.strip(_PUNCT))
        core = token.strip(_PUNCT)
        if new != core and not core.isascii() and (font in _font_votes(token) or is_syllable(new) or not is_syllable(core)):
            out += (text[at : m.start()], token.replace(core, new, 1))
            at, n = m.end(), n + 1
    return "".join([*out, text[at:]]), n


def _runs(words: list, voters: list) -> list:
    """Tokens that lie between voters no more than eight tokens apart."""
    index = {m.start(): i for i, m in enumerate(words)}
    at = [index[m.start()] for m in voters]
    keep: list[int] = []
    for i, p in enumerate(at):
        keep.append(p)
        if i + 1 < len(at) and at[i + 1] - p <= 9:
            keep.extend(range(p + 1, at[i + 1]))
    return [words[i] for i in keep]


_LOST = re.compile(r"(?<![^\W\d_])\?+[a-zà-ỹ]|[^\W\d_]\?+[^\W\d_]")


def restore(text: str | None) -> tuple[bool, str | None, str]:
    """Whether the text is garbled, the restored text, and what was found (codes joined by +)."""
    if not text:
        return False, text, ""
    found = []
    fixed, n = undo_utf8(text)
    if n:
        found.append("multibyte")
    fixed, m = undo_fonts(fixed)
    if m:
        found.append("font")
    if "�" in text:
        found.append("replaced")
    elif len(_LOST.findall(text)) >= 3:
        found.append("question")
    return bool(found), fixed if n or m else text, "+".join(found)


#: The only texts that are looked at: with anything but ASCII, Vietnamese letters and typographic signs, or a question mark before a
#: letter or another.  Python's engine tests a large class much faster than the JVM's, the way to Python included.
_DOUBTFUL = re.compile("[^\\x00-\\x7f" + "".join(sorted(LETTERS)) + _TYPOGRAPHIC + "]|\\?(?:[^\\W\\d_]|\\?)")
RESULT = (
    T.StructType()
    .add("garbled", T.BooleanType())
    .add("restored", T.StringType())
    .add("kinds", T.StringType())
)


@F.pandas_udf(RESULT)
def _restore_batch(texts: pd.Series) -> pd.DataFrame:
    rows = [restore(t) if t and _DOUBTFUL.search(t) else (False, None, "") for t in texts]
    return pd.DataFrame(rows, columns=["garbled", "restored", "kinds"])


def repair_encoding(df: DataFrame, column: str = "text") -> DataFrame:
    """Adds garbled, restored and kinds (names prefixed with the column's name) to every row."""
    text = F.col(f"`{column}`")
    out = df.withColumn("__fix", _restore_batch(text))
    return (
        out.withColumn(f"{column}_garbled", F.coalesce(F.col("__fix.garbled"), F.lit(False)))
        .withColumn(f"{column}_restored", F.coalesce(F.col("__fix.restored"), text))
        .withColumn(f"{column}_kinds", F.coalesce(F.col("__fix.kinds"), F.lit("")))
        .drop("__fix")
    )
