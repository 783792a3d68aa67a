"""Rule-built test of whether a token is a well-formed Vietnamese syllable."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

TONES = "̣̀́̃̉"
_SYLLABLE = re.compile(
    "(?:ngh|ng|nh|gh|gi|kh|ph|th|tr|ch|qu|[bcdđghklmnprstvx])?"
    "(?:uyê|uya|iê|yê|uô|ươ|oa|oă|oe|oo|uê|uy|uâ|uơ|ia|ua|ưa|[aăâeêioôơuưy])"
    "(?:ng|nh|ch|[cmnptiyou])?"
)
#: Lower-case letters of the Vietnamese alphabet that lie outside ASCII.
VIETNAMESE = frozenset(
    unicodedata.normalize("NFC", base + tone) for base in "aăâeêioôơuưy" for tone in ("", *TONES)
) - frozenset("aeiouy") | {"đ"}
LETTERS = VIETNAMESE | frozenset(c.upper() for c in VIETNAMESE)


def split_tone(token: str) -> tuple[str, str]:
    """The token without tone marks (quality marks stay), and its tone marks."""
    base, tones = [], []
    for ch in unicodedata.normalize("NFD", token):
        (tones if ch in TONES else base).append(ch)
    return unicodedata.normalize("NFC", "".join(base)), "".join(tones)


@lru_cache(maxsize=200_000)
def is_syllable(token: str) -> bool:
    base, tones = split_tone(token.lower())
    return len(tones) <= 1 and len(base) <= 7 and _SYLLABLE.fullmatch(base) is not None


def is_marked(token: str) -> bool:
    return any(c in LETTERS for c in token)


def strip_marks(token: str) -> str:
    """ASCII skeleton: no tone or quality marks, đ as d."""
    plain = "".join(c for c in unicodedata.normalize("NFD", token) if not unicodedata.combining(c))
    return plain.replace("đ", "d").replace("Đ", "D")


def char_class(chars: str) -> str:
    """The characters as compact ranges for a regular expression's class; few ranges keep the JVM's test short."""
    codes = sorted(set(map(ord, chars)))
    out, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"\\x{{{codes[i]:x}}}" if i == j else f"\\x{{{codes[i]:x}}}-\\x{{{codes[j]:x}}}")
        i = j + 1
    return "".join(out)
