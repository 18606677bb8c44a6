"""Romanisation of names and addresses to lower-case ASCII.

Latin letters lose their marks by decomposition. Letters of other scripts are named by Unicode (`DEVANAGARI LETTER
KA`, `CYRILLIC SMALL LETTER SHCHA`), and the name's last word is the sound; consonants of Indic scripts lose the
inherent vowel. This approximates a transliteration table, it doesn't equal any particular one.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that do not decompose, and punctuation.
LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...", "।": "."}
INDIC = ("DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM")


@lru_cache(maxsize=1 << 16)
def of_char(c: str) -> str:
    if c.isascii():
        return c.lower()
    if c.lower() in LETTERS:
        return LETTERS[c.lower()]
    plain = "".join(x for x in unicodedata.normalize("NFKD", c) if x.isascii())
    if plain:
        return plain.lower()
    if unicodedata.category(c) in ("Nd", "Nl", "No") and unicodedata.digit(c, None) is not None:
        return str(unicodedata.digit(c))
    base = unicodedata.normalize("NFKD", c)[0]
    if base != c and unicodedata.category(c)[0] == "L":
        return of_char(base)
    name = unicodedata.name(c, "")
    kind, _, sound = name.rpartition(" ")
    sound = sound.lower()
    if name.startswith("CYRILLIC"):
        m = re.fullmatch(r"e?([^aeiouy]+)[aeiou]*", sound)
        return (m[1].removesuffix("h") if m[1] == "gh" else m[1]) if m else {"ie": "e", "io": "yo", "yeru": "y", "sign": ""}.get(sound, sound)
    if name.startswith("GREEK"):
        return sound[:2] if sound[:2] in ("th", "ph", "ch", "ps") else sound[:1]
    if "VIRAMA" in name or "NUKTA" in name or unicodedata.category(c) == "Mn" and "VOWEL SIGN" not in name:
        return "n" if sound in ("anusvara", "candrabindu", "bindi", "tippi") else "h" if sound == "visarga" else ""
    if "VOWEL SIGN" in name:
        return sound
    if kind.startswith(INDIC) and "LETTER" in kind and len(sound) > 1 and sound.endswith("a") and sound != "aa":
        return sound[:-1]
    if "LETTER" in kind or "SYLLABLE" in kind:
        return sound if sound.isalpha() else ""
    return "" if unicodedata.category(c)[0] in "MC" else " "


def romanised(s: str | None) -> str:
    s = s or ""
    return s.lower() if s.isascii() else "".join(map(of_char, unicodedata.normalize("NFC", s)))


@F.pandas_udf(T.StringType())
def latin(s: pd.Series) -> pd.Series:
    return s.map(romanised)
