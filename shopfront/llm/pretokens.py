"""Cutting texts into the pieces that byte-pair merges never cross.

Most texts hold only common characters; for these the standard library's matcher with spelled-out
classes is exact and faster. Any other text takes the general way of its caller.
"""

from __future__ import annotations

import re

#: Characters for which the classes below are the Unicode classes, and which neither normal form C
#: nor lower-casing changes by context: printable ASCII, common white space, Latin-1 and Latin
#: Extended-A without the dotted capital I, and general punctuation.
COMMON = re.compile(r"[\t\n\r -~¡-įı-ſ‐-‧]*")
LETTER = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
NUMBER = "0-9²³¹¼-¾"
SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"

BYTE_LEVEL = re.compile(
    rf"{SUFFIXES}| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+"
)
WORD_LEVEL = re.compile(rf"{SUFFIXES}|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+")


def is_common(text: str) -> bool:
    return COMMON.fullmatch(text) is not None
