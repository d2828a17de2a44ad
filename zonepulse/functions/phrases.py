"""Numbers in running text, found by phrases written the way reports word them.

A phrase is a line of words in plain form (lower case, no accents). Signs in it:

* ``#`` a whole number, ``#5`` one of up to five digits, ``##`` one with spaces between thousands, ``%`` a share with its percent sign;
* ``...`` any text, ``...80`` up to 80 characters of it; ``:`` a colon or dash that may be missing; ``_`` a space or bracket that must follow;
* ``[`` and ``]`` around what may be missing; other words and signs stand for themselves.

Words of four letters or more may carry an s or x, apostrophes may be missing. One
function turns phrases into patterns for Spark's regular expressions, whose groups are
the numbers from left to right.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBERS = {"#": "([0-9]+)", "##": "([0-9][0-9 ]*)", "%": "([0-9]+[,.]?[0-9]*) ?%"}


def _part(token: str) -> tuple[str, bool]:
    """(pattern, whether a space must stand between it and a word) of one token."""
    if token in _NUMBERS:
        return _NUMBERS[token], True
    if re.fullmatch("#[0-9]+", token):
        return f"([0-9]{{1,{token[1:]}}})", True
    if token == ":":
        return "[:-]?", False
    if token == "_":
        return "(?=[ (])", False
    if token in "(),":
        return re.escape(token), False
    word = re.escape(token).replace("'", "'?")
    return (f"{word}[sx]?" if len(token) > 3 else word), True


def pattern(phrase: str) -> str:
    """The phrase as a regular expression over ``plain_words`` text."""
    out, tight = "", True  # tight: what comes next needs no space before it
    for token in phrase.split():
        if token == "[":
            out, tight = out + "(?:", True if not out else tight
        elif token == "]":
            out += ")?"
        elif token.startswith("..."):
            most = token[3:]
            out, tight = out + (f".{{0,{most}}}?" if most else ".*?"), True
        else:
            part, firm = _part(token)
            if token == "_":
                out += part
                continue
            gap = "" if tight or not out else " " if firm and spaced else " ?"
            out, tight = out + gap + part, False
            spaced = firm
    return (r"\b" if re.match("[a-z]", phrase) else "") + out


def first_of(words: Column, phrases: list[str], number: int = 1) -> list[Column]:
    """What each phrase gives for its n-th number, null where it is not said."""
    return [F.nullif(F.trim(F.regexp_extract(words, pattern(p), number)), F.lit("")) for p in phrases]


def said(words: Column, phrase: str, number: int = 1) -> Column:
    return first_of(words, [phrase], number)[0]


def every(words: Column, phrases: list[str]) -> Column:
    """All first numbers of each phrase in turn."""
    return F.flatten(F.array(*[F.regexp_extract_all(words, F.lit(pattern(p)), F.lit(1)) for p in phrases]))
