"""Patterns from plain phrases."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_WITH_MARKS = {"c": "[cčć]", "s": "[sš]", "z": "[zž]", "d": "[dđ]"}


def any_of(phrases: str, marks: bool = False) -> str:
    """A group of phrases parted by commas, for Java and Python alike.

    A space stands for any run of spaces, a star for the rest of a word, a dot for one that may be missing;
    with ``marks`` c, s, z and d also stand for their marked letters.
    """

    def one(p: str) -> str:
        out = "".join({" ": r"\s+", "*": r"\w*", ".": r"[.]?\s*"}.get(ch) or (marks and _WITH_MARKS.get(ch)) or re.escape(ch) for ch in p)
        return out.replace(r"\s*\s+", r"\s*").removesuffix(r"\s*")

    return "(?:" + "|".join(one(p.strip()) for p in phrases.split(",")) + ")"


def names(c: Column, phrases: str) -> Column:
    """Whether a folded text holds any of the phrases of ``any_of``: the longest plain part of each is sought first, its pattern only behind that."""
    hit = F.lit(False)
    for p in map(str.strip, phrases.split(",")):
        plain = max(re.split(r"[ *.]+", p), key=len)
        hit = hit | (c.contains(plain) if plain == p else c.contains(plain) & c.rlike(any_of(p)))
    return hit
