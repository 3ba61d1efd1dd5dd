"""Arabic text functions as Column expressions: white space, normal form, tokens, excerpts, highlighting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from waraq.functions.rules import ARABIC_RUN, MARK_CLOSE, MARK_OPEN, TASHKEEL, UNIFIED_FROM, UNIFIED_TO

#: Unicode white space, as Java's (?U)\s with the four information separators.
SPACE = r"[\s\x1c-\x1f]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def words(text: Column) -> Column:
    """The parts between runs of Unicode white space; none of an empty text."""
    return F.filter(F.split(text, rf"(?U){SPACE}+"), lambda w: w != "")


def solid_length(text: Column) -> Column:
    """Characters that are not white space."""
    return F.length(F.regexp_replace(text, rf"(?U){SPACE}+", ""))


def normalize(text: Column) -> Column:
    """The normal form: no vowel marks; forms of alef, yeh, teh marbuta and seated hamza unified. One pass."""
    return F.translate(text, UNIFIED_FROM + TASHKEEL, UNIFIED_TO)


def tokens(text: Column) -> Column:
    """Runs of Arabic characters in order."""
    return F.regexp_extract_all(text, F.lit(ARABIC_RUN), F.lit(0))


def starts_arabic(word: Column) -> Column:
    return word.rlike("^" + ARABIC_RUN)


def is_native(raw: Column, least: int = 50) -> Column:
    """A page with more than ``least`` solid characters holds text; the others are scans."""
    return solid_length(raw) > least


def excerpt(raw: Column, norm: Column, phrase: Column, longest: int = 300, around: int = 80) -> Column:
    """The first line whose normal form holds the phrase, stripped; else a window around the hit; else an empty text.

    The window is placed by the hit's position in the normal form and cut from the raw text.
    """
    lines = F.transform(F.split(raw, "\n", -1), strip)
    line = F.get(F.filter(lines, lambda x: (x != "") & F.contains(normalize(x), phrase)), F.lit(0))
    at = F.instr(norm, phrase)
    start = F.greatest(F.lit(0), at - 1 - around)
    end = F.least(F.length(raw), at - 1 + F.length(phrase) + around)
    window = F.substring(F.replace(F.substring(raw, start + 1, F.greatest(end - start, F.lit(0))), F.lit("\n"), F.lit(" ")), 1, longest)
    return F.coalesce(F.substring(line, 1, longest), F.when(at > 0, window), F.lit(""))


def highlight(text: Column, query: Column) -> Column:
    """Mark, for each query word, the first occurrence of each distinct token with an equal normal form.

    Tokens are taken from the text as the words before left it, in order of first occurrence.
    """

    def mark(state: Column, token: Column) -> Column:
        at = F.instr(state, token)
        return F.when(at > 0, F.concat(F.substring(state, F.lit(1), at - 1), F.lit(MARK_OPEN), token, F.lit(MARK_CLOSE), F.substring(state, at + F.length(token), F.length(state)))).otherwise(state)

    def mark_word(state: Column, word: Column) -> Column:
        equal = F.filter(F.array_distinct(tokens(state)), lambda t: normalize(t) == normalize(word))
        return F.aggregate(equal, state, mark)

    return F.aggregate(words(query), text, mark_word)
