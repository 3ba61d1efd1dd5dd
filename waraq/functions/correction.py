"""The OCR correction cascade: an ordered dictionary, then seventeen rewriting steps. The order is part of the result."""

from __future__ import annotations

import functools
import os.path
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from waraq.functions.rules import ALLOWED_VERBS, CONJUNCTION_HIGH, CONJUNCTION_LOW, CORRECTIONS, KEPT_AFTER_AAL, KEPT_AFTER_MAL, LIGATURES
from waraq.functions.text import let

Corrections = Sequence[tuple[str, str]]

#: Divide a dictionary's entries, and the halves of one, where it is a single literal; no entry holds them.
_ROW, _CELL = "\x1e", "\x1f"
_LETTER = "[؀-ۿ]"
_FULL = "ء-غف-ي"
#: (?U): white space is Unicode's; (?d): only a newline ends a line.
_SPACE = r"[\s\x1c-\x1f]"


def _literal(text: Column, wrong: str, right: str) -> Column:
    return F.replace(text, F.lit(wrong), F.lit(right))


def _all(text: Column, swaps: Corrections) -> Column:
    for wrong, right in swaps:
        text = _literal(text, wrong, right)
    return text


def trie_pattern(words: Sequence[str]) -> str:
    """A pattern that matches the longest of ``words`` at a place. Common beginnings are written once, so a place where
    none begins costs one look at its first letter."""
    children: dict[str, list[str]] = {}
    for w in words:
        children.setdefault(w[:1], []).append(w[1:])
    ends = "" in children
    branches = [re.escape(c) + trie_pattern(rest) for c, rest in sorted(children.items()) if c]
    if not branches:
        return ""
    return f"(?:{'|'.join(branches)}){'?' if ends else ''}"


def _makes(entry: tuple[str, str], wrong: str) -> bool:
    """Whether replacing by ``entry`` can bring about ``wrong`` where it was not, whatever stands around.

    What both forms of the entry begin or end with was there before. So a new hit has a letter of what lies between, or,
    where nothing does, spans the seam; and it agrees with the right form wherever the two overlap."""
    old, new = entry
    head = len(os.path.commonprefix([old, new]))
    tail = len(os.path.commonprefix([old[head:][::-1], new[head:][::-1]]))
    first, last = head, len(new) - tail  # new[first:last] is what the entry brings
    places = range(first - len(wrong) + 1, last) if first < last else range(first - len(wrong) + 1, first)
    return any(all(wrong[i] == new[at + i] for i in range(len(wrong)) if 0 <= at + i < len(new)) for at in places)


@functools.lru_cache(maxsize=16)
def _reach(corrections: tuple[tuple[str, str], ...]) -> dict[str, tuple[int, ...]]:
    """Entry's wrong form -> the places of all entries that may fire once it stands in a text: its own, those that are a
    beginning of it, and later ones that firing these may bring about, in any number of steps."""
    makes = {i: [j for j in range(i + 1, len(corrections)) if _makes(e, corrections[j][0])] for i, e in enumerate(corrections)}
    out = {}
    for wrong, _ in corrections:
        seen: set[int] = set()
        to_see = [j for j, (w, _) in enumerate(corrections) if wrong.startswith(w)]
        while to_see:
            i = to_see.pop()
            if i not in seen:
                seen.add(i)
                to_see += makes[i]
        out[wrong] = tuple(sorted(seen))
    return out


def _fold(text: Column, corrections: Corrections, start: Callable[[Column], Column], step: Callable[[Column, Column], Column], done: Callable[[Column], Column]) -> Column:
    """``step`` over the entries (i, w, r) that can fire in the text, in order.

    One pass of one pattern tells whether any wrong form stands in the text; texts with none are left at once. A second
    one tells which, at every place the longest, and the text goes through those and what these may bring about.
    """
    corrections = tuple(map(tuple, corrections))
    if any(mark in form for entry in corrections for form in entry for mark in (_ROW, _CELL)):
        raise ValueError("dictionary entries cannot hold the characters U+001E and U+001F")
    listed = lambda parts: F.split(F.lit(_ROW.join(parts)), _ROW, -1)  # noqa: E731  one literal, taken apart when the plan is made
    wrongs, rights = (listed(side) for side in zip(*corrections))
    may_fire = F.str_to_map(F.lit(_ROW.join(f"{w}{_CELL}{','.join(map(str, at))}" for w, at in _reach(corrections).items())), F.lit(_ROW), F.lit(_CELL))
    pattern = trie_pattern([w for w, _ in corrections])
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=({pattern}))"), F.lit(1)))

    def run(hits: Column) -> Column:
        at = F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda w: F.split(F.element_at(may_fire, w), ",").cast("array<int>")))))
        entries = F.transform(at, lambda i: F.struct(i.alias("i"), F.get(wrongs, i).alias("w"), F.get(rights, i).alias("r")))
        return F.aggregate(entries, start(text), step, done)

    return F.when(text.rlike(pattern), let(found, run)).otherwise(done(start(text)))


def dictionary(text: Column, corrections: Corrections = CORRECTIONS) -> Column:
    """Every entry in turn, anywhere in the text."""
    if not corrections:
        return text
    return let(text, lambda x: _fold(x, corrections, lambda t: t, lambda t, e: F.replace(t, e["w"], e["r"]), lambda t: t))


def corrected_with(text: Column, corrections: Corrections = CORRECTIONS) -> Column:
    """A struct of the text after every entry in turn, and ``wrong→right`` of those that were there when their turn came."""
    none = F.array().cast("array<string>")
    begin = lambda t: F.struct(t.alias("text"), none.alias("applied"))
    if not corrections:
        return begin(text)
    names = F.split(F.lit(_ROW.join(f"{w}→{r}" for w, r in corrections)), _ROW, -1)

    def step(state: Column, e: Column) -> Column:
        after = F.replace(state["text"], e["w"], e["r"])
        fired = lambda t: F.struct(t.alias("text"), F.when(t != state["text"], F.array_append(state["applied"], F.get(names, e["i"]))).otherwise(state["applied"]).alias("applied"))
        return let(after, fired)  # an entry that fires always changes the text

    return let(text, lambda x: _fold(x, corrections, begin, step, lambda state: state))


def applied(text: Column, corrections: Corrections = CORRECTIONS) -> Column:
    """``wrong→right`` of every entry that is there when its turn comes."""
    return corrected_with(text, corrections)["applied"]


def _ligatures(text: Column) -> Column:
    """Step 9. Swaps of the second and third letter after alef are one pattern: what it writes begins with alef and lam,
    which no swap takes. The others follow in order."""
    swapped = [(w, r) for w, r in LIGATURES if len(w) == 3 and (w[0], w[2]) == (r[0], r[1]) == ("ا", "ل") and w[1] == r[2] != "ل"]
    text = F.regexp_replace(text, rf"(?U)(^|(?<={_SPACE}))ا([{''.join(w[1] for w, _ in swapped)}])ل", "ال$2")
    for wrong, right in LIGATURES:
        if (wrong, right) not in swapped:
            text = F.regexp_replace(text, rf"(?U)(^|(?<={_SPACE})){wrong}", right)
    return text


def _hamza_article(text: Column) -> Column:
    kept = "|".join(v[2:] for v in ALLOWED_VERBS)
    ahead = rf"(?:^|(?<=[\s\x1c-\x1f،؛:؟!\n]))أل(?!(?:{kept})(?!{_LETTER}))({_LETTER}+)"
    return F.regexp_replace(text, "(?dmU)" + ahead, "الأ$1")


def _lam_after_meem(text: Column) -> Column:
    """Step 17. A hit on an exempt letter is taken first and put back, so what overlaps it is not rewritten; groups of the
    alternative that was not taken are empty."""
    return F.regexp_replace(text, f"(مال[{KEPT_AFTER_MAL}])|(م)(ا)(ل)([{_FULL}])", "$1$2$4$3$5")


def _lam_before_alef(text: Column) -> Column:
    """Step 18, alike."""
    return F.regexp_replace(text, f"([إا]عال[{KEPT_AFTER_AAL}])|([إا])(ع)(ا)(ل)([{_FULL}])", "$1$2$3$5$4$6")


#: Step number -> its rewriting. Step 1 is :func:`dictionary`.
STEPS: dict[int, Callable[[Column], Column]] = {
    2: lambda t: F.translate(t, "ـ", ""),
    3: lambda t: F.regexp_replace(t, rf"(?dU)يهة(?=[\s\x1c-\x1f،؛.\n]|$)", "ية"),
    4: lambda t: F.regexp_replace(t, r"(?U)(?<=[؀-ۿ\s\x1c-\x1f])[*+]{1,3}(?=[؀-ۿ\s\x1c-\x1f])", " "),
    5: lambda t: _literal(F.regexp_replace(t, rf"(?U)(?<![^\s\x1c-\x1f])اال({_LETTER})", "الا$1"), " اال", " الا"),
    6: lambda t: F.regexp_replace(t, rf"(?dU)({_LETTER}{{3,}})لا(?=[\s\x1c-\x1f،؛.\n]|$)", "$1ال"),
    7: lambda t: _literal(t, "احمل", "المح"),
    8: lambda t: F.regexp_replace(t, f"امل({_LETTER})", "الم$1"),
    9: _ligatures,
    10: lambda t: _all(t, CONJUNCTION_LOW),
    11: lambda t: F.regexp_replace(t, f"اإل({_LETTER})", "الإ$1"),
    12: lambda t: _all(t, CONJUNCTION_HIGH),
    13: lambda t: F.regexp_replace(t, "الا([أإآؤئ])", "ال$1"),
    14: _hamza_article,
    15: lambda t: F.regexp_replace(t, f"قغض({_LETTER}?)", "قض$1"),
    16: lambda t: F.regexp_replace(t, rf"(?dmU)(?:^|(?<={_SPACE}))ال ({_LETTER})", "لا $1"),
    17: _lam_after_meem,
    18: _lam_before_alef,
}


#: Step -> texts of which one must be there for it to change anything.
NEEDED = {
    3: ("يهة",), 4: ("*", "+"), 5: ("اال",), 6: ("لا",), 8: ("امل",), 11: ("اإل",), 13: ("الا",),
    14: ("أل",), 15: ("قغض",), 16: ("ال ",), 17: ("مال",), 18: ("عال",),
}


def _guarded(step: int) -> Callable[[Column], Column]:
    def run(t: Column) -> Column:
        there = [F.contains(t, F.lit(x)) for x in NEEDED[step]]
        return F.when(functools.reduce(lambda a, b: a | b, there), STEPS[step](t)).otherwise(t)

    return run


def correct_text(text: Column, corrections: Corrections = CORRECTIONS) -> Column:
    """All steps in order. Not idempotent: some entries are part of their own right form. Patterns run only on texts that
    hold what they look for."""
    text = dictionary(text, corrections)
    for step in sorted(STEPS):
        text = let(text, _guarded(step)) if step in NEEDED else STEPS[step](text)
    return text
