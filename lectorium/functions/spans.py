"""Spans in scientific prose, read by small grammars.

A grammar takes a text and a place and gives the end of what it reads there, or None.  Words and figures are
ASCII here, so a span may stand right beside Japanese letters.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterable

_WORD = frozenset(string.ascii_letters + string.digits + "_")
_DIGITS, _UPPER, _LOWER = frozenset(string.digits), frozenset(string.ascii_uppercase), frozenset(string.ascii_lowercase)
_DASHES = frozenset("-–—")
_AFTER_SCHEME = frozenset(")]}>,。、「」")
_DOI = _WORD | frozenset(".()/:;-")
# Words before a figure's number, units of measurements, signs of comparison, letters of tests.
FIGURE_WORDS = ("figures", "figure", "figs", "fig")
UNITS = frozenset("mm cm m km ms s hz khz mhz ghz uw mw w kg mg % °c".split())
COMPARISONS = ("!=", "̸=", "≠", "≠", "≤", "≥", "=", "<", ">")
TESTS = frozenset("χΧxXFfTtZz")
FIRST_YEAR, LAST_YEAR = 1500, 2099

Grammar = Callable[[str, int], int | None]


def _run(t: str, i: int, signs: frozenset) -> int:
    while i < len(t) and t[i] in signs:
        i += 1
    return i


def _blanks(t: str, i: int) -> int:
    while i < len(t) and t[i].isspace():
        i += 1
    return i


def _inside(t: str, i: int) -> bool:
    """A word goes on across place i."""
    return 0 < i < len(t) and t[i - 1] in _WORD and t[i] in _WORD


def _number(t: str, i: int) -> int | None:
    j = _run(t, i, _DIGITS)
    if j == i:
        return None
    k = _run(t, j + 1, _DIGITS) if t[j : j + 1] == "." else j
    return k if k > j + 1 else j


def _starts(t: str, i: int, words: Iterable[str]) -> int | None:
    low = t[i : i + 12].lower()
    return next((i + len(w) for w in words if low.startswith(w)), None)


def url(t: str, i: int) -> int | None:
    j = _starts(t, i, ("https://", "http://"))
    if j is None:
        return None
    k = j
    while k < len(t) and not t[k].isspace() and t[k] not in _AFTER_SCHEME:
        k += 1
    return k if k > j else None


def doi(t: str, i: int) -> int | None:
    if not t.startswith("10.", i) or _inside(t, i):
        return None
    j = _run(t, i + 3, _DIGITS)
    if not 4 <= j - i - 3 <= 9 or t[j : j + 1] != "/":
        return None
    k = _run(t, j + 1, _DOI)
    return k if k > j + 1 else None


def number_group(t: str, i: int) -> int | None:
    """[1], [2, 5], [3–7, 9]: a bracketed list of numbers and ranges."""
    if t[i] != "[":
        return None
    k = t.find("]", i)
    if k < 0:
        return None
    for item in t[i + 1 : k].split(","):
        ends = [x.strip() for x in "".join("-" if c in _DASHES else c for c in item).split("-")]
        if len(ends) > 2 or not all(x and set(x) <= _DIGITS for x in ends):
            return None
    return k + 1 if t[i + 1] in _DIGITS and t[k - 1] in _DIGITS else None


def inline_note(t: str, i: int) -> int | None:
    """A raised note number set as plain figures: behind a closing quotation or capital, before a bracket."""
    if not i or t[i] not in _DIGITS or not (t[i - 1] in "”’\"" or t[i - 1] in _UPPER):
        return None
    j = _run(t, i, _DIGITS)
    return j if j - i <= 3 and t[(k := _blanks(t, j)) : k + 1] == "(" else None


def figure(t: str, i: int) -> int | None:
    if _inside(t, i):
        return None
    j = _starts(t, i, FIGURE_WORDS)
    if j is None:
        return None
    j = _blanks(t, j + (t[j : j + 1] == "."))
    k = _run(t, j, _DIGITS)
    if k == j:
        return None
    if t[k : k + 1] == "(" and t[k + 2 : k + 3] == ")" and t[k + 1].lower() in _LOWER:
        return k + 3
    return k + 1 if t[k : k + 1].lower() in _LOWER else k


def year(t: str, i: int) -> int | None:
    j = _run(t, i, _DIGITS)
    return j if j - i == 4 and not _inside(t, i) and not _inside(t, j) and FIRST_YEAR <= int(t[i:j]) <= LAST_YEAR else None


def comparison(t: str, i: int) -> int | None:
    """n = 5, p < .05, F(2, 31) = 4.2, χ²(1) ≠ 3: a letter, perhaps with degrees, a sign and a number."""
    letter = t[i]
    if not (letter in TESTS or letter in _UPPER or letter in _LOWER) or _inside(t, i):
        return None
    j = i + 1
    if letter in "χΧxX" and t[j : j + 1] in ("²", "2"):
        j += 1
    j = _blanks(t, j)
    if t[j : j + 1] == "(" and letter in TESTS:
        k = t.find(")", j, j + 18)
        if k <= j + 1:
            return None
        j = _blanks(t, k + 1)
    elif j > i + 1 and not t[j - 1].isspace():
        return None
    sign = next((s for s in COMPARISONS if t.startswith(s, j)), None)
    if sign is None:
        return None
    j = _blanks(t, j + len(sign))
    if t[j : j + 1] in ("-", "+"):
        j += 1
    elif letter == "p" and t[j : j + 1] == ".":
        j += 1
    return _number(t, j)


def measurement(t: str, i: int) -> int | None:
    j = None if _inside(t, i) else _number(t, i)
    if j is None:
        return None
    j = _blanks(t, j)
    k = next((k for k in (j + 3, j + 2, j + 1) if t[j:k].lower() in UNITS and k <= len(t)), None)
    return k if k and not (k < len(t) and (t[k] in _WORD or t[k].isalnum())) else None


def acronym(t: str, i: int) -> int | None:
    """BERT, DeepIV, p53-free mixtures of cases, and joined names such as Mann-Whitney."""
    if t[i] not in _WORD or _inside(t, i):
        return None
    j = _run(t, i, _WORD)
    w = t[i:j]
    if "_" in w:
        return None
    if 2 <= len(w) <= 10 and w[0] in _UPPER and all(c in _UPPER or c in _DIGITS for c in w):
        return j
    turn = next((k for k in range(1, len(w)) if w[k] in _UPPER and w[k - 1] in _LOWER), None)
    if turn and w[:turn].isalpha():
        return j
    if not (len(w) > 1 and w[0] in _UPPER and all(c in _LOWER for c in w[1:])):
        return None
    while t[j : j + 1] == "-":  # lower-case links, then a second name
        k = _run(t, j + 1, _WORD)
        part = t[j + 1 : k]
        if len(part) > 1 and part[0] in _UPPER and all(c in _LOWER for c in part[1:]):
            return k
        if not part or not all(c in _LOWER for c in part):
            return None
        j = k
    return None


def plain_number(t: str, i: int) -> int | None:
    j = None if _inside(t, i) else _number(t, i)
    return j if j and not _inside(t, j) else None


def _bracketed(t: str, i: int, most: int) -> int | None:
    """End of a round bracket that holds no other one."""
    if t[i] != "(":
        return None
    k = next((k for k in range(i + 1, min(len(t), i + most + 2)) if t[k] in "()"), None)
    return k + 1 if k and t[k] == ")" and k > i + 1 else None


def author_year(t: str, i: int) -> int | None:
    """A round bracket with a year and a capitalised name."""
    end = _bracketed(t, i, 720)
    if end is None:
        return None
    dated = named = False
    k = i + 1
    while k < end - 1:
        j = _run(t, k, _WORD)
        w = t[k:j]
        body = w[:-1] if w[-1:] in _LOWER else w
        dated |= len(body) == 4 and set(body) <= _DIGITS and body[:2] in ("18", "19", "20")
        named |= w[:1] in _UPPER and len(t[k:end]) > 1 and (t[k + 1].isalpha() or t[k + 1] in "'’-")
        k = max(j, k + 1)
    return end if dated and named else None


def evidence(t: str, i: int) -> int | None:
    """A round bracket with a figure reference or a comparison."""
    end = _bracketed(t, i, 240)
    return end if end and any(figure(t, k) or comparison(t, k) for k in range(i + 1, end - 1)) else None


def found(t: str, grammar: Grammar) -> list[tuple[int, int]]:
    """Places of a grammar from left to right, none within another."""
    out, i = [], 0
    while i < len(t):
        end = grammar(t, i) if not t[i].isspace() else None
        if end and end > i:
            out.append((i, end))
            i = end
        else:
            i += 1
    return out


def longest(t: str, grammars: Iterable[Grammar]) -> list[tuple[int, int]]:
    """Of all grammars together the leftmost and there the longest, none within another."""
    out, i = [], 0
    while i < len(t):
        end = max((e for g in grammars if (e := g(t, i))), default=0) if not t[i].isspace() else 0
        if end > i:
            out.append((i, end))
            i = end
        else:
            i += 1
    return out
