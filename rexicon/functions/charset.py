"""Sets of code points as sorted, disjoint, inclusive intervals."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

LAST = 0x10FFFF
Intervals = tuple[tuple[int, int], ...]


def union(*sets: Intervals) -> Intervals:
    out: list[list[int]] = []
    for lo, hi in sorted(x for s in sets for x in s):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return tuple((lo, hi) for lo, hi in out)


def complement(s: Intervals) -> Intervals:
    out, at = [], 0
    for lo, hi in union(s):
        if lo > at:
            out.append((at, lo - 1))
        at = hi + 1
    if at <= LAST:
        out.append((at, LAST))
    return tuple(out)


ANY: Intervals = ((0, LAST),)
DIGIT: Intervals = ((0x30, 0x39),)
WORD: Intervals = union(DIGIT, ((0x41, 0x5A),), ((0x5F, 0x5F),), ((0x61, 0x7A),))
SPACE: Intervals = union(((0x09, 0x0D),), ((0x20, 0x20),))


class UnknownProperty(ValueError):
    """A Unicode property that has no known meaning."""


def _collect(test) -> Intervals:
    out, start = [], None
    for c in range(LAST + 2):
        inside = c <= LAST and test(chr(c))
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append((start, c - 1))
            start = None
    return tuple(out)


#: Long names of the general categories.
_LONG = {"letter": "L", "uppercase_letter": "Lu", "lowercase_letter": "Ll", "titlecase_letter": "Lt", "mark": "M", "number": "N", "decimal_number": "Nd", "punctuation": "P", "symbol": "S", "separator": "Z", "other": "C"}
_CATEGORIES = frozenset("Lu Ll Lt Lm Lo Mn Mc Me Nd Nl No Pc Pd Ps Pe Pi Pf Po Sm Sc Sk So Zs Zl Zp Cc Cf Cs Co Cn".split())


def category(name: str, value: str | None) -> str | None:
    """The general category that ``name`` (or ``gc=value``) means, if any."""
    if value is not None:
        if name.lower() not in ("gc", "general_category"):
            return None
        name = value
    found = _LONG.get(name.lower(), name[:1].upper() + name[1:].lower())
    return found if found in _CATEGORIES or any(c.startswith(found) and len(found) == 1 for c in _CATEGORIES) else None


def script(name: str, value: str | None) -> str | None:
    """The script name in ``Script=Han``, ``sc=Han`` or plain ``Han``."""
    if value is not None:
        return value if name.lower() in ("script", "sc") else None
    return name


@lru_cache(maxsize=256)
def property_set(name: str, value: str | None) -> Intervals:
    """The code points with a general category, a script, or a binary or block property."""
    found = category(name, value)
    if found:
        return _collect(lambda ch: unicodedata.category(ch).startswith(found))
    written = f"{name}={value}" if value else name
    try:
        import regex
    except ImportError as e:
        raise UnknownProperty(f"only categories are known without the regex module, not {written}") from e
    own = script(name, value)
    for form in ([f"Script={own}"] if own else []) + [written]:
        try:
            return _collect(regex.compile(rf"\p{{{form}}}").match)
        except regex.error:
            continue
    raise UnknownProperty(f"unknown unicode property: {written}")


@lru_cache(maxsize=256)
def is_script(name: str, value: str | None) -> bool:
    """True if a property names a script, so that other engines know it by that name."""
    own = script(name, value)
    if own is None:
        return False
    import regex

    try:
        regex.compile(rf"\p{{Script={own}}}")
    except regex.error:
        return False
    return True
