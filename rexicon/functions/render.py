"""Patterns of the language in the dialects of Java (Spark) and RE2 (DuckDB)."""

from __future__ import annotations

from . import charset
from .syntax import Alt, Assertion, Cat, Chars, Empty, Part, Repeat, parse

_W = "[A-Za-z0-9_]"
_JAVA = {
    "start": r"\A",
    "end": r"\z",
    "word": f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))",
    "inner": f"(?:(?<={_W})(?={_W})|(?<!{_W})(?!{_W}))",
}
_RE2 = {"start": r"\A", "end": r"\z", "word": r"\b", "inner": r"\B"}


def _char(c: int) -> str:
    ch = chr(c)
    if ch.isascii() and (ch.isalnum() or ch in " _"):
        return ch
    if 0x20 < c < 0x7F:
        return "\\" + ch
    return f"\\x{{{c:X}}}"


def _part(p: Part, java: bool) -> str:
    if p.name is None:
        return _char(p.low) if p.low == p.high else f"{_char(p.low)}-{_char(p.high)}"
    sign = "P" if p.negated else "p"
    found = charset.category(p.name, p.value)
    if found:
        return f"\\{sign}{{{found}}}"
    if not charset.is_script(p.name, p.value):  # binary and block properties: engines differ, so their code points
        return "".join(_part(Part(lo, hi), java) for lo, hi in p.intervals())
    own = charset.script(p.name, p.value)
    own = own[:1].upper() + own[1:].lower()
    return f"\\{sign}{{{'Is' if java else ''}{own}}}"


def _render(node, java: bool) -> str:
    if isinstance(node, Empty):
        return "(?:)"
    if isinstance(node, Assertion):
        return (_JAVA if java else _RE2)[node.kind]
    if isinstance(node, Chars):
        p = node.parts[0]
        if len(node.parts) == 1 and not node.negated:
            if p.name is None and p.low == p.high:
                return _char(p.low)
            if (p.low, p.high) == charset.ANY[0] and p.name is None:
                return "(?s:.)"
        if not node.intervals():
            return r"[^\x{0}-\x{10FFFF}]"
        return f"[{'^' if node.negated else ''}{''.join(_part(x, java) for x in node.parts)}]"
    if isinstance(node, Cat):
        return "".join(f"(?:{_render(x, java)})" if isinstance(x, Alt) else _render(x, java) for x in node.items)
    if isinstance(node, Alt):
        return "|".join(_render(x, java) for x in node.items)
    assert isinstance(node, Repeat)
    inner = _render(node.item, java)
    if not isinstance(node.item, Chars):
        inner = f"(?:{inner})"
    if (node.low, node.high) in ((0, None), (1, None), (0, 1)):
        return inner + {(0, None): "*", (1, None): "+", (0, 1): "?"}[node.low, node.high]
    return f"{inner}{{{node.low}}}" if node.low == node.high else f"{inner}{{{node.low},{'' if node.high is None else node.high}}}"


def java(pattern) -> str:
    """For Spark's ``rlike``; takes a pattern or a syntax tree."""
    return _render(parse(pattern) if isinstance(pattern, str) else pattern, True)


def re2(pattern) -> str:
    """For DuckDB's ``regexp_matches``."""
    return _render(parse(pattern) if isinstance(pattern, str) else pattern, False)


def python(pattern) -> str:
    """For Python's ``re``: every set as intervals, so that properties need no support there."""
    node = parse(pattern) if isinstance(pattern, str) else pattern
    if isinstance(node, Chars):
        found = node.intervals()
        return "[" + "".join(f"\\U{lo:08X}-\\U{hi:08X}" for lo, hi in found) + "]" if found else "(?!)"
    if isinstance(node, Assertion):
        return {**_JAVA, "end": r"\Z"}[node.kind]
    if isinstance(node, Cat):
        return "".join(f"(?:{python(x)})" for x in node.items)
    if isinstance(node, Alt):
        return "|".join(f"(?:{python(x)})" for x in node.items)
    if isinstance(node, Repeat):
        return f"(?:{python(node.item)}){{{node.low},{'' if node.high is None else node.high}}}"
    return ""
