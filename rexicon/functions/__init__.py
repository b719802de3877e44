"""Column functions of the pattern language."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import render
from .syntax import Assertion, Cat, UnsupportedPattern, literal, nullable, parse, required

__all__ = ["UnsupportedPattern", "match", "full_match", "normalize", "unnormalize", "install"]


def match(text: Column, pattern: str | None) -> Column:
    """True where ``text`` holds a match of ``pattern``; null for a null text or pattern.

    Patterns without choice become ``contains``, ``startswith`` or ``endswith``, which
    reach the scan as pushed filters; one that matches the empty string asks for no
    work at all.
    """
    if pattern is None:
        return F.lit(None).cast("boolean")
    node = parse(pattern)
    if nullable(node):
        return F.when(text.isNotNull(), F.lit(True))
    plain = literal(node)
    if plain is not None:
        return text.contains(plain)
    if isinstance(node, Cat):
        first, last = node.items[0] == Assertion("start"), node.items[-1] == Assertion("end")
        inner = literal(Cat(node.items[first : len(node.items) - last]))
        if inner and first and last:
            return text == F.lit(inner)
        if inner and first:
            return text.startswith(inner)
        if inner and last:
            return text.endswith(inner)
    found, must = text.rlike(render.java(node)), required(node)
    return text.contains(must) & found if len(must) > 1 else found  # the search for a string is far the faster


def full_match(text: Column, pattern: str) -> Column:
    """True where the whole of ``text`` matches."""
    return text.rlike(rf"\A(?:{render.java(pattern)})\z")


def normalize(text: Column, mapping: dict[str, str]) -> Column:
    """Replace single characters; ``mapping`` is checked by :func:`check_mapping`."""
    pairs = check_mapping(mapping)
    return F.translate(text, "".join(pairs), "".join(pairs.values()))


def unnormalize(text: Column, mapping: dict[str, str]) -> Column:
    """The inverse of :func:`normalize`; of characters mapped to the same one the first comes back."""
    back: dict[str, str] = {}
    for frm, to in check_mapping(mapping).items():
        back.setdefault(to, frm)
    return F.translate(text, "".join(back), "".join(back.values()))


def check_mapping(mapping) -> dict[str, str]:
    """A mapping of single ASCII characters, from a dict or its JSON."""
    import json

    pairs = json.loads(mapping) if isinstance(mapping, str) else dict(mapping)
    if not isinstance(pairs, dict) or any(not isinstance(x, str) or len(x) != 1 or not x.isascii() for kv in pairs.items() for x in kv):
        raise ValueError("a mapping of single ASCII characters is expected")
    return pairs


def install(spark: SparkSession) -> None:
    """Register ``regex_search(text, pattern)`` for SQL.

    The pattern of a SQL call is known only row by row, so this is an Arrow UDF that
    renders each distinct pattern once; :func:`match` is the faster way in code.
    """
    import re

    import pandas as pd

    def regex_search(text, pattern):
        known: dict = {}
        out = []
        for t, p in zip(text, pattern):
            if t is None or p is None:
                out.append(None)
                continue
            if p not in known:
                known[p] = re.compile(render.python(p))
            out.append(known[p].search(t) is not None)
        return pd.Series(out, dtype="object")

    regex_search.__annotations__ = {"text": pd.Series, "pattern": pd.Series, "return": pd.Series}
    spark.udf.register("regex_search", F.pandas_udf(regex_search, "boolean"))
