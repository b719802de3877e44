"""The pattern language: truth tables, rejections, and agreement of all renderings."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rexicon.functions import charset, check_mapping, render, syntax
from rexicon.plans import automaton, planner, steps

TRUTH = [
    ("[一-鿌㐀-䶵]`i`", ["國`i`"], ["12`i`", "國`", ""]),
    (r"(k[aeiou]\.){3}k", ["ka.ka.ka.k", "ke.ko.ku.k"], ["kka.ka.ka.k", "ka.ka.ka."]),
    ("a(a|ba)*|c*a", ["aa", "abaa", "cca"], ["abaacca"]),
    ("a+b+", ["aab", "abbbbb"], ["aa", ""]),
    (r"abc[^a-zA-Z]+?(?<name>st|uv)(?:pid)*\?", ["abc가나다st?", "abc012uvpidpid?"], ["abcst?", "abc012udvpidpid?"]),
    (r"cho\.cw?o\.ni", ["cho.cwo.ni", "cho.co.ni"], ["cho.co.nii", "cho.cwwo.ni"]),
    (".*", ["", "adsfdsaf", "가나다", "cho.c가나다wwo.ni", "a\nb"], []),
    (r"\w", ["s", "_", "0"], ["-", ","]),
    (r"\W", ["-", ","], ["s", "_", "0"]),
    (r"\d", ["0"], ["s", "_", "-", ","]),
    (r"\D", ["s", "_", "-", ","], ["0"]),
    (r"\s", [" ", "\x0b"], ["s", "_", "0", "-", ","]),
    (r"\S", ["s", "_", "0", "-", ","], [" "]),
    ("^foo", ["foo"], ["foobar", "bar"]),
    ("foo$", ["foo"], ["barfoo", "foobar"]),
    ("^foo$", ["foo"], ["foobar", "barfoo"]),
    (r"\p{L}", ["a", "한"], ["1", " ", "."]),
    (r"\p{Lu}", ["A", "Ω"], ["a", "1"]),
    (r"\P{L}", ["1", "."], ["a", "한"]),
    (r"\p{Script=Han}", ["汉", "語"], ["a", "1"]),
    (r"\p{gc=Nd}", ["0", "5"], ["a", "."]),
    ("[[&]", ["[", "&"], ["a"]),
    ("a{3,2}", ["aaa"], ["aa", "aaaa"]),
    (r"a[^\s\S]|b", ["b"], ["a", "ax"]),
    ("[^x]", ["\n", "é"], ["x"]),
]


@pytest.mark.parametrize("pattern,yes,no", TRUTH)
def test_truth_table(pattern, yes, no):
    dfa, own = automaton.compile_dfa(pattern), re.compile(rf"\A(?:{render.python(pattern)})\Z")
    for text in yes:
        assert dfa.match(text) and own.match(text)
    for text in no:
        assert not dfa.match(text) and not own.match(text)


@pytest.mark.parametrize("pattern", [r"\bfoo\b", r"^\d+$", r"\bword\b", r"abc[a-zA-Z]+?(?<name>st|uv)(?:pid)*\b\d*\?\p{Script=Han}$"])
def test_assertions_need_a_recheck(pattern):
    assert automaton.compile_dfa(pattern).needs_recheck


@pytest.mark.parametrize("pattern", ["", "a|", "()", "a{2,}", "a{,2}", r"\n", r"\x41", r"\]", "(?=a)", "(?i)a", r"(a)\1", "a++", "[]", "[b-a]", r"\p{Nope}", "^*", "a)", "(a", "[a", "a{99999999999}", "*", r"[\n]"])
def test_rejected(pattern):
    with pytest.raises(syntax.UnsupportedPattern):
        syntax.parse(pattern)


def test_dumps():
    assert "repeat 3..3" in syntax.dump(syntax.parse(r"(k[aeiou]){3}"))
    assert "states 3" in automaton.compile_dfa("a+b+").dump()


@pytest.mark.parametrize("lo,hi", [(0, 0x10FFFF), (0x80, 0x7FF), (0x100, 0x12345), (0xD700, 0xE010), (0x10000, 0x10FFFF), (0x41, 0x41)])
def test_utf8_ranges(lo, hi):
    found, rnd = automaton.utf8_ranges(lo, hi), random.Random(1)
    for _ in range(2000):
        c = rnd.choice([rnd.randint(0, 0x10FFFF), max(0, lo + rnd.randint(-3, 3)), min(0x10FFFF, hi + rnd.randint(-3, 3))])
        if not 0xD800 <= c <= 0xDFFF:
            b = chr(c).encode()
            assert any(len(r) == len(b) and all(x <= y <= z for y, (x, z) in zip(b, r)) for r in found) == (lo <= c <= hi)


def test_sets():
    assert charset.complement(charset.complement(charset.WORD)) == charset.WORD
    assert charset.union(((5, 9),), ((1, 4),)) == ((1, 9),)


atoms = st.sampled_from(["a", "b", "é", ".", "[ab]", "[^a]", r"\w", "國"])
patterns = st.recursive(atoms, lambda p: st.one_of(st.tuples(p, p).map("".join), st.tuples(p, p).map(lambda x: f"(?:{x[0]}|{x[1]})"), st.tuples(p, st.sampled_from(["*", "+", "?", "{2}", "{1,2}"])).map(lambda x: f"(?:{x[0]}){x[1]}")), max_leaves=6)


@settings(max_examples=150, deadline=None)
@given(patterns, st.lists(st.text(alphabet="abé國\n1", max_size=6), max_size=8))
def test_automaton_equals_regex(pattern, texts):
    dfa, own = automaton.compile_dfa(pattern), re.compile(rf"\A(?:{render.python(pattern)})\Z")
    for text in texts:
        assert dfa.match(text) == bool(own.match(text))


def test_token_steps():
    dfa = automaton.compile_dfa(r"(k[aeiou]\.){3}k")
    state = 0
    for token in (b"ka", b".ku", b".ko"):
        state = steps.consume(dfa, state, token)
        assert state not in (steps.REJECTED, steps.ACCEPTED)
    assert steps.consume(dfa, state, b".k") == steps.ACCEPTED


def test_viable_tokens_equal_consume():
    words = {n: w.encode() for n, w in enumerate(["k", "ka", "a.", ".", "ka.k", "x", "國", "o.ko"])}
    dfa = automaton.compile_dfa(r"k[ao]\.k")
    for state in range(len(dfa.table)):
        expected = {t: to for t, w in words.items() if (to := steps.consume(dfa, state, w)) != steps.REJECTED}
        assert steps.viable(dfa, state, steps.build_trie(words)) == expected


def test_cycles_are_cut():
    found = steps.build(automaton.compile_dfa("az*b"), {1: b"a", 2: b"z", 3: b"b"})
    assert found.cut and not steps.build(automaton.compile_dfa("azzb"), {1: b"a", 2: b"z", 3: b"b"}).cut


def test_too_large_patterns_scan():
    assert planner.plan("(.{9}a){90}", {1: b"a"}).mode == "scan"


def test_mapping():
    assert check_mapping('{".": "x"}') == {".": "x"}
    for bad in ("[]", '{"ab": "x"}', '{"é": "x"}'):
        with pytest.raises(ValueError):
            check_mapping(bad)
    node = planner.mapped(syntax.parse(r"a\."), {".": "x"})
    assert automaton.compile_dfa(node).match("ax") and not automaton.compile_dfa(node).match("a.")
