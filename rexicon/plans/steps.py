"""How vocabulary tokens drive an automaton.

``start`` rows say in which state a token leaves a match that begins inside it, ``step``
rows how a state goes on; ``ACCEPTED`` means that the match is complete, whatever
follows.  Only states that tokens can reach are expanded.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from .automaton import Dfa, TooLarge

ACCEPTED, REJECTED = -1, -2
#: More rows than this are no longer small beside the postings; scan instead.
MAX_STEPS = 200_000


def consume(dfa: Dfa, state: int, data: bytes) -> int:
    """The state behind ``data``; ACCEPTED as soon as a match is complete, REJECTED if there is none."""
    if state in dfa.accepting:
        return ACCEPTED
    for byte in data:
        state = dfa.table[state][byte]
        if state < 0:
            return REJECTED
        if state in dfa.accepting:
            return ACCEPTED
    return state


def build_trie(vocabulary: dict[int, bytes]) -> dict:
    """Nested dicts by byte; key -1 holds the tokens that end there."""
    root: dict = {}
    for token, data in vocabulary.items():
        at = root
        for byte in data:
            at = at.setdefault(byte, {})
        at.setdefault(-1, []).append(token)
    return root


def viable(dfa: Dfa, state: int, trie: dict) -> dict[int, int]:
    """token -> state behind it, for the tokens that keep the automaton alive."""
    out: dict[int, int] = {}
    todo = [(trie, state, state in dfa.accepting)]
    while todo:
        node, s, done = todo.pop()
        for byte, child in node.items():
            if byte == -1:
                if node is not trie:
                    out.update((token, ACCEPTED if done else s) for token in child)
            elif done:
                todo.append((child, s, True))
            elif (to := dfa.table[s][byte]) >= 0:
                todo.append((child, to, to in dfa.accepting))
    return out


@dataclass(frozen=True)
class Steps:
    """``start``: (token, next); ``step``: state -> (token, next); ``rank``: 0 for states whose
    continuation is left open (``cut``), else the longest way to them from there."""

    start: tuple[tuple[int, int], ...]
    step: dict[int, tuple[tuple[int, int], ...]]
    rank: dict[int, int]
    cut: frozenset[int]

    @property
    def rows(self) -> int:
        return len(self.start) + sum(map(len, self.step.values()))


def build(dfa: Dfa, vocabulary: dict[int, bytes], depth: int = 8) -> Steps:
    """The step tables of an automaton over a vocabulary.

    States on a cycle, and states deeper than ``depth`` tokens, are cut: their
    continuation counts as found and the candidates need a recheck.
    """
    start = set()
    for token, data in vocabulary.items():
        for pad in range(len(data)):
            to = consume(dfa, 0, data[pad:])
            if to != REJECTED:
                start.add((token, to))
    trie, step, level = build_trie(vocabulary), {}, {to: 1 for _, to in start if to >= 0}
    todo, rows = sorted(level), len(start)
    while todo:
        s = todo.pop(0)
        found = viable(dfa, s, trie) if level[s] <= depth else {}
        step[s] = tuple(sorted(found.items()))
        rows += len(found)
        if rows > MAX_STEPS:
            raise TooLarge(f"more than {MAX_STEPS} steps")
        for to in sorted(set(found.values())):
            if to >= 0 and to not in level:
                level[to] = level[s] + 1
                todo.append(to)
    nexts = {s: {to for _, to in own if to >= 0} for s, own in step.items()}
    cut = _cyclic(nexts) | {s for s in level if level[s] > depth}
    rank: dict[int, int] = {s: 0 for s in cut}

    def ranked(s: int) -> int:
        if s not in rank:
            rank[s] = 1 + max((ranked(to) for to in nexts[s]), default=0)
        return rank[s]

    for s in sorted(level, key=lambda x: -level[x]):
        ranked(s)
    kept = {s: own for s, own in step.items() if s not in cut}
    return Steps(tuple(sorted(start)), kept, rank, frozenset(cut))


def _cyclic(nexts: dict[int, set[int]]) -> set[int]:
    """States that lie on a cycle: what remains when states without successors, then without predecessors, are peeled off."""
    left = {s: set(to) for s, to in nexts.items()}
    for _ in range(2):
        back = defaultdict(set)
        for s, to in left.items():
            for t in to:
                back[t].add(s)
        todo = [s for s in left if not left[s]]
        while todo:
            s = todo.pop()
            left.pop(s)
            for p in back[s]:
                if p in left:
                    left[p].discard(s)
                    if not left[p]:
                        todo.append(p)
        turned = {s: set() for s in left}
        for s, to in left.items():
            for t in to:
                turned[t].add(s)
        left = turned
    return set(left)
