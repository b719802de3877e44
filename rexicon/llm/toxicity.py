"""Toxicity by a weighted lexicon (operator 2).

Texts are folded (case, homoglyphs, digits and signs that stand for letters), an
Aho-Corasick automaton finds the lexicon's terms at word starts, exception phrases
cover harmless hits, and the weights found are normalised by the length of the text.
The lexicon, the exceptions and the scale are learned from labelled documents.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from itertools import accumulate
from sys import intern
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, slices

# Letters of other scripts that look like Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "һ": "h", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ꜱ": "s", "ʟ": "l",
}
# Digits and signs written for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_FOLD = {ord(a): b for a, b in HOMOGLYPHS.items()}
_FOLD |= {0xFF41 + k: chr(97 + k) for k in range(26)}  # full-width letters, after lower-casing
_FOLD |= {c: None for c in (0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}  # invisible characters
#: Shorter texts count as so many words, so that one weak hit in a few words is no verdict.
SHORT = 50
_SUB = {ord(a): b for a, b in SUBSTITUTES.items()}
_SIGNS = re.compile(f"[{re.escape(''.join(SUBSTITUTES))}]+")
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """The folded words of a text, in order."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    if _SIGNS.search(text):
        text = _SIGNS.sub(_letters, text)
    return _WORDS.findall(text)


def _letters(run: re.Match) -> str:
    """A run of digits and signs as letters if a letter stands on either side; ``!`` that ends a word is none."""
    text, (start, end) = run.string, run.span()
    if end < len(text) and text[end].isalpha():
        return run[0].translate(_SUB)
    if start and text[start - 1].isalpha():
        own = run[0].rstrip("!")
        return own.translate(_SUB) + run[0][len(own) :]
    return run[0]


@dataclass
class Lexicon:
    """What scoring needs; its size is bounded by ``Limits``."""

    weights: dict[str, float]
    exceptions: frozenset = frozenset()
    power: float = 0.0
    cut: float = 0.5
    _automaton: object = field(default=None, repr=False, compare=False)

    def automaton(self):
        if self._automaton is None and self.weights:
            import ahocorasick

            found = ahocorasick.Automaton()
            for term in sorted(self.weights):
                found.add_word(" " + term, (len(term) + 1, self.weights[term], False))
            for phrase in sorted(self.exceptions):
                found.add_word(f" {phrase} ", (len(phrase) + 2, 0.0, True))
            found.make_automaton()
            self._automaton = found
        return self._automaton

    def raw(self, words: list[str]) -> float:
        """Summed weights of the hits that no exception phrase covers, by length."""
        automaton = self.automaton()
        if automaton is None or not words:
            return 0.0
        hits, covered = {}, []
        for end, (size, weight, harmless) in automaton.iter(" " + " ".join(words) + " "):
            start = end - size + 1
            if harmless:
                covered.append((start, end))
            elif weight > hits.get(start, (0.0, 0))[0]:  # of terms that begin one word the heaviest counts
                hits[start] = (weight, end)
        covered.sort()
        starts, reach = [a for a, _ in covered], list(accumulate((b for _, b in covered), max))
        # a phrase covers a hit if one that begins no later ends no earlier
        total = sum(w for start, (w, end) in hits.items() if not (k := bisect_right(starts, start)) or reach[k - 1] < end)
        return total / max(len(words), SHORT) ** self.power

    def score(self, text: str | None) -> float:
        """0 to 1; 0.7 at the cut."""
        raw = self.raw(words_of(text))
        return raw / (raw + self.cut * 3 / 7) if raw > 0 else 0.0


@dataclass(frozen=True)
class Limits:
    """Bounds of what is learned from, and of what is learned.

    Labelled rows per class; characters of one such text, longer ones are not learned
    from; characters per class in all.  Terms and exceptions are taken in the order of
    the documents that they explain, so beyond these bounds those that explain fewest
    are left out.  ``starts``: the longest word start that is a term of its own; longer
    words are candidates as a whole besides, so that words alike in these letters are
    still told apart.
    """

    toxic_rows: int = 1000
    clean_rows: int = 3000
    text_chars: int = 200_000
    class_chars: int = 40_000_000
    terms: int = 2000
    exceptions: int = 500
    starts: int = 12

    def candidates(self, word: str) -> list[str]:
        """The terms that a word can show: its starts from 3 letters on, and itself."""
        out = [word[:n] for n in range(3, min(len(word), self.starts) + 1)]
        return [*out, word] if len(word) > self.starts else out


def learn(rows: list[tuple[str, int]], limits: Limits = Limits()) -> Lexicon:
    """Fit a lexicon to (text, toxic) pairs.

    Candidate terms are word starts of 3 characters and more, each with the least
    number of hits (1 to 3) in a document that counts.  A term counts once per family
    of documents (those with the same least word hash, so that copies of one document
    prove nothing), and it must be too one-sided for chance given the number of
    candidates.  Documents that accepted terms explain no longer count for the next
    one, so that terms of a small language stand out too; then all terms that are
    one-sided over all toxic documents join.
    """
    docs = []
    for text, toxic in rows:
        words = [intern(w) for w in words_of(text)]
        unique = Counter(words)
        family = min((crc32(w.encode()) for w in unique if len(w) > 4), default=0)
        docs.append((int(bool(toxic)), unique, family, words))
    families = Counter(d[2] for d in docs)
    n_clean = sum(1 for d in docs if not d[0])
    n_toxic = len(docs) - n_clean
    starts: Counter = Counter()
    for toxic, unique, _, _ in docs:
        if toxic:
            starts.update({t for w in unique for t in limits.candidates(w)})
    hits: dict[str, dict[int, int]] = {t: {} for t, n in starts.items() if n >= 3}  # term -> toxic document -> hits
    del starts
    clean: dict[str, list[int]] = {}  # term -> clean documents with at least 1, 2, 3 hits, and hits
    for k, (toxic, unique, _, _) in enumerate(docs):
        if toxic:
            for w, c in unique.items():
                for t in limits.candidates(w):
                    if (of := hits.get(t)) is not None:
                        of[k] = of.get(k, 0) + c
    for toxic, unique, _, _ in docs:
        if not toxic:
            own: Counter = Counter()
            for w, c in unique.items():
                for t in limits.candidates(w):
                    if t in hits:
                        own[t] += c
            for t, c in own.items():
                of = clean.setdefault(t, [0, 0, 0, 0])
                for m in range(min(c, 3)):
                    of[m] += 1
                of[3] += min(c, 6)
    need = math.log(max(2, 3 * len(hits)) / 0.01)
    # (term, hits asked for): the toxic documents; only those that can ever be one-sided
    where = {}
    for t, of in hits.items():
        for m in (1, 2, 3):
            own = {k for k, c in of.items() if c >= m}
            if len(own) >= 3 and len({docs[k][2] for k in own}) >= 0.8 / 0.2 * clean.get(t, (0, 0, 0))[m - 1] * 0.999:
                where[t, m] = own

    def bits(own: set[int], t: str, m: int, rate: float, least: float) -> float:
        """How unlikely so one-sided a term is if toxic documents are ``rate`` of all."""
        fam, bad = len({docs[k][2] for k in own}), clean.get(t, (0, 0, 0))[m - 1]
        if fam < 3 or not 0 < rate < 1:
            return 0.0
        p = fam / (fam + bad)
        if p < least or p <= rate:
            return 0.0
        return (fam + bad) * (p * math.log(p / rate) + (0.0 if p == 1 else (1 - p) * math.log((1 - p) / (1 - rate))))

    weights: dict[str, float] = {}

    def accept(term: str, m: int, support: dict) -> set[int]:
        """Take the longest start that keeps nearly all of the support; return its documents."""
        n_best = len(support[term, m])
        same = [t for t, k in support if k == m and (t.startswith(term) or term.startswith(t)) and len(support[t, k]) >= 0.97 * n_best]
        stem = max(same, key=lambda t: (len(t), t))
        bad = (sum(min(c, 6) for c in hits[stem].values()) + 0.5) / max(1, n_toxic)
        good = (clean.get(stem, (0, 0, 0, 0))[3] + 0.5) / max(1, n_clean)
        weights[stem] = min(max(math.log(bad / good), 0.1), 6.0)
        return where[stem, m]

    open_docs = {k for k, d in enumerate(docs) if d[0]}
    while open_docs and len(weights) < limits.terms:
        rate = len(open_docs) / max(1, len(open_docs) + n_clean)
        support, strong = {}, {}
        for (t, m), own in where.items():
            left = own & open_docs
            if len(left) >= 3 and (b := bits(left, t, m, rate, 0.8)) > need:
                support[t, m], strong[t, m] = left, b
        if not support:
            break
        best = max(strong, key=lambda x: (strong[x], len(x[0]), x))
        open_docs -= accept(*best, support)
    rate = n_toxic / max(1, len(docs))
    support = {x: own for x, own in where.items() if bits(own, *x, rate, 0.95) > need + math.log(10) and len({docs[k][2] for k in own}) >= 10}
    for t, m in sorted(support, key=lambda x: (-len(support[x]), x[1], -len(x[0]), x[0])):
        if len(weights) >= limits.terms:
            break
        if not any(t.startswith(w) or w.startswith(t) for w in weights):
            accept(t, m, support)
    lexicon = Lexicon(weights)
    lexicon.exceptions = _exceptions(lexicon, docs, limits)
    return _scaled(lexicon, docs, families)


def _exceptions(lexicon: Lexicon, docs, limits: Limits) -> frozenset:
    """Words, and words with the one before, in which a term occurs in clean documents only."""
    stems = tuple(lexicon.weights)
    seen: dict[str, list[set]] = defaultdict(lambda: [set(), set()])
    for toxic, _, family, words in docs:
        for k, w in enumerate(words):
            if w.startswith(stems):
                for phrase in (w, f"{words[k - 1]} {w}") if k else (w,):
                    seen[phrase][toxic].add(family)
    good = sorted((p for p, (clean, toxic) in seen.items() if len(clean) >= 3 and not toxic), key=lambda p: (-len(seen[p][0]), p))
    return frozenset(good[: limits.exceptions])


def _scaled(lexicon: Lexicon, docs, families: Counter) -> Lexicon:
    """Choose the power of the length and the cut that separate the labelled documents best."""
    best = None
    sums = [(toxic, lexicon.raw(words), max(SHORT, len(words)), 1 / families[family]) for toxic, _, family, words in docs]
    for power in (0.0, 0.25, 0.5, 1.0):
        values = sorted(((raw / n**power, toxic, weight) for toxic, raw, n, weight in sums), key=lambda x: x[0])
        wrong = sum(w for v, t, w in values if not t)  # if all were called toxic
        options, low = [], 0.0
        for v, t, w in values:
            if v > low:
                options.append((wrong, low, v))
            wrong += w if t else -w
            low = v
        for cost, low, v in options:
            # a wide gap between the neighbours of the cut is worth more than a fine fit
            key = (-round(cost, 6), math.log(v / low) if low > 0 else 50.0 - power)
            if best is None or key > best[0]:
                best = (key, power, math.sqrt(low * v) if low > 0 else v / 2)
    if best:
        lexicon.power, lexicon.cut = best[1], best[2]
    return lexicon


def held_out(doc_id):
    """True for ids whose crc32 leaves 1 on division by 3: labels that nothing is learned from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> Lexicon:
    """A lexicon from a bounded sample of the labelled documents that are not held out.

    The sample has the ``toxic_rows`` and ``clean_rows`` labelled documents of least
    id hash, and of these, in that order, as many as ``Limits`` lets the driver hold.
    Of rows that share a doc_id the one of least text counts.  Labels that are null, or
    contradict each other for one doc_id, are not used; without any toxic label, or with
    an empty table, the lexicon is empty.
    """
    usable = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic")).where("_id is not null and _toxic is not null")
    usable = usable.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.min("_toxic").alias("_toxic"), F.max("_toxic").alias("_most")).where("_toxic = _most").drop("_most")
    picked = bounded_sample(usable.where("_toxic = 1"), "_id", limits.toxic_rows).unionByName(bounded_sample(usable.where("_toxic = 0"), "_id", limits.clean_rows))
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).where(F.length("_text") <= limits.text_chars)
    rows = texts.join(F.broadcast(picked), "_id").groupBy("_id", "_toxic").agg(F.min("_text").alias("_text"))
    upto = Window.partitionBy("_toxic").orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_chars", F.sum(F.length("_text")).over(upto)).where(F.col("_chars") <= limits.class_chars)
    rows = rows.select("_id", "_text", "_toxic").collect()
    return learn([(r._text, r._toxic) for r in sorted(rows, key=lambda r: (r._id, r._text or ""))], limits)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, score`` for every row of ``docs`` (``doc_id, text``), one pass without a shuffle.

    Null and empty texts score 0; repeated rows score alike; an empty table gives an
    empty result; the time is linear in the length of a text, however long; other
    columns, whatever their names, are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def rows(batches):
        scored = sent.value.score
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scored(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, score double")


def keep_clean(docs: DataFrame, lexicon: Lexicon, cut: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``cut``; null and empty texts stay."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    at = docs.columns.index("text")

    def rows(batches):
        scored = sent.value.score
        for batch in slices(batches):
            yield batch.filter(pa.array([scored(t) < cut for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)
