"""Quality rules with adaptive thresholds (operator 6).

Fixed cutoffs fit one corpus.  Here every (language, source) learns its own from the
spread of its documents: quantile sketches per group and metric give the quartiles,
and a document is rejected beyond the upper fence of its group.  A sketch is a
histogram over fixed logarithmic bins (relative error ``GAMMA - 1`` at most), so
sketches merge by adding counts, in any order and with the same result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, put, slices

SYMBOLS = "#*$%&|<>"
#: Ratio of the bounds of a sketch's bin, and the values below which all are one bin.
GAMMA, LEAST = 1.02, 1e-3
#: Per metric: fence = q3 + FENCE * max(q3 - q1, spread).  The group's sketch sets the
#: place and, where it is the wider, the spread; the constant is the least spread, so that
#: a group of which three quarters are alike does not reject all others.
FENCE = 3.0
SPREADS = {"symbols": 0.02, "dup_lines": 0.1, "repeats": 0.1, "word_length": 0.5}
#: Groups with fewer documents use the merged sketch of their language, then of all.
MIN_GROUP = 50
#: The base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = _WORDS(text)
    n = len(words)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    dup = 0
    if "\n" in text:
        seen = set()
        for line in text.split("\n"):
            if line in seen:
                dup += 1
            elif _WORD(line):
                seen.add(line)
    return n, chars, symbols, dup, repeat_words(words)


_WORDS, _WORD = re.compile(WORD).findall, re.compile(WORD).search


def repeat_words(words: list[str]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n + 2)
    v = len(number)
    # With over 2 million different words three numbers do not fit in 63 bits: number the pairs first.
    pairs = ids[:-1] * v + ids[1:]
    if v > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    codes = pairs[:-1] * v + ids[2:]
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k : k + n] |= twice
    return int(covered.sum())


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the counts of every document."""

    def rows(batches):
        for batch in slices(batches):
            found = [counts(t) for t in batch.column(3).to_pylist()]
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["doc_id", "lang", "source", *COUNTS])

    rows_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text"))
    return rows_of.mapInArrow(rows, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def metrics() -> dict[str, Column]:
    """The measures that the adaptive rules watch, higher is worse."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "dup_lines": F.col("n_dup_lines") * F.lit(10.0) / words,
        "repeats": F.col("n_repeat_words") / words,
        "word_length": F.col("word_chars") / words,
    }


def bin_of(value: Column) -> Column:
    """The sketch's bin of a value: 0 up to LEAST, then GAMMA-wide steps."""
    steps = F.ceil(F.log(F.greatest(value, F.lit(LEAST)) / F.lit(LEAST)) / F.lit(float(np.log(GAMMA))))
    return steps.cast("int")


def top_of(bin_: Column) -> Column:
    """The largest value of a bin."""
    return F.when(bin_ <= 0, F.lit(0.0)).otherwise(F.lit(LEAST) * F.pow(F.lit(GAMMA), bin_.cast("double")))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Upper fences from sketches ``keys, metric, bin, n``: one row per group and metric."""
    by = Window.partitionBy(*keys, "metric")
    upto = by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumn("_total", F.sum("n").over(by)).withColumn("_upto", F.sum("n").over(upto))
    quartile = lambda q: F.min(F.when(F.col("_upto") * 4 >= F.col("_total") * q, F.col("bin")))
    out = ranked.groupBy(*keys, "metric").agg(F.max("_total").alias("n_docs"), quartile(1).alias("_b1"), quartile(3).alias("_b3"))
    q1, q3 = top_of(F.col("_b1")), top_of(F.col("_b3"))
    spread = F.lit(0.0)
    for name, least in SPREADS.items():
        spread = F.when(F.col("metric") == name, F.lit(least)).otherwise(spread)
    return out.select(*keys, "metric", "n_docs", (q3 + F.lit(FENCE) * F.greatest(q3 - q1, spread)).alias("fence"))


def score(counted: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Add ``base_failed``, ``kept`` and the metrics to rows with ``lang, source`` and COUNTS.

    Fences are learned from the documents that pass the base rules.  A group whose
    documents are too few for its own sketch takes the sketch of its language, merged
    over sources, or of the whole table.  Null lang or source are groups of their own.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    rows = put(counted.withColumn("base_failed", failed), **metrics())
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), bin_of(F.col(m)).alias("bin")) for m in SPREADS])
    sketch = rows.where(~F.col("base_failed")).select("lang", "source", F.explode(pairs).alias("p")).groupBy("lang", "source", "p.metric", "p.bin").agg(F.count(F.lit(1)).alias("n"))
    levels = [fences(sketch, ["lang", "source"]), fences(_merge(sketch, ["lang"]), ["lang"]), fences(_merge(sketch, []), [])]
    wide = []
    for k, (level, keys) in enumerate(zip(levels, (["lang", "source"], ["lang"], []))):
        per = [F.max(F.when(F.col("metric") == m, F.col("fence"))).alias(f"_{m}{k}") for m in SPREADS]
        wide.append(level.groupBy(*keys).agg(F.max("n_docs").alias(f"_n{k}"), *per).select(*[F.col(c).alias(f"_{c}{k}") for c in keys], f"_n{k}", *[f"_{m}{k}" for m in SPREADS]))
    out = rows.join(wide[0], F.col("lang").eqNullSafe(F.col("_lang0")) & F.col("source").eqNullSafe(F.col("_source0")), "left")
    out = out.join(wide[1], F.col("lang").eqNullSafe(F.col("_lang1")), "left")
    out = out.join(F.broadcast(wide[2]), F.lit(True), "left")  # one row
    fits = F.lit(True)
    for m in SPREADS:
        fence = F.when(F.coalesce(F.col("_n0"), F.lit(0)) >= min_group, F.col(f"_{m}0")).when(F.coalesce(F.col("_n1"), F.lit(0)) >= min_group, F.col(f"_{m}1")).otherwise(F.col(f"_{m}2"))
        fits = fits & (F.col(m) <= fence)
    return out.select("doc_id", "lang", "source", *COUNTS, *SPREADS, "base_failed", (~F.col("base_failed") & F.coalesce(fits, F.lit(False))).alias("kept"))


def _merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of larger groups: the sum of those of their parts."""
    return sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))


def apply(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Counts, metrics and verdict of every document of ``docs`` (``doc_id, text, lang, source``).

    A null or empty text has no words and fails the base rules; a value equal to its
    fence is kept.  An empty table gives an empty result; repeated rows are judged
    alike; whole texts are counted, however long; other columns are ignored.
    """
    from .common import save

    return score(save(base_counts(docs), "quality"), min_group)
