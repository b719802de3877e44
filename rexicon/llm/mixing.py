"""Mixing sources to target weights as a time-varying curriculum (operator 8).

Every source has a weight schedule over training time.  Integrating the schedule
gives the share of the source's words that are due by a time; inverting that for
the words that stand before a document in its source gives the document's place
in training; a range sort by place gives the order of the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, numbered, put, save

#: Weights by the rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: A source is taken at most so often.
CAP = 3
#: Per weight, in the order of WEIGHTS: knots (time, relative rate).  Heavy sources
#: lead at the start, light ones at the end; rates are relative within a source.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)),
)
#: Rows in one piece of a source's order.
PIECE = 4096
#: Words in one range of the mixed table, and parts in which equal rows are numbered.
RANGE_WORDS, PARTS = 1 << 24, 64
_BITS = 40


def integral(knots) -> list[tuple[float, float, float, float]]:
    """Segments (time from, time to, rate from, rate to) and the total they add up to."""
    total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    return [(a[0], b[0], a[1] / total, b[1] / total) for a, b in zip(knots, knots[1:])]


def reached(time: Column, knots) -> Column:
    """The share of the integrated schedule that is reached by a time: the inverse of ``inverse``."""
    out, before = None, 0.0
    for t0, t1, r0, r1 in integral(knots):
        x = time - F.lit(t0)
        share = F.lit(before) + x * (F.lit(r0) + x * F.lit((r1 - r0) / (t1 - t0) / 2))
        out = F.when(time < F.lit(t1), share) if out is None else out.when(time < F.lit(t1), share)
        before += (t1 - t0) * (r0 + r1) / 2
    return out.otherwise(F.lit(1.0))


def inverse(share: Column, knots) -> Column:
    """The time by which ``share`` (0 to 1) of the integrated schedule is reached."""
    out, before = None, 0.0
    segments = integral(knots)
    for i, (t0, t1, r0, r1) in enumerate(segments):
        area = (t1 - t0) * (r0 + r1) / 2
        rest = share - F.lit(before)
        slope = (r1 - r0) / (t1 - t0)
        # r0 * x + slope / 2 * x ** 2 = rest, in the form that is stable for small slopes
        root = F.sqrt(F.greatest(F.lit(r0 * r0) + F.lit(2.0 * slope) * rest, F.lit(0.0)))
        t = F.least(F.lit(t0) + F.lit(2.0) * rest / F.greatest(F.lit(r0) + root, F.lit(1e-300)), F.lit(t1))
        before += area
        last = i == len(segments) - 1
        out = F.when(F.lit(True) if last else share < F.lit(before), t) if out is None else out.when(F.lit(True) if last else share < F.lit(before), t)
    return out


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Target words per source: ``source, source_size, n_docs, rank, target``.

    ``sizes``: one row per source with ``source, source_size, n_docs``.  The targets
    fill up like water: the level of words per weight rises as sources that reach
    their cap hand on what they cannot take, until none is above its cap.  Sources are
    ranked and summed in parallel, however many there are; the driver holds the level.
    """
    picks = F.array(*[F.lit(float(w)) for w in weights])
    df = numbered(sizes, [F.col("source").isNull(), F.col("source")], "rank")
    df = df.withColumn("_w", F.element_at(picks, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("_cap", F.col("source_size") * cap)
    df = save(df, "sources")
    total = df.agg(F.sum("source_size")).first()[0] or 0
    level, n_full = 0.0, -1
    while True:
        full = F.col("_cap") < F.lit(level) * F.col("_w")
        seen = df.agg(F.sum(F.when(full, F.col("_cap")).otherwise(F.lit(0))).alias("held"), F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("_w"))).alias("w"), F.count_if(full).alias("n")).first()
        if seen.n == n_full or not seen.w:
            break
        n_full, level = seen.n, (total - int(seen.held)) / seen.w
    target = F.least(F.lit(level) * F.col("_w"), F.col("_cap").cast("double"))
    return df.select("source", "source_size", "n_docs", "rank", target.alias("target"))


def _groups(docs: DataFrame, key: Column, weights, cap: int, seed: str, piece: int) -> tuple[DataFrame, DataFrame]:
    """The groups of rows equal in ``doc_id, source, size`` and ``key``, with what their source gives them, and the sources.

    ``doc_id, source, size, key, n, rank, source_size, target, _u, _start``: the rows of
    a group stand one after the other in their source's order, from word ``_start`` on.
    Only narrow rows move; rows repeated, or with one id, are counted before that, so
    they are no more work than others.
    """
    rows = docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"), key.alias("key"))
    rows = save(rows.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("n")), "sizes")
    by_source = targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs")), weights, cap)
    by_source = save(by_source, "targets")
    hashed = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("_u", F.conv(F.substring(hashed, 1, 10), 16, 10).cast("long"))
    right = by_source.withColumnRenamed("source", "_source")
    rows = rows.join(right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # A source's order falls into pieces of bounded size: sums of whole pieces, then a running sum in each.
    rows = rows.withColumn("_pieces", F.ceil(F.col("n_docs") / piece).cast("long"))
    rows = rows.withColumn("_piece", (F.col("_u").cast("double") * F.col("_pieces") / F.lit(float(1 << _BITS))).cast("long"))
    rows = rows.drop("_pieces")
    words = F.col("size") * F.col("n")
    pieces = rows.groupBy("rank", "_piece").agg(F.sum(words).alias("_sum"))
    up_to = Window.partitionBy("rank").orderBy("_piece").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("_base", F.sum("_sum").over(up_to) - F.col("_sum")).drop("_sum")
    inside = Window.partitionBy("rank", "_piece").orderBy("_u", "doc_id", "size", "key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(pieces, ["rank", "_piece"])
    start = F.col("_base") + F.sum(words).over(inside) - words
    return rows.select("doc_id", "source", "size", "key", "n", "rank", "source_size", "target", "_u", start.alias("_start")), by_source


def _taken(start: Column, schedules) -> dict[str, Column]:
    """``taken, whole, positions`` of a row that begins at word ``start`` of its source."""
    due = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(due / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = due - passes * F.col("source_size")
    part = F.greatest(F.least(rest - start, F.col("size")), F.lit(0).cast("long"))
    whole = F.when(F.col("size") > 0, passes + F.when(part * 2 >= F.col("size"), 1).otherwise(0)).otherwise(F.lit(1))
    copies = (passes + F.when(part > 0, 1).otherwise(0)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), F.greatest(copies, F.lit(1)) - 1), lambda k: start + k * F.col("source_size"))
    share = lambda s: F.least(s / F.greatest(due, F.lit(1)), F.lit(1.0))
    n = len(schedules)

    def at(s: Column) -> Column:
        out = F.when(F.col("rank") % n == 0, inverse(share(s), schedules[0]))
        for k in range(1, n):
            out = out.when(F.col("rank") % n == k, inverse(share(s), schedules[k]))
        return out

    positions = F.when(copies > 0, F.transform(starts, at)).otherwise(F.array().cast("array<double>"))
    return {"taken": passes * F.col("size") + part, "whole": whole.cast("int"), "positions": positions}


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, schedules=SCHEDULES, seed: str = "mix", piece: int = PIECE) -> DataFrame:
    """One row per document of ``docs`` (``doc_id, text, source``): what the mix takes of it and where.

    Returns ``doc_id, source, size, source_size, target, taken, whole, positions,
    position`` in the order of ``position``.  ``taken``: words, repeats counted;
    per source they add up to the whole part of its target.  A source is gone through
    in a fixed random order as often as its target needs; the last pass ends inside
    one document, of which ``taken`` counts the words before that point.  ``whole``:
    copies when that last piece counts if it is at least half of the document.
    ``positions``: the place in training, 0 to 1, of each copy begun; ``position``
    the first (null for documents that are not taken, which come last).

    Null text has size 0; a null source is one source, last in order; an empty table
    gives an empty result; repeated rows are taken each on its own account, in equal
    order keys by doc_id and size.  Other columns of the input, whatever their names,
    are ignored; a very long text is a document like any other.
    """
    groups = save(_groups(docs, F.lit(0), weights, cap, seed, piece)[0], "places")
    # Groups of many equal rows are dealt out in parts before each part is unrolled.
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / piece) - 1))
    many = groups.where(F.col("n") > piece).withColumn("_part", part).repartition("doc_id", "size", "_part")
    both = groups.where(F.col("n") <= piece).withColumn("_part", F.lit(0).cast("long")).unionByName(many)
    last = F.least(F.col("n") - F.col("_part") * piece, F.lit(piece)) - 1
    rows = both.withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.withColumn("_at", F.col("_start") + (F.col("_part") * piece + F.col("_r")) * F.col("size"))
    out = rows.select("doc_id", "source", "size", "source_size", "target", *[c.alias(k) for k, c in _taken(F.col("_at"), schedules).items()])
    return out.withColumn("position", F.get("positions", F.lit(0))).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def apply(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, schedules=SCHEDULES, seed: str = "mix", piece: int = PIECE) -> DataFrame:
    """The mixed documents themselves, in the order of training: each as often as the mix takes it whole.

    Columns are those of ``docs``.  Documents without words take no training time and
    stay once, at a random place.  A document that is taken less than half goes.  Rows
    that share a doc_id are told apart by their texts; rows equal in both are counted
    on, each with places of its own.  An empty table gives an empty result.

    The mix by time is known in advance, so every copy goes straight to the range of
    its place: ranges hold about equal numbers of words and none is sampled for.
    """
    groups, by_source = _groups(docs, F.xxhash64("text"), weights, cap, seed, piece)
    places = save(groups, "places")
    pick = ["n", "rank", "size", "source_size", "target", "_u", "_start"]
    names = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    plan = places.select(F.col("doc_id").alias("_rx_id"), F.col("source").alias("_rx_source"), F.col("key").alias("_rx_key"), F.struct(*pick).alias("_rx_plan"))
    on = F.col("doc_id").eqNullSafe(F.col("_rx_id")) & F.col("source").eqNullSafe(F.col("_rx_source")) & (F.col("_rx_hash") == F.col("_rx_key"))
    rows = put(docs, _rx_hash=F.xxhash64("text"))
    single = rows.join(plan.where("_rx_plan.n = 1"), on).withColumn("_rx_r", F.lit(0).cast("long"))
    several = plan.where("_rx_plan.n > 1")
    if not several.isEmpty():
        # Equal rows are numbered in parts, so that one task never has them all.
        many = save(rows.withColumn("_rx_no", F.monotonically_increasing_id()).join(several, on), "repeated")
        many = many.withColumn("_rx_part", F.pmod(F.col("_rx_no"), F.lit(PARTS)))
        group = ["_rx_id", "_rx_source", "_rx_key"]
        counts = many.groupBy(*group, "_rx_part").agg(F.count(F.lit(1)).alias("_rx_n"))
        upto = Window.partitionBy(*group).orderBy("_rx_part").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.select(*[F.col(c).alias(c + "_") for c in (*group, "_rx_part")], (F.sum("_rx_n").over(upto) - F.col("_rx_n")).alias("_rx_before"))
        same = F.lit(True)
        for c in (*group, "_rx_part"):
            same = same & F.col(c).eqNullSafe(F.col(c + "_"))
        own = Window.partitionBy(*group, "_rx_part").orderBy("_rx_no")
        many = many.withColumn("_rx_own", F.row_number().over(own) - 1).join(counts, same).withColumn("_rx_r", F.col("_rx_before") + F.col("_rx_own"))
        single = single.select(*names, "_rx_plan", "_rx_r").unionByName(many.select(*names, "_rx_plan", "_rx_r"))
    # What the plan needs goes by names that no column of the documents can clash with.
    told = single.select(F.struct(*names).alias("_doc"), "_rx_plan.*", "_rx_r")
    found = _taken(F.col("_start") + F.col("_rx_r") * F.col("size"), schedules)
    told = told.select("_doc", "_u", found["whole"].alias("whole"), found["positions"].alias("positions")).where("whole > 0")
    last = F.try_element_at("positions", F.lit(-1))
    copies = F.transform(F.sequence(F.lit(0), F.col("whole") - 1), lambda k: F.coalesce(F.get("positions", k), last, F.col("_u") / F.lit(float(1 << _BITS))))
    told = told.select("_doc", F.explode(copies).alias("at"))
    n = len(schedules)
    due = {r.kind: float(r.due) for r in by_source.groupBy((F.col("rank") % n).alias("kind")).agg(F.sum("target").alias("due")).collect()}
    total = sum(due.values())
    n_ranges = max(3 * docs.sparkSession.sparkContext.defaultParallelism, -(-int(total) // RANGE_WORDS))
    share = F.lit(0.0)
    for k, words in sorted(due.items()):
        share = share + reached(F.col("at"), schedules[k]) * F.lit(words / total if total else 0.0)
    told = told.withColumn("_range", F.greatest(F.least((share * n_ranges).cast("int"), F.lit(n_ranges - 1)), F.lit(0)))
    told = told.repartitionById(n_ranges, F.col("_range")).sortWithinPartitions("at", "_doc.doc_id")
    return told.select("_doc.*")
