"""Candidate search: postings driven by the step tables of a pattern."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.steps import ACCEPTED, Steps

#: Up to so many tokens, their ids go to the scan as a filter.
PUSHED_TOKENS = 2000


def _among(postings: DataFrame, tokens: set[int], buckets: int | None) -> DataFrame:
    """The postings of some tokens, by bucket and id; many ids are joined as a table, of a size that ``MAX_STEPS`` bounds."""
    if buckets:
        postings = postings.where(F.col("bucket").isin(sorted({t % buckets for t in tokens})))
    if len(tokens) <= PUSHED_TOKENS:
        postings = postings.where(F.col("token_id").isin(sorted(tokens)))
    else:
        some = pa.Table.from_arrays([pa.array(sorted(tokens), pa.int32())], names=["token_id"])
        postings = postings.join(F.broadcast(postings.sparkSession.createDataFrame(some)), "token_id", "left_semi")
    return postings.select("token_id", "doc_id", "pos")


def _walk(start: dict[int, tuple], step: dict[int, tuple]):
    """Batches of ``doc_id, pos, token_id``, a document's rows together and by falling position -> ids of the candidates.

    States are bits.  What lives at a position are the states from which the tokens
    from there on lead to the end; a token adds those whose next state is open or lives
    at the position behind it.
    """

    def found(batches):
        doc, place, alive, done = None, -1, 0, False
        for batch in batches:
            out = []
            for d, p, t in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if d != doc:
                    doc, place, alive, done = d, p, 0, False
                elif done:
                    continue
                behind = alive if p == place - 1 else 0
                place, alive = p, 0
                closed, goes = start.get(t, (False, 0))
                if closed or goes & behind:
                    out.append(d)
                    done = True
                    continue
                closed, moves = step.get(t, (0, ()))
                alive = closed
                if behind:
                    for bit, to in moves:
                        if to & behind:
                            alive |= bit
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["doc_id"])

    return found


def candidates(postings: DataFrame, steps: Steps, buckets: int | None = None) -> DataFrame:
    """``doc_id`` of the documents that can hold a match, each once.

    One scan of the postings of all tokens in the step tables and one shuffle by
    document, whatever the number of states; each document's positions are then gone
    through once, from the last to the first.  A pattern that single tokens decide
    needs no positions.
    """
    spark = postings.sparkSession
    open_ends = steps.cut | {ACCEPTED}
    bit = {s: 1 << n for n, s in enumerate(sorted(steps.step))}
    start: dict[int, tuple] = {}
    for t, to in steps.start:
        closed, goes = start.get(t, (False, 0))
        start[t] = (closed or to in open_ends, goes | bit.get(to, 0))
    step: dict[int, tuple] = {}
    for s, own in steps.step.items():
        for t, to in own:
            closed, moves = step.get(t, (0, ()))
            step[t] = (closed | bit[s], moves) if to in open_ends else (closed, (*moves, (bit[s], bit.get(to, 0))))
    if not start:
        return spark.createDataFrame([], "doc_id long")
    if not step or all(closed for closed, _ in start.values()):
        return _among(postings, {t for t, (closed, _) in start.items() if closed}, buckets).select("doc_id").distinct()
    rows = _among(postings, set(start) | set(step), buckets).repartition("doc_id").sortWithinPartitions("doc_id", F.col("pos").desc())
    return rows.select("doc_id", "pos", "token_id").mapInArrow(_walk(start, step), "doc_id long")
