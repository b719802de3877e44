"""Nearest neighbours by a blocked matrix join on 8-bit products (operator 3).

Vectors are packed into blocks.  A tile joins a block of queries with a block of
candidates: an int8 matrix product bounds every inner product from both sides, the
pairs whose upper bound reaches the k-th lower bound survive, and only those are
recomputed in double precision on the original vectors.  Heaps per query merge the
tiles' best.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: Vectors in a block of candidates and of queries: a tile of int8 products has so many cells.
CANDIDATES, QUERIES = 2048, 1024
#: Candidate blocks that one task joins with one block of queries before it emits its heaps.
RUN = 16


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, norm of the decoded vector and norm of the error, per row."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(decoded, axis=1), np.linalg.norm(x - decoded, axis=1)


def tile_bounds(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of two quantised blocks.

    With x = x' + e and y = y' + f, x.y differs from x'.y' by at most
    |x'||f| + |e||y'| + |e||f|.  Products of up to 1,000 codes are exact in float32;
    longer vectors use float64.  Where values are so large that a bound overflows, it
    is infinite and the pair survives.
    """
    kind = np.float32 if a[0].shape[1] <= 1000 else np.float64
    with np.errstate(over="ignore", invalid="ignore"):
        return _bounds(a, b, kind)


def _bounds(a, b, kind) -> tuple[np.ndarray, np.ndarray]:
    product = (a[0].astype(kind) @ b[0].astype(kind).T).astype(np.float64) * a[1][:, None] * b[1][None, :]
    slack = np.outer(a[2], b[3]) + np.outer(a[3], b[2] + b[3])
    slack += 1e-9 * (1.0 + np.abs(product))  # rounding of the bound itself
    low, high = product - slack, product + slack
    low[np.isnan(low)], high[np.isnan(high)] = -np.inf, np.inf
    return low, high


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, terms added in order, so that equal pairs give equal sums."""
    out = np.zeros(len(x))
    for k in range(x.shape[1]):
        out += x[:, k] * y[:, k]
    return out


class Heaps:
    """The best ``k`` of each query: score, then smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(n)]

    def floor(self) -> np.ndarray:
        """The k-th best score so far; -inf while there are fewer."""
        return np.array([h[0][0] if len(h) == self.k else -np.inf for h in self.heaps])

    def add(self, query: int, score: float, vec_id: int) -> None:
        heap, item = self.heaps[query], (score, -vec_id)
        if len(heap) < self.k:
            heapq.heappush(heap, item)
        elif item > heap[0]:
            heapq.heapreplace(heap, item)


def search_tile(q_ids, q, q_codes, c_ids, c, c_codes, heaps: Heaps, k: int, survivors: int = 200_000) -> int:
    """Offer a block of candidates to the heaps; returns how many pairs were recomputed."""
    low, high = tile_bounds(q_codes, c_codes)
    own = q_ids[:, None] == c_ids[None, :]
    low[own], high[own] = -np.inf, -np.inf
    floor = heaps.floor()
    if low.shape[1] >= k:
        floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
    rows, columns = np.nonzero((high >= floor[:, None]) & ~own)
    for at in range(0, len(rows), survivors):
        r, s = rows[at : at + survivors], columns[at : at + survivors]
        with np.errstate(over="ignore", invalid="ignore"):
            scores = dots(q[r], c[s])
        scores[np.isnan(scores)] = -np.inf  # infinite sums of both signs: no order can be given, so last
        # per query the best k of this tile, ties to smaller ids, then into the heaps
        order = np.lexsort((c_ids[s], -scores, r))
        r, s, scores = r[order], s[order], scores[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r, side="left")
        for a, b, v in zip(r[rank < k], s[rank < k], scores[rank < k]):
            heaps.add(int(a), float(v), int(c_ids[b]))
    return len(rows)


def usable(vector: Column) -> Column:
    """Not null, not all zero, all components present and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


_PACKED = "dim int, ids binary, data binary"


def _pack(size: int):
    """Rows (vec_id, embedding) -> blocks of at most ``size`` vectors of one dimension."""

    def blocks(batches):
        open_: dict[int, tuple[list, list]] = {}
        schema = pa.schema([("dim", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])

        def close(dim):
            ids, rows = open_.pop(dim)
            return pa.RecordBatch.from_pydict({"dim": [dim], "ids": [np.array(ids, "<i8").tobytes()], "data": [np.array(rows, "<f8").tobytes()]}, schema)

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, rows = open_.setdefault(len(v), ([], []))
                ids.append(i)
                rows.append(v)
                if len(ids) == size:
                    yield close(len(v))
        for dim in sorted(open_):
            yield close(dim)

    return blocks


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows, by inner product, of every row for which ``queries`` holds.

    Returns ``query_id, rank, vec_id, score``.  Rows without id, and vectors that are
    null, zero or hold null or non-finite components take no part; vectors of another
    dimension are never near.  Repeated ids: each row is a candidate, none of a query's
    own id, and each query id is asked once, with its least vector.  With fewer
    candidates than ``k``, all are returned.  Ties go to the smaller vec_id.  An empty
    table, or one without queries, gives an empty result.  Other columns, whatever
    their names, are ignored.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.where(F.col(id_col).isNotNull() & usable(v)).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("_query"))
    asked = rows.where("_query").groupBy("vec_id").agg(F.min("v").alias("v"))
    q = save(asked.mapInArrow(_pack(QUERIES), _PACKED), "query-blocks")
    c = save(rows.select("vec_id", "v").mapInArrow(_pack(CANDIDATES), _PACKED), "candidate-blocks")
    number = lambda df, n: df.withColumn(n, F.xxhash64("ids", "data"))
    # Every block of queries meets every block of candidates: runs of blocks, not of rows.
    n_blocks = c.count()
    n_runs = max(1, -(-n_blocks // RUN), min(n_blocks, 2 * vectors.sparkSession.sparkContext.defaultParallelism))
    c = number(c, "_c").withColumn("_run", F.pmod(F.col("_c"), F.lit(n_runs)).cast("int"))
    q = number(q, "_q").withColumn("_run", F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1))))
    q = q.select("_run", "dim", F.col("_q"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    tiles = q.join(c.select("_run", "dim", F.col("ids"), F.col("data")), ["_run", "dim"])

    def search(batches):
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        key, heaps, held = None, None, None

        def emit():
            found = [(int(held[0][n]), -i, s) for n, heap in enumerate(heaps.heaps) for s, i in heap]
            return pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], schema=schema)

        for batch in batches:
            for own, dim, q_ids, q_data, ids, data in zip(*(batch.column(j).to_pylist() for j in range(6))):
                if own != key:
                    if key is not None:
                        yield emit()
                    x = np.frombuffer(q_data, "<f8").reshape(-1, dim)
                    key, held = own, (np.frombuffer(q_ids, "<i8"), x, quantise(x))
                    heaps = Heaps(len(x), k)
                y = np.frombuffer(data, "<f8").reshape(-1, dim)
                search_tile(*held, np.frombuffer(ids, "<i8"), y, quantise(y), heaps, k)
        if key is not None:
            yield emit()

    tiles = tiles.sortWithinPartitions("_run", "dim", "_q")  # a query block's tiles of a run follow each other
    found = tiles.select("_q", "dim", "q_ids", "q_data", "ids", "data").mapInArrow(search, "query_id long, vec_id long, score double")
    # Merge of the runs' heaps: a query has at most k rows per run, cut to k per task before the shuffle.
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
