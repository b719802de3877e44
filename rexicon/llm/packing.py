"""Best-fit packing under conflicts (operator 5).

Documents go into bins of a fixed capacity.  Bins are ordered by what is left in them
and carry bitmaps of the sources and duplicate clusters they hold; for a document the
search starts at the least sufficient remainder and goes on to the next bin until one
is compatible, so the bin found is the tightest compatible one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, save, slices

CAPACITY = 2048
#: A bin holds at most so many documents of one source, and one of a cluster.
SOURCE_LIMIT = 4
#: Rows of one shard: a shard is packed by one task, in memory.
SHARD = 8192
#: Equal rows that are unrolled together.
PART = 1024


class Packer:
    """Bins of one shard, numbered in the order in which they are opened.

    The bitmaps that bins carry are kept by column: bit b of a source's (or cluster's)
    bitmap tells that bin b holds it, bit b of a remainder's that bin b has it left.
    So one ``and`` compares a document with all bins of a remainder at once.
    """

    def __init__(self, capacity: int = CAPACITY, source_limit: int = SOURCE_LIMIT):
        self.capacity, self.limit = capacity, source_limit
        self.n_bins = 0
        self.left: dict[int, int] = {}  # remainder -> bins
        self.sizes = 0  # remainders that some bin has
        self.planes: dict[int, list[int]] = {}  # source -> bins that hold it once, twice, ... limit times
        self.clusters: dict[int, int] = {}  # cluster -> bins

    def place(self, size: int, source: int, cluster: int) -> int:
        """The bin for a document; a new one if none is compatible."""
        planes = self.planes.setdefault(source, [0] * self.limit)
        closed = planes[-1] | self.clusters.get(cluster, 0)
        left = max(size, 1)
        while rest := self.sizes >> left:
            left += (rest & -rest).bit_length() - 1  # the successor among the remainders
            if open_ := self.left[left] & ~closed:
                bit = open_ & -open_
                self.left[left] ^= bit
                if not self.left[left]:
                    self.sizes ^= 1 << left
                break
            left += 1
        else:
            bit, left = 1 << self.n_bins, self.capacity
            self.n_bins += 1
        self.clusters[cluster] = self.clusters.get(cluster, 0) | bit
        for k, plane in enumerate(planes):
            if not plane & bit:
                planes[k] |= bit
                break
        if left > size:
            self.left[left - size] = self.left.get(left - size, 0) | bit
            self.sizes |= 1 << (left - size)
        return bit.bit_length() - 1


def cluster_of(text: Column) -> Column:
    """The duplicate cluster of a text: equal up to case and white space."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " ")))


def pack(docs: DataFrame, capacity: int = CAPACITY, source_limit: int = SOURCE_LIMIT, shard: int = SHARD, size: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """One row per piece of a document of ``docs`` (``doc_id, text, source``): its place in a bin.

    Returns ``doc_id, piece, size, source, shard, bin, bin_size``.  ``size`` (default:
    words) of more than ``capacity`` is cut into whole bins, each alone, and a rest;
    documents of size 0 join bins too.  A bin holds one document of a ``cluster``
    (default: texts equal up to case and white space) and ``source_limit`` of a source.
    Shards are dealt by the hash of the row and its number among equal rows, so every
    shard has a like mix of sources and no key decides a task's share.  Each is packed
    on its own, largest first, ties by doc_id: up to about ``shard`` rows the bin found
    is the tightest compatible one of all, beyond that the tightest of its shard.
    Null texts are empty, a null source is one source, a null cluster conflicts with
    nothing.  Repeated rows are packed each.  An empty table gives an empty result;
    other columns, whatever their names, are ignored.
    """
    size = n_words(F.col("text")) if size is None else size
    cluster = cluster_of(F.col("text")) if cluster is None else cluster
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.cast("long").alias("_whole"), cluster.cast("string").alias("_cluster"))
    # Equal rows are counted, and unrolled in parts, so that they are spread like others.
    rows = save(rows.groupBy("doc_id", "source", "_whole", "_cluster").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    n_shards = max(1, -(-(rows.agg(F.sum("_n")).first()[0] or 0) // shard))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_n") / PART) - 1))
    many = rows.where(F.col("_n") > PART).withColumn("_part", part).repartition("doc_id", "_whole", "_part")
    rows = rows.where(F.col("_n") <= PART).withColumn("_part", F.lit(0).cast("long")).unionByName(many)
    rows = rows.withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_n") - F.col("_part") * PART, F.lit(PART)) - 1)))
    # A cluster's rows go to different shards where they can: its copies then rarely meet.
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "_cluster", "_whole", "_part", "_r"), F.lit(n_shards)))

    def bins(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("size", pa.int64()), ("source", pa.string()), ("shard", pa.int64()), ("bin", pa.int64()), ("bin_size", pa.int64())])

        def packed(at, group):
            packer, sources, clusters, out = Packer(capacity, source_limit), {}, {}, []
            pieces = []
            for n, (doc, source, whole, cluster) in enumerate(group):
                full, rest = divmod(whole, capacity)
                if whole and not rest:
                    full, rest = full - 1, capacity
                pieces += [(capacity, n, k) for k in range(full)] + [(rest, n, full)]
            pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
            total: dict[int, int] = {}
            for size, n, k in pieces:
                doc, source, whole, cluster = group[n]
                s = sources.setdefault(source, len(sources))
                # pieces of one document, too, are never together; a null cluster is new each time
                c = clusters.setdefault(cluster if cluster is not None else (n, "null"), len(clusters))
                b = packer.place(size, s, c)
                total[b] = total.get(b, 0) + size
                out.append((doc, k, size, source, b))
            columns = list(zip(*out))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), pa.array([at] * len(out), pa.int64()), pa.array(columns[4], pa.int64()), pa.array([total[b] for b in columns[4]], pa.int64())],
                schema=schema,
            )

        at, group = None, []
        for batch in slices(batches):
            for own, *row in zip(*(batch.column(j).to_pylist() for j in range(5))):
                if own != at:
                    if group:
                        yield packed(at, group)
                    at, group = own, []
                group.append(row)
        if group:
            yield packed(at, group)

    dealt = rows.repartition("shard").sortWithinPartitions("shard", F.col("_whole").desc(), "doc_id", "_cluster", "source")
    return dealt.select("shard", "doc_id", "source", "_whole", "_cluster").mapInArrow(bins, "doc_id long, piece int, size long, source string, shard long, bin long, bin_size long")
