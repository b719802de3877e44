"""Near-duplicates by HyperMinHash (operator 10).

A document's shingle hashes fall into buckets; of each bucket's least hash a register
keeps the number of leading zeros and some mantissa bits, 16 bits in all.  Empty
buckets borrow from others in a fixed order of their own, so that registers of two
documents agree with the probability of their Jaccard similarity.  Bands of registers
find candidates, the share of equal registers less the expected accidental ones
estimates their similarity, and the full sets decide.

Documents of equal sets are one class from the start.  A bucket of a band is not
expanded into pairs: its members meet its least member, and only members that are then
still in different components meet each other, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, put, release, save, slices
from .graph import components

#: 32 bands of 5 registers: a pair at 0.8 is missed with a chance of (1 - 0.8 ** 5) ** 32 = 3e-6.
BANDS, ROWS = 32, 5
MANTISSA = 10
#: Chance that registers of different hashes agree, times 2 ** MANTISSA, for sets of equal size.
ACCIDENT = 0.1699
#: Estimates below the threshold by so many standard deviations rule a pair out before its sets are read.
SIGMAS = 5.0
#: Members of a bucket in one block, and bytes of their sets.
BLOCK, BLOCK_BYTES = 512, 16 << 20

_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _P2
    x = (x ^ (x >> np.uint64(27))) * _P3
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[bytes], known: dict) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    if len(known) > 100_000:
        known.clear()
    try:
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


_KNOWN: dict[bytes, int] = {}


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a UTF-8 text, A-Z in lower case.

    Fewer words than ``k`` are one shingle; no words, none.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = _word_hashes(words, _KNOWN)
    n = max(1, len(words) - k + 1)
    span = min(k, len(words))
    out = np.full(n, span, np.uint64)
    for j in range(span):
        out = mix(out * _P1 + h[j : j + n])
    return np.unique(out)


class Sketcher:
    """Registers of sets of hashes."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, self.m = bands, rows, bands * rows
        self.starts = np.array([-(-(b << 64) // self.m) for b in range(self.m)], dtype=np.uint64)
        random = np.random.default_rng(20)
        self.donors = np.argsort(random.random((self.m, self.m)), axis=1)  # per bucket, the order in which it borrows
        self.ranks = np.argsort(self.donors, axis=1)
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * _P1)

    def registers(self, hashes: np.ndarray) -> np.ndarray:
        """uint16 registers of a sorted, non-empty set."""
        first = np.searchsorted(hashes, self.starts)
        full = np.append(first[1:], len(hashes)) > first
        own = np.flatnonzero(full)
        inside = (hashes[first[own]] - self.starts[own]).astype(np.float64) * (self.m / 2.0**64)
        fraction, exponent = np.frexp(np.maximum(inside, 2.0**-50))
        codes = (np.minimum(-exponent, 63).astype(np.int64) << MANTISSA) | ((fraction - 0.5) * 2 ** (MANTISSA + 1)).astype(np.int64)
        out = np.zeros(self.m, np.uint16)
        out[own] = codes
        gaps = np.flatnonzero(~full)
        if len(gaps):
            if len(own) <= 48:
                out[gaps] = out[own[np.argmin(self.ranks[np.ix_(gaps, own)], axis=1)]]
            else:
                source, step = out.copy(), 0
                while len(gaps):
                    donor = self.donors[gaps, step]
                    hit = full[donor]
                    out[gaps[hit]] = source[donor[hit]]
                    gaps, step = gaps[~hit], step + 1
        return out

    def keys(self, registers: np.ndarray) -> np.ndarray:
        """int64 band keys, one row per row of registers."""
        parts = registers.reshape(-1, self.bands, self.rows).astype(np.uint64)
        h = np.broadcast_to(self.salt, parts.shape[:2]).copy()
        for j in range(self.rows):
            h = mix(h * _P1 + parts[:, :, j] + np.uint64(1))
        return h.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a, n_b) -> np.ndarray:
    """Jaccard similarity from registers (rows), corrected for accidental agreement."""
    share = (a == b).mean(axis=-1)
    n_a, n_b = np.asarray(n_a, float), np.asarray(n_b, float)
    accident = 4 * ACCIDENT * 2.0**-MANTISSA * n_a * n_b / np.maximum(n_a + n_b, 1) ** 2
    return np.clip((share - accident) / (1 - accident), 0.0, 1.0)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Exactly: 100 * intersection >= percent * union, of sorted sets."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _floor(percent: int, m: int) -> float:
    j = percent / 100
    return j - SIGMAS * (j * (1 - j) / m) ** 0.5


def sketches(docs: DataFrame, k: int, sketcher_args: tuple = (BANDS, ROWS)) -> DataFrame:
    """``_id, _th, _n, _fp, _regs`` of every row: id, text hash, set size, fingerprint of the set, registers."""

    def rows(batches):
        from xxhash import xxh3_128_digest

        sketcher = Sketcher(*sketcher_args)
        for batch in slices(batches):
            sets = [shingles(t, k) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([sketcher.registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["_id", "_th", "_n", "_fp", "_regs"],
            )

    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.xxhash64("text").alias("_th"), F.col("text").cast("binary").alias("_text"))
    return source.mapInArrow(rows, "_id long, _th long, _n long, _fp binary, _regs binary")


def _bands(classes: DataFrame, sketcher_args: tuple) -> DataFrame:
    """``key, rep``: one row per class and band."""

    def rows(batches):
        sketcher = Sketcher(*sketcher_args)
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, sketcher.m)
            keys = sketcher.keys(regs).ravel()
            reps = np.repeat(batch.column(0).to_numpy(), sketcher.bands)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(reps)], names=["key", "rep"])

    return classes.select("rep", "_regs").mapInArrow(rows, "key long, rep long")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``rep, hashes`` of the documents that ``wanted`` (``rep, _id, _th``) names, each once however often its row is repeated."""

    def rows(batches):
        for batch in slices(batches):
            sets = [shingles(t, k).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["rep", "hashes"])

    source = keyed(docs).select("_id", "_th", F.col("text").cast("binary").alias("_text"))
    once = source.join(wanted, ["_id", "_th"]).groupBy("_id", "_th").agg(F.first("rep").alias("rep"), F.first("_text").alias("_text"))
    return once.select("rep", "_text").mapInArrow(rows, "rep long, hashes binary")


def _likely(pairs: DataFrame, percent: int, m: int) -> DataFrame:
    """Of ``a, b, ra, rb, na, nb`` the pairs ``a, b`` that their registers do not rule out."""

    def rows(batches):
        least = _floor(percent, m)
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(j).to_pylist()), np.uint16).reshape(-1, m) for j in (2, 3))
            keep = estimate(ra, rb, batch.column(4).to_numpy(), batch.column(5).to_numpy()) >= least
            yield batch.select([0, 1]).filter(pa.array(keep))

    return pairs.mapInArrow(rows, "a long, b long")


def _checked(pairs: DataFrame, percent: int) -> DataFrame:
    """Of ``a, b, ha, hb`` the links ``a, b``, on the full sets."""

    def rows(batches):
        for batch in slices(batches):
            ha, hb = (batch.column(j).to_pylist() for j in (2, 3))
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(ha, hb)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(rows, "a long, b long")


def _grouped(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a pair of blocks (``key, i, j``) together, ordered by ``rep``."""
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep").select("key", "i", "j", *columns)


def _groups(batches, n: int):
    """The groups of ``_grouped`` rows with ``n`` columns, one after the other: key and list of rows."""
    key, group = None, []
    for batch in slices(batches):
        for k, i, j, *row in zip(*(batch.column(c).to_pylist() for c in range(3 + n))):
            if (k, i, j) != key:
                if len(group) > 1:
                    yield key, group
                key, group = (k, i, j), []
            group.append(row)
    if len(group) > 1:
        yield key, group


def _others(comp: np.ndarray, blk: np.ndarray, x: int, apart: bool) -> np.ndarray:
    """The members after ``x`` in other components and, of two blocks, in the other one."""
    rest = np.arange(x + 1, len(comp))
    rest = rest[comp[rest] != comp[x]]
    return rest[blk[rest] != blk[x]] if apart else rest


def _screened(members: DataFrame, percent: int, m: int) -> DataFrame:
    """Of ``key, i, j, blk, rep, comp, n, regs`` the rows that their registers pair with a member of another component."""

    def rows(batches):
        least = _floor(percent, m)
        for (k, i, j), group in _groups(batches, 5):
            blk, comp = np.array([g[0] for g in group]), np.array([g[2] for g in group])
            sizes = np.array([g[3] for g in group], float)
            regs = np.frombuffer(b"".join(g[4] for g in group), np.uint16).reshape(len(group), -1)
            live, apart = np.zeros(len(group), bool), blk.min() != blk.max()
            for x in range(len(group)):
                rest = _others(comp, blk, x, apart)
                if len(rest):
                    near = rest[estimate(regs[rest], regs[x], sizes[rest], sizes[x]) >= least]
                    live[near] = True
                    live[x] |= len(near) > 0
            if live.any():
                kept = [g[:3] for g, l in zip(group, live) if l]
                n = len(kept)
                yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int64()), pa.array([i] * n, pa.int32()), pa.array([j] * n, pa.int32()), *(pa.array([g[c] for g in kept], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64())))], names=["key", "i", "j", "blk", "rep", "comp"])

    return _grouped(members, ["blk", "rep", "comp", "n", "regs"]).mapInArrow(rows, "key long, i int, j int, blk int, rep long, comp long")


def _blocks(members: DataFrame, percent: int, m: int) -> DataFrame:
    """Links between members of a bucket that are in different components.

    ``members``: ``key, i, j, blk, rep, comp, regs, hashes``, one pair of blocks (i, j)
    being one group.  Within a group, two components are compared until a link joins
    them, or to the end; at most one link less than components is returned.
    """

    def rows(batches):
        least = _floor(percent, m)

        def links(group):
            of: dict[int, int] = {}

            def root(c):
                while of.get(c, c) != c:
                    c = of[c]
                return c

            blks, reps, comps = [g[0] for g in group], [g[1] for g in group], [g[2] for g in group]
            regs = np.frombuffer(b"".join(g[3] for g in group), np.uint16).reshape(len(group), -1)
            sets = [np.frombuffer(g[4], np.uint64) for g in group]
            sizes = np.array([len(s) for s in sets], float)
            comp, blk = np.array(comps), np.array(blks)
            apart = blk.min() != blk.max()
            for x in range(len(group)):
                rest = _others(comp, blk, x, apart)
                if not len(rest):
                    continue
                guess = estimate(regs[rest], regs[x], sizes[rest], sizes[x])
                for y, g in sorted(zip(rest.tolist(), guess.tolist()), key=lambda t: -t[1]):
                    if g < least:
                        break
                    if root(comps[x]) != root(comps[y]) and similar(sets[x], sets[y], percent):
                        of[root(comps[x])] = root(comps[y])
                        yield reps[x], reps[y]

        for _, group in _groups(batches, 5):
            found = list(links(group))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return _grouped(members, ["blk", "rep", "comp", "regs", "hashes"]).mapInArrow(rows, "a long, b long")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_id, _th`` added: the id, NULL_ID for null, and the hash of the text."""
    return put(docs, _id=F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), _th=F.xxhash64("text"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text``): ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if ``100 * intersection >= percent * union`` of their sets of
    ``k``-word shingles; components are by links.  ``component_id``: the least doc_id
    of the component; ``kept``: it is the document's own.  Null, empty and blank texts
    have an empty set and no links.  Rows that share a doc_id are one document with
    several texts: what any of them is linked with is reached from all.  A null doc_id
    counts as larger than any other and is given back as null; each null row stands
    for itself, so only its own text links it.  Repeated rows are given back each.  An
    empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    out = _judged(docs, k, percent, bands, rows, block)
    null_id = lambda c: F.when(c != NULL_ID, c)
    return out.select(null_id(F.col("_id")).alias("doc_id"), F.col("_n").alias("n_shingles"), null_id(F.col("_found._id")).alias("component_id"), (F.col("_id") == F.col("_found._id")).alias("kept"))


def _shared_ids(base: DataFrame, classes: DataFrame) -> DataFrame:
    """Links ``a, b`` between the classes of texts that share a doc_id."""
    known = base.where((F.col("_id") != NULL_ID) & F.col("_fp").isNotNull())
    several = known.groupBy("_id").agg(F.min("_fp").alias("_low"), F.max("_fp").alias("_high")).where("_low <> _high")
    several = save(several.select("_id"), "shared-ids")
    if several.isEmpty():
        return several.select(F.col("_id").alias("a"), F.col("_id").alias("b"))
    of_id = known.select("_id", "_fp").join(several, "_id", "left_semi").distinct().join(classes.select("_fp", "rep"), "_fp").select("_id", "rep")
    least = of_id.groupBy("_id").agg(F.min("rep").alias("b"))
    return of_id.join(least, "_id").select(F.col("rep").alias("a"), "b").where("a <> b")


def _judged(docs: DataFrame, k: int, percent: int, bands: int, rows: int, block: int) -> DataFrame:
    """``_id, _th, _n, _found`` of every row: its key, set size and the least key (``_id, _th``) of its component.

    The joins that carry registers and sets are sort-merge joins at every size: both
    sides grow with the documents.
    """
    args, m = (bands, rows), bands * rows
    base = save(sketches(docs, k, args), "sketches")
    classes = base.where("_fp is not null").groupBy("_fp").agg(F.min(F.struct("_id", "_th")).alias("least"), F.first("_regs").alias("_regs"), F.first("_n").alias("n"))
    classes = save(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    keys = _bands(classes, args)
    centers = save(keys.groupBy("key").agg(F.min("rep").alias("center"), F.count(F.lit(1)).alias("size")).where("size > 1"), "centers")
    members = save(keys.join(centers, "key"), "members")
    named = classes.join(members.select("rep").distinct(), "rep", "left_semi")
    sets = save(_sets(docs, named.select("rep", "least._id", "least._th"), k), "sets")
    regs = classes.select("rep", "n", F.col("_regs").alias("regs"))
    pairs = members.where("rep <> center").select(F.col("rep").alias("a"), F.col("center").alias("b")).distinct()
    side = lambda df, to, **more: df.select(F.col("rep").alias(to), *[F.col(c).alias(n) for n, c in more.items()]).hint("merge")
    guessed = pairs.join(side(regs, "a", ra="regs", na="n"), "a").join(side(regs, "b", rb="regs", nb="n"), "b")
    likely = _likely(guessed.select("a", "b", "ra", "rb", "na", "nb"), percent, m)
    exact = likely.join(side(sets, "a", ha="hashes"), "a").join(side(sets, "b", hb="hashes"), "b")
    links = save(_checked(exact.select("a", "b", "ha", "hb"), percent).unionByName(_shared_ids(base, classes)), "star-links")
    labels = components(links)
    # What the stars have left apart: buckets that hold more than one component.
    weight = sets.select("rep", F.octet_length("hashes").alias("bytes"))
    held = members.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").join(weight, "rep").select("key", "rep", F.coalesce("label", "rep").alias("comp"), "bytes")
    held = save(held, "held")
    # Per bucket, blocks for its largest component and for the others: the first ones meet only the others.
    parts = held.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    mixed = parts.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("_big"), F.max(F.struct("n", "bytes")).alias("_b"), F.sum("n").alias("_n"), F.sum("bytes").alias("_bytes"), F.count(F.lit(1)).alias("_comps")).where("_comps > 1")
    blocks = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    mixed = save(mixed.select("key", "_big", blocks(F.col("_n") - F.col("_b.n"), F.col("_bytes") - F.col("_b.bytes")).alias("_small"), blocks(F.col("_b.n"), F.col("_b.bytes")).alias("_large")), "mixed")
    rest = held.drop("bytes").join(mixed, "key")
    big, hash_ = F.col("comp") == F.col("_big"), F.xxhash64("rep")
    rest = rest.withColumn("blk", F.when(big, F.col("_small") + F.pmod(hash_, F.col("_large"))).otherwise(F.pmod(hash_, F.col("_small"))).cast("int"))
    others = F.sequence(F.lit(0), F.when(big, F.col("_small")).otherwise(F.col("_small") + F.col("_large")) - 1)
    rest = rest.withColumn("_o", F.explode(others)).select("key", F.least("blk", "_o").alias("i"), F.greatest("blk", "_o").alias("j"), "blk", "rep", "comp")
    # Registers travel first; sets only of members that some other component's member may be near.
    live = save(_screened(rest.join(regs.hint("merge"), "rep"), percent, m), "live")
    full = live.join(regs.select("rep", "regs").hint("merge"), "rep").join(sets.hint("merge"), "rep")
    more = save(_blocks(full, percent, m), "block-links")
    release(centers, members, sets, held, mixed, live)
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    joined = save(classes.select("_fp", "rep", "least").join(labels.select(F.col("node").alias("rep"), "label"), "rep"), "labels")
    least = joined.groupBy("label").agg(F.min("least").alias("_least"))
    of_class = save(joined.join(least, "label").select("_fp", "_least"), "components")
    alone = classes.select("_fp", F.col("least").alias("_alone"))
    out = base.select("_id", "_th", "_n", "_fp").join(alone, "_fp", "left").join(of_class, "_fp", "left")
    return out.select("_id", "_th", "_n", F.coalesce("_least", "_alone", F.struct("_id", "_th")).alias("_found"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, all columns, of one document per group of near-duplicates.

    It is the one of the least doc_id (null: last), of those with equal doc_id the one
    of the least text hash.  Rows equal in doc_id and text are one document and stay
    or go together; null, empty and blank texts are in no group and stay.  An empty
    table gives an empty result.
    """
    found = _judged(docs, k, percent, bands, rows, block)
    gone = found.where((F.col("_id") != F.col("_found._id")) | (F.col("_th") != F.col("_found._th"))).select(F.col("_id").alias("_rx_id"), F.col("_th").alias("_rx_th")).distinct()
    marked = put(docs, _rx_id=F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), _rx_th=F.xxhash64("text"))
    names = [f"`{c.replace('`', '``')}`" for c in docs.columns]
    return marked.join(save(gone, "gone"), ["_rx_id", "_rx_th"], "left_anti").select(*names)
