"""Token ids in directly addressable codes (operator 9).

A file holds the ids of a run of documents.  Ids are cut into chunks of 8 bits, the
lowest first; level k holds the k-th chunks of all ids that have one, a bitmap says
which of them go on in the next level, and a rank directory counts the set bits
before each block of the bitmap.  Any id is read by following its chunk's rank from
level to level; no block is decoded.  Layout, little-endian:

    magic "DAC1" | levels u32 | documents u64 | ids u64
    doc_ids i64[documents] | has_id u8[documents] | starts u64[documents + 1]
    per level: n u64 | chunks u8[n] | bitmap u8[ceil(n / 8)] | directory u64[ceil(n / 512) + 1]

Files are stored as binary cells of a Parquet table in the shared folder, so that
Spark's commit protocol covers them and any store that Spark reads can hold them.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, slices

MAGIC = b"DAC1"
BLOCK = 512
#: A file is closed when it has so many ids.
FILE_IDS = 1 << 20
_POPCOUNT = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)


def encode_ids(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of (chunks, packed bitmap, rank directory)."""
    rest, levels = np.asarray(ids, dtype=np.uint64), []
    while True:
        chunks = (rest & np.uint64(255)).astype(np.uint8)
        high = rest >> np.uint64(8)
        more = high != 0
        bitmap = np.packbits(more, bitorder="little")
        edges = np.arange(0, len(more), BLOCK)
        counts = np.add.reduceat(more, edges, dtype=np.uint64) if len(more) else np.zeros(0, np.uint64)
        levels.append((chunks, bitmap, np.concatenate([np.zeros(1, np.uint64), np.cumsum(counts, dtype=np.uint64)])))
        if not more.any():
            return levels
        rest = high[more]


def write_file(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """The bytes of one file."""
    levels = encode_ids(ids)
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    out = [MAGIC, struct.pack("<IQQ", len(levels), len(doc_ids), len(ids)), np.array([d if d is not None else 0 for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], "u1").tobytes(), starts.tobytes()]
    for chunks, bitmap, ranks in levels:
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bitmap.tobytes(), ranks.astype("<u8").tobytes()]
    return b"".join(out)


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        n_levels, n_docs, self.n_ids = struct.unpack_from("<IQQ", data, 4)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, known = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known)]
        self.starts = take("<u8", n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            chunks, bitmap = take("u1", n), take("u1", (n + 7) // 8)
            padded = np.concatenate([bitmap, np.zeros(BLOCK // 8 + 1, np.uint8)])
            self.levels.append((chunks, padded, take("<u8", (n + BLOCK - 1) // BLOCK + 1)))

    def _rank(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits of the level's bitmap before each place."""
        _, padded, ranks = self.levels[level]
        block = at // BLOCK
        out = ranks[block].astype(np.int64)
        first, byte = block * (BLOCK // 8), at // 8
        window = first[:, None] + np.arange(BLOCK // 8)
        whole = window < byte[:, None]
        out += (_POPCOUNT[padded[window]] * whole).sum(axis=1, dtype=np.int64)
        left = padded[byte] & ((1 << (at % 8).astype(np.int64)) - 1).astype(np.uint8)
        return out + _POPCOUNT[left]

    def get(self, places) -> np.ndarray:
        """The ids at any places."""
        at = np.asarray(places, dtype=np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n_ids):
            raise IndexError("place outside the file")
        out, live = np.zeros(len(at), np.uint64), np.arange(len(at))
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            if not len(live):
                break
            out[live] |= chunks[at].astype(np.uint64) << np.uint64(8 * k)
            more = (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            live, at = live[more], self._rank(k, at[more]) if more.any() else at[:0]
        return out

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids from start to before end: a run stays a run in every level."""
        out, live, lo, hi = np.zeros(end - start, np.uint64), np.arange(end - start), start, end
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            if lo == hi:
                break
            out[live] |= chunks[lo:hi].astype(np.uint64) << np.uint64(8 * k)
            bits = np.unpackbits(bitmap[lo // 8 : (hi + 7) // 8], bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)
            live = live[bits]
            if not len(live):
                break
            lo = int(self._rank(k, np.array([lo]))[0])
            hi = lo + len(live)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


# The rules of tokenizer files whose tokens span neither white space nor letters and signs.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

#: What a Python worker keeps between its tasks, per tokenizer file: the model, whether it goes word by word, ids by piece, ids by stem.
_KNOWN: dict[str, tuple] = {}


def wordwise(path: str) -> bool:
    """True if a tokenizer file has the rules WORDWISE and no added token with a blank in it."""
    import json

    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    plain = all(t["content"].split() == [t["content"]] and not (t["lstrip"] or t["rstrip"] or t["normalized"]) for t in rules.get("added_tokens") or [])
    return plain and rules["model"]["type"] == "BPE" and all(rules.get(k) == v for k, v in WORDWISE.items())


def splitter(path: str, pieces_kept: int = 300_000, stems_kept: int = 700_000):
    """UTF-8 text -> ids, as little-endian u32 bytes, of the tokenizer file at ``path``.

    With the rules WORDWISE a file lower-cases, drops white space and never lets a token
    span white space, or letters and signs.  Then the library encodes each distinct stem
    once (a blank-free piece, or its letters in lower case if signs other than the
    apostrophe end it) and the ids are joined.  With any other rules it encodes each
    text as a whole.  ``pieces_kept, stems_kept``: entries remembered before that memory
    starts anew.
    """
    import os
    import re

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    if path not in _KNOWN:
        _KNOWN[path] = (Tokenizer.from_file(path), wordwise(path), {}, {})
    model, by_word, known, stems = _KNOWN[path]
    if not by_word:
        return lambda text: np.array(model.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
    cut = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)").fullmatch

    bpe = model.model

    def stem(piece: str) -> bytes:
        found = stems.get(piece)
        if found is None:
            if len(stems) >= stems_kept:
                stems.clear()
            # ASCII letters in lower case pass the normaliser and the splitter as they are
            plain = piece.isascii() and piece.isalpha()
            own = [t.id for t in bpe.tokenize(piece)] if plain else model.encode(piece, add_special_tokens=False).ids
            found = stems[piece] = np.array(own, "<u4").tobytes()
        return found

    def ids(text: bytes) -> bytes:
        if len(known) >= pieces_kept:
            known.clear()
        pieces = text.split()
        out = list(map(known.get, pieces))
        if None in out:
            for k, found in enumerate(out):
                if found is None:
                    piece = pieces[k].decode()
                    m = cut(piece)
                    if m:
                        found = stem(m[1].lower()) + (stem(m[2]) if m[2] else b"")
                    else:
                        found = stem(piece)
                    known[pieces[k]] = out[k] = found
        return b"".join(out)

    return ids


FILES = "_part int, _seq int, n_docs long, n_ids long, payload binary"


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``docs`` (``doc_id, text``) in ascending doc_id order; returns the written table of files.

    One row per file: ``_part, _seq`` (their order is the order of the documents),
    ``n_docs, n_ids, payload``.  A null text counts as empty, so the document has the
    end id only; null doc_ids come first; rows with equal doc_id are ordered by text and
    repeated rows are encoded each.  A text longer than ``file_ids`` ids makes a longer
    file.  An empty table gives an empty one; other columns are ignored.
    """

    def files(batches):
        from pyspark import TaskContext

        encode, part, seq = splitter(tokenizer), TaskContext.get().partitionId(), 0
        end = int(end_id).to_bytes(4, "little")
        names, lengths, parts, total = [], [], [], 0
        schema = pa.schema([("_part", pa.int32()), ("_seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])

        def close():
            payload = write_file(names, lengths, np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_pydict({"_part": [part], "_seq": [seq], "n_docs": [len(names)], "n_ids": [total], "payload": [payload]}, schema)

        for batch in slices(batches):
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(t or b"") + end
                names.append(d)
                lengths.append(len(ids) // 4)
                parts.append(ids)
                total += len(ids) // 4
                if total >= file_ids:
                    yield close()
                    names, lengths, parts, total, seq = [], [], [], 0, seq + 1
        if names:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return save(rows.mapInArrow(files, FILES), "tokens")


def read(files: DataFrame) -> DataFrame:
    """What the files hold, per document: ``doc_id, start, n_tokens, ids_crc32``.

    ``start``: ids before it in all files.  The base of each file comes from the
    counts beside the payloads; only narrow rows are moved.
    """

    def documents(batches):
        import zlib

        schema = pa.schema([("_part", pa.int32()), ("_seq", pa.int32()), ("doc_id", pa.int64()), ("_at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in slices(batches):
            for part, seq, payload in zip(*(batch.column(k).to_pylist() for k in range(3))):
                file = Reader(payload)
                crcs = [zlib.crc32(file.document(k).astype("<u4").tobytes()) for k in range(len(file.doc_ids))]
                n = len(crcs)
                yield pa.RecordBatch.from_pydict({"_part": [part] * n, "_seq": [seq] * n, "doc_id": file.doc_ids, "_at": file.starts[:-1], "n_tokens": np.diff(file.starts), "ids_crc32": crcs}, schema)

    out = files.select("_part", "_seq", "payload").mapInArrow(documents, "_part int, _seq int, doc_id long, _at long, n_tokens long, ids_crc32 long")
    by_part = files.groupBy("_part").agg(F.sum("n_ids").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    by_part = by_part.select("_part", (F.sum("_sum").over(before) - F.col("_sum")).alias("_part_base"))
    within = Window.partitionBy("_part").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    bases = files.select("_part", "_seq", "n_ids").join(by_part, "_part")
    bases = bases.select("_part", "_seq", (F.col("_part_base") + F.sum("n_ids").over(within) - F.col("n_ids")).alias("_base"))
    out = out.join(bases, ["_part", "_seq"])
    return out.select("doc_id", (F.col("_base") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")
