"""Tokenizers whose tokens' bytes, joined, are the text's bytes."""

from __future__ import annotations

import heapq
import json
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import check_mapping


def byte_alphabet() -> dict[int, str]:
    """The usual printable stand-ins of bytes: printable Latin-1 stays, the others follow from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(0x100 + n) for n, b in enumerate(rest)}


_TO = byte_alphabet()
_FROM = {c: b for b, c in _TO.items()}


def to_unicode(data: bytes) -> str:
    return "".join(map(_TO.__getitem__, data))


def to_bytes(text: str) -> bytes:
    """Inverse of :func:`to_unicode`; characters outside the alphabet are an error."""
    try:
        return bytes(map(_FROM.__getitem__, text))
    except KeyError as e:
        raise ValueError(f"{e.args[0]!r} stands for no byte") from None


class ByteTokenizer:
    """Ids 2..257 for bytes 0..255, 0 and 1 for start and end; needs no file and no Python at run time."""

    bos, eos = 0, 1

    def __init__(self, mapping: dict | None = None):
        self.mapping = check_mapping(mapping or {})

    def spec(self) -> dict:
        return {"kind": "byte", "mapping": self.mapping}

    def vocabulary(self) -> dict[int, bytes]:
        return {b + 2: bytes([b]) for b in range(256)}

    def vocab_size(self) -> int:
        return 258

    def max_token_bytes(self) -> int:
        return 1

    def tokenize(self, rows: DataFrame, special: bool = False) -> DataFrame:
        """``doc_id, text`` -> ``doc_id, tokens``."""
        text = F.translate("text", "".join(self.mapping), "".join(self.mapping.values())) if self.mapping else F.col("text")
        coded = rows.select("doc_id", F.hex(F.encode(text, "UTF-8")).alias("_h"))
        n = (F.length("_h") / 2).cast("int")
        ids = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substr("_h", i * 2 + 1, F.lit(2)), 16, 10).cast("int") + 2)).otherwise(F.array().cast("array<int>"))
        return coded.select("doc_id", (F.concat(F.array(F.lit(self.bos)), ids, F.array(F.lit(self.eos))) if special else ids).alias("tokens"))


class BpeTokenizer:
    """A byte-level BPE file in the usual JSON; each line of a text is encoded as a whole, without a splitter."""

    def __init__(self, path: str, mapping: dict | None = None, bos: int | None = None, eos: int | None = None):
        if not os.path.exists(path):
            raise FileNotFoundError(f"tokenizer file {path} does not exist")
        with open(path, encoding="utf-8") as f:
            self.model = json.load(f)
        self.path, self.mapping = path, check_mapping(mapping or {})
        self._vocabulary: dict[int, bytes] = {}
        self.special = {t["id"] for t in self.model.get("added_tokens") or []}
        by_name = {t["content"]: t["id"] for t in self.model.get("added_tokens") or []}
        self.bos = bos if bos is not None else by_name.get("<s>")
        self.eos = eos if eos is not None else by_name.get("</s>")

    def spec(self) -> dict:
        return {"kind": "bpe", "path": self.path, "mapping": self.mapping, "bos": self.bos, "eos": self.eos}

    def vocabulary(self) -> dict[int, bytes]:
        if not self._vocabulary:
            self._vocabulary.update((i, to_bytes(t)) for t, i in self.model["model"]["vocab"].items() if i not in self.special)
        return self._vocabulary

    def vocab_size(self) -> int:
        return len(set(self.model["model"]["vocab"].values()) | self.special)

    def max_token_bytes(self) -> int:
        return max(map(len, self.vocabulary().values()), default=0)

    def encoder(self):
        """str -> list of ids, from the library if it is there."""
        own = {k: v for k, v in self.model.items() if k not in ("post_processor", "truncation", "padding")} | {"pre_tokenizer": None, "normalizer": None, "added_tokens": []}
        try:
            from tokenizers import Tokenizer
        except ImportError:
            return merger(self.model["model"])
        made = Tokenizer.from_str(json.dumps(own | {"post_processor": None, "truncation": None, "padding": None}))
        return lambda text: made.encode(text, add_special_tokens=False).ids

    def encode(self, text: str, special: bool = False, encoder=None) -> list[int]:
        encoder = encoder or self.encoder()
        text = text.translate(str.maketrans(self.mapping)) if self.mapping else text
        out = [self.bos] if special and self.bos is not None else []
        for line in text.splitlines(keepends=True):
            out += encoder(to_unicode(line.encode()))
        return out + ([self.eos] if special and self.eos is not None else [])

    def tokenize(self, rows: DataFrame, special: bool = False) -> DataFrame:
        """``doc_id, text`` -> ``doc_id, tokens``; an Arrow UDF, as merging is a loop over each text."""
        sent = rows.sparkSession.sparkContext.broadcast(self)

        def encoded(batches):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            encoder = sent.value.encoder()
            for batch in batches:
                tokens = [sent.value.encode(t, special, encoder) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.int32()))], names=["doc_id", "tokens"])

        return rows.select("doc_id", "text").mapInArrow(encoded, "doc_id long, tokens array<int>")


def merger(model: dict):
    """Byte-pair merging in Python: the best-ranked neighbours join first, from the left."""
    vocab = model["vocab"]
    ranks = {tuple(m.split(" ") if isinstance(m, str) else m): r for r, m in enumerate(model["merges"])}

    def encode(text: str) -> list[int]:
        piece, n = list(text), len(text)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap = [(ranks[p], k, *p) for k in range(n - 1) if (p := (piece[k], piece[k + 1])) in ranks]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if gone[k] or j >= n or piece[k] != a or piece[j] != b:
                continue
            piece[k], gone[j], after[k] = a + b, True, after[j]
            if after[k] < n:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (piece[x], piece[y]) in ranks:
                    heapq.heappush(heap, (ranks[piece[x], piece[y]], x, piece[x], piece[y]))
        return [vocab[piece[k]] for k in range(n) if not gone[k]]

    return encode


def from_spec(spec: dict):
    if spec["kind"] == "byte":
        return ByteTokenizer(spec["mapping"])
    return BpeTokenizer(spec["path"], spec["mapping"], spec["bos"], spec["eos"])
