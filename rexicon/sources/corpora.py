"""Where rows come from and where results go."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOKENS = "id long, tokens array<int>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text`` of the rows that an index can hold: null keys and texts are left out."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")


def unpack(data: bytes) -> list:
    """The values of a msgpack stream (nil, bool, numbers, strings, binaries, arrays, maps)."""
    at, out = 0, []

    def number(form: str):
        nonlocal at
        n = struct.calcsize(form)
        if at + n > len(data):
            raise ValueError("msgpack stream ends inside a value")
        found = struct.unpack_from(form, data, at)[0]
        at += n
        return found

    def raw(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("msgpack stream ends inside a value")
        at += n
        return data[at - n : at]

    sized = {0xC4: ("B", bytes), 0xC5: (">H", bytes), 0xC6: (">I", bytes), 0xD9: ("B", str), 0xDA: (">H", str), 0xDB: (">I", str), 0xDC: (">H", list), 0xDD: (">I", list), 0xDE: (">H", dict), 0xDF: (">I", dict)}
    plain = {0xCA: ">f", 0xCB: ">d", 0xCC: "B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: "b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}

    def value():
        tag = number("B")
        if tag < 0x80 or tag >= 0xE0:
            return tag if tag < 0x80 else tag - 256
        if tag in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[tag]
        if tag in plain:
            return number(plain[tag])
        if tag in sized:
            form, kind = sized[tag]
            n = number(form)
        elif tag < 0xC0:
            kind, n = (dict, tag & 15) if tag < 0x90 else (list, tag & 15) if tag < 0xA0 else (str, tag & 31)
        else:
            raise ValueError(f"unsupported msgpack type {tag:#x}")
        if kind is list:
            return [value() for _ in range(n)]
        if kind is dict:
            return {value(): value() for _ in range(n)}
        return raw(n).decode() if kind is str else raw(n)

    while at < len(data):
        out.append(value())
    return out


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``id, tokens`` of msgpack files of maps ``{"id": n, "tokens": [..]}``; of equal ids the last counts."""

    def rows(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = [(m["id"], m["tokens"]) for m in unpack(content)]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int32())), pa.array([name] * len(found)), pa.array(range(len(found)), pa.int64())], names=["id", "tokens", "_file", "_at"])

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, TOKENS + ", _file string, _at long")
    last = Window.partitionBy("id").orderBy(F.col("_file").desc(), F.col("_at").desc())
    return found.withColumn("_n", F.row_number().over(last)).where("_n = 1").select("id", "tokens")


def token_stats(tokens: DataFrame) -> DataFrame:
    """Longest list, largest id and number of lists."""
    return tokens.agg(F.max(F.size("tokens")).alias("max_tokens"), F.max("id").alias("max_id"), F.count(F.lit(1)).alias("n_rows"))


def write_ids(result: DataFrame, path: str) -> None:
    """One id per line."""
    result.select(F.col("doc_id").cast("string")).write.mode("overwrite").text(path)
