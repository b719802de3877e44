"""Small files beside the index, on any store that Spark reads."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession

META, FORMAT = "_index_meta", 2


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _fs(spark, path)
    fs.delete(at, True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes under a path."""
    at, fs = _fs(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the manifests at a path, in order."""
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n.rpartition(".")[2]) for n in names if n.startswith(META + ".") and n.rpartition(".")[2].isdigit())


def read_meta(spark: SparkSession, path: str) -> dict:
    """The newest manifest of an index; raises if there is none or it is of another format."""
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no index at {path}")
    at, fs = _fs(spark, f"{path}/{META}.{found[-1]}")
    stream = fs.open(at)
    try:
        found = json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()
    if found.get("format") != FORMAT:
        raise ValueError(f"index format {found.get('format')} is not {FORMAT}")
    missing = {"generations", "tombstones", "tokenizer", "buckets", "n_postings", "merged", "next", "version"} - found.keys()
    if missing:
        raise ValueError(f"the manifest at {path} lacks {', '.join(sorted(missing))}")
    return found


def write_meta(spark: SparkSession, path: str, meta: dict) -> dict:
    """Publish the manifest that follows ``meta``: written aside, then renamed to a number of its own.

    Readers take the highest number, so they see the old manifest or the new one.  A
    number that is taken already means that another writer was faster: an error, and
    nothing is lost.  The manifest before stays for readers that have just listed it.
    """
    new = meta | {"format": FORMAT, "version": meta.get("version", 0) + 1}
    at, fs = _fs(spark, f"{path}/{META}.{new['version']}")
    aside, _ = _fs(spark, f"{path}/.{META}-{uuid.uuid4().hex}")
    stream = fs.create(aside, False)
    stream.write(bytearray(json.dumps(new).encode()))
    stream.close()
    if fs.exists(at) or not fs.rename(aside, at):
        fs.delete(aside, False)
        raise OSError(f"the index at {path} was changed by another writer")
    for old in versions(spark, path):
        if old < new["version"] - 1:
            delete(spark, f"{path}/{META}.{old}")
    return new


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); on one machine without it, a temporary one."""
    for key in ("spark.checkpoint.dir", "spark.rexicon.index.dir"):
        found = spark.conf.get(key, None)
        if found:
            return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="rexicon-index-")
    spark.conf.set("spark.rexicon.index.dir", own)
    return own
