"""A regex index over a text column: build, append, delete, compact, search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import match
from .functions.syntax import nullable, parse
from .operators import postings as P
from .operators.search import candidates
from .plans.planner import Plan, plan
from .sources import store
from .sources.corpora import text_rows
from .sources.tokenizers import from_spec

#: Directories of the postings, by token id modulo this; up to 32 are listed without a job of their own.
BUCKETS = 32


#: Below so many postings mode ``auto`` scans, unless an index is opened with another bound.
SMALL = 50_000_000
STATS = "token_id int, n_docs long, n_postings long"


class RegexIndex:
    """An index in ``path``.

    Rows come in generations, each in directories of its own; the manifest names the
    ones that count, so readers never see half a write.  Deleted ids are tombstones
    until ``compact``; ids are never used again.
    """

    def __init__(self, spark: SparkSession, path: str, small: int = SMALL):
        self.spark, self.path, self.small = spark, path, small
        self._frames: dict[tuple, DataFrame] = {}  # keeps file listings between searches
        self._frequencies: tuple | None = None
        self._load()

    def _load(self) -> None:
        self.meta = store.read_meta(self.spark, self.path)
        self.tokenizer = from_spec(self.meta["tokenizer"])

    @classmethod
    def _empty(cls, spark: SparkSession, tokenizer, path: str, overwrite: bool) -> RegexIndex:
        if store.versions(spark, path) and not overwrite:
            raise FileExistsError(f"there is an index at {path}")
        store.delete(spark, path)
        store.write_meta(spark, path, {"generations": [], "tombstones": [], "merged": [], "next": 0, "tokenizer": tokenizer.spec(), "buckets": BUCKETS, "n_postings": {}})
        return cls(spark, path)

    @classmethod
    def build(cls, df: DataFrame, tokenizer, path: str, key: str = "doc_id", text: str = "text", overwrite: bool = False) -> RegexIndex:
        """Index the rows of ``df``; an empty table makes an empty index."""
        out = cls._empty(df.sparkSession, tokenizer, path, overwrite)
        out.append(df, key, text)
        return out

    @classmethod
    def build_tokens(cls, tokens: DataFrame, tokenizer, path: str, overwrite: bool = False) -> RegexIndex:
        """Index rows ``id, tokens`` that the tokenizer has made elsewhere."""
        out = cls._empty(tokens.sparkSession, tokenizer, path, overwrite)
        name = out._name("g")
        out._write(tokens.select(F.col("id").cast("long").alias("doc_id"), "tokens").where("doc_id is not null and tokens is not null"), name)
        out._publish([], [name])
        return out

    def _name(self, logical: str) -> str:
        """A directory that no manifest has ever named."""
        self.meta["next"] += 1
        return f"{logical}-{self.meta['next']}-{uuid.uuid4().hex[:8]}"

    def _write(self, tokens: DataFrame, name: str) -> None:
        """Documents, postings and statistics of a generation; the tokens are made once and read back."""
        staged = f"{self.path}/staging/{name}"
        tokens.write.mode("overwrite").parquet(staged)
        tokens = self.spark.read.schema("doc_id long, tokens array<int>").parquet(staged)
        tokens.select("doc_id").write.mode("overwrite").parquet(f"{self.path}/docs/{name}")
        self._sorted(P.explode(tokens).withColumn("bucket", F.col("token_id") % BUCKETS), name)
        store.delete(self.spark, staged)

    def _sorted(self, rows: DataFrame, name: str) -> None:
        """Write postings by bucket, token, document and position, and their statistics."""
        P.sort_postings(rows).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/{name}")
        P.statistics(self._postings([name])).write.mode("overwrite").parquet(f"{self.path}/stats/{name}")
        total = self._read("stats", STATS, [name]).agg(F.coalesce(F.sum("n_postings"), F.lit(0))).first()[0]
        self.meta["n_postings"][name] = int(total)

    def _publish(self, gone: list[str], new: list[str], tombstones: list[str] | None = None) -> None:
        """A manifest with some generations replaced; only then are directories deleted."""
        graves = [] if tombstones is None else [t for t in self.meta["tombstones"] if t not in tombstones]
        self.meta["generations"] = [g for g in self.meta["generations"] if g not in gone] + new
        self.meta["n_postings"] = {g: n for g, n in self.meta["n_postings"].items() if g in self.meta["generations"]}
        if tombstones is not None:
            self.meta["tombstones"] = tombstones
        self.meta = store.write_meta(self.spark, self.path, self.meta)
        self._frames, self._frequencies = {}, None
        for kind, names in (("postings", gone), ("docs", gone), ("stats", gone), ("tombstones", graves)):
            for name in names:
                store.delete(self.spark, f"{self.path}/{kind}/{name}")

    def append(self, df: DataFrame, key: str = "doc_id", text: str = "text", name: str | None = None) -> str:
        """Add rows as a generation; returns its name.

        The same ``name`` again replaces the generation, so a batch can be repeated;
        one that ``compact`` has merged already is left alone.
        """
        self._load()
        if name is not None and name in self.meta["merged"]:
            return name
        old = [g for g in self.meta["generations"] if name is not None and g.rsplit("-", 2)[0] == name]
        own = self._name(name or "g")
        rows = text_rows(df, key, text)
        cores = self.spark.sparkContext.defaultParallelism
        if not df.isStreaming and rows.rdd.getNumPartitions() < cores:
            rows = rows.repartition(2 * cores)
        self._write(self.tokenizer.tokenize(rows, special=True), own)
        self._publish(old, [own])
        return own

    def delete(self, ids: DataFrame, key: str = "doc_id") -> None:
        """Hide documents."""
        self._load()
        name = self._name("t")
        ids.select(F.col(key).cast("long").alias("doc_id")).where("doc_id is not null").distinct().write.mode("overwrite").parquet(f"{self.path}/tombstones/{name}")
        self._publish([], [], [*self.meta["tombstones"], name])

    def compact(self) -> None:
        """Rewrite all generations as one, without the deleted documents."""
        self._load()
        old, name = list(self.meta["generations"]), self._name("c")
        self.documents().write.mode("overwrite").parquet(f"{self.path}/docs/{name}")
        self._sorted(self.postings(), name)
        self.meta["merged"] = sorted({*self.meta["merged"], *(g.rsplit("-", 2)[0] for g in old if not g.startswith(("g-", "c-")))})
        self._publish(old, [name], [])

    def drop(self) -> None:
        store.delete(self.spark, self.path)

    def size(self) -> int:
        """Bytes on disk."""
        return store.size(self.spark, self.path)

    def _read(self, kind: str, schema: str, names: list[str]) -> DataFrame:
        paths = [f"{self.path}/{kind}/{g}" for g in names]
        if not paths:
            return self.spark.createDataFrame([], schema)
        out = None
        for p in paths:
            own = self._frames.get((p, schema))
            if own is None:
                own = self._frames[p, schema] = self.spark.read.schema(schema).parquet(p)
            out = own if out is None else out.unionByName(own)
        return out

    def _postings(self, names: list[str]) -> DataFrame:
        return self._read("postings", P.POSTINGS + ", bucket int", names)

    def _live(self, df: DataFrame) -> DataFrame:
        if not self.meta["tombstones"]:
            return df
        return df.join(self._read("tombstones", "doc_id long", self.meta["tombstones"]), "doc_id", "left_anti")

    def postings(self) -> DataFrame:
        """All live postings."""
        return self._live(self._postings(self.meta["generations"])).select("token_id", "doc_id", "pos", "next_tok", "bucket")

    def documents(self) -> DataFrame:
        """``doc_id`` of all live documents."""
        return self._live(self._read("docs", "doc_id long", self.meta["generations"])).distinct()

    def statistics(self) -> DataFrame:
        """Documents and postings per token; deleted ones count until ``compact``."""
        return self._read("stats", STATS, self.meta["generations"]).groupBy("token_id").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_postings").alias("n_postings"))

    def plan(self, pattern: str, mode: str = "auto", recheck: bool | None = None) -> Plan:
        """How ``search`` would go; the vocabulary bounds what is read from the statistics."""
        frequencies = None
        if mode == "auto":
            if sum(self.meta["n_postings"].values()) < self.small and not nullable(parse(pattern)):
                return Plan(pattern, "scan", False, why=f"fewer than {self.small} postings: a scan ends before the index's jobs have begun")
            names = tuple(self.meta["generations"])
            if self._frequencies is None or self._frequencies[0] != names:
                self._frequencies = (names, {r.token_id: r.n_postings for r in self.statistics().collect()})
            frequencies = self._frequencies[1]
        return plan(pattern, self.tokenizer.vocabulary(), self.tokenizer.mapping, frequencies, mode, recheck)

    def candidates(self, pattern: str) -> tuple[DataFrame, bool]:
        """Candidate ``doc_id``s from the index alone, and whether they need a recheck."""
        found = self.plan(pattern, "index")
        if found.mode != "index":
            return self.documents(), found.mode == "scan"
        return self._live(candidates(self._postings(self.meta["generations"]), found.steps, self.meta["buckets"])), found.needs_recheck

    def search(self, df: DataFrame, pattern: str | None, key: str = "doc_id", text: str = "text", mode: str = "auto", recheck: bool | None = None) -> DataFrame:
        """The rows of ``df``, the indexed table, whose text holds a match and that are not deleted."""
        if pattern is None:
            return df.where(F.lit(False))
        found = self.plan(pattern, mode, recheck)
        if found.mode in ("all", "scan"):
            out = df.where(match(F.col(text), pattern))
            if not self.meta["tombstones"]:
                return out
            gone = self._read("tombstones", "doc_id long", self.meta["tombstones"]).select(F.col("doc_id").alias("_rx_doc"))
            return out.join(gone, F.col(key) == F.col("_rx_doc"), "left_anti")
        ids = self._live(candidates(self._postings(self.meta["generations"]), found.steps, self.meta["buckets"]))
        out = self._keep(df, ids, key)
        return out.where(match(F.col(text), pattern)) if found.needs_recheck else out

    @staticmethod
    def _keep(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
        return df.join(ids.select(F.col("doc_id").alias("_rx_doc")), F.col(key) == F.col("_rx_doc"), "left_semi")


def regex_search(df: DataFrame, text: str, pattern: str | None) -> DataFrame:
    """The rows of ``df`` whose ``text`` holds a match of ``pattern``, by scan."""
    return df.where(match(F.col(text), pattern)) if pattern is not None else df.where(F.lit(False))


def check(pattern: str):
    """The syntax tree, or :class:`~rexicon.functions.UnsupportedPattern`."""
    return parse(pattern)
