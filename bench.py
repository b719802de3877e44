"""Headline queries, timed; prints one JSON line."""

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])


def main() -> None:
    from pyspark.sql import SparkSession

    from rexicon import catalogue
    from rexicon.sources.corpora import table

    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, make, runs: int = 2) -> None:
        best = None
        for _ in range(runs):
            began = time.time()
            make().write.format("noop").mode("overwrite").save()
            took = time.time() - began
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)

    docs = table(spark, directory, "documents")
    timed("warm_up", lambda: docs)
    del seconds["warm_up"]
    found = catalogue.queries()
    for name in ("regex_literal", "regex_class", "regex_bounded", "regex_unicode_prop", "regex_anchor_start", "regex_word_boundary", "match_count_by_lang"):
        timed(name, lambda name=name: found[name](spark, directory))
    began = time.time()
    index = catalogue.document_index(spark, directory)
    seconds["index_build"] = round(time.time() - began, 3)
    for name, pattern in (("rare", "TT"), ("literal", "tion"), ("class", "th[aeiou]n?t"), ("accent", "ón")):
        timed(f"index_{name}", lambda pattern=pattern: index.search(docs, pattern, mode="index").select("doc_id"))
        timed(f"auto_{name}", lambda pattern=pattern: index.search(docs, pattern).select("doc_id"))
        timed(f"scan_{name}", lambda pattern=pattern: index.search(docs, pattern, mode="scan").select("doc_id"))
    total = round(sum(v for k, v in seconds.items() if k != "index_build"), 3)
    print(json.dumps({"metric": "regex search, total of the best runs", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(directory.rstrip("/")), "index_bytes": index.size()}))
    spark.stop()


if __name__ == "__main__":
    main()
