"""The registered queries of the regex engine and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import match, normalize, render, unnormalize
from .index import RegexIndex, regex_search
from .operators import postings as P
from .plans import automaton, steps
from .sources import store
from .sources.corpora import table, text_rows, write_ids
from .sources.tokenizers import BpeTokenizer, ByteTokenizer

#: Scans over documents: name -> pattern.
SCANS = {
    "regex_literal": "tion",
    "regex_escaped_meta": r"[ou]\.",
    "regex_class": "th[aeiou]n?t",
    "regex_negated_class_newline": "n[^a-z]T",
    "regex_alternation_group": "(ement|achl|iud|erth)(?:en|the)",
    "regex_named_lazy": "t(?<vowels>[aeiou]+?)n(?<rest>th|ed)??",
    "regex_optional_star_plus": "an?th*er+",
    "regex_bounded": "(?:an|th){2,3}",
    "regex_digits_bounded": r"\d{3}",
    "regex_dot_newline": "a.T",
    "regex_digit_word_space": r"\d[\s]\w",
    "regex_negated_sets": r"\D\S\W\S",
    "regex_unicode_prop": r"\p{Lu}\p{Ll}{5}",
    "regex_negated_prop": r"\P{L}{3}",
    "regex_prop_value": r"\p{gc=Nd}\p{Script=Latin}",
    "regex_multibyte_range": "[à-ÿ]{2}",
    "regex_anchor_start": "^The",
    "regex_anchor_end": r"\.$",
    "regex_anchor_both": r"^[A-Z].*[a-z]\.$",
    "regex_word_boundary": r"\band\b",
    "regex_not_boundary": r"\Band\B",
    "regex_class_literals": "[[&]|[|]",
    "regex_match_all": ".*",
    "regex_no_match": "國家",
    "regex_empty_set": r"a[^\s\S]",
    "regex_lower_bound_wins": "(?:th){2,1}e",
}
#: Scans over other tables: name -> (table, key, column, pattern).
OTHER_SCANS = {
    "regex_pages_html": ("pages", ["page_id"], "html", "<h[1-6]>"),
    "regex_conversations": ("conversations", ["conv_id", "turn"], "text", r"[aeiou]{3}\."),
    "regex_part_name": ("part", ["p_partkey"], "p_name", r"\w+[ ]\w*e\w*"),
}
#: Searches through the index: name -> pattern; the last one is cyclic.
INDEXED = {
    "index_search_literal": "tion",
    "index_search_class": "th[aeiou]n?t",
    "index_search_accent": "ón",
    "index_search_rare": "TT",
    "index_search_bounded": r"(?:an|th){2}e",
    "index_search_anchored": "^The",
    "index_search_cyclic": "tz[a-z]*ung",
}


def _scan(pattern: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return regex_search(table(spark, sf_dir, "documents"), "text", pattern).select("doc_id")


def _other(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    source, keys, column, pattern = OTHER_SCANS[name]
    return regex_search(table(spark, sf_dir, source), column, pattern).select(*keys)


def tokenizer():
    """The tokenizer of the index queries: a public byte-level BPE file if it is installed, else bytes."""
    try:
        import public_tokenizers
    except ImportError:
        return ByteTokenizer()
    return BpeTokenizer(public_tokenizers.path("byte_bpe_50k.json"))


_BUILT: dict[tuple, RegexIndex] = {}


def document_index(spark: SparkSession, sf_dir: str) -> RegexIndex:
    """The index of ``documents``, built once per session and directory."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BUILT:
        path = f"{store.shared_dir(spark)}/index-{abs(hash(key)):x}"
        _BUILT[key] = RegexIndex.build(table(spark, sf_dir, "documents"), tokenizer(), path, overwrite=True)
    return _BUILT[key]


def _indexed(pattern: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return document_index(spark, sf_dir).search(docs, pattern, mode="index").select("doc_id")


def _null_pattern(spark, sf_dir):
    return regex_search(table(spark, sf_dir, "documents"), "text", None).select("doc_id")


def _count_by_lang(spark, sf_dir):
    hits = regex_search(table(spark, sf_dir, "documents"), "text", "th[aeiou]n?t")
    return hits.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"))


def _count_all(spark, sf_dir):
    return regex_search(table(spark, sf_dir, "documents"), "text", r"\d{3}").agg(F.count(F.lit(1)).alias("n_docs"))


def _ids_array(spark, sf_dir):
    """Ids as text, per language: what ``array_agg(... ORDER BY ...)`` and ``array_length`` give."""
    hits = regex_search(table(spark, sf_dir, "documents"), "text", r"\d{3}")
    ids = F.sort_array(F.collect_list("doc_id"))
    return hits.groupBy("lang").agg(F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"), F.size(ids).cast("long").alias("n_ids"))


def _normalize(spark, sf_dir):
    mapping = {".": "x", "/": "Z", "\\": "X", "`": "C"}
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(normalize(F.col("text"), mapping)).alias("digest"))


def _bytes(spark, sf_dir):
    return P.explode(ByteTokenizer().tokenize(text_rows(table(spark, sf_dir, "part"), "p_partkey", "p_name")))


def _postings(spark, sf_dir):
    return _bytes(spark, sf_dir).select("doc_id", "pos", "token_id")


def _postings_next(spark, sf_dir):
    return _bytes(spark, sf_dir).select("doc_id", "pos", "next_tok")


def _posting_stats(spark, sf_dir):
    return P.statistics(_bytes(spark, sf_dir))


def _token(spark, sf_dir, char: str) -> DataFrame:
    return _bytes(spark, sf_dir).where(F.col("token_id") == ord(char) + 2)


def _followed_by(spark, sf_dir):
    return P.followed_by(_token(spark, sf_dir, "a"), _token(spark, sf_dir, "n")).select("doc_id", "pos")


def _merged(spark, sf_dir):
    own = [_token(spark, sf_dir, c).select("doc_id", "pos") for c in "aen"]
    return P.merge_lists(*own, own[0])


def _sentence_ids(spark, sf_dir):
    return P.sentence_ids(_token(spark, sf_dir, "k").select("doc_id", "pos"))


def _index_vs_scan(spark, sf_dir):
    """Rows that index and scan do not share, both ways: none."""
    docs, out = table(spark, sf_dir, "documents"), None
    for pattern in ("th[aeiou]n?t", r"\d{3}"):
        scan, found = regex_search(docs, "text", pattern).select("doc_id"), _indexed(pattern, spark, sf_dir)
        own = scan.subtract(found).unionByName(found.subtract(scan))
        out = own if out is None else out.unionByName(own)
    return out


def _fresh(spark: SparkSession, sf_dir: str, name: str, rows: DataFrame) -> RegexIndex:
    return RegexIndex.build(rows, ByteTokenizer(), f"{store.shared_dir(spark)}/{name}-{abs(hash(sf_dir)):x}", "p_partkey", "p_name", overwrite=True)


def _maintained(spark, sf_dir, name: str, compact: bool) -> DataFrame:
    part = table(spark, sf_dir, "part")
    half = part.agg(F.avg("p_partkey")).first()[0]
    index = _fresh(spark, sf_dir, name, part.where(F.col("p_partkey") <= half))
    index.append(part.where(F.col("p_partkey") > half), "p_partkey", "p_name")
    index.delete(part.where(F.col("p_partkey") % 7 == 0), "p_partkey")
    if compact:
        index.compact()
    return index.search(part, "an[a-z]", "p_partkey", "p_name", mode="index").select("p_partkey")


def _compact_twice(spark, sf_dir):
    """Compaction between appends and deletions, again and again."""
    part = table(spark, sf_dir, "part")
    third = lambda k: part.where(F.col("p_partkey") % 3 == k)
    index = _fresh(spark, sf_dir, "twice", third(0))
    index.append(third(1), "p_partkey", "p_name")
    index.compact()
    index.compact()
    index.delete(part.where(F.col("p_partkey") % 7 == 0), "p_partkey")
    index.append(third(2).where(F.col("p_partkey") % 7 != 0), "p_partkey", "p_name")
    index.compact()
    return index.search(part, "an[a-z]", "p_partkey", "p_name", mode="index").select("p_partkey")


def _from_tokens(spark, sf_dir):
    """An index of rows that come as tokens."""
    part, made = table(spark, sf_dir, "part"), ByteTokenizer()
    tokens = made.tokenize(text_rows(part, "p_partkey", "p_name"), special=True).withColumnRenamed("doc_id", "id")
    index = RegexIndex.build_tokens(tokens, made, f"{store.shared_dir(spark)}/tokens-{abs(hash(sf_dir)):x}", overwrite=True)
    return index.search(part, "an[a-z]", "p_partkey", "p_name", mode="index").select("p_partkey")


def _auto_index(spark, sf_dir):
    """Mode ``auto`` with an index that is never too small to be worth its jobs: the cost rule takes it."""
    index = RegexIndex(spark, document_index(spark, sf_dir).path, small=0)
    plan = index.plan("TT")
    if plan.mode != "index":
        raise AssertionError(plan.explain())
    return index.search(table(spark, sf_dir, "documents"), "TT").select("doc_id")


def _written_ids(spark, sf_dir):
    """Ids written one per line, and read back."""
    path = f"{store.shared_dir(spark)}/ids-{abs(hash(sf_dir)):x}"
    write_ids(_scan(r"\d{3}", spark, sf_dir), path)
    return spark.read.text(path).select(F.col("value").cast("long").alias("doc_id"))


def _sorted_postings(spark, sf_dir):
    """Global order of the postings: how many stand out of order within their task's rows, and all."""
    rows = P.sort_postings(_bytes(spark, sf_dir)).withColumn("_no", F.monotonically_increasing_id())
    by = Window.partitionBy(F.spark_partition_id()).orderBy("_no")
    key = F.struct("token_id", "doc_id", "pos")
    rows = rows.withColumn("_bad", F.coalesce(F.lag(key).over(by) >= key, F.lit(False)))
    return rows.agg(F.count_if("_bad").alias("n_wrong"), F.count(F.lit(1)).alias("n_rows"))


def _unnormalized(spark, sf_dir):
    mapping = {".": "x", "/": "Z", "\\": "X", "`": "C"}
    back = unnormalize(normalize(F.col("text"), mapping), mapping)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(back).alias("digest"))


def _token_statistics(spark, sf_dir):
    """Statistics of the stored index: its postings are one per token and two marks per document."""
    from .sources.corpora import token_stats

    rows = ByteTokenizer().tokenize(text_rows(table(spark, sf_dir, "part"), "p_partkey", "p_name"))
    return token_stats(rows.select(F.col("doc_id").alias("id"), "tokens"))


def _stream(spark, sf_dir):
    """Rows that arrive as a stream, indexed batch by batch, then searched."""
    import uuid

    from .streaming import append_stream

    part = table(spark, sf_dir, "part")
    index = _fresh(spark, sf_dir, "streamed", part.where(F.lit(False)))
    base = f"{store.shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    part.select("p_partkey", "p_name").repartition(3).write.parquet(f"{base}/in")
    rows = spark.readStream.schema(part.select("p_partkey", "p_name").schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    append_stream(rows, index, f"{base}/checkpoint", "p_partkey", "p_name").awaitTermination()
    index = RegexIndex(spark, index.path)
    return index.search(part, "an[a-z]", "p_partkey", "p_name", mode="index").select("p_partkey")


def _dfa_table(spark, sf_dir):
    return spark.createDataFrame(automaton.compile_dfa("th[aeiou]n?t").edges(), "state int, lo int, hi int, target int")


def _step_table(spark, sf_dir):
    found = steps.build(automaton.compile_dfa("th[aeiou]n?t"), ByteTokenizer().vocabulary())
    rows = [(-1, t, to) for t, to in found.start] + [(s, t, to) for s, own in found.step.items() for t, to in own]
    return spark.createDataFrame(rows, "state int, token_id int, next_state int")


def _index_files(spark, sf_dir):
    """Postings and documents that the stored index holds."""
    index = document_index(spark, sf_dir)
    return index.documents().agg(F.count(F.lit(1)).alias("n_docs"))


def _full_match(spark, sf_dir):
    from .functions import full_match

    return table(spark, sf_dir, "customer").where(full_match(F.col("c_name"), r"Customer#\d+[05]")).select("c_custkey")


def _sql_function(spark, sf_dir):
    from .functions import install

    install(spark)
    table(spark, sf_dir, "part").createOrReplaceTempView("rexicon_part")
    return spark.sql("SELECT p_partkey FROM rexicon_part WHERE regex_search(p_name, 'an[a-z]')")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: partial(_scan, pattern) for name, pattern in SCANS.items()}
    out |= {name: partial(_other, name) for name in OTHER_SCANS}
    out |= {name: partial(_indexed, pattern) for name, pattern in INDEXED.items()}
    return out | {
        "regex_null_pattern": _null_pattern,
        "regex_full_match": _full_match,
        "regex_sql_function": _sql_function,
        "match_count": _count_all,
        "match_count_by_lang": _count_by_lang,
        "matched_ids_array": _ids_array,
        "normalize_map": _normalize,
        "postings": _postings,
        "postings_next_tok": _postings_next,
        "posting_list_stats": _posting_stats,
        "followed_by": _followed_by,
        "merge_sorted_lists": _merged,
        "sentence_ids": _sentence_ids,
        "index_documents": _index_files,
        "index_vs_scan_diff": _index_vs_scan,
        "pending_and_tombstones": partial(_maintained, name="maintained", compact=False),
        "compact_equivalence": partial(_maintained, name="compacted", compact=True),
        "compact_twice": _compact_twice,
        "index_from_tokens": _from_tokens,
        "auto_index_rare": _auto_index,
        "written_ids": _written_ids,
        "sorted_postings": _sorted_postings,
        "unnormalize_map": _unnormalized,
        "token_file_stats": _token_statistics,
        "stream_append_search": _stream,
        "dfa_table": _dfa_table,
        "step_table": _step_table,
    }


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _where(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_quoted(render.re2(pattern))})"


#: Byte postings of part names, for the SQL of the posting operators.
_BYTES = """WITH h AS (SELECT p_partkey AS doc_id, hex(encode(p_name)) AS h FROM part WHERE p_name IS NOT NULL),
e AS (SELECT doc_id, h, unnest(range(length(h) // 2)) AS pos FROM h),
t AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos,
 CAST((instr('0123456789ABCDEF', substr(h, 2 * pos + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2 * pos + 2, 1)) + 1 AS INTEGER) AS token_id FROM e)
"""


def oracle_sql() -> dict[str, str]:
    out = {name: f"SELECT doc_id FROM documents WHERE {_where('text', p)}" for name, p in (SCANS | INDEXED).items()}
    out |= {name: f"SELECT {', '.join(keys)} FROM {source} WHERE {_where(column, p)}" for name, (source, keys, column, p) in OTHER_SCANS.items()}
    part = f"SELECT p_partkey FROM part WHERE {_where('p_name', 'an[a-z]')}"
    digits = _where("text", r"\d{3}")
    return out | {
        "regex_null_pattern": "SELECT doc_id FROM documents WHERE false",
        "regex_full_match": r"SELECT c_custkey FROM customer WHERE regexp_full_match(c_name, 'Customer#[0-9]+[05]')",
        "regex_sql_function": part,
        "match_count": f"SELECT count(*) AS n_docs FROM documents WHERE {digits}",
        "match_count_by_lang": f"SELECT lang, count(*) AS n_docs FROM documents WHERE {_where('text', 'th[aeiou]n?t')} GROUP BY lang",
        "matched_ids_array": f"SELECT lang, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids, count(*) AS n_ids FROM documents WHERE {digits} GROUP BY lang",
        "normalize_map": "SELECT doc_id, md5(translate(text, './\\`', 'xZXC')) AS digest FROM documents",
        "postings": _BYTES + "SELECT doc_id, pos, token_id FROM t",
        "postings_next_tok": _BYTES + "SELECT doc_id, pos, coalesce(lead(token_id) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS next_tok FROM t",
        "posting_list_stats": _BYTES + "SELECT token_id, count(DISTINCT doc_id) AS n_docs, count(*) AS n_postings FROM t GROUP BY token_id",
        "followed_by": _BYTES + "SELECT doc_id, pos FROM t a WHERE token_id = 99 AND EXISTS (SELECT 1 FROM t b WHERE b.token_id = 112 AND b.doc_id = a.doc_id AND b.pos = a.pos + 1)",
        "merge_sorted_lists": _BYTES + "SELECT DISTINCT doc_id, pos FROM t WHERE token_id IN (99, 103, 112)",
        "sentence_ids": _BYTES + "SELECT DISTINCT doc_id FROM t WHERE token_id = 109",
        "index_documents": "SELECT count(*) AS n_docs FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL",
        "index_vs_scan_diff": "SELECT doc_id FROM documents WHERE false",
        "pending_and_tombstones": part + " AND p_partkey % 7 <> 0",
        "compact_equivalence": part + " AND p_partkey % 7 <> 0",
        "compact_twice": part + " AND p_partkey % 7 <> 0",
        "index_from_tokens": part,
        "auto_index_rare": f"SELECT doc_id FROM documents WHERE {_where('text', 'TT')}",
        "written_ids": f"SELECT doc_id FROM documents WHERE {digits}",
        "sorted_postings": _BYTES + "SELECT 0 AS n_wrong, count(*) AS n_rows FROM t",
        "unnormalize_map": "SELECT doc_id, md5(translate(translate(text, './\\`', 'xZXC'), 'xZXC', './\\`')) AS digest FROM documents",
        "token_file_stats": "SELECT CAST(max(length(hex(encode(p_name))) // 2) AS INTEGER) AS max_tokens, CAST(max(p_partkey) AS BIGINT) AS max_id, count(*) AS n_rows FROM part WHERE p_name IS NOT NULL",
        "stream_append_search": part,
    }


__all__ = ["match", "oracle_sql", "queries"]
