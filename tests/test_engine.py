"""Renderings, tokenizers, postings, the index's life, and the registered queries against DuckDB."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from rexicon import catalogue
from rexicon.functions import full_match, match, render
from rexicon.index import RegexIndex, regex_search
from rexicon.operators import postings as P
from rexicon.sources import corpora, store, tokenizers
from rexicon.streaming import append_stream
from tests.test_language import TRUTH

SF = "/root/testdata/sf0.001"


def test_rlike_and_re2_agree_with_the_truth_table(spark):
    con = duckdb.connect()
    texts = sorted({t for _, yes, no in TRUTH for t in yes + no})
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", *[full_match(F.col("t"), p).alias(f"p{k}") for k, (p, _, _) in enumerate(TRUTH)]).collect()
    for k, (pattern, yes, no) in enumerate(TRUTH):
        got = {r.t: r[f"p{k}"] for r in rows}
        for text, expected in [(t, True) for t in yes] + [(t, False) for t in no]:
            assert got[text] == expected, (pattern, text)
            assert con.execute("SELECT regexp_matches(?, ?)", [text, rf"\A(?:{render.re2(pattern)})\z"]).fetchall()[0][0] == expected, (pattern, text)


def test_scan_rewrites(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = lambda p: regex_search(docs, "text", p)._jdf.queryExecution().executedPlan().toString()
    assert "StringContains" in plan("tion") and "StringStartsWith" in plan("^The") and "StringEndsWith" in plan(r"\.$")
    assert "RLIKE" in plan("t[aeiou]n") and "RLIKE" not in plan(".*")
    assert regex_search(docs, "text", None).count() == 0


def test_null_text_never_matches(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",)], "t string")
    assert [df.where(match(F.col("t"), p)).count() for p in (".*", "a", "[ab]", "^a$")] == [2, 1, 1, 1]


@pytest.fixture(scope="module")
def bpe(tmp_path_factory):
    alphabet = tokenizers.byte_alphabet()
    merges = [("n", "g"), ("ng", "i"), ("t", "a"), ("Ġ", "t"), ("Ġt", "a"), ("h", "o"), ("s", "i"), ("Ġ", "ngi")]
    vocab = {"<s>": 0, "</s>": 1}
    for token in [*alphabet.values(), *(a + b for a, b in merges)]:
        vocab[token] = len(vocab)
    path = tmp_path_factory.mktemp("tok") / "tokenizer.json"
    added = [{"id": i, "content": c, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True} for c, i in (("<s>", 0), ("</s>", 1))]
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": [list(m) for m in merges]}
    path.write_text(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": added, "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None, "model": model}))
    return str(path)


def test_bpe_is_lossless_and_its_fallback_agrees(bpe):
    tok = tokenizers.BpeTokenizer(bpe)
    words, own = tok.vocabulary(), tokenizers.merger(tok.model["model"])
    for text in ("ho ngi ta", "sisi ngingi\nta 國 é\x00", "", "\r\n\n"):
        ids = tok.encode(text)
        assert b"".join(words[i] for i in ids) == text.encode()
        assert tok.encode(text, encoder=own) == ids
    assert tok.encode("ta", special=True)[0] == 0 and tok.encode("ta", special=True)[-1] == 1
    assert tok.vocab_size() == 2 + 256 + 8 and tok.max_token_bytes() == 4
    assert tokenizers.to_bytes(tokenizers.to_unicode(bytes(range(256)))) == bytes(range(256))
    with pytest.raises(FileNotFoundError):
        tokenizers.BpeTokenizer("/nowhere.json")


def test_msgpack_source(spark, tmp_path):
    first = b"\x82\xa2id\x01\xa6tokens\x93\x01\x02\xcd\x01\x00"
    again = b"\x82\xa2id\x01\xa6tokens\x91\x05"
    (tmp_path / "a.msgpack").write_bytes(first + b"\x82\xa2id\xcd\x01\x00\xa6tokens\x90" + again)
    got = {r.id: r.tokens for r in corpora.read_tokens(spark, f"file://{tmp_path}/a.msgpack").collect()}
    assert got == {1: [5], 256: []}
    with pytest.raises(ValueError):
        corpora.unpack(first[:-2])
    stats = corpora.token_stats(spark.createDataFrame([(1, [1, 2]), (7, [3])], corpora.TOKENS)).first()
    assert (stats.max_tokens, stats.max_id, stats.n_rows) == (2, 7, 2)


def test_posting_operators(spark):
    rows = spark.createDataFrame([(1, [5, 6, 5]), (2, [6])], "doc_id long, tokens array<int>")
    found = sorted(tuple(r) for r in P.explode(rows).collect())
    assert found == [(5, 1, 0, 6), (5, 1, 2, 0), (6, 1, 1, 5), (6, 2, 0, 0)]
    a = spark.createDataFrame([(1, 0), (1, 1), (2, 4)], "doc_id long, pos int")
    b = spark.createDataFrame([(1, 1), (1, 1), (2, 6)], "doc_id long, pos int")
    assert [tuple(r) for r in P.followed_by(a, b).collect()] == [(1, 0)]
    assert P.merge_lists(a, b).count() == 4 and P.sentence_ids(a).count() == 2


def rows_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def agree(index, table, pattern, expected=None):
    found = {r.doc_id for r in index.search(table, pattern, mode="index").collect()}
    gone = {r.doc_id for r in table.select("doc_id").subtract(index.documents()).collect()}
    assert found == {r.doc_id for r in regex_search(table, "text", pattern).collect()} - gone
    if expected is not None:
        assert len(found) == expected


A = ["ho ngi ta", "si ta so ngi ta", "ta si ho ta"]
B = ["ho ngi ta", "si ta so ngi ta", "ta ho si", "ta si ho", "ngi ta ho"]


@pytest.mark.parametrize("kind", ["byte", "bpe"])
def test_index_life(spark, tmp_path, bpe, kind):
    tok = tokenizers.ByteTokenizer() if kind == "byte" else tokenizers.BpeTokenizer(bpe)
    at = lambda n: f"file://{tmp_path}/{n}"
    empty = RegexIndex.build(rows_of(spark, []), tok, at("a"))
    table = rows_of(spark, A)
    empty.append(table)
    agree(empty, table, "ngi", 2)
    agree(empty, table, "ho", 2)
    empty.delete(rows_of(spark, A[:1]))
    agree(empty, table, "ngi", 1)
    empty.compact()
    agree(empty, table, "ngi", 1)
    agree(empty, table, "ho", 1)
    with pytest.raises(FileExistsError):
        RegexIndex.build(table, tok, at("a"))

    more = ["ho si ta", "ngi.ta ngi ho", "si ngi ta", None, ""]
    index = RegexIndex.build(rows_of(spark, B), tok, at("b"))
    index.append(rows_of(spark, more, 5))
    table = rows_of(spark, B + more)
    for pattern in ("ngi", "(ta|si) ho", "ngi[^x]ta", "n.*o", "^ta", "國") if kind == "bpe" else ("ho", "h?o", r"\bho\b"):
        agree(index, table, pattern)
    agree(index, table, r"ngi\.ta", 1)
    assert index.size() > 0 and index.postings().count() == index.statistics().agg(F.sum("n_postings")).first()[0]
    assert index.plan("ngi", "index").needs_recheck is False and index.plan("n.*o", "index").needs_recheck is True
    assert {r.doc_id for r in index.search(table, ".*").collect()} == set(range(10)) - {8}
    assert index.search(table, None).count() == 0
    index.drop()
    with pytest.raises(FileNotFoundError):
        RegexIndex(spark, at("b"))


def test_compaction_again_and_again(spark, tmp_path):
    table = rows_of(spark, B + A)
    index = RegexIndex.build(rows_of(spark, B), tokenizers.ByteTokenizer(), f"file://{tmp_path}/c")
    reader = RegexIndex(spark, index.path)
    index.append(rows_of(spark, A, 5), name="s0")
    index.compact()
    index.compact()
    agree(index, table, "ngi", 5)
    index.append(rows_of(spark, A, 5), name="s0")  # a batch that is merged already
    index.delete(rows_of(spark, B[:1]))
    index.compact()
    index.append(rows_of(spark, ["ngi"], 8))
    index.compact()
    agree(index, rows_of(spark, B + A + ["ngi"]), "ngi", 5)
    assert index.documents().count() == 8 and index.postings().groupBy("doc_id", "pos").count().where("count > 1").isEmpty()
    reader._load()
    agree(reader, table.where("doc_id < 8"), "ta", 7)
    stale = dict(index.meta)
    index.append(rows_of(spark, ["ho"], 9))
    with pytest.raises(OSError):  # another writer was faster
        store.write_meta(spark, index.path, stale)
    with pytest.raises(FileExistsError):
        RegexIndex.build(table, tokenizers.ByteTokenizer(), index.path)


def test_long_literals_read_the_postings_once(spark, tmp_path):
    table = rows_of(spark, B)
    index = RegexIndex.build(table, tokenizers.ByteTokenizer(), f"file://{tmp_path}/l")
    found, recheck = index.candidates("ta so ngi")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and not recheck and {r.doc_id for r in found.collect()} == {1}


def test_counts_properties_and_required_strings(spark):
    from rexicon.functions.syntax import parse, required

    df = spark.createDataFrame([("a" * 1500,), ("a" * 1499,), ("x \u3000",)], "t string")
    assert [r.y for r in df.select(match(F.col("t"), "a{1500}").alias("y")).collect()] == [True, False, False]
    assert [r.y for r in df.select(match(F.col("t"), r"^(?:a{30}){50}$").alias("y")).collect()] == [True, False, False]
    assert df.select(match(F.col("t"), r"x \p{White_Space}").alias("y")).collect()[2].y
    assert [required(parse(p)) for p in (r"\band\b", "th[aeiou]n?t", "(?:abc)+d?", "a|b", "x(yz){2}w")] == ["and", "th", "abc", "", "xyzyzw"]


def test_lossy_mapping_is_rechecked(spark, tmp_path):
    table = rows_of(spark, ["a.b", "axb", "a-b"])
    index = RegexIndex.build(table, tokenizers.ByteTokenizer({".": "x"}), f"file://{tmp_path}/m")
    for pattern, n in ((r"a\.b", 1), ("axb", 1), ("a[^x]b", 2), ("a.b", 3)):
        agree(index, table, pattern, n)


def test_manifest_format_is_checked(spark, tmp_path):
    store.write_meta(spark, f"file://{tmp_path}", {})
    with pytest.raises(ValueError, match="lacks"):
        store.read_meta(spark, f"file://{tmp_path}")
    (tmp_path / f"{store.META}.2").write_text('{"format": 99}')
    with pytest.raises(ValueError):
        store.read_meta(spark, f"file://{tmp_path}")


def test_stream_replays_do_not_double(spark, tmp_path):
    index = RegexIndex.build(rows_of(spark, []), tokenizers.ByteTokenizer(), f"file://{tmp_path}/s")
    rows_of(spark, A).write.parquet(f"{tmp_path}/in")
    for n in (1, 2):  # a second run from an empty checkpoint replays batch 0
        stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tmp_path}/in")
        append_stream(stream, index, f"{tmp_path}/check{n}").awaitTermination()
    index = RegexIndex(spark, index.path)
    assert index.documents().count() == 3
    agree(index, rows_of(spark, A), "ngi", 2)


def test_queries_equal_duckdb(spark, bpe, monkeypatch):
    monkeypatch.setattr(catalogue, "tokenizer", lambda: tokenizers.BpeTokenizer(bpe))
    con = duckdb.connect()
    for name in ("documents", "pages", "conversations", "part", "customer"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    found, oracle = catalogue.queries(), catalogue.oracle_sql()
    assert set(found) - set(oracle) == {"dfa_table", "step_table"}
    for name, sql in oracle.items():
        got = found[name](spark, SF)
        columns = sorted(got.columns)
        expected = con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(expected), name
