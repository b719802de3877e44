"""DuckDB SQL for the operators that it can express."""

from __future__ import annotations

from . import mixing, quality

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    list_reduce(list_transform(generate_series(1, len(q.e)), lambda k: q.e[k] * c.e[k]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op6() -> str:
    metric = {
        "symbols": "CAST(n_symbols AS DOUBLE) / CAST(greatest(word_chars, 1) AS DOUBLE)",
        "dup_lines": "n_dup_lines * CAST(10.0 AS DOUBLE) / CAST(greatest(n_words, 1) AS DOUBLE)",
        "repeats": "CAST(n_repeat_words AS DOUBLE) / CAST(greatest(n_words, 1) AS DOUBLE)",
        "word_length": "CAST(word_chars AS DOUBLE) / CAST(greatest(n_words, 1) AS DOUBLE)",
    }
    spread = "CASE metric " + " ".join(f"WHEN '{m}' THEN {v!r}::DOUBLE" for m, v in quality.SPREADS.items()) + " END"
    levels = {"l0": "lang, source", "l1": "lang", "l2": ""}
    ctes = []
    for name, keys in levels.items():
        k = keys + ", " if keys else ""
        g = f"PARTITION BY {k}metric"
        ctes.append(
            f"{name}a AS (SELECT {k}metric, bin, sum(n) AS n FROM sk GROUP BY ALL),\n"
            f"{name}b AS (SELECT *, sum(n) OVER ({g}) AS total, sum(n) OVER ({g} ORDER BY bin) AS upto FROM {name}a),\n"
            f"{name}c AS (SELECT {k}metric, max(total) AS n_docs, min(bin) FILTER (upto * 4 >= total) AS b1, min(bin) FILTER (upto * 4 >= total * 3) AS b3 FROM {name}b GROUP BY ALL),\n"
            f"{name} AS (SELECT {k}metric, n_docs, q3 + {quality.FENCE}::DOUBLE * greatest(q3 - q1, {spread}) AS fence FROM (SELECT *, "
            + ", ".join(f"CASE WHEN {b} <= 0 THEN 0.0 ELSE {quality.LEAST!r}::DOUBLE * pow({quality.GAMMA!r}::DOUBLE, {b}::DOUBLE) END AS {q}" for b, q in (("b1", "q1"), ("b3", "q3")))
            + f" FROM {name}c))"
        )
    pick = f"CASE WHEN coalesce(l0.n_docs, 0) >= {quality.MIN_GROUP} THEN l0.fence WHEN coalesce(l1.n_docs, 0) >= {quality.MIN_GROUP} THEN l1.fence ELSE l2.fence END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, * FROM documents),
w AS (SELECT rid, doc_id, lang, source, {_WORDS} AS ws, coalesce(text, '') AS t FROM d),
tri AS (SELECT rid, unnest(generate_series(1, len(ws) - 2)) AS i, ws FROM w WHERE len(ws) > 2),
win AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM tri),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + k AS p FROM rep, (VALUES (0), (1), (2)) o(k)) GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM w),
dup AS (SELECT rid, sum(n - 1) AS n FROM (SELECT rid, line, count(*) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line) GROUP BY rid),
c AS (SELECT w.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov ON cov.rid = w.rid LEFT JOIN dup ON dup.rid = w.rid),
m AS (SELECT *, n_words < {quality.MIN_WORDS} OR n_repeat_words * 100 > n_words * {quality.MAX_REPEAT_PERCENT} AS base_failed, {', '.join(f'{e} AS {k}' for k, e in metric.items())} FROM c),
u AS (SELECT rid, doc_id, lang, source, base_failed, unnest([{', '.join(f"{{'metric': '{k}', 'v': {k}}}" for k in metric)}], recursive := true) FROM m),
b AS (SELECT *, CAST(ceil(ln(greatest(v, {quality.LEAST!r}::DOUBLE) / {quality.LEAST!r}::DOUBLE) / ln({quality.GAMMA!r}::DOUBLE)) AS INTEGER) AS bin FROM u),
sk AS (SELECT lang, source, metric, bin, count(*) AS n FROM b WHERE NOT base_failed GROUP BY ALL),
{(',' + chr(10)).join(ctes)},
ok AS (SELECT b.rid, bool_and(coalesce(b.v <= {pick}, false)) AS fits FROM b
  LEFT JOIN l0 ON l0.lang IS NOT DISTINCT FROM b.lang AND l0.source IS NOT DISTINCT FROM b.source AND l0.metric = b.metric
  LEFT JOIN l1 ON l1.lang IS NOT DISTINCT FROM b.lang AND l1.metric = b.metric
  LEFT JOIN l2 ON l2.metric = b.metric GROUP BY b.rid)
SELECT doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {', '.join(metric)}, base_failed, NOT base_failed AND fits AS kept FROM m JOIN ok USING (rid)
"""


def _inverse(x: str, knots) -> str:
    """The same arithmetic as ``mixing.inverse``, in the same order."""
    out, before = "", 0.0
    segments = mixing.integral(knots)
    for i, (t0, t1, r0, r1) in enumerate(segments):
        slope = (r1 - r0) / (t1 - t0)
        rest = f"({x} - {before!r}::DOUBLE)"
        t = f"least({t0!r}::DOUBLE + 2.0::DOUBLE * {rest} / greatest({r0!r}::DOUBLE + sqrt(greatest({r0 * r0!r}::DOUBLE + {2.0 * slope!r}::DOUBLE * {rest}, 0.0::DOUBLE)), 1e-300::DOUBLE), {t1!r}::DOUBLE)"
        before += (t1 - t0) * (r0 + r1) / 2
        out += f"WHEN {'true' if i == len(segments) - 1 else f'{x} < {before!r}::DOUBLE'} THEN {t} "
    return f"CASE {out}END"


def op8() -> str:
    w = "CASE rank % 3 " + " ".join(f"WHEN {k} THEN {float(v)!r}::DOUBLE" for k, v in enumerate(mixing.WEIGHTS)) + " END"
    at = "CASE rank % 3 " + " ".join(f"WHEN {k} THEN {_inverse('x', s)}" for k, s in enumerate(mixing.SCHEDULES)) + " END"
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 10) AS BIGINT) AS u FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM s0),
s2 AS (SELECT *, {w} AS w, source_size * {mixing.CAP} AS cap, sum(source_size) OVER () AS total FROM s1),
s3 AS (SELECT *, CAST(total - (sum(cap) OVER (ORDER BY cap / w, rank) - cap) AS DOUBLE) / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY cap / w, rank) AS place FROM s2),
s4 AS (SELECT *, level * w <= cap AS free FROM s3),
s5 AS (SELECT *, (SELECT level FROM s4 WHERE free ORDER BY place LIMIT 1) AS water FROM s4),
s AS (SELECT source, source_size, rank, least(CASE WHEN free THEN water * w ELSE CAST(cap AS DOUBLE) END, CAST(cap AS DOUBLE)) AS target FROM s5),
r AS (SELECT d.doc_id, d.size, s.source_size, s.target, s.rank, CAST(floor(target) AS BIGINT) AS due,
  CAST(sum(d.size) OVER (PARTITION BY s.rank ORDER BY d.u, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS start
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN due // source_size ELSE 0 END AS passes FROM r),
q AS (SELECT *, greatest(least(due - passes * source_size - start, size), 0) AS part, least(CAST(start AS DOUBLE) / CAST(greatest(due, 1) AS DOUBLE), 1.0::DOUBLE) AS x FROM p)
SELECT doc_id, size, source_size, target, CAST(passes * size + part AS BIGINT) AS taken, CASE WHEN passes > 0 OR part > 0 THEN {at} END AS position FROM q
"""


OP10 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_distinct(list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1])) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON r.c = e.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id, w.doc_id = r.c AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id) r ON r.doc_id = w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_neighbours": OP3, "op6_quality": op6(), "op8_mixing": op8(), "op10_minhash": OP10}
