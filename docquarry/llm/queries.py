"""The thin queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_duckdb, collision_search, exact_dedup, filter_audit, html_main, knn_join, language_id, ngram_join, packing, secret_scan, token_alignment, token_files, url_filter
from .shared import shared_dir, spread, table, text_of

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_token_files(table(spark, sf_dir, "documents"), shared_dir(spark, "token-files"), public_tokenizers.path(BYTE_BPE))
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spread(table(spark, sf_dir, "documents")))


def op3_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join.knn_join(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (SELECT * FROM v WHERE len(v) = (SELECT len(v) FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score
      FROM (SELECT vec_id, min(v) AS v FROM d WHERE vec_id % 50 = 0 GROUP BY vec_id) AS q JOIN d AS x ON x.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 5
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(spread(table(spark, sf_dir, "documents")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secret_scan.span_text(F.col("base")), 256).alias("base_sha256"),
        secret_scan.span_text(F.concat("base", "linked")).alias("spans"),
    )


def op5_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(spread(table(spark, sf_dir, "pages")))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe_duckdb.encode_decode(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(spread(table(spark, sf_dir, "documents")), n_words=4, percent=85).select("doc_id", "n_shingles", "component_id")


OP7_SQL = f"""
WITH RECURSIVE
t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(
        CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM t)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s AS x JOIN s AS y USING (shingle) WHERE x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.reached FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


def _kind_sql(kind: str, pattern: str, keep: str | None) -> str:
    """Rows (doc_id, rank, kind, s, e): lengths of pieces and matches summed up in order."""
    p = pattern.replace("'", "''")
    k = "WHERE regexp_matches(hit, '" + keep.replace("'", "''") + "')" if keep else ""
    return f"""
    SELECT doc_id, {secret_scan.ORDER[kind]} AS rank, '{kind}' AS kind, e - length(hit) AS s, e FROM (
      SELECT doc_id, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM (
        SELECT doc_id, unnest(range(len(hits))) AS i, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap FROM (
          SELECT doc_id, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS gaps FROM t)))
    {k}"""


_ROLE_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in secret_scan.ROLE.items()) + " END"

OP8_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS ({" UNION ALL ".join(_kind_sql(*x) for x in secret_scan.BASE)}),
w AS ({" UNION ALL ".join(_kind_sql(*x) for x in secret_scan.WEAK)}),
p AS (SELECT *, {_ROLE_SQL} AS role FROM (FROM b UNION ALL FROM w)),
l AS (SELECT doc_id, rank, kind, s, e FROM p WHERE rank > 2 AND EXISTS (
        SELECT 1 FROM p AS o WHERE o.doc_id = p.doc_id AND p.s <= o.e + {secret_scan.SCOPE} AND p.e >= o.s - {secret_scan.SCOPE}
          AND (p.role = 'secret') <> (o.role = 'secret'))),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank <= 2) AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM (FROM b UNION ALL FROM l) GROUP BY doc_id)
SELECT t.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (doc_id)
"""


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).drop("template_rejected")


def _rule_sql(column: int, rules: list[url_filter.Rule] = URL_RULES) -> str:
    cases = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(v, r)[column]}'" for v, r, h, p in url_filter.by_length(rules)]
    return "CASE " + " ".join(cases) + " END"


OP9_SQL = f"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, translate(regexp_extract(url, '{url_filter.URL}', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
             regexp_extract(url, '{url_filter.URL}', 2) AS path FROM u),
f AS (SELECT *, {_rule_sql(1)} AS rule, {_rule_sql(0)} AS decided,
        list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s:
          CASE WHEN regexp_matches(s, '{url_filter.HEX}') AND NOT regexp_matches(s, '^[0-9]+$') THEN '{{h}}'
               ELSE regexp_replace(s, '{url_filter.NUMBER}', '{{n}}') END) AS raw FROM h),
p AS (SELECT host, raw, count(decided) AS labelled, count(*) FILTER (decided = 'block') AS blocked FROM f GROUP BY ALL),
w AS (
  SELECT host, raw, labelled, blocked, 0 AS depth, '' AS template FROM p
  UNION ALL
  SELECT host, raw, labelled, blocked, depth + 1, template || '/' || CASE WHEN
      CASE WHEN n_children = 1 THEN false WHEN all_lab = 0 THEN true WHEN lab = 0 OR all_lab = lab THEN false
           ELSE abs(bad / lab - (all_bad - bad) / (all_lab - lab))
                <= {url_filter.Z} * sqrt(all_bad / all_lab * (1 - all_bad / all_lab) * (1 / lab + 1 / (all_lab - lab))) END
      THEN '*' ELSE segment END
  FROM (SELECT *, count(DISTINCT segment) OVER n AS n_children, sum(labelled) OVER n AS all_lab, sum(blocked) OVER n AS all_bad,
               sum(labelled) OVER b AS lab, sum(blocked) OVER b AS bad
        FROM (SELECT *, raw[depth + 1] AS segment FROM w WHERE depth < len(raw))
        WINDOW n AS (PARTITION BY host, template), b AS (PARTITION BY host, template, segment))),
t AS (SELECT host, raw, labelled, blocked, template FROM w WHERE depth = len(raw)),
r AS (SELECT host, template FROM t GROUP BY ALL HAVING (sum(blocked) + 1) / (sum(labelled) + 2) > {url_filter.REJECT})
SELECT page_id, f.host, path, rule, coalesce(decided, CASE WHEN r.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM f LEFT JOIN t ON t.host = f.host AND t.raw = f.raw LEFT JOIN r ON r.host = t.host AND r.template = t.template
"""


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return filter_audit.audit(docs, filter_audit.text_failures(text_of()), table(spark, sf_dir, "labels"))


OP11_SQL = """
WITH RECURSIVE t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM t),
marks AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda f: CASE f
        WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS fails, good, toxic
      FROM (SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
                   100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
                   coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
            FROM w LEFT JOIN marks ON marks.doc_id = w.doc_id)),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM m GROUP BY ALL),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || f FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS u(f) WHERE NOT contains(filter_order, f)),
s AS (SELECT filter_order, step::INTEGER AS step, filter_order[step:step] AS f, string_split(filter_order[1:step - 1], '') AS before
      FROM o, unnest(range(1, 6)) AS u(step) WHERE length(filter_order) = 5),
r AS (SELECT part, filter_order, step, f,
             sum(n) FILTER (NOT list_contains(fails, f) AND NOT list_has_any(fails, before)) AS kept,
             sum(n) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, before)) AS removed,
             sum(n) FILTER (list_contains(fails, f) AND list_has_any(fails, before)) AS redundant,
             sum(n) FILTER (fails = [f]) AS unique_fails,
             sum(g) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, before)) AS good_lost,
             sum(x) FILTER (list_contains(fails, f) AND NOT list_has_any(fails, before)) AS toxic_lost
      FROM cells CROSS JOIN s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley FROM r
"""


def op12_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(spread(table(spark, sf_dir, "documents")), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_token_files, op2_language_id, op3_knn_join, op4_exact_dedup, op5_html_main, op6_bpe, op7_ngram_join, op8_secret_scan, op9_url_filter, op10_packing, op11_filter_audit, op12_collision_search, op13_token_alignment]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_knn_join": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op7_ngram_join": OP7_SQL, "op8_secret_scan": OP8_SQL, "op9_url_filter": OP9_SQL, "op11_filter_audit": OP11_SQL}
