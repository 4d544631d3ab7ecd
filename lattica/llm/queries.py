"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chunks, clusters, decontaminate, html, language, licenses, near_dedup, quality, token_counts, toxicity, urls, whitening
from ._base import table

WORD_BPE = "word_bpe_49k.json"


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.group(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_held_out(table(spark, sf_dir, "documents"))


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_near_dedup, op2_language_id, op3_bpe_roundtrip, op4_license_scan, op5_url_filter, op6_decontaminate, op7_quality_rules, op8_token_counts, op9_toxicity, op10_main_text, op11_centroid_clusters, op12_exact_dedup, op13_whitening)
    return {f.__name__: f for f in every}


WORDS = r"list_filter(string_split_regex({0}, '[ \t-\r]+'), lambda x: x <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 85 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT s.doc_id AS doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m ON node = s.doc_id"""


def op7_sql(alpha: float = 0.05, delta: float = 0.05, gain: float = 0.99) -> str:
    part = lambda a, b: f"CAST({a} AS DOUBLE) / greatest({b}, 1)"
    metrics = {"symbol_ratio": part("n_symbols", "word_chars"), "upper_ratio": part("n_upper", "word_chars"), "mark_ratio": part("n_marks", "n_words"), "dup_line_ratio": part("n_dup_lines", "n_lines"), "repeat_ratio": part("n_repeat_words", "n_words")}
    rows = " UNION ALL ".join(f"SELECT doc_id, stratum, '{r}' AS rule, {m} AS v FROM base" for r, m in metrics.items())
    rules = list(quality.GRID)
    paths = ", ".join(f"({k}, '{rules[i]}')" for k, p in enumerate(quality.PATHS) for i in p)
    cut = ", ".join(f"('{r}', {level}, CAST({c} AS DOUBLE))" for r, own in quality.GRID.items() for level, c in enumerate(own, 1))
    return rf"""WITH w AS (SELECT doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM twice) GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM w),
base AS (SELECT w.doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  len(regexp_extract_all(t, '\p{{Lu}}')) AS n_upper, len(regexp_extract_all(t, '[!?]')) AS n_marks, len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w JOIN ln ON ln.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id),
fail AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
long AS ({rows}),
lab AS (SELECT doc_id, max(quality) AS q FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
grid(rule, level, cut) AS (VALUES {cut}),
path(path, rule) AS (VALUES {paths}),
one AS (SELECT doc_id, stratum, md5(t) AS text_key, q FROM fail JOIN w USING (doc_id, stratum) JOIN lab USING (doc_id) WHERE NOT base_failed QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY md5(t)) = 1),
trial AS (SELECT min(doc_id) AS doc_id, stratum, max(q) AS q FROM one GROUP BY stratum, text_key),
lev AS (SELECT doc_id, stratum, q, g.rule, count(*) FILTER (v >= cut) AS level FROM trial JOIN long USING (doc_id, stratum) JOIN grid g USING (rule) GROUP BY ALL),
onpath AS (SELECT doc_id, stratum, q, path, max(level) AS level FROM lev JOIN path USING (rule) GROUP BY ALL),
cell AS (SELECT stratum, path, s.level AS level, count(*) FILTER (q = 1) AS n, count(*) FILTER (q = 1 AND p.level >= s.level) AS k, count(*) FILTER (q = 0 AND p.level >= s.level) AS caught FROM onpath p, (SELECT unnest(range(1, {quality.STEPS + 1})) AS level) s GROUP BY ALL),
test AS (SELECT *, n > 0 AND k < n * {alpha} AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}) + (n - i) * ln(1 - {alpha})))) <= {delta} / ({len(quality.PATHS)} * (SELECT count(DISTINCT stratum) FROM trial)) AS ok FROM cell),
cert AS (SELECT * FROM test QUALIFY bool_and(ok) OVER (PARTITION BY stratum, path ORDER BY level DESC)),
best AS (SELECT *, max(caught) OVER (PARTITION BY stratum) AS most FROM cert WHERE caught > 0),
pick AS (SELECT stratum, path, level FROM best WHERE caught >= {gain} * most QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY k, level DESC, path) = 1),
cutoff AS (SELECT stratum, rule, cut FROM pick JOIN path USING (path) JOIN grid USING (rule, level)),
hit AS (SELECT DISTINCT doc_id FROM long JOIN cutoff USING (stratum, rule) WHERE v >= cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM hit) AS kept FROM fail"""


def op11_sql(k: int = 8, rounds: int = 10) -> str:
    nearest = lambda i: f"SELECT vec_id, x, c.k AS cluster, list_sum(list_transform(list_zip(x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance FROM v, c{i} c QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, c.k) = 1"
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS k, x AS c FROM v QUALIFY k < {k})",
    ]
    for i in range(rounds):
        steps += [
            f"a{i} AS MATERIALIZED ({nearest(i)})",
            f"m{i} AS (SELECT cluster, d, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS e, unnest(range(1, 65)) AS d FROM a{i}) GROUP BY ALL)",
            f"n{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY d) AS c FROM m{i} GROUP BY cluster)",
            f"c{i + 1} AS MATERIALIZED (SELECT k, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN n{i} n ON cluster = k)",
        ]
    return "WITH " + ",\n".join(steps) + f""",
last AS MATERIALIZED ({nearest(rounds)})
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM last JOIN c{rounds} ON k = cluster"""


OP12_SQL = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; the others are tested against brute-force versions in tests/llm."""
    return {"op1_near_dedup": OP1_SQL, "op7_quality_rules": op7_sql(), "op11_centroid_clusters": op11_sql(), "op12_exact_dedup": OP12_SQL}
