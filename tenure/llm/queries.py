"""The registered query of each operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

import sys
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.llm import ann, bpe, fingerprints, katz, licenses, merkle, mixing, quality_classifier, ranked, simhash, token_counts, toxicity, urls
from tenure.llm.labelled import FOLDS
from tenure.llm.tables import held_out_fold, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _scored(spark: SparkSession, sf_dir: str, classifier) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = classifier.train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", held_out_fold("doc_id", FOLDS).alias("held_out"), classifier.score(F.col("text"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= classifier.THRESHOLD).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, toxicity)


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licences(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, quality_classifier)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    domain, epoch, tokens = mixing.mixed_names(docs)
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", F.col(domain).alias("domain"), "lang", "source", F.col(epoch).alias("epoch"), F.col(tokens).alias("n_tokens"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.search(vectors, vectors.filter("vec_id % 20 = 0"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_counts(table(spark, sf_dir, "documents", "doc_id", "text"), VOCABULARY)


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_texts(table(spark, sf_dir, "documents", "doc_id", "text"), held_out_fold("doc_id", 7))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents", "doc_id", "text"), VOCABULARY)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *merkle.FIELDS)
    rows = merkle.verify(docs, merkle.tampered_fold("doc_id"), {"n_chars": F.col("n_chars") + 1})
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


# Rules of op13_urls: (verdict, host, path).
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES).drop("url")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = str(Path(__file__).resolve().parents[2])
    if top not in sys.path:
        sys.path.insert(0, top)
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_licenses, op3_fingerprints, op4_quality, op5_mixing, op6_simhash, op7_neighbours, op8_token_counts, op9_katz, op10_bpe, op11_merkle, op12_ranked, op13_urls, pipeline,
    )
}


def _case(column: str, values: dict, default: str) -> str:
    return f"CASE {' '.join(f'WHEN {column} = {k!r} THEN {v!r}' for k, v in values.items())} ELSE {default} END"


def _filled(name: str, source: str, keys: list[str], child: str, weight: str) -> str:
    """CTEs that split each parent's budget by comparing every child with its siblings."""
    same = " AND ".join(f"s.{k} = c.{k}" for k in keys) or "TRUE"
    later = f"s.lim / s.w > c.lim / c.w OR (s.lim / s.w = c.lim / c.w AND s.{child} >= c.{child})"
    cols = ", ".join(f"c.{k}" for k in [*keys, child])
    group = ", ".join([*keys, child])
    return f"""
{name}_c AS (SELECT *, {weight} AS w FROM ({source})),
{name}_f AS (
  SELECT {cols}, c.lim, c.w, c.budget,
    c.lim::HUGEINT * sum(s.w) FILTER (WHERE {later}) <= (c.budget - coalesce(sum(s.lim) FILTER (WHERE NOT ({later})), 0))::HUGEINT * c.w AS is_full
  FROM {name}_c c JOIN {name}_c s ON {same} GROUP BY {cols}, c.lim, c.w, c.budget),
{name} AS (
  SELECT {", ".join("c." + x for x in group.split(", "))},
    CASE WHEN c.is_full THEN c.lim
      ELSE ((c.budget - coalesce((SELECT sum(s.lim) FROM {name}_f s WHERE s.is_full AND {same}), 0)) * c.w
        // (SELECT sum(s.w) FROM {name}_f s WHERE NOT s.is_full AND {same}))::BIGINT END AS quota
  FROM {name}_f c)"""


MIXING_SQL = f"""
WITH d AS (
  SELECT doc_id, lang AS lang0, source AS source0, coalesce({_case("source", mixing.DOMAIN_OF, "'(none)'")}, '(none)') AS domain,
    coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
    coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS n
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens, (sum(n) * {mixing.MAX_EPOCHS})::BIGINT AS lim FROM d GROUP BY ALL),
{_filled("dq", "SELECT domain, sum(lim)::BIGINT AS lim, (SELECT sum(tokens)::BIGINT FROM leaf) AS budget FROM leaf GROUP BY domain", [], "domain", _case("domain", mixing.DOMAIN_WEIGHTS, str(mixing.OTHER)))},
{_filled("lq", "SELECT leaf.domain, lang, sum(lim)::BIGINT AS lim, any_value(dq.quota) AS budget FROM leaf JOIN dq ON dq.domain = leaf.domain GROUP BY leaf.domain, lang", ["domain"], "lang", _case("lang", mixing.LANGUAGE_WEIGHTS, str(mixing.OTHER)))},
{_filled("sq", "SELECT leaf.domain, leaf.lang, source, lim, lq.quota AS budget FROM leaf JOIN lq ON lq.domain = leaf.domain AND lq.lang = leaf.lang", ["domain", "lang"], "source", "1")},
plan AS (
  SELECT sq.*, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS whole, CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END AS rest
  FROM sq JOIN leaf USING (domain, lang, source)),
ranked AS (
  SELECT d.*, whole, rest,
    sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat('{mixing.SEED}:', whole + 1, ':', doc_id)), n) AS upto
  FROM d JOIN plan USING (domain, lang, source)),
taken AS (SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS times FROM ranked)
SELECT doc_id, domain, lang0 AS lang, source0 AS source, unnest(range(1, times + 1))::INTEGER AS epoch, n AS n_tokens FROM taken
"""

_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_CRC32 = "xor(list_reduce(list_concat([4294967295], list_transform(range(length({0})), lambda i: ascii({0}[i + 1])::BIGINT)), lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295)"


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(n_chars if f == 'n_chars' else f) for f in merkle.FIELDS)})"


MERKLE_SQL = f"""
WITH RECURSIVE crc_table AS MATERIALIZED (SELECT {_CRC_TABLE} AS crc),
d AS MATERIALIZED (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf("(n_chars + 1)")} AS other,
    coalesce({_CRC32.format("CAST(doc_id AS VARCHAR)")} % 7 = 0, FALSE) AS tampered FROM documents, crc_table),
placed AS MATERIALIZED (
  SELECT row_number() OVER () AS id, *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
low(lang, height, pos, n, node) AS (
  SELECT lang, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT lang, height + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY lang, height, pos // 2),
tops AS MATERIALIZED (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high(height, pos, n, node) AS (
  SELECT 0, pos, n, subroot FROM tops
  UNION ALL
  SELECT height + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY height, pos // 2),
path AS MATERIALIZED (
  SELECT id, height, (p.pos >> height) & 1 AS side, b.node AS sibling
  FROM placed p, (SELECT DISTINCT height FROM low WHERE n > 1) JOIN low a USING (height) LEFT JOIN low b ON b.height = a.height AND b.lang IS NOT DISTINCT FROM a.lang AND b.pos = xor(a.pos, 1)
  WHERE a.lang IS NOT DISTINCT FROM p.lang AND a.pos = p.pos >> height AND a.n > 1
  UNION ALL
  SELECT id, 1000 + a.height, (t.pos >> a.height) & 1, b.node
  FROM placed p JOIN tops t ON t.lang IS NOT DISTINCT FROM p.lang JOIN high a ON a.n > 1 AND a.pos = t.pos >> a.height LEFT JOIN high b ON b.height = a.height AND b.pos = xor(a.pos, 1)),
steps AS MATERIALIZED (SELECT id, list(sibling ORDER BY height) AS siblings, list(side ORDER BY height) AS sides FROM path GROUP BY id),
folds(id, step, node) AS (
  SELECT id, 0, CASE WHEN tampered AND other IS NOT NULL THEN other ELSE leaf END FROM placed
  UNION ALL
  SELECT f.id, step + 1, sha256(CASE WHEN siblings[step + 1] IS NULL THEN node WHEN sides[step + 1] = 1 THEN siblings[step + 1] || node ELSE node || siblings[step + 1] END)
  FROM folds f JOIN steps USING (id) WHERE step < len(siblings))
SELECT p.doc_id, p.leaf, t.subroot, r.node AS root, sha256(coalesce(array_to_string(list_filter(s.siblings, lambda x: x IS NOT NULL), ''), '')) AS proof_sha256,
  f.node AS folded_root, f.node = r.node AS verified
FROM placed p JOIN tops t ON t.lang IS NOT DISTINCT FROM p.lang LEFT JOIN steps s USING (id) JOIN folds f ON f.id = p.id AND f.step = coalesce(len(s.siblings), 0)
CROSS JOIN (SELECT node FROM high WHERE n = 1) r
"""

_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
RANKED_SQL = f"""
WITH words AS (SELECT row_no, doc_id, {_TERMS} FROM (SELECT row_number() OVER () AS row_no, doc_id, text FROM documents)),
tf AS MATERIALIZED (SELECT row_no, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words GROUP BY row_no, term),
size AS (SELECT row_no, sum(tf)::BIGINT AS n FROM tf GROUP BY row_no),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM size),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
item AS (SELECT DISTINCT item_id, {_TERMS} FROM benchmark),
scored AS (
  SELECT item_id, row_no, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
  FROM item JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (row_no), total GROUP BY item_id, row_no),
ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {ranked.K}
"""

URLS_SQL = f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {", ".join(map(repr, URL_RULES))}),
cut AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fit AS (
  SELECT s.*, r.*, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost) DESC, length(rpath) DESC, verdict DESC) AS place
  FROM (SELECT DISTINCT * FROM split) s JOIN rules r ON (s.host = rhost OR ends_with(s.host, '.' || rhost)) AND starts_with(s.path, rpath))
SELECT s.page_id, s.host, s.path, f.rhost || f.rpath AS rule, coalesce(f.verdict, '{urls.ALLOW}') AS verdict
FROM split s LEFT JOIN fit f ON f.place = 1 AND f.page_id IS NOT DISTINCT FROM s.page_id AND f.host = s.host AND f.path = s.path
"""

ORACLE_SQL = {"op5_mixing": MIXING_SQL, "op11_merkle": MERKLE_SQL, "op12_ranked": RANKED_SQL, "op13_urls": URLS_SQL}
