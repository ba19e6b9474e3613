"""The queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontam,
    langid,
    lexical,
    lmscore,
    mixing,
    periodic,
    pii,
    quality,
    sharding,
    simhash,
    substring,
    tokenbin,
    urlfilter,
)

#: Fixed values of the URL query.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"), 8)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.token_digest(_read(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle=4, radius=4, seed=42)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_read(spark, sf_dir, "documents"), width=50)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_read(spark, sf_dir, "pages"), RULES)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_read(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.plan(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(_read(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(_read(spark, sf_dir, "documents"), piece_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_token_files,
        op3_simhash,
        op4_substring_dedup,
        op5_pii,
        op6_url_filter,
        op7_language_id,
        op8_quality_rules,
        op9_decontamination,
        op10_mixing,
        op11_periodic_runs,
        op12_ranked_search,
        op13_lm_scoring,
    )
}

_OP6 = """
WITH cut AS (
  SELECT page_id, contains(coalesce(url, ''), '://') AS has,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         CASE WHEN has THEN translate(regexp_extract(rest, '^([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN has THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM cut
), judged AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7')
      THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8')
      THEN 'example.net/de/8'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/'
  END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

_OP10 = """
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS o
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ord
  FROM docs GROUP BY source
), capped AS (
  SELECT *, 3 * source_size AS cap, CASE ord % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM src
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE
          / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM capped
  WINDOW before AS (ORDER BY cap::DOUBLE / weight, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), watered AS (
  SELECT *, max(CASE WHEN level * weight <= cap THEN level END) OVER () AS water FROM levels
), targets AS (
  SELECT source, source_size, ord, least(cap::DOUBLE, water * weight) AS target FROM watered
), block AS (
  SELECT greatest(1, (sum(size)::BIGINT + 262143) // 262144)::BIGINT AS size FROM docs
), cut AS (
  SELECT t.*, CASE WHEN target > 0
      THEN greatest((source_size + b.size - 1) // b.size, least(source_size, ceil(1000 * source_size / target)::BIGINT))
      ELSE (source_size + b.size - 1) // b.size END AS blocks
  FROM targets t, block b WHERE source_size > 0
), shared AS (
  SELECT *, round(target * blocks / source_size * 1000)::BIGINT AS share FROM cut
), summed AS (
  SELECT *, (sum(share) OVER (ORDER BY ord))::BIGINT AS upto, (sum(share) OVER ())::BIGINT AS shares FROM shared
), owned AS (
  SELECT *, ((upto - share) * 4294967296) // shares AS low, (upto * 4294967296) // shares AS high FROM summed
), points AS (
  SELECT i AS id, (i * 2654435769) % 4294967296 AS point
  FROM (SELECT unnest(range(0, coalesce((SELECT (max(shares) + 999) // 1000 FROM summed), 0))) AS i)
), ranked AS (
  SELECT o.ord, o.blocks, row_number() OVER (PARTITION BY o.ord ORDER BY p.id) - 1 AS rank
  FROM points p ASOF JOIN owned o ON p.point >= o.low
), times AS (
  SELECT ord, rank % blocks AS block, least(count(*), 3) AS times FROM ranked GROUP BY ord, rank % blocks
), placed AS (
  SELECT d.doc_id, d.size, t.ord, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY t.ord ORDER BY d.o
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), pieces AS (
  SELECT p.*, s.blocks, unnest(CASE WHEN p.size > 0 THEN range(
           ((p.start + 1) * s.blocks - 1) // p.source_size,
           ((p.start + p.size) * s.blocks - 1) // p.source_size + 1) END) AS block
  FROM placed p JOIN shared s ON p.ord = s.ord WHERE p.size > 0
), taken AS (
  SELECT p.ord, p.start, sum((least(p.start + p.size, ((p.block + 1) * p.source_size) // p.blocks)
           - greatest(p.start, (p.block * p.source_size) // p.blocks)) * coalesce(t.times, 0))::BIGINT AS taken
  FROM pieces p LEFT JOIN times t ON p.ord = t.ord AND p.block = t.block GROUP BY p.ord, p.start
)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM placed p LEFT JOIN taken t ON p.size > 0 AND p.ord = t.ord AND p.start = t.start
"""

_OP12 = """
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
), docs AS (
  SELECT *, len(terms)::BIGINT AS n FROM cut WHERE len(terms) > 0
), corpus AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM docs
), item_terms AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL
), counts AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM item_terms) GROUP BY r, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts, corpus GROUP BY term, docs
), scores AS (
  SELECT i.item_id, d.r, d.doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
  FROM item_terms i JOIN counts c ON i.term = c.term JOIN weights w ON c.term = w.term JOIN docs d ON c.r = d.r, corpus
  GROUP BY i.item_id, d.r, d.doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

#: DuckDB SQL for the same rows. The other operators need hashes, checksums or models that SQL lacks.
ORACLES: dict[str, str] = {"op6_url_filter": _OP6, "op10_mixing": _OP10, "op12_ranked_search": _OP12}
