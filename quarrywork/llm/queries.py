"""The registered queries of this subpackage, with production parameters, and their SQL where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, debruijn, imi, mixing, packing, ppm, simhash, toxicity, url_trie, weak, wrappers


#: Runs of a query whose written tables stay; the tables of older ones go when it runs again, and all when the process ends.
RUNS = 3
_RUNS: dict[str, list[str]] = {}


def _scope(spark: SparkSession, name: str) -> str:
    """A name for what this run of a query writes to the shared folder."""
    runs = _RUNS.setdefault(name, [])
    runs.append(f"{name}-{uuid.uuid4().hex}")
    if len(runs) > RUNS:
        common.release(spark, runs.pop(0))
    return runs[-1]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imi.search(_read(spark, sf_dir, "embeddings"), lambda i: F.pmod(i, F.lit(20)) == 0, scope=_scope(spark, "op1"))


def op2_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"), scope=_scope(spark, "op2"))


def op3_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_read(spark, sf_dir, "documents"), scope=_scope(spark, "op3"))


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trie.filter_urls(_read(spark, sf_dir, "pages"), URL_RULES)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), scope=_scope(spark, "op5"))


def op6_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.deduplicate(_read(spark, sf_dir, "documents"), with_text=False, scope=_scope(spark, "op6"))


def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak.judge(_read(spark, sf_dir, "documents"), scope=_scope(spark, "op7"))


def op8_water_filling_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"), scope=_scope(spark, "op8"))


TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path(), scope=_scope(spark, "op9"))


def op10_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(_read(spark, sf_dir, "pages"), scope=_scope(spark, "op10"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_inverted_multi_index": op1_inverted_multi_index,
    "op2_simhash_groups": op2_simhash_groups,
    "op3_ppm_scores": op3_ppm_scores,
    "op4_url_filter": op4_url_filter,
    "op5_toxicity": op5_toxicity,
    "op6_debruijn_dedup": op6_debruijn_dedup,
    "op7_weak_supervision": op7_weak_supervision,
    "op8_water_filling_mix": op8_water_filling_mix,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_wrapper_extraction": op10_wrapper_extraction,
}

_OP4 = """
WITH r(host, path, rule, verdict) AS (VALUES
  ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'), ('www.example.com', '/en/', 'www.example.com/en/', 'allow'),
  ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block')),
u AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE regexp_extract(url, '(?s)^.*?://([^?#]*)', 1) END AS rest, ROW_NUMBER() OVER () AS n FROM pages),
h AS (SELECT page_id, n, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, CASE WHEN strpos(rest, '/') = 0 THEN '' ELSE substr(rest, strpos(rest, '/')) END AS path FROM u),
m AS (
  SELECT h.n, max_by(r.rule, length(r.host) * 100000 + length(r.path)) AS rule, max_by(r.verdict, length(r.host) * 100000 + length(r.path)) AS verdict
  FROM h JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path) GROUP BY h.n)
SELECT h.page_id, h.host, h.path, m.rule, COALESCE(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (n)
"""

_OP6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_transform(range(1, len(w) - 48), lambda j: md5(array_to_string(w[j:j + 49], ' '))) AS hs FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS j FROM l),
m AS (SELECT h, MIN(doc_id) AS lo FROM h GROUP BY h),
r AS (SELECT DISTINCT doc_id, j FROM h JOIN m USING (h) WHERE lo < doc_id),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
c AS (SELECT x.doc_id, x.i, x.word, MAX(r.j) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM x LEFT JOIN r ON r.doc_id = x.doc_id AND r.j = x.i),
k AS (SELECT doc_id, COUNT(*) FILTER (gone) AS n_removed, COALESCE(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(COALESCE(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(COALESCE(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

ORACLES: dict[str, str] = {"op4_url_filter": _OP4, "op6_debruijn_dedup": _OP6, "op8_water_filling_mix": mixing.ORACLE}
