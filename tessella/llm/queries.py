"""The operators with their production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import exact_dedup, lm_scoring, mixing, packing, quality_classifier, quality_rules, simhash, token_counts, toxicity, url_filter
from tessella.runtime import table

RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.selectExpr("doc_id", "size", "source_size", "target", "copies * size AS taken")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return token_counts.token_counts(table(spark, sf_dir, "documents"), file.read())


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify_quality(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_url_filters, op3_source_mixing, op4_lm_scoring, op5_quality_rules, op6_toxicity, op7_token_counts,
        op8_quality_classifier, op9_simhash, op10_exact_dedup,
    )
}

ORACLES: dict[str, str] = {
    "op2_url_filters": r"""
        WITH rules(verdict, rule, host, path) AS (VALUES
            ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'),
            ('allow', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'),
            ('block', 'org/es/', 'org', '/es/')),
        parts AS (SELECT page_id,
            translate(regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            regexp_extract(coalesce(url, ''), '(?s)://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
        hits AS (SELECT p.*, (SELECT max_by({'rule': r.rule, 'verdict': r.verdict}, length(r.rule)) FROM rules r
            WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS hit FROM parts p)
        SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, 'allow') AS verdict FROM hits""",
    "op3_source_mixing": r"""
        WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
        sources AS (SELECT source, sum(size) AS source_size FROM sized GROUP BY source),
        weighted AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 3 AS ceiling FROM sources),
        stepped AS (SELECT *, ceiling::DOUBLE / weight AS per_weight,
            coalesce(sum(ceiling) OVER earlier, 0) AS given, coalesce(sum(weight) OVER earlier, 0) AS spent,
            sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM weighted
            WINDOW earlier AS (ORDER BY ceiling::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        shared AS (SELECT min_by((total - given)::DOUBLE / (weights - spent)::DOUBLE, (per_weight, source IS NULL, coalesce(source, ''))) AS share FROM stepped
            WHERE per_weight >= (total - given)::DOUBLE / (weights - spent)::DOUBLE),
        targets AS (SELECT source, source_size::BIGINT AS source_size, least(ceiling::DOUBLE, coalesce(weight * share, ceiling::DOUBLE)) AS target FROM stepped, shared),
        ranks AS (SELECT s.doc_id, s.size::BIGINT AS size, t.source_size, t.target,
            row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS FIRST) - 1 AS rank,
            CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS expected,
            ('0x' || substr(sha256('17:' || coalesce(s.source, '')), 1, 4))::INT / 65536.0::DOUBLE AS start
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
            (least(floor((rank + 1) * expected + start) - floor(rank * expected + start), 3) * size)::BIGINT AS taken FROM ranks""",
    "op10_exact_dedup": r"""
        WITH rows AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
        groups AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM rows GROUP BY body)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256 FROM rows JOIN groups USING (body)""",
}
