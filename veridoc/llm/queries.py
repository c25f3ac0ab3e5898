"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.llm import bpe, decontaminate, fingerprint, html_main, ngram_join, pii, quality, suffix_dedup, tokenfile, url_filter
from veridoc.llm.common import table


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_sets(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), word_bpe())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(table(spark, sf_dir, "pages"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform(F.coalesce("items", F.array().cast("array<bigint>")), lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.col("n_items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read_frames(tokenfile.write_frames(table(spark, sf_dir, "documents"), word_bpe(), 2))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_report(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS[:4])],
        F.sha2(pii.joined(F.filter("found", lambda s: s["kind"] < 4)), 256).alias("base_sha256"), pii.joined(F.col("found")).alias("spans"),
        F.size("found").cast("long").alias("n_spans"),
    )


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_suffix_dedup, op3_bpe, op4_quality, op5_html, op6_url_filter, op7_decontaminate, op8_token_files, op9_fingerprint, op10_pii)}
LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"coalesce(list_filter(regexp_split_to_array({LOWERED.format('text')}, '{decontaminate.GAPS_LOWERED}'), lambda x: x <> ''), [])"
RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in url_filter.RULES)

#: Operators that SQL expresses and that are quick enough in it on whole tables.
SQL: dict[str, str] = {
    "op6_url_filter": f"""
WITH rules(rhost, rpath, verdict) AS (VALUES {RULE_ROWS}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, coalesce({LOWERED.format("regexp_extract(rest, '^([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
urls AS (SELECT DISTINCT host, path FROM parts),
best AS (SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (host, path)""",
    "op7_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
items AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS s FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM items)),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT r, n, unnest(list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda k: {{'k': k, 's': array_to_string(w[k : k + n - 1], ' ')}})) AS x FROM d, sizes),
hits AS (SELECT r, spots.n AS n, x.k AS k, item_id FROM spots JOIN windows ON spots.n = windows.n AND x.s = windows.s),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN found USING (r)""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
