"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import shared_dir, spread, table
from . import (
    decontamination,
    exact_dedup,
    lm_scoring,
    packing,
    secret_scan,
    sharding,
    simhash,
    token_counts,
    toxicity,
    url_filter,
)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a ledger of the run's own in the shared folder, so that every blob is unseen and the whole table is scanned
    ledger = f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"
    found = secret_scan.scan(table(spark, sf_dir, "documents"), ledger_dir=ledger)
    spans = secret_scan.written(F.col("findings"))
    return found.select(
        "doc_id",
        *(secret_scan.count_of(F.col("findings"), k).alias(f"n_{r.kind}") for k, r in enumerate(secret_scan.BASE_RULES)),
        F.sha2(spans.cast("binary"), 256).alias("base_sha256"),
        spans.alias("spans"),
    )


def _op6_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS kind_no, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(x, '{p}') AS gaps, "
        f"regexp_extract_all(x, '{p}', 0) AS whole, regexp_extract_all(x, '{p}', {r.group}) AS part FROM t"
        for k, r in enumerate(secret_scan.BASE_RULES)
        for p in [r.pattern.replace("'", "''")]
    )
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
m AS ({parts}),
p AS (SELECT doc_id, kind_no, kind, least, i, length(gaps[i]) AS gap, length(whole[i]) AS n, length(part[i]) AS pn
      FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM m)),
e AS (SELECT *, sum(gap + n) OVER (PARTITION BY doc_id, kind_no ORDER BY i) AS stop FROM p),
s AS (SELECT doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access,
             count(*) FILTER (kind_no = 2) AS n_hex,
             string_agg(kind || ':' || CAST(CAST(stop - n AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR), ',' ORDER BY stop - n, kind_no) AS spans
      FROM e WHERE pn >= least GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN s USING (doc_id)
"""


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of the pages whose document, numbered in the path, has labels."""
    url = F.col("url")
    refs = pages.select(
        url_filter.host_of(url).alias("host"),
        F.expr("try_cast(nullif(regexp_extract(url, '^.*?://[^/?#]*/[a-z]+/([0-9]+)', 1), '') as bigint)").alias("doc_id"),
    )
    # null where the labels do not tell
    bad = ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")
    return refs.join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("host", "bad")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, page_outcomes(pages, table(spark, sf_dir, "labels")))


def _op7_sql() -> str:
    ordered = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))", h + p, act) for act, h, p in ordered]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{n}'" for f, n, _ in fits) + " END"
    act = "CASE " + " ".join(f"WHEN {f} THEN '{a}'" for f, _, a in fits) + " END"
    two = ", ".join(f"'{s}'" for s in url_filter.TWO_LABEL_SUFFIXES)
    last = lambda n: f"array_to_string(string_split(host, '.')[-{n}:], '.')"
    suffix = f"CASE WHEN {last(2)} IN ({two}) THEN {last(2)} ELSE {last(1)} END"
    domain = f"CASE WHEN {last(2)} IN ({two}) THEN {last(3)} ELSE {last(2)} END"
    low, high = url_filter.STRENGTH

    def level(name: str, source: str) -> str:
        return f"""
{name}_m AS (SELECT CASE WHEN d IS NULL OR d = 0 OR (s - e) / d <= 0 THEN {high}
                         ELSE least({high}, greatest({low}, d / (s - e) - 1)) END AS m
  FROM (SELECT sum(n * (bad / n - mu) ** 2) AS s, sum(mu * (1 - mu)) AS e, sum(mu * (1 - mu) * (n - 1)) AS d FROM {source})),
{name}_p AS (SELECT k, (m * mu + bad) / (m + n) AS mean, CAST(m + n AS DOUBLE) AS weight FROM {source}, {name}_m)"""

    return f"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{url_filter._UPPER}', '{url_filter._LOWER}'), '') AS host,
                  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
           FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages)),
v AS (SELECT *, {suffix} AS suffix, {domain} AS domain FROM u),
o AS (SELECT v.host, v.suffix, v.domain, CAST(toxic = 1 OR quality = 0 AS INT) AS bad
      FROM v JOIN labels l ON l.doc_id = TRY_CAST(nullif(regexp_extract(v.path, '^/[a-z]+/([0-9]+)', 1), '') AS BIGINT) WHERE (toxic = 1 OR quality = 0) IS NOT NULL),
h AS (SELECT host, suffix, domain, CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad FROM o GROUP BY ALL),
g AS (SELECT (coalesce(sum(bad), 0) + 1.0) / (coalesce(sum(n), 0) + 2.0) AS mean, coalesce(sum(n), 0) + 2.0 AS weight FROM h),
suffix_s AS (SELECT suffix AS k, sum(n) AS n, sum(bad) AS bad, (SELECT mean FROM g) AS mu FROM h GROUP BY suffix),{level("suffix", "suffix_s")},
domain_s AS (SELECT x.k, x.n, x.bad, p.mean AS mu FROM (SELECT domain AS k, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL) x JOIN suffix_p p ON p.k = x.suffix),{level("domain", "domain_s")},
host_s AS (SELECT host AS k, n, bad, p.mean AS mu FROM h JOIN domain_p p ON p.k = h.domain),{level("host", "host_s")},
j AS (SELECT v.*, coalesce(a.mean, b.mean, c.mean, g.mean) AS mean, coalesce(a.weight, b.weight, c.weight, g.weight) AS weight
      FROM v CROSS JOIN g LEFT JOIN host_p a ON a.k = v.host LEFT JOIN domain_p b ON b.k = v.domain LEFT JOIN suffix_p c ON c.k = v.suffix)
SELECT page_id, host, path, {rule} AS rule,
       coalesce({act}, CASE WHEN mean - {url_filter.Z} * sqrt(mean * (1 - mean) / (weight + 1)) > {url_filter.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM j
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spread(table(spark, sf_dir, "documents")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(spread(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_toxicity": op3_toxicity,
        "op4_simhash": op4_simhash,
        "op5_decontamination": op5_decontamination,
        "op6_secret_scan": op6_secret_scan,
        "op7_url_filter": op7_url_filter,
        "op8_packing": op8_packing,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_token_counts": op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": OP2_SQL,
        "op6_secret_scan": _op6_sql(),
        "op7_url_filter": _op7_sql(),
    }
