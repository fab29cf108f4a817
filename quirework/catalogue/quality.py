"""Queries over text quality. What is recognised is the benchmark's text with letters confused, or the documents'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TRIM, WS, error_rate, normalise_line, normalise_report, report_tokens, round_to, split_lines
from ..functions.udfs import nfkc
from ..operators import quality
from ..operators.progress import display_positions
from ..runtime import spread, table


def plain(s: Column) -> Column:
    """Other characters than ASCII as ?, so that lengths are the same by whatever unit."""
    return F.regexp_replace(s, r"[^\x00-\x7F]", "?")


def confused(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, "th", "lh"), "on ", "or")


def text_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(
        "item_id", plain(normalise_line(F.col("text"))).alias("e"), plain(normalise_line(confused(F.col("text")))).alias("a")
    )
    rate = error_rate(F.col("e"), F.col("a"))
    return rows.select(
        "item_id", F.levenshtein("e", "a").alias("distance"), round_to(rate, 4).alias("cer"), round_to(1 - rate, 4).alias("accuracy")
    )


def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against a passage of the benchmark, of which all are taken in turn."""
    items = table(spark, sf_dir, "benchmark")
    order = display_positions(items.select(F.lit("benchmark").alias("project_id"), F.col("item_id").alias("page_index")))
    wanted = items.join(order.select(F.col("page_index").alias("item_id"), "position"), "item_id").select("position", F.col("text").alias("want"))
    turn = F.pmod("doc_id", F.lit(items.count())).alias("position")
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text", turn)).join(wanted, "position")
    toks = lambda c: report_tokens(F.coalesce(c, F.lit("")))
    return quality.token_overlap(rows.select("doc_id", toks("want").alias("expected"), toks("text").alias("actual")), ["doc_id"])


def report_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts normalised for reports, with compatibility characters composed first."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", normalise_report(nfkc(F.coalesce("text", F.lit("")))).alias("t"))
    return docs.select("doc_id", F.length("t").alias("n_chars"), F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"))


def provider_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as providers, by the share of their labelled documents that are good; one without labels has failed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("provider"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    got = docs.join(labels, "doc_id", "left").groupBy("provider").agg(F.avg("q").alias("accuracy"))
    error = F.when(F.col("accuracy").isNull() | (F.col("provider") == "src3"), "no result")
    rows = quality.ranked_providers(got.select("provider", F.round("accuracy", 6).alias("accuracy"), error.alias("error")))
    return rows.select("rank", "provider", "accuracy", "error", "line")


def _turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(split_lines(F.coalesce("text", F.lit("")))).alias("k", "t"))
    n = F.length("t")
    return turns.select(
        "conv_id", (F.col("turn") * 1000 + F.col("k")).cast("long").alias("index"),
        (F.pmod(n * 7919, F.lit(1000)) / 1000.0).alias("accuracy"), (F.pmod(n * 104729, F.lit(1000)) / 1000.0).alias("confidence"),
    )


def worst_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.representative_lines(_turn_lines(spark, sf_dir), ["conv_id"])


def aligned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's lines, words joined in fives, against themselves with letters confused and every third line lost."""
    words = F.filter(F.split(plain(F.col("text")), "\\s+"), lambda w: w != "")
    fives = F.transform(
        F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"))), lambda x: x["i"] % 5 == 0),
        lambda x: F.array_join(F.slice(words, x["i"] + 1, 5), " "),
    )
    rows = table(spark, sf_dir, "benchmark").select("item_id", fives.alias("expected"))
    kept = F.transform(F.filter(F.transform("expected", lambda e, i: F.struct(e.alias("e"), i.alias("i"))), lambda x: x["i"] % 3 != 1), lambda x: confused(x["e"]))
    rows = rows.withColumn("actual", kept)
    rows = rows.select("item_id", F.posexplode(F.arrays_zip(quality.align_lines(F.col("expected"), F.col("actual")).alias("i"), F.col("actual").alias("t"))).alias("line", "z"))
    return rows.select("item_id", "line", F.col("z.i").alias("baseline"), F.col("z.t").alias("text"))


def mean_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence of the words of each conversation; 0 where there are none."""
    turns = table(spark, sf_dir, "conversations")
    conf = F.when(F.col("role") == "user", F.pmod(F.length("text"), F.lit(100)) / 100.0)
    return turns.groupBy("conv_id").agg(F.round(F.coalesce(F.avg(conf), F.lit(0.0)), 6).alias("mean_confidence"), F.count("text").alias("n"))


QUERIES = {f.__name__: f for f in (text_cer, token_overlap, report_normalised, provider_ranking, worst_lines, aligned_lines, mean_confidence)}


def _line(t: str) -> str:
    s = f"regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}\\n ]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace(regexp_replace({s}, '{WS}+', ' ', 'g'), '{TRIM}', '', 'g'), '[^\\x00-\\x7F]', '?', 'g')"


def _report(t: str) -> str:
    s = f"translate({t}, '‘’“”—–', '''''\"\"--')"
    return f"lower(regexp_replace(regexp_replace({s}, '{WS}+', ' ', 'g'), '{TRIM}', '', 'g'))"


SQL = {
    "text_cer": f"""
WITH t AS (SELECT item_id, {_line("text")} AS e, {_line("regexp_replace(regexp_replace(text, 'th', 'lh', 'g'), 'on ', 'or', 'g')")} AS a FROM benchmark),
d AS (SELECT item_id, e, levenshtein(e, a) AS n, CASE WHEN length(e) > 0 THEN levenshtein(e, a) / length(e) ELSE 0 END AS r FROM t)
SELECT item_id, CAST(n AS INT) AS distance, floor(r * 10000 + 0.5) / 10000 AS cer, floor((1 - r) * 10000 + 0.5) / 10000 AS accuracy FROM d""",
    "token_overlap": f"""
WITH p AS (SELECT doc_id, {_report("coalesce(b.text, '')")} AS e, {_report("coalesce(d.text, '')")} AS a FROM documents d 
      JOIN (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n FROM benchmark) b ON b.k = ((doc_id % n) + n) % n),
x AS (SELECT doc_id, unnest(regexp_extract_all(e, '[a-z0-9'']+')) AS t, 1 AS e, 0 AS a FROM p
      UNION ALL SELECT doc_id, unnest(regexp_extract_all(a, '[a-z0-9'']+')) AS t, 0 AS e, 1 AS a FROM p),
c AS (SELECT doc_id, t, sum(e) AS e, sum(a) AS a FROM x GROUP BY ALL),
s AS (SELECT doc_id, CAST(sum(least(e, a)) AS BIGINT) AS matched, CAST(sum(e) AS BIGINT) AS expected_words, CAST(sum(a) AS BIGINT) AS actual_words FROM c GROUP BY doc_id),
z AS (SELECT p.doc_id, coalesce(matched, 0) AS matched, coalesce(expected_words, 0) AS expected_words, coalesce(actual_words, 0) AS actual_words FROM p LEFT JOIN s USING (doc_id)),
m AS (SELECT *, CASE WHEN actual_words > 0 THEN matched / actual_words ELSE 0 END AS p, CASE WHEN expected_words > 0 THEN matched / expected_words ELSE 0 END AS r FROM z)
SELECT doc_id, matched, expected_words, actual_words, floor(p * 10000 + 0.5) / 10000 AS precision, floor(r * 10000 + 0.5) / 10000 AS recall,
       floor(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END * 10000 + 0.5) / 10000 AS f1 FROM m""",
    "provider_ranking": """
WITH l AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
g AS (SELECT source AS provider, round(avg(q), 6) AS accuracy FROM documents LEFT JOIN l USING (doc_id) GROUP BY source),
e AS (SELECT *, CASE WHEN accuracy IS NULL OR provider = 'src3' THEN 'no result' END AS error FROM g),
f AS (SELECT *, CAST(greatest(0, least(24, floor(accuracy * 24 + 0.5))) AS INT) AS n FROM e)
SELECT CAST(row_number() OVER (ORDER BY CASE WHEN error IS NULL THEN accuracy END DESC NULLS LAST, provider) AS INT) AS rank, provider, accuracy, error,
       rpad(provider, 24, ' ') || CASE WHEN error IS NULL THEN rpad(printf('%.1f%%', floor(accuracy * 1000 + 0.5) / 10), 12, ' ') || repeat('█', n) || repeat('░', 24 - n) ELSE 'error    ' || error END AS line FROM f""",
    "worst_lines": f"""
WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\r?\\n'), lambda s: regexp_replace(s, '{TRIM}', '', 'g')), lambda s: s <> '') AS ls FROM conversations),
t AS (SELECT conv_id, turn * 1000 + k - 1 AS index, length(ls[k]) AS n FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS k FROM s)),
a AS (SELECT conv_id, CAST(index AS BIGINT) AS index, (n * 7919 % 1000) / 1000.0::DOUBLE AS accuracy, (n * 104729 % 1000) / 1000.0::DOUBLE AS confidence FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY index) AS r1, row_number() OVER (PARTITION BY conv_id ORDER BY accuracy, index) AS r2,
             row_number() OVER (PARTITION BY conv_id ORDER BY confidence, index) AS r3 FROM a),
o AS (SELECT *, CASE WHEN r1 <= 5 THEN r1 WHEN r2 <= 8 THEN 100 + r2 WHEN r3 <= 8 THEN 200 + r3 END AS o FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY o) AS pick FROM o WHERE o IS NOT NULL)
SELECT conv_id, index, accuracy, confidence FROM p WHERE pick <= 16""",
    "report_normalised": f"""
WITH t AS (SELECT doc_id, {_report("coalesce(text, '')")} AS t FROM documents) SELECT doc_id, CAST(length(t) AS INT) AS n_chars, sha256(t) AS text_sha256 FROM t""",
    "aligned_lines": f"""
WITH RECURSIVE w AS (SELECT item_id, list_filter(string_split_regex(regexp_replace(text, '[^\x00-\x7F]', '?', 'g'), '\\s+'), lambda w: w <> '') AS ws FROM benchmark),
e AS (SELECT item_id, list_transform(range(0, len(ws), 5), lambda i: array_to_string(ws[i + 1:i + 5], ' ')) AS ex FROM w),
a AS (SELECT *, list_transform(list_filter(range(len(ex)), lambda i: i % 3 <> 1), lambda i: regexp_replace(regexp_replace(ex[i + 1], 'th', 'lh', 'g'), 'on ', 'or', 'g')) AS ac FROM e),
n AS (SELECT item_id, ac, list_transform(ex, lambda s: {_line("s")}) AS en, list_transform(ac, lambda s: {_line("s")}) AS an FROM a),
r AS (SELECT item_id, 0 AS k, 0 AS upto, CAST(NULL AS BIGINT) AS best FROM n
      UNION ALL
      SELECT item_id, k + 1, CASE WHEN i >= 0 THEN i + 1 ELSE upto END, i FROM (
        SELECT item_id, k, upto, CASE WHEN upto < len(en) THEN upto + list_position(s, list_max(s)) - 1 ELSE len(en) - 1 END AS i FROM (
          SELECT r.item_id, r.k, r.upto, n.en, list_transform(n.en[r.upto + 1:r.upto + 8], lambda x:
                   CASE WHEN length(x) > 0 THEN 1 - levenshtein(x, n.an[r.k + 1]) / length(x) WHEN length(n.an[r.k + 1]) > 0 THEN 0 ELSE 1 END) AS s
          FROM r JOIN n ON n.item_id = r.item_id WHERE r.k < len(n.an))))
SELECT r.item_id, CAST(r.k - 1 AS INT) AS line, CAST(best AS INT) AS baseline, n.ac[r.k] AS text FROM r JOIN n ON n.item_id = r.item_id WHERE r.k > 0""",
    "mean_confidence": """
SELECT conv_id, round(coalesce(avg(CASE WHEN role = 'user' THEN (length(text) % 100) / 100.0::DOUBLE END), 0), 6) AS mean_confidence, count(text) AS n FROM conversations GROUP BY conv_id""",
}
