"""Queries over the progress of projects.

The event log stands for it: a user is a page of one of twenty projects, each
kind of event finishes a stage of the page, an error is a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..functions import languages as lang
from ..functions.text import format_bytes, format_bytes_scaled, format_bytes_whole
from ..operators import progress, rewind
from ..plans import stages as plans
from ..runtime import table

STAGE_OF = {"signup": "render", "view": "preprocess", "click": "detect", "purchase": "ocr"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    stage = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in STAGE_OF.items()), F.lit("detect"))
    status = F.when(F.col("event_type") == "error", "failed").when(F.pmod("event_id", F.lit(6)) == 0, "running").otherwise("done")
    return e.select(
        F.concat(F.lit("proj-"), F.pmod("user_id", F.lit(20)).cast("string")).alias("project_id"),
        F.col("user_id").alias("page_index"),
        stage.alias("stage"),
        status.alias("status"),
        F.when((F.col("event_type") == "error") & (F.pmod("event_id", F.lit(4)) > 0), F.concat(F.lit("failed at "), F.col("event_id").cast("string"))).alias("error"),
        F.col("event_id").alias("seq"),
        F.floor(F.col("value") * 100).cast("long").alias("size_bytes"),
    )


def pages(ev: DataFrame) -> DataFrame:
    return ev.select("project_id", "page_index").distinct()


def page_stage(ev: DataFrame) -> DataFrame:
    rows = ev.where("status = 'done'").groupBy("project_id", "page_index", "stage").agg(F.max_by("size_bytes", "seq").alias("size_bytes"), F.max("seq").alias("seq"))
    return rows.withColumn("overlay_bytes", F.when(F.col("stage") == "detect", F.col("seq") % 1000))


def builds(ev: DataFrame) -> DataFrame:
    """Every third project is built."""
    n = F.substring("project_id", 6, 9).cast("int")
    return ev.where(n % 3 == 0).groupBy("project_id").agg(F.max("size_bytes").alias("size_bytes"))


def project_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    rows = progress.project_progress(pages(ev), page_stage(ev), builds(ev))
    return rows.withColumn("label", progress.run_label(F.col("built"), F.col("partial")))


def progress_without_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return progress.project_progress(pages(ev), page_stage(ev), builds(ev), detect=False)


def incomplete_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return progress.incomplete_pages(pages(ev), page_stage(ev))


def progress_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return progress.progress_grid(pages(ev), page_stage(ev))


def page_status_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    flags = progress._page_done(pages(ev), page_stage(ev), progress.required_stages())
    last = progress.latest_events(ev).select("project_id", "page_index", F.when(F.col("status") == "running", F.col("stage")).alias("running"))
    rows = flags.join(last, ["project_id", "page_index"])
    label = progress.status_label(F.col("running"), {s: F.col(f"has_{s}") for s in progress.required_stages()})
    return rows.select("project_id", "page_index", label.alias("label"))


def latest_event_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.latest_events(events(spark, sf_dir))


def failure_banner(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return progress.failures(ev, builds(ev))


def invalidation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return progress.invalidation(page_stage(ev), builds(ev), ("detect", "ocr"))


def artifact_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return progress.artifact_bytes(page_stage(ev), builds(ev))


def size_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' sizes against what their projects' build would be, in three ways of writing sizes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 37).alias("source"))
    built = F.when(F.pmod("doc_id", F.lit(9)) > 0, F.floor(F.col("source") * (F.pmod("doc_id", F.lit(7)) + 17) / 20)).cast("long")
    rows = docs.withColumn("built", built).withColumn("d", progress.size_delta(F.col("source"), F.col("built")))
    return rows.select(
        "doc_id", F.col("d.percent").alias("percent"), F.col("d.tone").alias("tone"), F.length("d.label").alias("label_chars"),
        F.regexp_extract(format_bytes(F.col("source")), "[A-Z]+$", 0).alias("unit"),
        F.regexp_extract(format_bytes_whole(F.col("source")), "[A-Z]+$", 0).alias("unit_whole"),
        F.regexp_extract(format_bytes_scaled(F.col("source")), "[A-Z]+$", 0).alias("unit_scaled"),
    )


def display_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages keep their index, which has holes where a project's neighbours are others'; positions close up."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), F.col("doc_id").alias("page_index"))
    return progress.display_positions(docs)


def cache_miss_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose preprocess artifact is missing or was made with other settings."""
    ev = events(spark, sf_dir)
    settings = hashing.default_settings()
    have = page_stage(ev).where("stage = 'preprocess'").withColumn(
        "hash", F.when(F.col("seq") % 5 > 0, hashing.settings_hash(settings, "preprocess")).otherwise("0" * 16)
    )
    wanted = pages(ev).select("project_id", "page_index", F.lit("preprocess").alias("stage"), hashing.settings_hash(settings, "preprocess").alias("hash"))
    return plans.cache_misses(wanted, have)


def rewind_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each project's stages when proj-4 is rewound to detect and a page of proj-5 is removed."""
    ev = events(spark, sf_dir)
    digest = F.substring(F.sha2(F.concat("stage", F.col("seq").cast("string")).cast("binary"), 256), 1, 16)
    path = hashing.artifact_path(F.col("project_id"), F.col("page_index"), F.col("stage"), digest, F.lit("bin"))
    ps = page_stage(ev).withColumn("artifact_path", path).withColumn("overlay_path", F.when(F.col("stage") == "detect", hashing.overlay_path(F.col("project_id"), F.col("page_index"), digest)))
    ps, left, gone = rewind.rewind(ps, builds(ev), "proj-4", "detect")
    projects = pages(ev).groupBy("project_id").agg(F.count(F.lit(1)).cast("int").alias("page_count"))
    projects, pg, ps, left, more = rewind.remove_page(projects, pages(ev), ps, left, "proj-5", 25)
    kept = ps.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_artifacts"))
    lost = gone.unionByName(more).groupBy("project_id").agg(F.count(F.lit(1)).alias("n_deleted"))
    rows = projects.join(kept, "project_id", "left").join(lost, "project_id", "left").join(left.select("project_id", F.lit(True).alias("b")), "project_id", "left")
    return rows.select("project_id", "page_count", F.coalesce("n_artifacts", F.lit(0)).alias("n_artifacts"), F.coalesce("n_deleted", F.lit(0)).alias("n_deleted"), F.coalesce("b", F.lit(False)).alias("built"))


def script_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.script_vote(_script_pages(spark, sf_dir))


def _script_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of a document stands for its script, its labels for the detector's confidence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    script = F.when(F.col("lang").isin("en", "fr"), "Latin").when(F.col("lang") == "de", "Cyrillic").otherwise("Han")
    return docs.join(labels, "doc_id", "left").select(
        F.col("source").alias("project_id"), script.alias("script"), (F.col("q") * 2.0 + F.pmod("doc_id", F.lit(2))).alias("confidence")
    )


def language_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = script_vote(spark, sf_dir)
    chosen = votes.select("project_id", F.explode(lang.parse_languages(F.concat(F.lit("eng + fra+"), F.lit("chi_sim")))).alias("code"))
    return progress.suggestions(votes, lang.languages(spark), chosen)


def language_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    value = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lit("eng+eng")).otherwise(F.concat(F.lit("eng+"), F.col("lang"), F.lit("+eng")))
    rows = docs.select("doc_id", lang.join_languages(lang.parse_languages(value)).alias("joined"), lang.model_path(value, "https://models.example/").alias("m"), lang.model_url(F.col("lang"), "https://models.example/").alias("url"))
    return rows.select("doc_id", "joined", F.col("m.path").alias("path"), F.col("m.gzip").alias("gzip"), "url")


def settings_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashes of every stage for each resolution that the documents' ids give."""
    docs = table(spark, sf_dir, "documents").select((F.pmod("doc_id", F.lit(4)) * 100 + 100).cast("int").alias("dpi")).distinct()
    s = hashing.default_settings().withField("render.dpi", F.col("dpi"))
    return docs.select("dpi", F.explode(F.array(*(F.struct(F.lit(st).alias("stage"), hashing.settings_hash(s, st).alias("hash")) for st in hashing.STAGES))).alias("x")).select("dpi", "x.*")


def artifact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    digest = hashing.short_hash(F.col("doc_id").cast("string"))
    pid = hashing.project_id(F.col("source"))
    return docs.select(
        "doc_id", hashing.artifact_path(pid, F.col("doc_id"), F.lit("ocr"), digest, F.lit("json")).alias("path"),
        hashing.overlay_path(pid, F.col("doc_id"), digest).alias("overlay"), hashing.output_path(pid, digest).alias("output"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        project_progress, progress_without_detect, incomplete_pages, progress_grid, page_status_label, latest_event_per_page,
        failure_banner, invalidation_report, artifact_bytes, size_delta, display_positions, cache_miss_work, rewind_status,
        script_vote, language_suggestions, language_paths, settings_hash, artifact_paths,
    )
}

_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STAGE_OF.items())
_EV = f"""
ev AS (SELECT 'proj-' || (user_id % 20) AS project_id, user_id AS page_index, CASE event_type {_CASES} ELSE 'detect' END AS stage,
              CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 6 = 0 THEN 'running' ELSE 'done' END AS status,
              CASE WHEN event_type = 'error' AND event_id % 4 > 0 THEN 'failed at ' || event_id END AS error,
              event_id AS seq, CAST(floor(value * 100) AS BIGINT) AS size_bytes FROM events),
pg AS (SELECT DISTINCT project_id, page_index FROM ev),
ps AS (SELECT project_id, page_index, stage, arg_max(size_bytes, seq) AS size_bytes, max(seq) AS seq,
              CASE WHEN stage = 'detect' THEN max(seq) % 1000 END AS overlay_bytes FROM ev WHERE status = 'done' GROUP BY project_id, page_index, stage),
bd AS (SELECT project_id, max(size_bytes) AS size_bytes FROM ev WHERE CAST(project_id[6:] AS INT) % 3 = 0 GROUP BY project_id),
fl AS (SELECT pg.project_id, pg.page_index, count(*) FILTER (stage = 'render') > 0 AS r, count(*) FILTER (stage = 'preprocess') > 0 AS p,
              count(*) FILTER (stage = 'detect') > 0 AS d, count(*) FILTER (stage = 'ocr') > 0 AS o
       FROM pg LEFT JOIN ps USING (project_id, page_index) GROUP BY ALL)"""


def _progress_sql(detect: bool) -> str:
    n = "CAST(r AS INT) + CAST(p AS INT) + CAST(o AS INT)" + (" + CAST(d AS INT)" if detect else "")
    k = 4 if detect else 3
    mid = "WHEN NOT bool_and(d) THEN 'detect'" if detect else ""
    label = ", CASE WHEN built THEN 'Re-run' WHEN partial THEN 'Resume' ELSE 'Run' END AS label" if detect else ""
    return f"""
WITH {_EV},
s AS (SELECT project_id, count(*) AS page_count, sum({n}) AS done, count(*) FILTER ({n} < {k}) AS n_incomplete,
             CASE WHEN NOT bool_and(r) THEN 'render' WHEN NOT bool_and(p) THEN 'preprocess' {mid} WHEN NOT bool_and(o) THEN 'ocr' END AS miss FROM fl GROUP BY project_id),
t AS (SELECT s.*, bd.project_id IS NOT NULL AS built, CAST(done AS BIGINT) + CASE WHEN bd.project_id IS NOT NULL THEN 1 ELSE 0 END AS stages_done, page_count * {k} + 1 AS stages_total FROM s LEFT JOIN bd USING (project_id)),
u AS (SELECT project_id, page_count, stages_done, stages_total, round(stages_done / stages_total, 6) AS ratio, n_incomplete,
             coalesce(miss, CASE WHEN NOT built THEN 'build' END) AS earliest_missing, stages_done > 0 AND stages_done < stages_total AS partial, built FROM t)
SELECT *{label} FROM u"""


SQL = {
    "project_progress": _progress_sql(True),
    "progress_without_detect": _progress_sql(False),
    "incomplete_pages": f"WITH {_EV} SELECT project_id, page_index FROM fl WHERE NOT (r AND p AND d AND o)",
    "progress_grid": f"""WITH {_EV} SELECT pg.project_id, pg.page_index, s.stage, ps.stage IS NOT NULL AS done
FROM pg CROSS JOIN (SELECT unnest(['render', 'preprocess', 'detect', 'ocr']) AS stage) s LEFT JOIN ps ON ps.project_id = pg.project_id AND ps.page_index = pg.page_index AND ps.stage = s.stage""",
    "page_status_label": f"""WITH {_EV},
la AS (SELECT project_id, page_index, arg_max(stage, seq) AS stage, arg_max(status, seq) AS status FROM ev GROUP BY ALL)
SELECT project_id, page_index, CASE WHEN status = 'running' THEN stage WHEN o THEN 'ocr done' WHEN d THEN 'detect done' WHEN p THEN 'preprocess done' WHEN r THEN 'rendered' ELSE 'queued' END AS label
FROM fl JOIN la USING (project_id, page_index)""",
    "latest_event_per_page": f"WITH {_EV} SELECT project_id, page_index, arg_max(stage, seq) AS stage, arg_max(status, seq) AS status, max(seq) AS seq FROM ev GROUP BY project_id, page_index",
    "failure_banner": f"""WITH {_EV},
f AS (SELECT project_id, stage, page_index, max(seq) AS seq FROM ev WHERE status = 'failed' AND project_id NOT IN (SELECT project_id FROM bd) GROUP BY ALL),
g AS (SELECT f.*, coalesce(ev.error, 'unknown error') AS error FROM f JOIN ev USING (seq))
SELECT project_id, CAST(rank AS INT) AS rank, stage, page_index, error, seq
FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY seq DESC) AS rank FROM (SELECT f.project_id, f.stage, f.page_index, f.seq, g.error FROM f JOIN g USING (seq))) WHERE rank <= 3""",
    "invalidation_report": f"""WITH {_EV}, x AS (SELECT project_id, size_bytes FROM ps WHERE stage IN ('detect', 'ocr') UNION ALL SELECT project_id, size_bytes FROM bd)
SELECT project_id, count(*) AS artifact_count, CAST(sum(coalesce(size_bytes, 0)) AS BIGINT) AS byte_count FROM x GROUP BY project_id""",
    "artifact_bytes": f"""WITH {_EV}, x AS (SELECT project_id, coalesce(size_bytes, 0) + coalesce(overlay_bytes, 0) AS b FROM ps UNION ALL SELECT project_id, coalesce(size_bytes, 0) FROM bd)
SELECT project_id, CAST(sum(b) AS BIGINT) AS bytes FROM x GROUP BY project_id""",
    "size_delta": """
WITH s AS (SELECT doc_id, n_chars * 37 AS source FROM documents),
b AS (SELECT *, CASE WHEN doc_id % 9 > 0 THEN CAST(floor(source * (doc_id % 7 + 17) / 20) AS BIGINT) END AS built FROM s),
p AS (SELECT *, CASE WHEN source > 0 AND built > 0 THEN CAST(floor((built - source) / source * 100 + 0.5) AS BIGINT) END AS percent FROM b),
f AS (SELECT *, CASE WHEN source < 1024 THEN source || ' B' WHEN source < 1048576 THEN printf('%.1f', source / 1024.0::DOUBLE) || ' KB' ELSE printf('%.1f', source / 1048576.0::DOUBLE) || ' MB' END AS fs,
             CASE WHEN built < 1024 THEN built || ' B' WHEN built < 1048576 THEN printf('%.1f', built / 1024.0::DOUBLE) || ' KB' ELSE printf('%.1f', built / 1048576.0::DOUBLE) || ' MB' END AS fb FROM p)
SELECT doc_id, percent, CASE WHEN percent IS NULL THEN NULL WHEN percent <= -5 THEN 'smaller' WHEN percent >= 5 THEN 'larger' ELSE 'same' END AS tone,
       CAST(length(fs || ' → ' || fb || ' (' || CASE WHEN percent >= 0 THEN '+' ELSE '' END || percent || '%)') AS INT) AS label_chars,
       regexp_extract(fs, '[A-Z]+$', 0) AS unit, regexp_extract(fs, '[A-Z]+$', 0) AS unit_whole, regexp_extract(fs, '[A-Z]+$', 0) AS unit_scaled FROM f""",
    "display_positions": "SELECT source AS project_id, doc_id AS page_index, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position FROM documents",
    "cache_miss_work": f"""WITH {_EV}, h AS (SELECT substr(sha256('{{"settings":{{"preprocess":{{"binarizer":"sauvola","denoiseRadius":1,"deskew":true,"orientationDetect":true}},"render":{{"dpi":300}}}},"stage":"preprocess"}}'), 1, 16) AS hash)
SELECT pg.project_id, pg.page_index, 'preprocess' AS stage, h.hash FROM pg, h
WHERE NOT EXISTS (SELECT 1 FROM ps WHERE ps.project_id = pg.project_id AND ps.page_index = pg.page_index AND ps.stage = 'preprocess' AND ps.seq % 5 > 0)""",
    "rewind_status": f"""WITH {_EV},
k AS (SELECT * FROM ps WHERE NOT (project_id = 'proj-4' AND stage IN ('detect', 'ocr')) AND NOT (project_id = 'proj-5' AND page_index = 25)),
x AS (SELECT project_id, stage FROM ps WHERE (project_id = 'proj-4' AND stage IN ('detect', 'ocr')) OR (project_id = 'proj-5' AND page_index = 25)),
c AS (SELECT project_id, count(*) AS n FROM pg GROUP BY project_id)
SELECT c.project_id, CAST(CASE WHEN c.project_id = 'proj-5' THEN greatest(0, n - 1) ELSE n END AS INT) AS page_count,
       (SELECT count(*) FROM k WHERE k.project_id = c.project_id) AS n_artifacts,
       (SELECT coalesce(sum(CASE WHEN stage = 'detect' THEN 2 ELSE 1 END), 0)::BIGINT FROM x WHERE x.project_id = c.project_id) AS n_deleted,
       c.project_id IN (SELECT project_id FROM bd) AND c.project_id NOT IN ('proj-4', 'proj-5') AS built FROM c""",
    "settings_hash": """
WITH d AS (SELECT DISTINCT CAST(doc_id % 4 * 100 + 100 AS INT) AS dpi FROM documents),
j AS (SELECT dpi, '"render":{"dpi":' || dpi || '}' AS r, '"preprocess":{"binarizer":"sauvola","denoiseRadius":1,"deskew":true,"orientationDetect":true}' AS p,
             '"detect":{"enabled":true}' AS d, '"ocr":{"language":"eng","providerId":"tesseract"}' AS o FROM d),
s AS (SELECT dpi, unnest([{'stage': 'render', 'b': r}, {'stage': 'preprocess', 'b': p || ',' || r}, {'stage': 'detect', 'b': d || ',' || p || ',' || r},
                          {'stage': 'ocr', 'b': d || ',' || o || ',' || p || ',' || r}, {'stage': 'build', 'b': d || ',' || o || ',' || p || ',' || r}]) AS x FROM j)
SELECT dpi, x.stage AS stage, substr(sha256('{"settings":{' || x.b || '},"stage":"' || x.stage || '"}'), 1, 16) AS hash FROM s""",
    "artifact_paths": """
WITH a AS (SELECT doc_id, 'proj-' || substr(sha256(source), 1, 8) AS p, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS h FROM documents)
SELECT doc_id, p || '/pages/' || doc_id || '/ocr.' || h || '.json' AS path, p || '/pages/' || doc_id || '/detect-overlay.' || h || '.png' AS overlay, p || '/output.' || h || '.pdf' AS output FROM a""",
    "language_paths": """
WITH v AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN 'eng+eng' ELSE 'eng+' || lang || '+eng' END AS value FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR lang = 'eng' THEN 'eng' ELSE 'eng+' || lang END AS joined,
       CASE WHEN doc_id % 3 = 0 OR lang = 'eng' THEN '/tesseract/' ELSE 'https://models.example/' END AS path,
       NOT (doc_id % 3 = 0 OR lang = 'eng') AS gzip, 'https://models.example/' || lang || '.traineddata.gz' AS url FROM v""",
}

_VOTE = """
pg AS (SELECT source AS project_id, CASE WHEN lang IN ('en', 'fr') THEN 'Latin' WHEN lang = 'de' THEN 'Cyrillic' ELSE 'Han' END AS script,
              q * 2.0 + doc_id % 2 AS confidence FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id)),
c AS (SELECT project_id, script, count(*) FILTER (coalesce(confidence, 0) >= 1.5) AS n, count(*) AS al FROM pg GROUP BY ALL),
t AS (SELECT project_id, sum(n)::BIGINT AS confident_pages, sum(al)::BIGINT AS total_pages FROM c GROUP BY project_id),
v AS (SELECT c.project_id, c.script, c.n AS page_count, confident_pages, total_pages FROM c JOIN t USING (project_id) WHERE c.n > 0 AND c.n * 2 > confident_pages)"""
SQL["script_vote"] = f"WITH {_VOTE} SELECT * FROM v"
SQL["language_suggestions"] = f"""WITH {_VOTE},
l AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{c}', '{s}')" for k, (c, _, s) in enumerate(lang.LANGUAGES))}) AS l(position, code, script))
SELECT project_id, CAST(rank AS INT) AS rank, code FROM (
  SELECT v.project_id, l.code, row_number() OVER (PARTITION BY v.project_id ORDER BY l.position) AS rank
  FROM v JOIN l ON contains(lower(l.script), lower(v.script)) WHERE l.code NOT IN ('eng', 'fra', 'chi_sim')) WHERE rank <= 3"""
