"""Queries over stages, builds, settings and the progress log as a stream.

Documents are the pages of their sources' projects, as in the layout queries;
rewinds and streams work on the event log of the progress queries.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing
from ..operators import rewind
from ..plans import control, stages
from ..runtime import shared_dir, table
from ..streaming import progress as streams
from . import progress

OTSU = hashing.DEFAULTS | {"preprocess": hashing.DEFAULTS["preprocess"] | {"binarizer": "otsu"}}


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their text; every thirteenth is turned by hand."""
    docs = table(spark, sf_dir, "documents")
    turn = F.when(F.pmod("doc_id", F.lit(13)) == 0, 90)
    return docs.select(F.col("source").alias("project_id"), F.col("doc_id").cast("int").alias("page_index"), turn.alias("rotation_override"), F.coalesce("text", F.lit("")).alias("text"))


def _short(c):
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 16)


def _preprocess(spark: SparkSession, sf_dir: str) -> stages.StageRun:
    """Some pages have no input, some an artifact under this or another key, some cannot be read."""
    pages, n = _pages(spark, sf_dir), F.length("text")
    index, settings = F.col("page_index"), hashing.default_settings()
    digest = F.when(F.pmod(index, F.lit(8)) == 0, hashing.settings_hash(settings, "preprocess")).otherwise("0" * 16)
    status = pages.where(F.pmod(index, F.lit(4)) == 0).select(
        "project_id", "page_index", F.lit("preprocess").alias("stage"), digest.alias("hash"), F.lit("old").alias("artifact_path"), F.lit(3).cast("long").alias("size_bytes")
    )
    inputs = pages.where(F.pmod(n, F.lit(9)) != 0).select("project_id", "page_index", F.col("text").alias("payload"))
    stored = pages.where(F.pmod(index, F.lit(3)) != 0).select("project_id", "page_index", F.lit("old").alias("payload"))

    def compute(work: DataFrame) -> DataFrame:
        bad = F.pmod(F.length("payload"), F.lit(7)) == 0
        return work.select("project_id", "page_index", F.when(~bad, _short(F.col("payload"))).alias("payload"), F.when(bad, "unreadable").alias("error"))

    return stages.run_stage("preprocess", settings, pages, status, inputs, stored, compute)


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _preprocess(spark, sf_dir)
    return run.events.join(run.results, ["project_id", "page_index"], "left")


def stage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preprocess(spark, sf_dir).status


def stage_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All page stages, one after the other; some pages fail at preprocess, some at detect, and the others go on."""
    pages = _pages(spark, sf_dir)
    status = spark.createDataFrame([], "project_id string, page_index int, stage string, hash string, artifact_path string, size_bytes long")
    none = spark.createDataFrame([], "project_id string, page_index int, payload string")

    def compute(fails):
        error = F.when(fails, "unreadable")
        return lambda work: work.select("project_id", "page_index", F.when(~fails, _short(F.col("payload"))).alias("payload"), error.alias("error"))

    computes = {s: compute(F.lit(False)) for s in hashing.PAGE_STAGES}
    computes["preprocess"] = compute(F.pmod("page_index", F.lit(17)) == 3)
    computes["detect"] = compute(F.pmod("page_index", F.lit(11)) == 5)
    held = {"source": pages.select("project_id", "page_index", F.col("text").alias("payload")), **{s: none for s in hashing.PAGE_STAGES}}
    _, results, events = stages.run_from("all", hashing.default_settings(), pages, status, held, computes)
    texts = results["ocr"].select("project_id", "page_index", F.lit("ocr").alias("stage"), F.lit("done").alias("status"), "payload")
    return events.join(texts, ["project_id", "page_index", "stage", "status"], "left")


def single_page_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stage again for two pages of each project that has them, detect switched off for the rest."""
    pages = _pages(spark, sf_dir)
    inputs = pages.select("project_id", "page_index", F.col("text").alias("payload"))
    status = spark.createDataFrame([], "project_id string, page_index int, stage string, hash string, artifact_path string, size_bytes long")
    compute = lambda work: work.withColumn("error", F.lit(None).cast("string"))
    run = stages.run_stage("ocr", hashing.default_settings(), pages, status, inputs, inputs.limit(0), compute, page_indices=[1, 5])
    off = stages.run_stage("detect", hashing.default_settings(), pages, run.status, inputs, inputs.limit(0), compute, enabled=False)
    return run.events.unionByName(off.events)


def build_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects that lack a page's text, that are built under this key or another, or not at all."""
    pages, settings = _pages(spark, sf_dir), hashing.default_settings()
    lost = F.col("project_id").isin("src1", "src4") & (F.pmod("page_index", F.lit(5)) == 0)
    results = pages.where(~lost).select("project_id", "page_index", F.col("text").alias("payload"))
    status = pages.select("project_id", "page_index", F.lit("preprocess").alias("stage"), (F.pmod("page_index", F.lit(4)) * 90).cast("int").alias("osd_angle"))
    named = pages.select("project_id").distinct()
    digest = F.when(F.col("project_id") == "src2", hashing.settings_hash(settings, "build")).otherwise("0" * 16)
    builds = named.where("project_id IN ('src2', 'src3')").select("project_id", digest.alias("hash"), F.lit("old").alias("artifact_path"), F.lit(1).cast("long").alias("size_bytes"))
    stored = builds.select("project_id", F.lit("old").cast("binary").alias("content"))

    def compute(rows: DataFrame) -> DataFrame:
        made = F.concat_ws(",", F.count(F.lit(1)), F.sum(F.length("payload")), F.sum("osd_angle")).cast("binary")
        return rows.groupBy("project_id").agg(made.alias("content")).withColumn("size_bytes", F.length("content"))

    run = stages.run_build(settings, pages, results, status, builds, stored, compute)
    rows = run.events.select("project_id", "page_index", "status", "error").join(run.builds, "project_id", "left")
    return rows.join(run.documents.select("project_id", F.col("content").cast("string").alias("content")), "project_id", "left")


def rotation_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page turned by hand: what is left of its project, what is deleted, and the angle that holds."""
    ev = progress.events(spark, sf_dir)
    ps = _stored(ev)
    pages = progress.pages(ev).withColumn("rotation_override", F.lit(None).cast("int"))
    pages, left, builds, gone = rewind.override_rotation(pages, ps, progress.builds(ev), "proj-6", 6, 90)
    kept = left.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_artifacts"))
    out = gone.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_deleted"))
    turned = pages.groupBy("project_id").agg(F.max("rotation_override").alias("angle"))
    rows = turned.join(kept, "project_id", "left").join(out, "project_id", "left").join(builds.select("project_id", F.lit(True).alias("built")), "project_id", "left")
    return rows.select("project_id", "angle", F.coalesce("n_artifacts", F.lit(0)).alias("n_artifacts"), F.coalesce("n_deleted", F.lit(0)).alias("n_deleted"), F.coalesce("built", F.lit(False)).alias("built"))


def _stored(ev: DataFrame) -> DataFrame:
    digest = F.substring(F.sha2(F.concat("stage", F.col("seq").cast("string")).cast("binary"), 256), 1, 16)
    path = hashing.artifact_path(F.col("project_id"), F.col("page_index"), F.col("stage"), digest, F.lit("bin"))
    overlay = F.when(F.col("stage") == "detect", hashing.overlay_path(F.col("project_id"), F.col("page_index"), digest))
    return progress.page_stage(ev).withColumn("artifact_path", path).withColumn("overlay_path", overlay)


def settings_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What another binarizer would discard of each project, and what is left of one project once it is applied."""
    ev = progress.events(spark, sf_dir)
    ps, builds = _stored(ev), progress.builds(ev)
    shown = control.preview(ps, builds, hashing.DEFAULTS, OTSU)
    left, built, gone = control.apply_settings(ps, builds, "proj-3", hashing.DEFAULTS, OTSU)
    after = left.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_left"))
    lost = gone.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_deleted"))
    rows = shown.join(after, "project_id", "left").join(lost, "project_id", "left").join(built.select("project_id", F.lit(True).alias("built")), "project_id", "left")
    return rows.select("project_id", "artifact_count", "byte_count", F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_deleted", F.lit(0)).alias("n_deleted"), F.coalesce("built", F.lit(False)).alias("built"))


def reprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project rewound to preprocess, of which then only preprocess runs; and one whose render artifacts are dropped."""
    ev = progress.events(spark, sf_dir)
    ps = _stored(ev)
    again = ps.where("project_id = 'proj-8' AND stage = 'preprocess'").withColumn("size_bytes", F.lit(1).cast("long"))
    done, _, _ = control.reprocess(ps, progress.builds(ev), "proj-8", lambda left: rewind.upsert(left, again, ["project_id", "page_index", "stage"]))
    left, _ = rewind.drop_stage(done, "proj-9", "render")
    return left.groupBy("project_id", "stage").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"))


def enumerated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of as many pages as documents; rows that exist keep their turn."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), "doc_id")
    projects = docs.groupBy("project_id").agg(F.count(F.lit(1)).cast("int").alias("page_count"))
    have = docs.where("doc_id < 20").select("project_id", F.col("doc_id").cast("int").alias("page_index"), F.lit(90).alias("rotation_override"))
    return rewind.enumerate_pages(projects, have)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.events(spark, sf_dir).select("project_id", "page_index", "stage", "status", "error", "seq")


def _streamed(spark: SparkSession, log: DataFrame, result) -> DataFrame:
    """The log as two generations of files; the changes that a query writes, with the number of their batch."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    half = (log.agg(F.max("seq")).first()[0] or 0) // 2

    def add(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{root}/out")

    for part in (log.where(F.col("seq") <= half), log.where(F.col("seq") > half)):
        part.coalesce(1).write.mode("append").parquet(f"{root}/log")
        changes = result(streams.events(spark, f"{root}/log", 1)).writeStream.outputMode("update").option("checkpointLocation", f"{root}/state")
        changes.foreachBatch(add).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out")


def stream_latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _streamed(spark, _log(spark, sf_dir), streams.latest_events)
    last = F.max_by(F.struct("stage", "status", "seq"), "batch").alias("e")
    return out.groupBy("project_id", "page_index").agg(last).select("project_id", "page_index", "e.*")


def stream_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each project's failures to show, after the whole log; the build of every third project clears them."""
    log = _log(spark, sf_dir)
    third = F.substring("project_id", 6, 9).cast("int") % 3 == 0
    built = log.where(third).groupBy("project_id").agg((F.max("seq") - 40).alias("seq"))
    ends = built.select("project_id", F.lit(-1).cast("long").alias("page_index"), F.lit("build").alias("stage"), F.lit("done").alias("status"), F.lit(None).cast("string").alias("error"), "seq")
    out = _streamed(spark, log.unionByName(ends), streams.failures)
    last = out.groupBy("project_id").agg(F.max_by("failures", "batch").alias("f"))
    return last.select("project_id", F.posexplode("f").alias("rank", "x")).select("project_id", (F.col("rank") + 1).alias("rank"), "x.*")


def stream_of_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of one project, as they come."""
    out = _streamed(spark, _log(spark, sf_dir), lambda stream: streams.of_project(stream, "proj-7"))
    return out.drop("batch")


QUERIES = {
    f.__name__: f
    for f in (
        stage_events, stage_status, stage_chain, single_page_run, build_runs, rotation_overrides, settings_change, reprocessed,
        enumerated_pages, stream_latest_events, stream_failures, stream_of_project,
    )
}


def _hash(stage: str) -> str:
    parts = {d: hashing.DEFAULTS[d] for d in hashing.DEPENDS[stage]}
    return hashlib.sha256(json.dumps({"settings": parts, "stage": stage}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


_KEY = f"CASE WHEN rot IS NULL THEN '{_hash('preprocess')}' ELSE substr(sha256('{_hash('preprocess')}@' || rot), 1, 16) END"
_PG = "pg AS (SELECT source AS project_id, CAST(doc_id AS INT) AS page_index, CASE WHEN doc_id % 13 = 0 THEN 90 END AS rot, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents)"
_RUN = f"""{_PG},
r AS (SELECT *, CASE WHEN n % 9 = 0 THEN 'missing' WHEN page_index % 8 = 0 AND page_index % 3 <> 0 AND rot IS NULL THEN 'cached' WHEN n % 7 = 0 THEN 'bad' ELSE 'done' END AS s FROM pg)"""
_EV = progress._EV
_STORED = f"{_EV}, st AS (SELECT *, CASE WHEN stage = 'detect' THEN 2 ELSE 1 END AS files FROM ps)"

SQL = {
    "stage_events": f"""
WITH {_RUN}
SELECT project_id, page_index, 'preprocess' AS stage, CASE WHEN s IN ('missing', 'bad') THEN 'failed' ELSE s END AS status,
       CASE s WHEN 'missing' THEN 'no render artifact' WHEN 'bad' THEN 'unreadable' END AS error,
       CASE s WHEN 'cached' THEN 'old' WHEN 'done' THEN substr(sha256(text), 1, 16) END AS payload FROM r""",
    "stage_status": f"""
WITH {_RUN}
SELECT project_id, page_index, 'preprocess' AS stage, {_KEY} AS hash, project_id || '/pages/' || page_index || '/preprocess.' || {_KEY} || '.png' AS artifact_path, CAST(16 AS BIGINT) AS size_bytes FROM r WHERE s = 'done'
UNION ALL SELECT project_id, page_index, 'preprocess', CASE WHEN page_index % 8 = 0 THEN '{_hash('preprocess')}' ELSE '{"0" * 16}' END, 'old', 3 FROM r WHERE s <> 'done' AND page_index % 4 = 0""",
    "stage_chain": f"""
WITH {_PG},
x AS (SELECT *, page_index % 17 = 3 AS p_bad, page_index % 11 = 5 AS d_bad, unnest(['render', 'preprocess', 'detect', 'ocr']) AS stage FROM pg),
e AS (SELECT *, CASE WHEN stage = 'preprocess' AND p_bad THEN 'unreadable' WHEN stage IN ('detect', 'ocr') AND p_bad THEN 'no preprocess artifact' WHEN stage = 'detect' AND d_bad THEN 'unreadable' END AS error FROM x)
SELECT project_id, page_index, stage, CASE WHEN error IS NULL THEN 'done' ELSE 'failed' END AS status, error,
       CASE WHEN stage = 'ocr' AND error IS NULL THEN substr(sha256(substr(sha256(substr(sha256(text), 1, 16)), 1, 16)), 1, 16) END AS payload FROM e""",
    "single_page_run": f"WITH {_PG} SELECT project_id, page_index, 'ocr' AS stage, 'done' AS status, CAST(NULL AS VARCHAR) AS error FROM pg WHERE page_index IN (1, 5)",
    "build_runs": f"""
WITH {_PG},
p AS (SELECT project_id, count(*) AS n, CAST(sum(n) AS BIGINT) AS chars, CAST(sum(coalesce(rot, page_index % 4 * 90)) AS BIGINT) AS turns,
             count(*) FILTER (project_id IN ('src1', 'src4') AND page_index % 5 = 0) AS lost FROM pg GROUP BY project_id),
s AS (SELECT *, CASE WHEN lost > 0 THEN 'failed' WHEN project_id = 'src2' THEN 'cached' ELSE 'done' END AS status, n || ',' || chars || ',' || turns AS made FROM p)
SELECT project_id, -1 AS page_index, status, CASE WHEN lost > 0 THEN lost || ' page(s) without recognised text' END AS error,
       CASE WHEN status <> 'failed' THEN '{_hash('build')}' END AS hash, CASE status WHEN 'cached' THEN 'old' WHEN 'done' THEN project_id || '/output.{_hash('build')}.pdf' END AS artifact_path,
       CASE status WHEN 'cached' THEN 1 WHEN 'done' THEN CAST(length(made) AS BIGINT) END AS size_bytes, CASE status WHEN 'cached' THEN 'old' WHEN 'done' THEN made END AS content FROM s""",
    "rotation_overrides": f"""
WITH {_STORED},
g AS (SELECT *, project_id = 'proj-6' AND page_index = 6 AND stage <> 'render' AS gone FROM st),
c AS (SELECT project_id, max(CASE WHEN project_id = 'proj-6' AND page_index = 6 THEN 90 END) AS angle FROM pg GROUP BY project_id)
SELECT project_id, angle, (SELECT count(*) FROM g WHERE NOT gone AND g.project_id = c.project_id) AS n_artifacts,
       (SELECT CAST(coalesce(sum(files), 0) AS BIGINT) FROM g WHERE gone AND g.project_id = c.project_id) AS n_deleted,
       project_id <> 'proj-6' AND project_id IN (SELECT project_id FROM bd) AS built FROM c""",
    "settings_change": f"""
WITH {_STORED},
x AS (SELECT project_id, size_bytes FROM ps WHERE stage <> 'render' UNION ALL SELECT project_id, size_bytes FROM bd),
s AS (SELECT project_id, count(*) AS artifact_count, CAST(sum(coalesce(size_bytes, 0)) AS BIGINT) AS byte_count FROM x GROUP BY project_id)
SELECT *, (SELECT count(*) FROM st WHERE st.project_id = s.project_id AND (s.project_id <> 'proj-3' OR stage = 'render')) AS n_left,
       (SELECT CAST(coalesce(sum(files), 0) AS BIGINT) FROM st WHERE st.project_id = s.project_id AND s.project_id = 'proj-3' AND stage <> 'render') AS n_deleted,
       project_id <> 'proj-3' AND project_id IN (SELECT project_id FROM bd) AS built FROM s""",
    "reprocessed": f"""
WITH {_STORED}
SELECT project_id, stage, count(*) AS n, CAST(sum(CASE WHEN project_id = 'proj-8' AND stage = 'preprocess' THEN 1 ELSE size_bytes END) AS BIGINT) AS bytes FROM st
WHERE NOT (project_id = 'proj-8' AND stage IN ('detect', 'ocr')) AND NOT (project_id = 'proj-9' AND stage = 'render') GROUP BY project_id, stage""",
    "enumerated_pages": """
WITH c AS (SELECT source AS project_id, count(*) AS n FROM documents GROUP BY source),
h AS (SELECT source AS project_id, CAST(doc_id AS INT) AS page_index FROM documents WHERE doc_id < 20),
w AS (SELECT project_id, CAST(unnest(range(0, n)) AS INT) AS page_index FROM c)
SELECT project_id, page_index, 90 AS rotation_override FROM h
UNION ALL SELECT project_id, page_index, NULL FROM w WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.project_id = w.project_id AND h.page_index = w.page_index)""",
    "stream_latest_events": f"WITH {_EV} SELECT project_id, page_index, arg_max(stage, seq) AS stage, arg_max(status, seq) AS status, max(seq) AS seq FROM ev GROUP BY project_id, page_index",
    "stream_failures": f"""
WITH {_EV},
b AS (SELECT project_id, max(seq) - 40 AS cleared FROM ev WHERE CAST(project_id[6:] AS INT) % 3 = 0 GROUP BY project_id),
f AS (SELECT project_id, stage, page_index, max(seq) AS seq, coalesce(arg_max(coalesce(error, 'unknown error'), seq), 'unknown error') AS error
      FROM ev LEFT JOIN b USING (project_id) WHERE status = 'failed' AND (cleared IS NULL OR seq > cleared) GROUP BY ALL)
SELECT project_id, CAST(rank AS INT) AS rank, stage, page_index, error, seq FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY seq DESC) AS rank FROM f) WHERE rank <= 3""",
    "stream_of_project": f"WITH {_EV} SELECT project_id, page_index, stage, status, error, seq FROM ev WHERE project_id = 'proj-7'",
}
