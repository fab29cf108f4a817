"""Stages as functions from tables to tables, recomputed only where their key changed.

A stage takes the pages that exist, the artifacts of the stage before it and the
status table. Pages split into three, by joins on (project_id, page_index):
those without an input fail and do not stop the others; those with an artifact
made under the same key are cached; the rest is work. The split is a narrow
table, written once. ``compute`` turns the work into payloads, one narrow
transformation without a shuffle; what it makes is written once too, and status,
results and events are read from there, so an expensive or inexact function runs
once for each page of work. A page whose payload holds an error fails, and keeps
no status.

The key is the settings hash, with a page's rotation override where it has one.

The build is the stage of a project: the same split, then one PDF for each
project that has work. Pages are rows until the function that writes the file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import STAGES, artifact_path, output_path, settings_hash
from ..operators.rewind import PAGE_KEY, upsert
from ..runtime import durable

# The stage whose artifacts each stage reads, and the kinds of artifact.
INPUT_OF = {"render": None, "preprocess": "render", "detect": "preprocess", "ocr": "preprocess", "build": "ocr"}
SECOND_INPUT_OF = {"detect": "render"}
EXTENSION = {"render": "png", "preprocess": "png", "detect": "json", "ocr": "json", "build": "pdf"}


def cache_misses(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Rows of ``wanted`` (project_id, page_index, stage, hash) that ``have`` lacks."""
    key = [*PAGE_KEY, "stage", "hash"]
    return wanted.join(have.select(*key), key, "left_anti")


def stage_key(settings: Column, stage: str, rotation_override: Column | None = None) -> Column:
    digest = settings_hash(settings, stage)
    if rotation_override is None or stage == "render":
        return digest
    return F.when(rotation_override.isNull(), digest).otherwise(
        F.substring(F.sha2(F.concat(digest, F.lit("@"), rotation_override.cast("string")).cast("binary"), 256), 1, 16)
    )


@dataclass
class StageRun:
    """results: project_id, page_index, payload of this stage, cached ones too; events: one row for each page."""

    status: DataFrame
    results: DataFrame
    events: DataFrame


EVENTS = "project_id string, page_index int, stage string, status string, error string"


def _event(rows: DataFrame, stage: str, name: str, error: Column | None = None) -> DataFrame:
    error = F.lit(None) if error is None else error
    return rows.select(*PAGE_KEY, F.lit(stage).alias("stage"), F.lit(name).alias("status"), error.cast("string").alias("error"))


def run_stage(
    stage: str,
    settings: Column,
    pages: DataFrame,
    status: DataFrame,
    inputs: DataFrame,
    artifacts: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    *,
    second: DataFrame | None = None,
    page_indices: list[int] | None = None,
    enabled: bool = True,
) -> StageRun:
    """Run one page stage.

    pages      project_id, page_index, rotation_override
    status     project_id, page_index, stage, hash, artifact_path, size_bytes
    inputs     project_id, page_index, payload: the artifacts of the stage before
    artifacts  project_id, page_index, payload: this stage's artifacts that are stored
    compute    from (project_id, page_index, payload[, second]) to the same with (payload, error)
    second     project_id, page_index, payload: artifacts of SECOND_INPUT_OF, which must be there too

    A disabled stage changes nothing and gives no events.
    """
    spark = pages.sparkSession
    kind = inputs.schema["payload"].dataType.simpleString()
    if not enabled:
        return StageRun(status, artifacts.limit(0), spark.createDataFrame([], EVENTS))
    if page_indices is not None:
        pages = pages.where(F.col("page_index").isin(page_indices))
    wanted = pages.select(*PAGE_KEY, F.lit(stage).alias("stage"), stage_key(settings, stage, F.col("rotation_override")).alias("hash"))
    there = lambda rows, name: rows.where(F.col("payload").isNotNull()).select(*PAGE_KEY, F.lit(True).alias(name))
    # valid: the status has this key and the artifact is there
    valid = status.select(*PAGE_KEY, "stage", "hash").join(there(artifacts, "hit"), PAGE_KEY)
    keys = wanted.join(there(inputs, "has"), PAGE_KEY, "left").join(valid, [*PAGE_KEY, "stage", "hash"], "left")
    lacking = F.when(F.col("has").isNull(), f"no {INPUT_OF[stage] or 'source'} artifact")
    if second is not None:
        keys = keys.join(there(second, "also"), PAGE_KEY, "left")
        lacking = lacking.when(F.col("also").isNull() & F.col("hit").isNull(), f"no {SECOND_INPUT_OF[stage]} artifact")
    keys = durable(keys.withColumn("lacking", lacking))
    cached = keys.where(F.col("lacking").isNull() & F.col("hit"))
    todo = keys.where(F.col("lacking").isNull() & F.col("hit").isNull()).select(*PAGE_KEY, "stage", "hash")
    work = todo.select(*PAGE_KEY).join(inputs.select(*PAGE_KEY, "payload"), PAGE_KEY)
    if second is not None:
        work = work.join(second.select(*PAGE_KEY, F.col("payload").alias("second")), PAGE_KEY)
    made = durable(compute(work))
    good = made.where(F.col("error").isNull())
    events = (
        _event(keys.where(F.col("lacking").isNotNull()), stage, "failed", F.col("lacking"))
        .unionByName(_event(cached, stage, "cached"))
        .unionByName(_event(good, stage, "done"))
        .unionByName(_event(made.where(F.col("error").isNotNull()), stage, "failed", F.col("error")))
    )
    size = F.octet_length(F.col("payload") if kind in ("string", "binary") else F.to_json("payload")).cast("long")
    new = good.select(*PAGE_KEY, size.alias("size_bytes")).join(todo, PAGE_KEY).select(
        *PAGE_KEY,
        "stage",
        "hash",
        artifact_path(F.col("project_id"), F.col("page_index"), F.col("stage"), F.col("hash"), F.lit(EXTENSION[stage])).alias("artifact_path"),
        "size_bytes",
    )
    kept = cached.select(*PAGE_KEY).join(artifacts.select(*PAGE_KEY, "payload"), PAGE_KEY)
    return StageRun(upsert(status, new, [*PAGE_KEY, "stage"]), kept.unionByName(good.select(*PAGE_KEY, "payload")), events)


def run_from(
    start: str,
    settings: Column,
    pages: DataFrame,
    status: DataFrame,
    artifacts: dict[str, DataFrame],
    compute: dict[str, Callable[[DataFrame], DataFrame]],
    *,
    page_indices: list[int] | None = None,
    detect: bool = True,
) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Run the page stages from ``start`` ("all": the first) on; (status, artifacts by stage, events).

    ``artifacts["source"]`` is the input of the first stage. Stages are joined
    by the tables that each writes; the build, a group by project, comes after all
    pages (``run_build``). Detect also needs the render stage's artifacts.
    """
    at = 0 if start == "all" else STAGES.index(start)
    held = dict(artifacts)
    events = None
    for stage in STAGES[at:4]:
        run = run_stage(
            stage,
            settings,
            pages,
            status,
            held[INPUT_OF[stage] or "source"],
            held[stage],
            compute[stage],
            second=held[SECOND_INPUT_OF[stage]] if stage in SECOND_INPUT_OF else None,
            page_indices=page_indices,
            enabled=detect or stage != "detect",
        )
        status = run.status
        if detect or stage != "detect":
            held[stage] = run.results
        events = run.events if events is None else events.unionByName(run.events)
    return status, held, events


def build_inputs(pages: DataFrame, results: DataFrame, status: DataFrame) -> DataFrame:
    """What builds read, a row for each page: (project_id, page_index, payload, osd_angle, n_missing).

    Pages are joined by index, not by position. ``n_missing``: how many of the
    project's pages have no payload. The angle is the override, else the detected one, else 0.
    """
    there = results.where(F.col("payload").isNotNull()).select(*PAGE_KEY, F.lit(1).alias("there"))
    counts = pages.select(*PAGE_KEY).join(there, PAGE_KEY, "left").groupBy("project_id").agg(F.count_if(F.col("there").isNull()).alias("n_missing"))
    angle = F.col("osd_angle") if "osd_angle" in status.columns else F.lit(None).cast("int")
    angles = status.where("stage = 'preprocess'").select(*PAGE_KEY, angle.alias("detected"))
    override = F.col("rotation_override") if "rotation_override" in pages.columns else F.lit(None).cast("int")
    return (
        pages.select(*PAGE_KEY, override.alias("override"))
        .join(results.select(*PAGE_KEY, "payload"), PAGE_KEY, "left")
        .join(angles, PAGE_KEY, "left")
        .join(counts, "project_id")
        .select(*PAGE_KEY, "payload", F.coalesce("override", "detected", F.lit(0)).cast("int").alias("osd_angle"), "n_missing")
    )


def guarded_builds(inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of projects that can be built, and the projects that cannot as pages have no recognised text."""
    return inputs.where("n_missing = 0"), inputs.where("n_missing > 0").select(
        "project_id", F.format_string("%d page(s) without recognised text", F.col("n_missing")).alias("error")
    ).distinct()


@dataclass
class BuildRun:
    """builds: project_id, hash, artifact_path, size_bytes; documents: project_id, content of new and cached builds."""

    builds: DataFrame
    documents: DataFrame
    events: DataFrame


def run_build(
    settings: Column,
    pages: DataFrame,
    results: DataFrame,
    status: DataFrame,
    builds: DataFrame,
    stored: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
) -> BuildRun:
    """Build the projects whose pages all have recognised text and that have no build under the same key.

    pages    project_id, page_index[, rotation_override]
    results  project_id, page_index, payload: what was recognised
    builds   project_id, hash, artifact_path, size_bytes
    stored   project_id, content: the documents that are there
    compute  from rows of ``build_inputs`` to (project_id, content, size_bytes), as ``pdf.build`` does

    Nothing of a cached project is read but its key; a project's pages meet only
    in the task that writes its file.
    """
    key = settings_hash(settings, "build")
    rows = build_inputs(pages, results, status)
    ready, blocked = guarded_builds(rows)
    have = stored.where(F.col("content").isNotNull()).select("project_id").distinct()
    hit = builds.where(F.col("hash") == key).select("project_id").distinct().join(have, "project_id", "left_semi")
    cached = durable(ready.select("project_id").distinct().join(hit, "project_id", "left_semi"))
    made = durable(compute(ready.join(cached, "project_id", "left_anti")).select("project_id", "content", "size_bytes"))
    new = made.select(
        "project_id", key.alias("hash"), output_path(F.col("project_id"), key).alias("artifact_path"), F.col("size_bytes").cast("long").alias("size_bytes")
    )
    event = lambda df, name, error=None: _event(df.withColumn("page_index", F.lit(-1)), "build", name, error)
    events = event(blocked, "failed", F.col("error")).unionByName(event(cached, "cached")).unionByName(event(made, "done"))
    documents = stored.join(cached, "project_id", "left_semi").select("project_id", "content").unionByName(made.select("project_id", "content"))
    return BuildRun(upsert(builds, new, ["project_id"]), documents, events)
