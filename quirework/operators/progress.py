"""Progress, invalidation and failures of projects, over these tables:

pages       project_id, page_index
page_stage  project_id, page_index, stage, size_bytes, overlay_bytes (one row for each finished stage of a page)
builds      project_id, size_bytes (one row for each built project)
events      project_id, page_index, stage, status, error, seq

Pages that exist are counted, whatever holes their indices have, and a disabled
detect stage is not required.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import DOWNSTREAM, PAGE_STAGES, STAGES
from ..functions.text import format_bytes, js_round

FAILURES_SHOWN = 3


def required_stages(detect: bool = True) -> tuple[str, ...]:
    return tuple(s for s in PAGE_STAGES if detect or s != "detect")


def _page_done(pages: DataFrame, page_stage: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """One row for each page with a flag for each stage."""
    done = page_stage.where(F.col("stage").isin(*stages)).groupBy("project_id", "page_index")
    flags = done.agg(*(F.max(F.col("stage") == s).alias(f"has_{s}") for s in stages))
    joined = pages.select("project_id", "page_index").join(flags, ["project_id", "page_index"], "left")
    return joined.select("project_id", "page_index", *(F.coalesce(f"has_{s}", F.lit(False)).alias(f"has_{s}") for s in stages))


def project_progress(pages: DataFrame, page_stage: DataFrame, builds: DataFrame, detect: bool = True) -> DataFrame:
    """Stages done and wanted, ratio, incomplete pages, earliest missing stage, partial, built."""
    stages = required_stages(detect)
    rows = _page_done(pages, page_stage, stages)
    n_done = sum((F.col(f"has_{s}").cast("long") for s in stages), F.lit(0))
    sums = rows.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.sum(n_done).alias("done"),
        F.sum((n_done < len(stages)).cast("long")).alias("n_incomplete"),
        *(F.min(F.col(f"has_{s}")).alias(f"all_{s}") for s in stages),
    )
    rows = sums.join(builds.select("project_id", F.lit(True).alias("b")), "project_id", "left")
    built = F.coalesce("b", F.lit(False))
    done = F.col("done") + built.cast("long")
    total = F.col("page_count") * len(stages) + 1
    missing = F.when(~built, "build")
    for s in reversed(stages):
        missing = F.when(~F.col(f"all_{s}"), s).otherwise(missing)
    return rows.select(
        "project_id",
        "page_count",
        done.alias("stages_done"),
        total.alias("stages_total"),
        F.round(done / total, 6).alias("ratio"),
        "n_incomplete",
        missing.alias("earliest_missing"),
        ((done > 0) & (done < total)).alias("partial"),
        built.alias("built"),
    )


def incomplete_pages(pages: DataFrame, page_stage: DataFrame, detect: bool = True) -> DataFrame:
    stages = required_stages(detect)
    rows = _page_done(pages, page_stage, stages)
    every = F.lit(True)
    for s in stages:
        every = every & F.col(f"has_{s}")
    return rows.where(~every).select("project_id", "page_index")


def run_label(built: Column, partial: Column) -> Column:
    return F.when(built, "Re-run").when(partial, "Resume").otherwise("Run")


def status_label(running: Column, done: dict[str, Column]) -> Column:
    """The running stage, else the highest finished one."""
    return (
        F.when(running.isNotNull(), running)
        .when(done["ocr"], "ocr done")
        .when(done["detect"], "detect done")
        .when(done["preprocess"], "preprocess done")
        .when(done["render"], "rendered")
        .otherwise("queued")
    )


def size_delta(source: Column, built: Column) -> Column:
    """(percent, tone, label) of the built file against its source; null where either is absent or 0."""
    pct = js_round((built - source) / source * 100).cast("long")
    tone = F.when(pct <= -5, "smaller").when(pct >= 5, "larger").otherwise("same")
    sign = F.when(pct >= 0, "+").otherwise("")
    label = F.concat(format_bytes(source), F.lit(" → "), format_bytes(built), F.lit(" ("), sign, pct.cast("string"), F.lit("%)"))
    return F.when((source > 0) & (built > 0), F.struct(pct.alias("percent"), tone.alias("tone"), label.alias("label")))


def downstream_of(changed: tuple[str, ...]) -> tuple[str, ...]:
    """Distinct stages at or after any changed one, in the order in which they are first reached."""
    return tuple(dict.fromkeys(d for s in changed for d in DOWNSTREAM[s]))


def invalidation(page_stage: DataFrame, builds: DataFrame, changed: tuple[str, ...]) -> DataFrame:
    """Artifacts and bytes that a change of settings would discard, for each project; a build counts once."""
    stages = downstream_of(changed)
    lost = page_stage.where(F.col("stage").isin(*[s for s in stages if s != "build"])).select("project_id", "size_bytes")
    if "build" in stages:
        lost = lost.unionByName(builds.select("project_id", "size_bytes"))
    return lost.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("artifact_count"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("byte_count")
    )


def artifact_bytes(page_stage: DataFrame, builds: DataFrame) -> DataFrame:
    """Bytes on disk of each project: artifacts, overlays and the build."""
    parts = page_stage.select("project_id", (F.coalesce("size_bytes", F.lit(0)) + F.coalesce("overlay_bytes", F.lit(0))).alias("b"))
    parts = parts.unionByName(builds.select("project_id", F.coalesce("size_bytes", F.lit(0)).alias("b")))
    return parts.groupBy("project_id").agg(F.sum("b").alias("bytes"))


def display_positions(pages: DataFrame, block: int = 4096) -> DataFrame:
    """The gap-free position of each page among those of its project that are left.

    Ranked within blocks of the index, to which the counts of all earlier blocks
    are added, so that no project, however large, is one task.
    """
    rows = pages.select("project_id", "page_index", F.floor(F.col("page_index") / block).alias("block_"))
    counts = rows.groupBy("project_id", "block_").agg(F.count(F.lit(1)).alias("n_"))
    before = Window.partitionBy("project_id").orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("project_id", "block_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    inside = Window.partitionBy("project_id", "block_").orderBy("page_index")
    return (
        rows.withColumn("k_", F.row_number().over(inside) - 1)
        .join(counts, ["project_id", "block_"])
        .select("project_id", "page_index", (F.col("before_") + F.col("k_")).cast("long").alias("position"))
    )


def latest_events(events: DataFrame) -> DataFrame:
    """The last event of each page, by its sequence number; combined within partitions first."""
    best = F.max_by(F.struct("stage", "status"), "seq").alias("e")
    return events.groupBy("project_id", "page_index").agg(best, F.max("seq").alias("seq")).select("project_id", "page_index", "e.*", "seq")


def failures(events: DataFrame, builds: DataFrame, shown: int = FAILURES_SHOWN) -> DataFrame:
    """The newest failure of each stage and page, newest first, at most ``shown`` for each project that is not built."""
    failed = events.where(F.col("status") == "failed").join(builds.select("project_id"), "project_id", "left_anti")
    last = failed.groupBy("project_id", "stage", "page_index").agg(
        F.max_by("error", "seq").alias("error"), F.max("seq").alias("seq")
    )
    # the feature is a short list: the least that each task passes on is what it shows
    newest = Window.partitionBy("project_id").orderBy(F.desc("seq"))
    return (
        last.withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= shown)
        .select("project_id", "rank", "stage", "page_index", F.coalesce("error", F.lit("unknown error")).alias("error"), "seq")
    )


def script_vote(pages: DataFrame, least: float = 1.5) -> DataFrame:
    """(project_id, script, page_count, confident_pages, total_pages): the script of more than half of the confident pages.

    ``pages``: project_id, script, confidence; one row for each page. No more than one script can have more than half.
    """
    sure = F.col("script").isNotNull() & (F.col("script") != "") & (F.coalesce("confidence", F.lit(0.0)) >= least)
    counts = pages.groupBy("project_id", "script").agg(F.count_if(sure).alias("n"), F.count(F.lit(1)).alias("all"))
    totals = counts.groupBy("project_id").agg(
        F.max_by(F.struct("script", "n"), F.struct("n", "script")).alias("w"), F.sum("n").alias("confident_pages"), F.sum("all").alias("total_pages")
    )
    won = totals.where((F.col("w.n") > 0) & (F.col("w.n") * 2 > F.col("confident_pages")))
    return won.select("project_id", F.col("w.script").alias("script"), F.col("w.n").alias("page_count"), "confident_pages", "total_pages")


def suggestions(votes: DataFrame, languages: DataFrame, selected: DataFrame, most: int = 3) -> DataFrame:
    """At most ``most`` languages for each project whose script contains the voted one and that are not selected.

    ``languages`` is the catalogue of 22 rows, ``selected`` has (project_id, code).
    """
    fits = F.lower("l.script").contains(F.lower("v.script"))
    matched = votes.alias("v").join(F.broadcast(languages.alias("l")), fits).select("project_id", "position", "code")
    free = matched.join(selected.select("project_id", "code"), ["project_id", "code"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy("position"))
    return free.withColumn("rank", rank).where(F.col("rank") <= most).select("project_id", "rank", "code")


def progress_grid(pages: DataFrame, page_stage: DataFrame) -> DataFrame:
    """Every page with every stage, finished or not."""
    stages = F.array(*map(F.lit, PAGE_STAGES))
    grid = pages.select("project_id", "page_index", F.explode(stages).alias("stage"))
    have = page_stage.select("project_id", "page_index", "stage", F.lit(True).alias("d"))
    return grid.join(have, ["project_id", "page_index", "stage"], "left").select(
        "project_id", "page_index", "stage", F.coalesce("d", F.lit(False)).alias("done")
    )


def rank_of(stage: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STAGES)), stage)
