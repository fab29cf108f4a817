"""Changing settings, running again, and stopping."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..functions.hashing import PAGE_STAGES
from ..operators.progress import invalidation
from ..operators.rewind import rewind


def changed_stages(old: dict, new: dict) -> tuple[str, ...]:
    """The stages whose own settings differ, in order."""
    return tuple(s for s in PAGE_STAGES if old.get(s) != new.get(s))


def preview(page_stage: DataFrame, builds: DataFrame, old: dict, new: dict) -> DataFrame:
    """What a change of settings would discard, without discarding it."""
    return invalidation(page_stage, builds, changed_stages(old, new))


def apply_settings(
    page_stage: DataFrame, builds: DataFrame, project_id: str, old: dict, new: dict
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(page_stage, builds, paths to delete): the project rewound to the first stage that changed; None if none did."""
    stages = changed_stages(old, new)
    if not stages:
        return page_stage, builds, None
    return rewind(page_stage, builds, project_id, stages[0])


def reprocess(page_stage: DataFrame, builds: DataFrame, project_id: str, run: Callable[[DataFrame], DataFrame], stage: str = "preprocess"):
    """Rewind to a stage and run that stage only; ``run`` goes from the status left to the new one."""
    left, builds, gone = rewind(page_stage, builds, project_id, stage)
    return run(left), builds, gone


@contextmanager
def abortable(spark: SparkSession, tag: str):
    """Jobs that this thread starts within can be stopped by ``abort``; what they write is committed whole or not at all."""
    sc = spark.sparkContext
    sc.addJobTag(tag)
    sc.setInterruptOnCancel(True)  # else a task first waits for its Python worker
    try:
        yield
    finally:
        sc.setInterruptOnCancel(False)
        sc.removeJobTag(tag)


def abort(spark: SparkSession, tag: str) -> None:
    """Stop the jobs with this tag, from any thread."""
    spark.sparkContext.cancelJobsWithTag(tag)
