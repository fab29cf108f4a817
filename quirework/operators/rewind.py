"""Changes to the status table, as functions from tables to tables.

A state is (projects, pages, page_stage, builds); page_stage also has
artifact_path and overlay_path. Each function returns the new tables and, where
it discards artifacts, the paths to delete, overlays among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import DOWNSTREAM

PAGE_KEY = ["project_id", "page_index"]


def _paths(rows: DataFrame) -> DataFrame:
    both = F.array_distinct(F.array("artifact_path", "overlay_path"))
    return rows.select("project_id", F.explode(both).alias("path")).where(F.col("path").isNotNull()).distinct()


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` in place of those of ``table`` with the same key."""
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def update(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Set columns where a condition holds; lit(None) clears one."""
    for name, value in values.items():
        table = table.withColumn(name, F.when(where, value).otherwise(F.col(name)))
    return table


def without_build(builds: DataFrame, projects: DataFrame) -> DataFrame:
    return builds.join(projects.select("project_id"), "project_id", "left_anti")


def rewind(page_stage: DataFrame, builds: DataFrame, project_id: str, stage: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Discard ``stage`` and all after it on all pages of a project, and its build."""
    gone = (F.col("project_id") == project_id) & F.col("stage").isin(*DOWNSTREAM[stage])
    return page_stage.where(~gone), builds.where(F.col("project_id") != project_id), _paths(page_stage.where(gone))


def override_rotation(
    pages: DataFrame, page_stage: DataFrame, builds: DataFrame, project_id: str, page_index: int, angle: int | None
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Set or clear a page's rotation; its preprocess stage and all after it go, and the build."""
    page = (F.col("project_id") == project_id) & (F.col("page_index") == page_index)
    gone = page & F.col("stage").isin(*DOWNSTREAM["preprocess"])
    return (
        update(pages, page, rotation_override=F.lit(angle).cast("int")),
        page_stage.where(~gone),
        builds.where(F.col("project_id") != project_id),
        _paths(page_stage.where(gone)),
    )


def remove_page(
    projects: DataFrame, pages: DataFrame, page_stage: DataFrame, builds: DataFrame, project_id: str, page_index: int
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Remove a page; the others keep their indices."""
    mine = F.col("project_id") == project_id
    page = mine & (F.col("page_index") == page_index)
    return (
        update(projects, mine, page_count=F.greatest(F.lit(0), F.col("page_count") - 1)),
        pages.where(~page),
        page_stage.where(~page),
        builds.where(~mine),
        _paths(page_stage.where(page)),
    )


def drop_stage(page_stage: DataFrame, project_id: str, stage: str) -> tuple[DataFrame, DataFrame]:
    """Discard one stage's artifacts only."""
    gone = (F.col("project_id") == project_id) & (F.col("stage") == stage)
    return page_stage.where(~gone), _paths(page_stage.where(gone))


def enumerate_pages(projects: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows for all pages of the projects; rows that exist keep what they hold."""
    wanted = projects.where(F.col("page_count") > 0).select(
        "project_id", F.explode(F.sequence(F.lit(0), F.col("page_count").cast("int") - 1)).alias("page_index")
    )
    new = wanted.join(pages.select(*PAGE_KEY), PAGE_KEY, "left_anti")
    return pages.unionByName(new, allowMissingColumns=True)
