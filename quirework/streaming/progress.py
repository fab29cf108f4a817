"""The progress log as a stream: the last event of each page, and the failures to show.

Order is the order of ``seq``; a late event with a smaller number changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..runtime import ship_package

EVENTS = "project_id string, page_index long, stage string, status string, error string, seq long"
SHOWN = 3


def events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """The log as files that are added to a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def of_project(stream: DataFrame, project_id: str) -> DataFrame:
    return stream.where(F.col("project_id") == project_id)


def latest_events(stream: DataFrame) -> DataFrame:
    """In update mode: the last event of each page whenever it changes."""
    best = F.max_by(F.struct("stage", "status"), "seq").alias("e")
    return stream.groupBy("project_id", "page_index").agg(best, F.max("seq").alias("seq")).select("project_id", "page_index", "e.*", "seq")


def failures(stream: DataFrame) -> DataFrame:
    """In update mode: each project's failures to show, newest first, as a list.

    One for each stage and page, the newest; at most SHOWN; none once the
    project is built, and not those that an event of status dismissed takes away.
    The state of a project is that short list: failures that newer ones displaced do not come back.
    """
    ship_package(stream.sparkSession)
    wanted = stream.where(F.col("status").isin("failed", "dismissed") | ((F.col("stage") == "build") & (F.col("status") == "done")))
    return wanted.groupBy("project_id").applyInPandasWithState(
        _fold,
        "project_id string, failures array<struct<stage:string,page_index:long,error:string,seq:long>>",
        "stages array<string>, pages array<long>, errors array<string>, seqs array<long>, built boolean",
        "update",
        GroupStateTimeout.NoTimeout,
    )


def fold_failures(held: list[tuple], built: bool, rows: list[tuple], shown: int = SHOWN) -> tuple[list[tuple], bool]:
    """Apply rows (stage, page, status, error, seq), in the order of seq, to a list of (stage, page, error, seq)."""
    for stage, page, status, error, seq in sorted(rows, key=lambda r: r[4]):
        if stage == "build" and status == "done":
            held, built = [], True
        elif status == "failed":
            built = False
            rest = [h for h in held if (h[0], h[1]) != (stage, page)]
            held = [(stage, page, error or "unknown error", seq), *rest][:shown]
        elif status == "dismissed":
            held = [h for h in held if (h[0], h[1]) != (stage, page)]
    return held, built


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held, built = [], False
    if state.exists:
        *lists, built = state.get
        held = list(zip(*lists, strict=True))
    rows = [tuple(r) for pdf in batches for r in pdf[["stage", "page_index", "status", "error", "seq"]].itertuples(index=False)]
    held, built = fold_failures(held, bool(built), rows)
    cols = [list(c) for c in zip(*held, strict=True)] or [[], [], [], []]
    state.update((*cols, built))
    shown = [{"stage": s, "page_index": int(p), "error": e, "seq": int(q)} for s, p, e, q in held]
    yield pd.DataFrame({"project_id": [key[0]], "failures": [shown]})


def live(stream: DataFrame, refresh, checkpoint: str, seconds: int = 5):
    """Call ``refresh`` with each batch, every few seconds: a query that stays up to date."""
    return (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=f"{seconds} seconds")
        .foreachBatch(lambda df, k: refresh(df, k))
        .start()
    )
