import threading
import time

import pytest
from pyspark.sql import functions as F

from quirework.functions.hashing import DEFAULTS, PAGE_STAGES
from quirework.plans import control
from quirework.runtime import path_exists


@pytest.fixture(scope="module")
def tables(spark):
    rows = [("p", i, s, 10, None, f"{s}{i}", None) for i in range(3) for s in PAGE_STAGES]
    ps = spark.createDataFrame(rows, "project_id string, page_index int, stage string, size_bytes long, overlay_bytes long, artifact_path string, overlay_path string")
    return ps, spark.createDataFrame([("p", 5)], "project_id string, size_bytes long")


def test_preview_and_change(tables):
    ps, builds = tables
    new = DEFAULTS | {"preprocess": DEFAULTS["preprocess"] | {"binarizer": "otsu"}}
    assert control.changed_stages(DEFAULTS, new) == ("preprocess",)
    r = control.preview(ps, builds, DEFAULTS, new).first()
    assert (r.artifact_count, r.byte_count) == (10, 95)
    left, b, gone = control.apply_settings(ps, builds, "p", DEFAULTS, new)
    assert {r.stage for r in left.collect()} == {"render"} and b.count() == 0 and gone.count() == 9
    assert control.apply_settings(ps, builds, "p", DEFAULTS, DEFAULTS)[2] is None
    done, _, _ = control.reprocess(ps, builds, "p", lambda left: left.unionByName(ps.where("stage = 'preprocess'")))
    assert {r.stage for r in done.collect()} == {"render", "preprocess"}


def test_an_aborted_run_commits_nothing(spark, tmp_path):
    at, failed = str(tmp_path / "out"), []

    def slow(batches):
        for b in batches:
            time.sleep(60)
            yield b

    def work():
        with control.abortable(spark, "run-1"):
            try:
                spark.range(4, numPartitions=2).mapInPandas(slow, "id long").write.parquet(at)
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    t = threading.Thread(target=work)
    t.start()
    until = time.time() + 60
    while t.is_alive() and time.time() < until:  # the job may not have begun yet
        time.sleep(2)
        control.abort(spark, "run-1")
    t.join(5)
    assert failed and not t.is_alive()
    assert not path_exists(spark, at + "/_SUCCESS")
    assert spark.range(3).agg(F.sum("id")).first()[0] == 3
