import random

from quirework.operators import progress
from quirework.streaming import progress as S

ROWS = []
_rng = random.Random(5)
for _k in range(300):
    _st = _rng.choice(["running", "done", "failed", "failed"])
    ROWS.append((f"p{_rng.randrange(3)}", _rng.randrange(6), _rng.choice(["render", "ocr"]), _st, f"e{_k}" if _st == "failed" and _k % 3 else None, _k))


def _write(spark, folder):
    for k in range(0, 300, 60):
        spark.createDataFrame(ROWS[k : k + 60], S.EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_latest_events_equal_the_batch(spark, tmp_path):
    folder = str(tmp_path / "log")
    _write(spark, folder)
    q = S.latest_events(S.events(spark, folder, 1)).writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql("select project_id, page_index, stage, status, seq from latest").collect()}
    batch = progress.latest_events(spark.createDataFrame(ROWS, S.EVENTS)).select("project_id", "page_index", "stage", "status", "seq")
    assert got == {tuple(r) for r in batch.collect()}


def test_failures_end_as_the_batch(spark, tmp_path):
    folder = str(tmp_path / "log")
    _write(spark, folder)
    seen = {}

    def keep(df, k):
        for r in df.collect():
            seen[r.project_id] = [(f.stage, f.page_index, f.error, f.seq) for f in r.failures]

    q = S.failures(S.events(spark, folder, 100)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = progress.failures(spark.createDataFrame(ROWS, S.EVENTS), spark.createDataFrame([], "project_id string, size_bytes long"))
    want = {}
    for r in batch.orderBy("project_id", "rank").collect():
        want.setdefault(r.project_id, []).append((r.stage, r.page_index, r.error, r.seq))
    assert seen == want


def test_a_failure_can_be_dismissed():
    rows = [("ocr", p, "failed", f"e{p}", p) for p in range(1, 5)]
    held, built = S.fold_failures([], False, [*rows, ("ocr", 3, "dismissed", None, 9), ("ocr", 7, "dismissed", None, 10)])
    assert [h[1] for h in held] == [4, 2] and not built
    assert [h[1] for h in S.fold_failures(held, built, [("ocr", 3, "failed", "again", 11)])[0]] == [3, 4, 2]


def test_build_clears_failures():
    held, built = S.fold_failures([], False, [("ocr", 1, "failed", "a", 1), ("ocr", 1, "failed", None, 2)])
    assert held == [("ocr", 1, "unknown error", 2)] and not built
    assert S.fold_failures(held, built, [("build", -1, "done", None, 3)]) == ([], True)
