import numpy as np
from pyspark.sql import functions as F

from quirework.functions import hashing, text
from quirework.operators import geometry, kernels, progress, quality, rewind
from quirework.plans import recognisers
from quirework.sources import files
from quirework.streaming import progress as S


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_small_functions(spark):
    assert one(spark, text.normalise_spaces(F.lit(" A\n\tb  "))) == "A b"
    assert hashing.artifact_glob("p", 3, "ocr") == "p/pages/3/ocr.*"
    assert one(spark, F.size(geometry.first_regions(F.sequence(F.lit(1), F.lit(500))))) == 180
    assert one(spark, geometry.is_recognised(F.lit("x"), F.lit(0.19))) is False
    assert one(spark, geometry.is_recognised(F.lit("x"), F.lit(0.2))) is True
    assert one(spark, progress.rank_of(F.lit("build"))) == 5
    assert one(spark, quality.line_tokens(F.lit("A-b, c!"))) == ["a", "b", "c"]
    assert one(spark, files.is_image_mime(F.lit("image/png"))) is True
    line = one(spark, quality.worst_line_report(F.lit(4), F.lit(0.5), F.lit(0.25), F.lit("a"), F.lit("b")))
    assert line == '- line 05: 50.0% | conf 0.250 | actual="a" | expected="b"'
    r = one(spark, files.detected_regions(F.lit('{"regions":[],"width":1,"height":2}')))
    assert (r.width, r.height, r.overlayPath) == (1, 2, None)


def test_grey_to_colour():
    out = kernels.rgba(np.array([[7]], np.uint8))
    assert out.tolist() == [[[7, 7, 7, 255]]]


def test_tables(spark, tmp_path):
    ps = spark.createDataFrame([("p", 0, "render", "a", None), ("p", 0, "ocr", "b", None)], "project_id string, page_index int, stage string, artifact_path string, overlay_path string")
    left, gone = rewind.drop_stage(ps, "p", "render")
    assert [r.stage for r in left.collect()] == ["ocr"] and [r.path for r in gone.collect()] == ["a"]
    builds = spark.createDataFrame([("p", 1), ("q", 1)], "project_id string, size_bytes long")
    assert [r.project_id for r in rewind.without_build(builds, ps.select("project_id").distinct()).collect()] == ["q"]
    projects = spark.createDataFrame([("a", 1), ("b", 2)], "project_id string, created_at long")
    assert [r.project_id for r in files.newest_projects(projects).collect()] == ["b", "a"]
    files.write_artifacts(ps, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("project_id = 'p'").count() == 2
    got = recognisers.mock_results(ps.where("stage = 'ocr'")).first()
    assert got.payload.text == "Mock page 1 of example document."


def test_live_query(spark, tmp_path):
    folder, seen = str(tmp_path / "log"), []
    spark.createDataFrame([("p", 1, "ocr", "done", None, 1), ("q", 1, "ocr", "done", None, 2)], S.EVENTS).write.parquet(folder)
    q = S.live(S.of_project(S.events(spark, folder), "p"), lambda df, k: seen.extend(r.seq for r in df.collect()), str(tmp_path / "c"), 1)
    q.processAllAvailable()
    q.stop()
    assert seen == [1]
