import pytest
from pyspark.sql import functions as F

from quirework.functions import hashing
from quirework.operators import progress, quality, rewind
from quirework.plans import recognisers, stages


@pytest.fixture(scope="module")
def state(spark):
    """One project of three pages, all four stages done, built."""
    projects = spark.createDataFrame([("p", 3)], "project_id string, page_count int")
    pages = spark.createDataFrame([("p", i, None) for i in range(3)], "project_id string, page_index int, rotation_override int")
    rows = [("p", i, s, 100, 7 if s == "detect" else None, f"p/{i}/{s}", f"p/{i}/overlay" if s == "detect" else None) for i in range(3) for s in hashing.PAGE_STAGES]
    ps = spark.createDataFrame(rows, "project_id string, page_index int, stage string, size_bytes long, overlay_bytes long, artifact_path string, overlay_path string")
    return projects, pages, ps, spark.createDataFrame([("p", 1000)], "project_id string, size_bytes long")


def test_full_progress_is_13_of_13(state):
    _, pages, ps, builds = state
    r = progress.project_progress(pages, ps, builds).first()
    assert (r.stages_done, r.stages_total, r.ratio, r.built, r.earliest_missing) == (13, 13, 1.0, True, None)


def test_invalidating_preprocess_discards_ten(state):
    _, _, ps, builds = state
    r = progress.invalidation(ps, builds, ("preprocess",)).first()
    assert (r.artifact_count, r.byte_count) == (10, 1900)
    assert progress.downstream_of(("ocr", "detect")) == ("ocr", "build", "detect")


def test_bytes_hold_overlays_and_build(state):
    _, _, ps, builds = state
    assert progress.artifact_bytes(ps, builds).first().bytes == 12 * 100 + 3 * 7 + 1000


def test_removal_leaves_holes(state):
    projects, pages, ps, builds = state
    projects, pages, ps, builds, gone = rewind.remove_page(projects, pages, ps, builds, "p", 1)
    assert sorted(r.page_index for r in pages.collect()) == [0, 2]
    assert projects.first().page_count == 2
    assert builds.count() == 0
    assert gone.count() == 5  # four artifacts and an overlay
    assert [(r.page_index, r.position) for r in progress.display_positions(pages).orderBy("position").collect()] == [(0, 0), (2, 1)]
    r = progress.project_progress(pages, ps, builds).first()
    assert (r.stages_done, r.stages_total, r.earliest_missing) == (8, 9, "build")


def test_rewind_and_override(state):
    _, pages, ps, builds = state
    left, b, gone = rewind.rewind(ps, builds, "p", "detect")
    assert left.count() == 6 and b.count() == 0 and gone.count() == 9
    pages, left, b, gone = rewind.override_rotation(pages, ps, builds, "p", 2, 90)
    assert left.count() == 9 and gone.count() == 4
    assert {r.page_index: r.rotation_override for r in pages.collect()} == {0: None, 1: None, 2: 90}
    cleared = rewind.update(pages, F.lit(True), rotation_override=F.lit(None).cast("int"))
    assert cleared.where("rotation_override is not null").count() == 0


def test_upsert_and_enumeration(spark, state):
    projects, pages, ps, _ = state
    new = ps.where("page_index = 0 and stage = 'ocr'").withColumn("size_bytes", F.lit(5).cast("long"))
    out = rewind.upsert(ps, new, ["project_id", "page_index", "stage"])
    assert out.count() == 12 and out.where("size_bytes = 5").count() == 1
    assert rewind.enumerate_pages(projects, pages.where("page_index <> 1")).count() == 3


def test_disabled_detect_is_not_required(state):
    _, pages, ps, builds = state
    r = progress.project_progress(pages, ps.where("stage <> 'detect'"), builds, detect=False).first()
    assert (r.stages_done, r.stages_total) == (10, 10)


def test_failures_are_the_newest_of_each(spark):
    rows = [("p", 1, "ocr", "failed", "a", 1), ("p", 1, "ocr", "failed", None, 5), ("p", 2, "ocr", "failed", "c", 3), ("p", 3, "ocr", "failed", "d", 2), ("p", 4, "ocr", "failed", "e", 4), ("q", 1, "ocr", "failed", "x", 9)]
    ev = spark.createDataFrame(rows, "project_id string, page_index int, stage string, status string, error string, seq long")
    builds = spark.createDataFrame([("q", 1)], "project_id string, size_bytes long")
    got = [(r.page_index, r.error) for r in progress.failures(ev, builds).orderBy("rank").collect()]
    assert got == [(1, "unknown error"), (4, "e"), (2, "c")]


def test_script_vote_needs_more_than_half(spark):
    rows = [("a", "Latin", 2.0), ("a", "Han", 2.0), ("b", "Latin", 2.0), ("b", "Latin", 1.5), ("b", "Han", 9.0), ("b", "Han", 1.0), ("c", None, 9.0)]
    got = progress.script_vote(spark.createDataFrame(rows, "project_id string, script string, confidence double")).collect()
    assert [tuple(r) for r in got] == [("b", "Latin", 2, 3, 4)]


def test_size_delta(spark):
    d = lambda a, b: spark.range(1).select(progress.size_delta(F.lit(a), F.lit(b)).alias("d")).first().d
    assert tuple(d(1000, 900)) == (-10, "smaller", "1000 B → 900 B (-10%)")
    assert d(0, 5) is None


# --- stages


def _compute(df):
    bad = F.col("page_index") == 7
    return df.select("project_id", "page_index", F.when(~bad, F.concat("payload", F.lit("!"))).alias("payload"), F.when(bad, F.lit("broken")).alias("error"))


@pytest.fixture
def frames(spark):
    pages = spark.createDataFrame([("p", i, None) for i in (0, 1, 7, 9)], "project_id string, page_index int, rotation_override int")
    status = spark.createDataFrame([], "project_id string, page_index int, stage string, hash string, artifact_path string, size_bytes long")
    inputs = spark.createDataFrame([("p", i, f"in{i}") for i in (0, 1, 7)], "project_id string, page_index int, payload string")
    none = spark.createDataFrame([], "project_id string, page_index int, payload string")
    return pages, status, inputs, none


def test_stage_splits_and_second_run_is_cached(frames):
    pages, status, inputs, none = frames
    s = hashing.default_settings()
    run = stages.run_stage("preprocess", s, pages, status, inputs, none, _compute)
    got = {r.page_index: (r.status, r.error) for r in run.events.collect()}
    assert got == {0: ("done", None), 1: ("done", None), 7: ("failed", "broken"), 9: ("failed", "no render artifact")}
    assert sorted(r.page_index for r in run.status.collect()) == [0, 1]
    again = stages.run_stage("preprocess", s, pages, run.status, inputs, run.results, _compute)
    got = {r.page_index: r.status for r in again.events.collect()}
    assert got == {0: "cached", 1: "cached", 7: "failed", 9: "failed"}
    assert {r.payload for r in again.results.collect()} == {"in0!", "in1!"}
    # other settings, a lost artifact and an override are work again
    other = s.withField("preprocess.binarizer", F.lit("otsu"))
    assert stages.run_stage("preprocess", other, pages, run.status, inputs, run.results, _compute).events.where("status = 'cached'").count() == 0
    assert stages.run_stage("preprocess", s, pages, run.status, inputs, none, _compute).events.where("status = 'cached'").count() == 0
    turned = pages.withColumn("rotation_override", F.when(F.col("page_index") == 1, 90))
    got = {r.page_index: r.status for r in stages.run_stage("preprocess", s, turned, run.status, inputs, run.results, _compute).events.collect()}
    assert got[0] == "cached" and got[1] == "done"


def test_stage_subset_and_disabled(frames):
    pages, status, inputs, none = frames
    s = hashing.default_settings()
    run = stages.run_stage("preprocess", s, pages, status, inputs, none, _compute, page_indices=[1])
    assert [r.page_index for r in run.events.collect()] == [1]
    off = stages.run_stage("detect", s, pages, status, inputs, none, _compute, enabled=False)
    assert off.events.count() == 0 and off.status.count() == 0


def test_run_from_cascades_and_build_is_guarded(frames):
    pages, status, inputs, none = frames
    held = {"source": inputs, **{s: none for s in hashing.PAGE_STAGES}}
    compute = {s: _compute for s in hashing.PAGE_STAGES}
    status, results, events = stages.run_from("all", hashing.default_settings(), pages, status, held, compute)
    assert {(r.page_index, r.payload) for r in results["ocr"].collect()} == {(0, "in0!!!"), (1, "in1!!!")}
    ready, blocked = stages.guarded_builds(stages.build_inputs(pages, results["ocr"], status))
    assert ready.count() == 0 and blocked.first().error == "2 page(s) without recognised text"
    ready, blocked = stages.guarded_builds(stages.build_inputs(pages.where("page_index < 7"), results["ocr"], status))
    assert sorted((r.page_index, r.payload, r.osd_angle) for r in ready.collect()) == [(0, "in0!!!", 0), (1, "in1!!!", 0)] and blocked.count() == 0


def test_each_page_is_computed_once_for_each_stage(spark):
    """100 pages and four stages are 400 calls, whatever is read of the results; a second run makes none."""
    calls = spark.sparkContext.accumulator(0)

    def compute(df):
        def run(batches):
            for pdf in batches:
                calls.add(len(pdf))
                yield pdf[["project_id", "page_index"]].assign(payload=pdf["payload"] + "!", error=None)

        return df.mapInPandas(run, "project_id string, page_index int, payload string, error string")

    pages = spark.createDataFrame([("p", i, None) for i in range(100)], "project_id string, page_index int, rotation_override int")
    status = spark.createDataFrame([], "project_id string, page_index int, stage string, hash string, artifact_path string, size_bytes long")
    none = spark.createDataFrame([], "project_id string, page_index int, payload string")
    held = {"source": pages.selectExpr("project_id", "page_index", "'x' AS payload"), **{s: none for s in hashing.PAGE_STAGES}}
    computes, s = {k: compute for k in hashing.PAGE_STAGES}, hashing.default_settings()
    status, results, events = stages.run_from("all", s, pages, status, held, computes)
    assert {(r.stage, r["count"]) for r in events.where("status = 'done'").groupBy("stage").count().collect()} == {(k, 100) for k in hashing.PAGE_STAGES}
    assert status.count() == 400 and results["ocr"].where("payload = 'x!!!'").count() == 100 and events.count() == 400
    assert calls.value == 400
    _, _, events = stages.run_from("all", s, pages, status, results, computes)
    assert events.where("status = 'cached'").count() == 400 and calls.value == 400


def test_detect_needs_the_rendered_page_too(frames):
    pages, status, inputs, none = frames
    s = hashing.default_settings()
    second = inputs.where("page_index > 0")
    run = stages.run_stage("detect", s, pages, status, inputs, none, _compute, second=second)
    got = {r.page_index: (r.status, r.error) for r in run.events.collect()}
    assert got == {0: ("failed", "no render artifact"), 1: ("done", None), 7: ("failed", "broken"), 9: ("failed", "no preprocess artifact")}
    # one that is cached is not read again, whatever became of the rendered page
    again = stages.run_stage("detect", s, pages, run.status, inputs, run.results, _compute, second=second.limit(0))
    assert {r.page_index: r.status for r in again.events.collect()} == {0: "failed", 1: "cached", 7: "failed", 9: "failed"}


def test_build_is_guarded_cached_and_by_index(spark):
    """Project p is built of pages 2 and 0, q lacks a page, r has a build under this key."""
    from quirework.operators import kernels, pdf
    from test_images import page

    s = hashing.default_settings()
    key = spark.range(1).select(hashing.settings_hash(s, "build")).first()[0]
    pages = spark.createDataFrame([("p", 2, 90), ("p", 0, None), ("q", 0, None), ("q", 1, None), ("r", 0, None)], "project_id string, page_index int, rotation_override int")
    results = spark.createDataFrame([("p", 2, "third"), ("p", 0, "first"), ("q", 0, "one"), ("r", 0, "old")], "project_id string, page_index int, payload string")
    status = spark.createDataFrame([("p", 0, "preprocess", 180)], "project_id string, page_index int, stage string, osd_angle int")
    builds = spark.createDataFrame([("r", key, "r/output.pdf", 3), ("p", "old", "p/output.old.pdf", 1)], "project_id string, hash string, artifact_path string, size_bytes long")
    stored = spark.createDataFrame([("r", bytearray(b"pdf")), ("p", bytearray(b"old"))], "project_id string, content binary")
    png = bytearray(kernels.png_encode(page(33, 25)))

    def compute(rows):
        words = F.array(F.struct(F.col("payload").alias("text"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.lit(9.0).alias("size")))
        return pdf.build(
            rows.select(
                "project_id", F.lit("n").alias("name"), "page_index", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"),
                F.col("osd_angle").alias("rotation"), words.alias("words"), F.lit(bytes(png)).alias("payload"),
            )
        )

    run = stages.run_build(s, pages, results, status, builds, stored, compute)
    got = {r.project_id: (r.page_index, r.status, r.error) for r in run.events.collect()}
    assert got == {"p": (-1, "done", None), "q": (-1, "failed", "1 page(s) without recognised text"), "r": (-1, "cached", None)}
    docs = {r.project_id: bytes(r.content) for r in run.documents.collect()}
    assert docs.keys() == {"p", "r"} and docs["r"] == b"pdf" and pdf.texts(docs["p"]) == [["first"], ["third"]]
    assert docs["p"].index(b"/Rotate 180") < docs["p"].index(b"/Rotate 90")
    held = {r.project_id: (r.hash, r.artifact_path, r.size_bytes) for r in run.builds.collect()}
    assert held == {"p": (key, f"p/output.{key}.pdf", len(docs["p"])), "r": (key, "r/output.pdf", 3)}
    again = stages.run_build(s, pages, results, status, run.builds, run.documents, compute)
    assert {r.project_id: r.status for r in again.events.collect()} == {"p": "cached", "q": "failed", "r": "cached"}
    gone = stages.run_build(s, pages, results, status, run.builds, run.documents.limit(0), compute)
    assert {r.project_id: r.status for r in gone.events.collect()} == {"p": "done", "q": "failed", "r": "done"}


# --- recognisers


def test_registry():
    recognisers.register(recognisers.mock("m1"))
    n = len(recognisers.recognisers())
    recognisers.register(recognisers.mock("m1"))
    assert len(recognisers.recognisers()) == n
    with pytest.raises(KeyError, match="unknown OCR provider"):
        recognisers.recogniser("none")


def test_visible_providers(spark):
    keys = spark.createDataFrame([("mistral-ocr",)], "id string")
    got = {r.id for r in recognisers.visible(recognisers.catalogue(spark), keys).collect()}
    assert {"tesseract", "onnx-paddle", "mistral-ocr"} <= got and "gemini-flash" not in got


def test_pages_are_recognised(spark):
    pages = spark.createDataFrame([("p", 0, b"x"), ("p", 1, b"y")], "project_id string, page_index int, content binary")
    got = {r.page_index: (r.text, r.error) for r in recognisers.recognise_pages(pages, recognisers.mock(), "eng").collect()}
    assert got[1] == ("Mock page 2 of example document.", None)
    missing = recognisers.recognise_pages(pages, recognisers.recogniser("tesseract"), "eng").first()
    assert missing.text is None and "not installed" in missing.error


def test_each_region_is_cropped_before_the_call(spark):
    """A recogniser that answers with the size and the first pixel of what it is given."""
    from quirework.operators import kernels
    import numpy as np

    image = np.arange(80 * 100).reshape(80, 100) % 251
    png = kernels.png_encode(image.astype(np.uint8))

    def measure(content, index, language):
        got = kernels.png_decode(content)
        if got.shape[1] == 7:
            raise ValueError("seven")
        return f" {got.shape[1]} x {got.shape[0]}\n{got[0, 0, 0]} "

    which = recognisers.Recogniser("size", "Size", "hosted", measure)
    pages = spark.createDataFrame([("p", k, bytearray(png), 100, 80) for k in range(4)] + [("p", 4, bytearray(b"broken"), 100, 80)], "project_id string, page_index int, content binary, width int, height int")
    boxes = [(10, 20, 30, 4), (0, 0, 5, 9), (60, 70, 40, 10)]
    det = spark.createDataFrame(
        [("p", 0, boxes), ("p", 2, []), ("p", 3, [(0, 0, 7, 7), (0, 0, 5, 5)]), ("p", 4, boxes[:1])],
        "project_id string, page_index int, regions array<struct<x:int,y:int,width:int,height:int>>",
    )
    rows = {r.page_index: r for r in recognisers.by_region(pages, det, which, "eng").collect()}
    first = lambda x, y: image[y, x]
    want = [f"{w} x {h}\n{first(x, y)}" for x, y, w, h in boxes]
    assert rows[0].text == "\n".join(want) and rows[0].error is None
    assert [(ln.text, tuple(ln.bbox)) for ln in rows[0].lines] == list(zip(want, boxes, strict=True))
    # words stand in their region, line by line of the crop
    assert [(w.text, tuple(w.bbox)) for w in rows[0].lines[0].words] == [("30", (10, 20, 30, 2)), ("x", (10, 20, 30, 2)), ("4", (10, 20, 30, 2)), (str(first(10, 20)), (10, 22, 30, 2))]
    assert len(rows[0].words) == 12
    for k in (1, 2):
        assert [ln.text for ln in rows[k].lines] == ["100 x 80", "0"] and rows[k].lines[1].bbox.y == 40 and rows[k].text == " 100 x 80\n0 "
    assert rows[3].error == "seven" and rows[4].error


def test_requests_of_the_hosted_services(spark):
    import base64
    import json

    seen = []

    def send(url, headers, body):
        seen.append((url, headers, json.loads(body)))
        if "mistral" in url:
            return 200, json.dumps({"pages": [{"markdown": "# Title"}]}).encode()
        return 200, json.dumps({"candidates": [{"content": {"parts": [{"text": "plain"}]}}]}).encode()

    assert recognisers.gemini("k&y", send).recognise(b"img", 0, "eng") == "plain"
    assert recognisers.mistral("key", send).recognise(b"img", 0, "eng") == "# Title"
    data = base64.b64encode(b"img").decode()
    (url, headers, body), (url2, headers2, body2) = seen
    assert url.endswith("?key=k%26y") and body["contents"][0]["parts"][1] == {"inlineData": {"mimeType": "image/png", "data": data}}
    assert body["generationConfig"]["temperature"] == 0 and "Authorization" not in headers
    assert headers2["Authorization"] == "Bearer key" and body2 == {"model": "mistral-ocr-latest", "document": {"type": "image_url", "image_url": "data:image/png;base64," + data}}
    page = spark.createDataFrame([("p", 0, b"x")], "project_id string, page_index int, content binary")
    assert recognisers.recognise_pages(page, recognisers.recogniser("mistral-ocr"), "eng").first().error == "mistral-ocr has no key"


def test_hosted_replies():
    import json

    a = {"candidates": [{"content": {"parts": [{"text": "x"}, {"text": "y"}]}}]}
    b = {"pages": [{"index": 0, "markdown": "# t", "dimensions": {"width": 1, "height": 2}}]}
    assert recognisers.candidate_text(a) == "xy" and recognisers.first_page_text(b) == "# t" and recognisers.first_page_text({}) == ""
    send = lambda url, headers, body: (401, json.dumps({"message": "no key"}).encode())
    r = recognisers.hosted("h", "H", "https://h.example", lambda c, lang: ({}, {}), recognisers.first_page_text, send)
    with pytest.raises(RuntimeError, match="no key"):
        r.recognise(b"", 0, "eng")


def test_deadline():
    import time

    with pytest.raises(TimeoutError, match="slow timed out"):
        recognisers.with_deadline(lambda: time.sleep(1), 0.05, "slow")


# --- quality


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_align_lines(spark):
    import random

    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    cases = []
    for _ in range(25):
        ex = [" ".join(rng.choices(words, k=3)) for _ in range(rng.randrange(14))]
        ac = ["".join(c if rng.random() > 0.1 else "x" for c in e) for e in ex if rng.random() > 0.3] + (["extra"] if rng.random() > 0.5 else [])
        cases.append((ex, ac))

    def score(e, a):
        return 1 - _levenshtein(e, a) / len(e) if e else float(not a)

    def want(ex, ac):
        at, out = 0, []
        for a in ac:
            best = at if at < len(ex) else len(ex) - 1
            for k in range(at, min(len(ex), at + 8)):
                if score(ex[k], a) > score(ex[best], a):
                    best = k
            if best >= 0:
                at = best + 1
            out.append(best)
        return out

    df = spark.createDataFrame([(k, e, a) for k, (e, a) in enumerate(cases)], "k int, e array<string>, a array<string>")
    got = {r.k: r.o for r in df.select("k", quality.align_lines(F.col("e"), F.col("a")).alias("o")).collect()}
    assert got == {k: want(e, a) for k, (e, a) in enumerate(cases)}


def test_token_overlap(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"], ["a", "c", "a", "a"]), (2, [], []), (3, ["x"], [])], "k int, expected array<string>, actual array<string>")
    got = {r.k: (r.matched, r.precision, r.recall, r.f1) for r in quality.token_overlap(df, ["k"]).collect()}
    assert got == {1: (2, 0.5, 0.6667, 0.5714), 2: (0, 0.0, 0.0, 0.0), 3: (0, 0.0, 0.0, 0.0)}
