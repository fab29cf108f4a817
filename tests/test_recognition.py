import random

import numpy as np
from pyspark.sql import functions as F

from quirework.operators import kernels, layout, overlay, pdf, recognition
from test_images import page
from test_layout import merged


def test_joined_lines_is_the_column_function():
    rng = random.Random(9)
    for _ in range(50):
        boxes = [(rng.randrange(300), 20 * rng.randrange(6), rng.randrange(5, 40), rng.randrange(9, 15)) for _ in range(12)]
        assert recognition.joined_lines(boxes) == merged(recognition.in_reading_order(boxes, 8))


def test_boxes_of_scores():
    scores = np.zeros((40, 80))
    scores[10:20, 10:30] = 0.9
    scores[10:20, 36:60] = 0.8
    scores[30:34, 70:72] = 0.9  # too small
    assert recognition.boxes_of(scores) == [(7, 7, 55, 16)] or len(recognition.boxes_of(scores)) == 1
    assert recognition.boxes_of(np.zeros((5, 5))) == []


def test_grown_needs_two_neighbours():
    bits = np.zeros((3, 4), bool)
    bits[1, 0] = bits[1, 2] = True
    assert recognition.grown(bits).astype(int).tolist() == [[0, 1, 0, 0], [1, 1, 1, 0], [0, 1, 0, 0]]


def test_decoding():
    steps = np.array([[0, 0.9, 0], [0, 0.8, 0], [0.9, 0, 0], [0, 0.7, 0], [0, 0, 0.5], [-1, -1, -1]])
    text, score = recognition.decoded(steps, ["", "a", "b"])
    assert text == "aab" and abs(score - (0.9 + 0.7 + 0.5) / 3) < 1e-9
    assert recognition.decoded(np.zeros((0, 3)), ["", "a"]) == ("", 0.0)


def test_reader_with_made_sessions():
    image = page()

    def detect(x):
        return (x[0, 0] < 0).astype(float)  # dark is text

    seen = []

    def read(x):
        seen.append(x.shape)
        return np.array([[[0, 0.9, 0], [0, 0, 0.8]]])

    reader = recognition.LineReader(detect, lambda x: np.array([[5.0, 0.0]]), read, ["", "h", "i"])
    out = reader.recognise(image, "eng")
    assert len(out["lines"]) == 6 and out["text"] == "\n".join(["hi"] * 6) and seen[0] == (1, 3, 48, 320)
    ys = [ln["bbox"][1] for ln in out["lines"]]
    assert ys == sorted(ys)
    given = reader.recognise(image, "eng", [(30, 30, 300, 40)])
    assert len(given["lines"]) == 1
    try:
        reader.recognise(image, "deu")
        raise AssertionError
    except ValueError:
        pass


def test_words_along_a_line(spark):
    text = "two  words here"
    b = F.struct(F.lit(3).alias("x"), F.lit(4).alias("y"), F.lit(150).alias("width"), F.lit(9).alias("height"))
    want = spark.range(1).select(layout.proportional_words(F.lit(text), b, F.lit(0.5)).alias("w")).first().w
    got = recognition.words_along(text, (3, 4, 150, 9), 0.5)
    assert [(w["text"], w["bbox"]) for w in got] == [(w.text, tuple(w.bbox)) for w in want]


def test_pdf_holds_its_words(spark):
    words = [("Hello", 10.0, 20.0, 9.0), ("(a\\b)", 30.0, 20.0, 9.0), ("é漢", 1.0, 2.0, 3.0)]
    made = pdf.write([{"width": 100.0, "height": 50.0, "rotation": 90, "image": page(50, 100), "words": words}, {"width": 9.0, "height": 9.0, "image": page(20, 20), "words": []}], "t")
    assert made.startswith(b"%PDF-") and made.rstrip().endswith(b"%%EOF") and b"/Rotate 90" in made
    assert pdf.texts(made) == [["Hello", "(a\\b)", "é?"], []]
    start = int(made.rsplit(b"startxref\n", 1)[1].split(b"\n")[0])
    assert made[start : start + 4] == b"xref"
    for k, line in enumerate(made[start:].split(b"\n")[3:], 1):
        if not line.endswith(b"n "):
            break
        assert made[int(line[:10]) :].startswith(b"%d 0 obj" % k)


def test_build_orders_pages_by_index(spark):
    png = bytearray(kernels.png_encode(page(33, 25)))
    at = overlay.placement(F.col("t"), F.struct(F.lit(1).alias("x"), F.lit(2).alias("y"), F.lit(20).alias("width"), F.lit(5).alias("height")), F.lit(25.0), F.lit(33.0), F.lit(612.0), F.lit(792.0), F.lit(0))
    df = spark.createDataFrame([("p", "n", 2, "third", png), ("p", "n", 0, "first", png), ("q", "m", 5, "only", png)], "project_id string, name string, page_index int, t string, payload binary")
    rows = df.select("project_id", "name", "page_index", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.lit(0).alias("rotation"), "payload", F.array(F.struct(F.col("t").alias("text"), at["x"].alias("x"), at["y"].alias("y"), at["size"].alias("size"))).alias("words"))
    got = {r.project_id: pdf.texts(bytes(r.content)) for r in pdf.build(rows).collect()}
    assert got == {"p": [["first"], ["third"]], "q": [["only"]]}
