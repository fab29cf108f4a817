import random

from pyspark.sql import functions as F

from quirework.operators import exports, geometry, layout, overlay


def merged(boxes):
    """What merging means, box by box."""
    out = []
    for x, y, w, h in boxes:
        if out:
            a = out[-1]
            over = max(0, min(a[1] + a[3], y + h) - max(a[1], y))
            least, gap = min(a[3], h), x - (a[0] + a[2])
            if over > least * 0.45 and -8 <= gap < max(24, least * 1.2):
                x1, y1 = min(a[0], x), min(a[1], y)
                out[-1] = (x1, y1, max(a[0] + a[2], x + w) - x1, max(a[1] + a[3], y + h) - y1)
                continue
        out.append((x, y, w, h))
    return out


def test_merge_line_boxes(spark):
    rng = random.Random(1)
    cases = [[(rng.randrange(200), rng.randrange(40), rng.randrange(5, 40), rng.randrange(5, 30)) for _ in range(rng.randrange(12))] for _ in range(40)]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, b array<struct<x:int,y:int,width:int,height:int>>")
    got = {r["k"]: [tuple(b) for b in r["m"]] for r in df.select("k", layout.merge_line_boxes(F.col("b")).alias("m")).collect()}
    assert got == {k: merged(c) for k, c in enumerate(cases)}


def test_reading_order(spark):
    boxes = [(1, 300, 0), (1, 10, 4), (1, 10, 52), (1, 200, 50), (1, 5, 100)]
    df = spark.createDataFrame(boxes, "page int, x int, y int")
    got = [(r.x, r.y) for r in layout.reading_rank(df, ["page"]).orderBy("rank").collect()]
    assert got == [(10, 4), (300, 0), (10, 52), (200, 50), (5, 100)]


def test_proportional_words(spark):
    b = F.struct(F.lit(10).alias("x"), F.lit(5).alias("y"), F.lit(100).alias("width"), F.lit(9).alias("height"))
    df = spark.createDataFrame([("ab  cde",), ("one",), ("",)], "t string")
    rows = df.select(layout.proportional_words(F.col("t"), b, F.lit(0.5)).alias("w")).collect()
    assert [(w.text, w.bbox.x, w.bbox.width) for w in rows[0].w] == [("ab", 10, 29), ("cde", 67, 43)]
    assert [(w.text, w.bbox.width) for w in rows[1].w] == [("one", 100)]
    assert [(w.text, w.bbox.width) for w in rows[2].w] == [("", 100)]


def test_mock_page(spark):
    p = spark.range(1).select(layout.mock_page(F.lit(2)).alias("p")).first().p
    assert p.text == "Mock page 3 of example document."
    assert [w.bbox.x for w in p.words] == [20 + 90 * k for k in range(6)]
    assert p.lines[0].bbox.width == 540


def test_empty_page_has_no_lines(spark):
    df = spark.createDataFrame([(None,), ("",), (" \n ",)], "t string")
    got = df.select(F.size(layout.even_lines(F.coalesce("t", F.lit("")), F.lit(10), F.lit(10))).alias("n")).collect()
    assert [r.n for r in got] == [0, 0, 0]


def test_placement_turns(spark):
    b = F.struct(F.lit(100).alias("x"), F.lit(200).alias("y"), F.lit(5000).alias("width"), F.lit(50).alias("height"))
    at = {r: spark.range(1).select(overlay.placement(F.lit("word"), b, F.lit(1000.0), F.lit(1000.0), F.lit(500.0), F.lit(400.0), F.lit(r)).alias("p")).first().p for r in (0, 90, 180, 270)}
    assert (at[0].x, at[0].y) == (50.0, 300.0)
    assert (at[90].x, at[90].y) == (500 - 375.0, 40.0)
    assert (at[180].x, at[180].y) == (450.0, 100.0)
    assert (at[270].x, at[270].y) == (375.0, 360.0)


def test_font_shrinks_to_fit(spark):
    b = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(10).alias("width"), F.lit(100).alias("height"))
    p = spark.range(1).select(overlay.placement(F.lit("WWWW"), b, F.lit(100.0), F.lit(100.0), F.lit(100.0), F.lit(100.0), F.lit(0)).alias("p")).first().p
    assert abs(p.size - 10 / (4 * 0.944)) < 1e-9


def test_helvetica_table():
    assert len(overlay.HELVETICA) == 95


def test_rotation_prefers_override(spark):
    r = lambda o, d, e: spark.range(1).select(geometry.resolved_rotation(F.lit(o).cast("int"), F.lit(d), F.lit(e)).alias("r")).first().r
    assert (r(0, 90, True), r(None, 90, True), r(None, 90, False)) == (0, 90, 0)


def test_pixels_at_300_dpi(spark):
    got = spark.range(1).select(geometry.pixels_at(F.lit(612.0), F.lit(300)).alias("w"), geometry.pixels_at(F.lit(792.0), F.lit(300)).alias("h")).first()
    assert tuple(got) == (2550, 3300)


def test_documents_have_their_parts_in_order(spark):
    import xml.etree.ElementTree as ET

    lines = layout.even_lines(F.col("t"), F.lit(100), F.lit(60))
    df = spark.createDataFrame([("p", "n & m", 2, "b\nc <d>"), ("p", "n & m", 0, "it's")], "project_id string, name string, page_index int, t string")
    for kind, page in (("hocr", exports.hocr_page), ("alto", exports.alto_page)):
        rows = df.withColumn("part", page(F.col("page_index"), F.lit(100), F.lit(60), lines))
        doc = exports.document(rows, kind).first().document
        root = ET.fromstring(doc.encode())
        ids = [e.get("ID") or e.get("id") for e in root.iter() if (e.get("ID") or e.get("id") or "").startswith("page_")]
        assert ids == ["page_1", "page_3"]


def test_a_page_of_words_without_lines_is_one_line(spark):
    df = spark.range(1).select(layout.even_lines(F.lit("one two"), F.lit(100), F.lit(60)).alias("lines"))
    words = F.flatten(F.transform("lines", lambda ln: ln["words"]))
    none = F.slice("lines", 1, 0)
    made = exports.lines_or_page(none, F.lit("one two"), words, F.lit(100), F.lit(60))
    r = df.select(exports.hocr_page(F.lit(0), F.lit(100), F.lit(60), made).alias("h"), exports.alto_page(F.lit(0), F.lit(100), F.lit(60), made).alias("a")).first()
    assert r.h.count("ocr_line") == 1 and r.h.count("ocrx_word") == 2 and 'id="line_1_1" title="bbox 0 0 100 60"' in r.h
    assert r.a.count("<TextLine") == 1 and r.a.count("<String") == 2
    same = exports.lines_or_page(F.col("lines"), F.lit("x"), words, F.lit(100), F.lit(60))
    assert df.select((same == F.col("lines")).alias("same")).first().same


def test_join_growing(spark):
    from quirework.functions.text import join_growing

    cases = [["", "", "a", "", "b", ""], [], [""], ["x"], ["", "y"]]
    df = spark.createDataFrame([(c,) for c in cases], "l array<string>")

    def grown(parts):
        acc = ""
        for p in parts:
            acc = p if acc == "" else acc + "\n" + p
        return acc

    assert [r.t for r in df.select(join_growing(F.col("l")).alias("t")).collect()] == [grown(c) for c in cases]


def test_native_hocr(spark):
    h = "<html><div class='ocr_page' id='p9'><span class='ocr_line'>x</span></div></html>"
    got = spark.range(1).select(exports.native_block(F.lit(h), F.lit(4)).alias("a"), exports.native_block(F.lit("<div class='ocr_page'></div>"), F.lit(0)).alias("b")).first()
    assert got.a == "<div class='ocr_page' id=\"page_5\"><span class='ocr_line'>x</span></div>"
    assert got.b is None
    more = """<p id="no"><DIV class='x'></DIV><div data-x="1" class="a ocr_page b" title='t'><i class='ocrx_word' id="w1">q</i></div><div class='ocr_page'></div>"""
    got = spark.range(1).select(exports.native_block(F.lit(more), F.lit(0)).alias("a"), exports.native_block(F.lit("<div class='ocr_page'>ocr_line"), F.lit(0)).alias("b")).first()
    assert got.a == """<div data-x="1" class="a ocr_page b" title='t'><i class='ocrx_word' id="page_1">q</i></div>""" and got.b is None
