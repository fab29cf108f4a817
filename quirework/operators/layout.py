"""Layout of recognised text: lines, words and their boxes, as nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.text import NOT_WS, js_round, js_trim, split_lines, split_words

WORD_CONFIDENCE = 0.85
# How much of the lower box's height two boxes of one line share, how far the next may begin before the
# last ends and how far behind it, in pixels or in heights.
SHARED_HEIGHT, MOST_BACK, MOST_GAP, GAP_HEIGHTS = 0.45, 8, 24, 1.2


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), width.cast("int").alias("width"), height.cast("int").alias("height"))


def word(text: Column, bbox: Column, confidence: Column) -> Column:
    return F.struct(text.alias("text"), bbox.alias("bbox"), confidence.cast("double").alias("confidence"))


def even_lines(text: Column, width: Column, height: Column, confidence: float = WORD_CONFIDENCE) -> Column:
    """Lines of a plain text spread evenly over a page; every word has its line's box."""

    def placed(lines: Column) -> Column:
        part = height / F.size(lines)

        def one(line: Column, i: Column) -> Column:
            bbox = box(F.lit(0), js_round(part * i), width, F.greatest(F.lit(1), js_round(part)))
            words = let(bbox, lambda b: F.transform(split_words(line), lambda w: word(w, b, F.lit(confidence))))
            return F.struct(line.alias("text"), bbox.alias("bbox"), words.alias("words"))

        return F.transform(lines, one)

    return let(split_lines(text), placed)


def even_line_boxes(text: Column, width: Column, height: Column) -> Column:
    """(text, bbox) of the lines of ``even_lines``, without their words."""

    def placed(lines: Column) -> Column:
        part = height / F.size(lines)
        one = lambda line, i: F.struct(line.alias("text"), box(F.lit(0), js_round(part * i), width, F.greatest(F.lit(1), js_round(part))).alias("bbox"))
        return F.transform(lines, one)

    return let(split_lines(text), placed)


def even_line_rows(pages: DataFrame, keep: list[str], text: Column, width: Column, height: Column) -> DataFrame:
    """(.., line, text, bbox): the lines of ``even_lines`` as rows, without their words."""
    lines = pages.select(*keep, split_lines(text).alias("lines")).select(*keep, F.size("lines").alias("n"), F.posexplode("lines").alias("line", "text"))
    part = height / F.col("n")
    bbox = box(F.lit(0), js_round(part * F.col("line")), width, F.greatest(F.lit(1), js_round(part)))
    return lines.select(*keep, "line", "text", bbox.alias("bbox"))


def even_words(pages: DataFrame, keep: list[str], text: Column, width: Column, height: Column, confidence: float = WORD_CONFIDENCE) -> DataFrame:
    """(.., line, word, text, bbox, confidence): ``even_lines`` as a row for each word, whose box is made once for each line."""
    lines = even_line_rows(pages, keep, text, width, height)
    rows = lines.select(*keep, "line", "bbox", F.posexplode(split_words(F.col("text"))).alias("word", "text"))
    return rows.select(*keep, "line", "word", "text", "bbox", F.lit(confidence).cast("double").alias("confidence"))


def strip_markdown(text: Column) -> Column:
    """Without a leading or trailing code fence and without heading marks."""
    text = F.regexp_replace(text, r"\A```[a-zA-Z]*\n?", "")
    text = F.regexp_replace(text, r"\n?```\s*\z", "")
    return F.regexp_replace(text, r"(?m)^#{1,6}[ \t]+", "")


def mock_page(index: Column) -> Column:
    """The deterministic stand-in for a recogniser: (text, lines)."""
    text = F.concat(F.lit("Mock page "), (index + 1).cast("string"), F.lit(" of example document."))
    words = F.transform(
        F.split(text, " "),
        lambda w, i: word(w, box(20 + i * 90, F.lit(40), F.lit(80), F.lit(28)), F.lit(0.99)),
    )
    line = F.struct(text.alias("text"), box(F.lit(20), F.lit(40), F.size(words) * 90, F.lit(28)).alias("bbox"), words.alias("words"))
    return F.struct(text.alias("text"), F.array(line).alias("lines"), words.alias("words"))


def corner_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("width"), (y1 - y0).alias("height"))


def unit_confidence(percent: Column) -> Column:
    """Percent to 0..1; what is no number is 0."""
    return F.coalesce(percent.cast("double") / 100, F.lit(0.0))


def flatten_blocks(blocks: Column) -> Column:
    """blocks > paragraphs > lines to lines, in order, missing levels as empty."""
    none = lambda a: F.filter(a, lambda x: x.isNotNull())
    paragraphs = F.flatten(none(F.transform(none(blocks), lambda b: b["paragraphs"])))
    return F.flatten(none(F.transform(none(paragraphs), lambda p: p["lines"])))


def offset_words(words: Column, region: Column) -> Column:
    """Words recognised inside a region, moved to page coordinates."""
    return F.transform(
        words,
        lambda w: word(
            w["text"],
            box(w["bbox"]["x"] + region["x"], w["bbox"]["y"] + region["y"], w["bbox"]["width"], w["bbox"]["height"]),
            w["confidence"],
        ),
    )


def proportional_words(text: Column, bbox: Column, confidence: Column) -> Column:
    """Words placed by their share of the line's characters; one word takes the whole box."""
    n = F.length(text)
    gaps = F.split(text, NOT_WS + "+", -1)
    whole = F.array(word(text, box(bbox["x"], bbox["y"], bbox["width"], bbox["height"]), confidence))
    none = F.array().cast("array<struct<s:int,e:int>>")

    # (start, end) of each token from the running length of gaps and tokens
    def step(acc: Column, z: Column) -> Column:
        s = acc["at"] + F.length(z["g"])
        e = s + F.length(z["t"])
        grown = F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e")))).alias("out"))
        return F.when(z["t"].isNull(), acc).otherwise(grown)

    def placed(toks: Column) -> Column:
        spans = F.aggregate(F.arrays_zip(gaps.alias("g"), toks.alias("t")), F.struct(F.lit(0).alias("at"), none.alias("out")), step)

        def one(z: Column) -> Column:
            x = bbox["x"] + js_round(bbox["width"] * z["p"]["s"] / n)
            right = bbox["x"] + js_round(bbox["width"] * z["p"]["e"] / n)
            return word(z["t"], box(x, bbox["y"], F.greatest(F.lit(1), right - x), bbox["height"]), confidence)

        zipped = F.arrays_zip(toks.alias("t"), spans["out"].alias("p"))
        return F.when(F.size(toks) <= 1, whole).otherwise(F.transform(zipped, one))

    return let(F.regexp_extract_all(text, F.lit(NOT_WS + "+"), F.lit(0)), placed)


def reading_rank(boxes: DataFrame, page: list[str], tolerance: int = 10) -> DataFrame:
    """``boxes`` (x, y) with ``rank``, from 0, in reading order within each page.

    Boxes whose tops follow one another by less than the tolerance are one row,
    rows are read from top to bottom, and from left to right within. This is
    what a pairwise comparison means wherever that is a consistent order; where
    it is not, rows chain.
    """
    down = Window.partitionBy(*page).orderBy("y", "x")
    opens = F.coalesce(F.col("y") - F.lag("y").over(down) >= tolerance, F.lit(True)).cast("int")
    rows = boxes.withColumn("row_", opens).withColumn("row_", F.sum("row_").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    across = Window.partitionBy(*page).orderBy("row_", "x", "y")
    return rows.withColumn("rank", (F.row_number().over(across) - 1).cast("int")).drop("row_")


def merge_line_boxes(boxes: Column) -> Column:
    """Boxes in reading order, each merged into the one before it if both stand on one line."""

    def joined(last: Column, b: Column) -> Column:
        x1, y1 = F.least(last["x"], b["x"]), F.least(last["y"], b["y"])
        x2 = F.greatest(last["x"] + last["width"], b["x"] + b["width"])
        y2 = F.greatest(last["y"] + last["height"], b["y"] + b["height"])
        return box(x1, y1, x2 - x1, y2 - y1)

    def same_line(last: Column, b: Column) -> Column:
        over = F.greatest(
            F.lit(0), F.least(last["y"] + last["height"], b["y"] + b["height"]) - F.greatest(last["y"], b["y"])
        )
        least = F.least(last["height"], b["height"])
        gap = b["x"] - (last["x"] + last["width"])
        return (over > least * SHARED_HEIGHT) & (gap >= -MOST_BACK) & (gap < F.greatest(F.lit(float(MOST_GAP)), least * GAP_HEIGHTS))

    def step(acc: Column, b: Column) -> Column:
        n = F.size(acc)
        last = F.get(acc, n - 1)
        return F.when((n > 0) & same_line(last, b), F.concat(F.slice(acc, 1, F.greatest(n - 1, F.lit(0))), F.array(joined(last, b)))).otherwise(
            F.concat(acc, F.array(box(b["x"], b["y"], b["width"], b["height"])))
        )

    return F.aggregate(boxes, F.array().cast("array<struct<x:int,y:int,width:int,height:int>>"), step)


def is_text_word(text: Column, confidence: Column, split: bool = False) -> Column:
    """Words worth placing: not blank, not a doubtful fragment, not a guess; ``split``: of ``split_words``, without white space."""
    return ~(((text if split else js_trim(text)) == "") | ((F.length(text) < 2) & (confidence < 0.5)) | (confidence < 0.2))
