"""Queries over the layout of recognised text.

Each document is a recognised page of its source's project; its index is its
doc_id, as indices have holes where pages were removed. A page is a Letter sheet
at 300 dots per inch, 2550 x 3300 pixels, or 612 x 792 points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NOT_WS, TRIM, WS, join_growing, split_lines, split_words
from ..operators import layout, overlay
from ..runtime import spread, table

WIDTH, HEIGHT = 2550, 3300
POINTS_W, POINTS_H = 612.0, 792.0


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")))


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, text, lines): one page each."""
    docs = _texts(spark, sf_dir)
    return docs.withColumn("lines", layout.even_lines(F.col("text"), F.lit(WIDTH), F.lit(HEIGHT)))


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, line, text, bbox): the lines of ``page_lines`` without their words."""
    return layout.even_line_rows(_texts(spark, sf_dir), ["doc_id", "source"], F.col("text"), F.lit(WIDTH), F.lit(HEIGHT))


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rows(spark, sf_dir).select("doc_id", "line", "text", "bbox.*", F.size(split_words(F.col("text"))).alias("n_words"))


def words_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, line, word, text, bbox, confidence): the words of ``page_lines``, whose box is made once for each line."""
    return layout.even_words(_texts(spark, sf_dir), ["doc_id", "source"], F.col("text"), F.lit(WIDTH), F.lit(HEIGHT))


def layout_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_frame(spark, sf_dir).select("doc_id", "line", "word", "text", "bbox.*", "confidence")


def _placed(spark: SparkSession, sf_dir: str, rotation) -> DataFrame:
    kept = words_frame(spark, sf_dir).where(layout.is_text_word(F.col("text"), F.col("confidence"), split=True))
    at = overlay.placement(
        F.col("text"), F.col("bbox"), F.lit(float(WIDTH)), F.lit(float(HEIGHT)), F.lit(POINTS_W), F.lit(POINTS_H), rotation
    )
    return kept.withColumn("at", at)


def overlay_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark-free placement of every word, the page turned by a quarter for each step of doc_id."""
    turn = (F.pmod(F.col("doc_id"), F.lit(4)) * 90).cast("int")
    rows = _placed(spark, sf_dir, turn)
    r = lambda c: F.round(F.col(c), 6)
    return rows.select("doc_id", "line", "word", r("at.x").alias("x"), r("at.y").alias("y"), r("at.size").alias("size"))


def overlay_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: lines, words, mean confidence and the corner of the text of each page, without a shuffle.

    The words of a line share its box and their confidence, so they are counted line by line.
    """
    conf = F.lit(layout.WORD_CONFIDENCE)
    words = lambda text: F.size(F.filter(split_words(text), lambda w: layout.is_text_word(w, conf, split=True)))
    lines = layout.even_line_boxes(F.col("text"), F.lit(WIDTH), F.lit(HEIGHT))
    counted = F.transform(lines, lambda ln: F.struct(words(ln["text"]).alias("n"), ln["bbox"].alias("bbox")))
    rows = _texts(spark, sf_dir).select("doc_id", counted.alias("l"))
    rows = rows.select("doc_id", F.size("l").alias("n_lines"), F.filter("l", lambda ln: ln["n"] > 0).alias("w"))
    rows = rows.withColumn("n", F.aggregate("w", F.lit(0), lambda a, ln: a + ln["n"]))
    n, total = F.col("n"), F.aggregate("w", F.lit(0.0), lambda a, ln: a + ln["n"] * conf)
    sy = POINTS_H / HEIGHT
    lefts = F.transform("w", lambda ln: ln["bbox"]["x"] * F.lit(POINTS_W / WIDTH))
    bottoms = F.transform("w", lambda ln: F.lit(POINTS_H) - (ln["bbox"]["y"] + ln["bbox"]["height"]) * F.lit(sy))
    return rows.select(
        "doc_id",
        "n_lines",
        n.alias("n_words"),
        F.round(F.when(n > 0, total / n).otherwise(0.0), 6).alias("mean_conf"),
        F.round(F.array_min(lefts), 4).alias("text_left_pt"),
        F.round(F.array_min(bottoms), 4).alias("text_bottom_pt"),
    )


def page_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir).select("doc_id", split_lines(F.col("text")).alias("lines"))
    joined = F.array_join("lines", "\n")
    return rows.select(
        "doc_id",
        F.size("lines").alias("n_lines"),
        F.aggregate("lines", F.lit(0), lambda n, ln: n + F.size(split_words(ln))).alias("n_words"),
        F.length(joined).alias("n_chars"),
        F.sha2(joined.cast("binary"), 256).alias("text_sha256"),
    )


def growing_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a page that is gathered part by part: leading empty parts vanish, later ones leave a line."""
    docs = table(spark, sf_dir, "documents")
    parts = F.split(F.coalesce("text", F.lit("")), "\\. ")
    held = F.transform(parts, lambda p, i: F.when(F.pmod(i + F.col("doc_id"), F.lit(3)) == 0, "").otherwise(p))
    made = docs.select("doc_id", join_growing(held).alias("t"))
    return made.select("doc_id", F.length("t").alias("n_chars"), F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"))


def mock_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", layout.mock_page(F.col("doc_id")).alias("p"))
    words = docs.select("doc_id", F.posexplode("p.words").alias("word", "w"), F.col("p.lines")[0]["bbox"]["width"].alias("line_width"))
    return words.select("doc_id", "word", F.col("w.text").alias("text"), "w.bbox.*", F.col("w.confidence").alias("confidence"), "line_width")


def markdown_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layout leaves out fences and headings; the text that is kept does not."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    md = F.concat(F.lit("```markdown\n# "), text, F.lit("\n## Notes\n```"))
    rows = docs.select("doc_id", md.alias("md"), layout.even_lines(layout.strip_markdown(md), F.lit(WIDTH), F.lit(HEIGHT)).alias("lines"))
    rows = rows.select("doc_id", F.length("md").alias("text_chars"), F.posexplode("lines").alias("line", "l"))
    return rows.select("doc_id", "text_chars", "line", F.col("l.text").alias("text"), "l.bbox.*")


def proportional_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = table(spark, sf_dir, "benchmark")
    one = F.struct(F.lit(100).alias("x"), F.lit(200).alias("y"), F.lit(2000).alias("width"), F.lit(40).alias("height"))
    rows = bench.select("item_id", F.posexplode(layout.proportional_words(F.col("text"), one, F.lit(0.9))).alias("word", "w"))
    return rows.select("item_id", "word", F.col("w.text").alias("text"), "w.bbox.*")


def region_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as a region of a page; its words move by the region's corner, the page's text gathers them."""
    turns = table(spark, sf_dir, "conversations")
    region = F.struct((F.col("turn") * 17).cast("int").alias("x"), (F.col("turn") * 120).cast("int").alias("y"))
    words = F.flatten(F.transform(layout.even_lines(F.coalesce("text", F.lit("")), F.lit(800), F.lit(100)), lambda ln: ln["words"]))
    moved = turns.select("conv_id", "turn", F.posexplode(layout.offset_words(words, region)).alias("word", "w"))
    return moved.select("conv_id", "turn", "word", F.col("w.text").alias("text"), "w.bbox.*")


def ordered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation in order, joined by newlines."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    text = F.array_join(F.transform(parts, lambda p: p["text"]), "\n")
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_parts"), text.alias("text"))


QUERIES = {
    f.__name__: f
    for f in (
        layout_lines, layout_words, overlay_words, overlay_summary, page_text_stats, growing_text, mock_ocr,
        markdown_layout, proportional_words, region_offset, ordered_parts,
    )
}



def _lines(t: str) -> str:
    parts = f"string_split_regex({t}, '\\r?\\n')"
    return f"list_filter(list_transform({parts}, lambda s: regexp_replace(s, '{TRIM}', '', 'g')), lambda s: s <> '')"


def _words(t: str) -> str:
    return f"list_filter(string_split_regex({t}, '{WS}+'), lambda s: s <> '')"


def _lines_cte(source: str, key: str, text: str, height: int, extra: str = "") -> str:
    return f"""
p AS (SELECT {key}, {extra} {_lines(text)} AS ls FROM {source}),
l AS (SELECT *, ls[i] AS text, CAST(i - 1 AS INT) AS line, CAST(floor({height} / len(ls) * (i - 1) + 0.5) AS INT) AS y,
             CAST(greatest(1, floor({height} / len(ls) + 0.5)) AS INT) AS height
      FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM p)),
w AS (SELECT * EXCLUDE (text), ws[j] AS text, CAST(j - 1 AS INT) AS word
      FROM (SELECT *, {_words('text')} AS ws, unnest(range(1, len({_words('text')}) + 1)) AS j FROM l))"""


_DOCS = _lines_cte("documents", "doc_id, source", "coalesce(text, '')", HEIGHT)
_HELV = "[" + ", ".join(map(str, overlay.HELVETICA)) + "]"
_NOISE = f"NOT (regexp_replace(text, '{TRIM}', '', 'g') = '' OR (length(text) < 2 AND 0.85 < 0.5) OR 0.85 < 0.2)"

SQL = {
    "layout_lines": f"WITH {_DOCS} SELECT doc_id, line, text, 0 AS x, y, {WIDTH} AS width, height, CAST(len({_words('text')}) AS INT) AS n_words FROM l",
    "layout_words": f"WITH {_DOCS} SELECT doc_id, line, word, text, 0 AS x, y, {WIDTH} AS width, height, CAST(0.85 AS DOUBLE) AS confidence FROM w",
    "overlay_words": f"""
WITH {_DOCS},
k AS (SELECT *, CAST(((doc_id % 4) + 4) % 4 * 90 AS INT) AS rot,
             list_sum(list_transform(string_split(text, ''), lambda c: CASE WHEN c = '' THEN 0 WHEN ascii(c) BETWEEN 32 AND 126 THEN {_HELV}[ascii(c) - 31] ELSE 556 END)) AS units
      FROM w WHERE {_NOISE}),
d AS (SELECT *, CASE WHEN rot IN (90, 270) THEN {POINTS_H} ELSE {POINTS_W} END AS dw, CASE WHEN rot IN (90, 270) THEN {POINTS_W} ELSE {POINTS_H} END AS dh FROM k),
s AS (SELECT *, CAST(0 AS DOUBLE) * (CAST(dw AS DOUBLE) / {WIDTH}) AS dx, CAST(dh AS DOUBLE) - (y + height) * (CAST(dh AS DOUBLE) / {HEIGHT}) AS dy,
             greatest(1.0, height * (CAST(dh AS DOUBLE) / {HEIGHT}) * CAST(0.85 AS DOUBLE)) AS size0, {WIDTH} * (CAST(dw AS DOUBLE) / {WIDTH}) AS room FROM d),
m AS (SELECT *, units * size0 / 1000.0 AS measured FROM s)
SELECT doc_id, line, word,
       round(CASE rot WHEN 0 THEN dx WHEN 90 THEN {POINTS_W} - dy WHEN 180 THEN {POINTS_W} - dx ELSE dy END, 6) AS x,
       round(CASE rot WHEN 0 THEN dy WHEN 90 THEN dx WHEN 180 THEN {POINTS_H} - dy ELSE {POINTS_H} - dx END, 6) AS y,
       round(CASE WHEN measured > room AND measured > 0 THEN size0 * room / measured ELSE size0 END, 6) AS size
FROM m""",
    "overlay_summary": f"""
WITH {_DOCS},
a AS (SELECT doc_id, count(*) AS n, round(avg(CAST(0.85 AS DOUBLE)), 6) AS mc, round(min(CAST({POINTS_H} AS DOUBLE) - (y + height) * (CAST({POINTS_H} AS DOUBLE) / {HEIGHT})), 4) AS b
      FROM w WHERE {_NOISE} GROUP BY doc_id)
SELECT p.doc_id, CAST(len(ls) AS INT) AS n_lines, CAST(coalesce(n, 0) AS INT) AS n_words, coalesce(mc, 0) AS mean_conf,
       CASE WHEN n > 0 THEN CAST(0 AS DOUBLE) END AS text_left_pt, b AS text_bottom_pt
FROM p LEFT JOIN a USING (doc_id)""",
    "page_text_stats": f"""
WITH {_DOCS}, a AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id)
SELECT p.doc_id, CAST(len(ls) AS INT) AS n_lines, CAST(coalesce(n, 0) AS INT) AS n_words,
       CAST(length(array_to_string(ls, chr(10))) AS INT) AS n_chars, sha256(array_to_string(ls, chr(10))) AS text_sha256
FROM p LEFT JOIN a USING (doc_id)""",
    "growing_text": """
WITH s AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\. ') AS ps FROM documents),
h AS (SELECT doc_id, list_transform(ps, lambda x, i: CASE WHEN (i - 1 + doc_id) % 3 = 0 THEN '' ELSE x END) AS hs FROM s),
f AS (SELECT doc_id, hs, list_position(list_transform(hs, lambda x: x <> ''), true) AS k FROM h)
SELECT doc_id, CAST(length(t) AS INT) AS n_chars, sha256(t) AS text_sha256
FROM (SELECT doc_id, CASE WHEN k IS NULL OR k = 0 THEN CASE WHEN len(hs) > 1 THEN '' ELSE hs[1] END ELSE array_to_string(hs[k:], chr(10)) END AS t FROM f)""",
    "mock_ocr": """
WITH t AS (SELECT doc_id, string_split('Mock page ' || (doc_id + 1) || ' of example document.', ' ') AS ws FROM documents)
SELECT doc_id, CAST(j - 1 AS INT) AS word, ws[j] AS text, CAST(20 + (j - 1) * 90 AS INT) AS x, 40 AS y, 80 AS width, 28 AS height,
       CAST(0.99 AS DOUBLE) AS confidence, CAST(len(ws) * 90 AS INT) AS line_width
FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS j FROM t)""",
    "markdown_layout": "WITH q AS (SELECT doc_id, '```markdown' || chr(10) || '# ' || coalesce(text, '') || chr(10) || '## Notes' || chr(10) || '```' AS md FROM documents),"
    + _lines_cte(
        "q",
        "doc_id",
        r"regexp_replace(regexp_replace(regexp_replace(md, '\A```[a-zA-Z]*\n?', ''), '\n?```\s*\z', ''), '(?m)^#{1,6}[ \t]+', '', 'g')",
        HEIGHT,
        "length(md) AS text_chars,",
    )
    + f" SELECT doc_id, CAST(text_chars AS INT) AS text_chars, line, text, 0 AS x, y, {WIDTH} AS width, height FROM l",
    "proportional_words": f"""
WITH t AS (SELECT item_id, text AS full_text, regexp_extract_all(text, '{NOT_WS}+') AS ws, string_split_regex(text, '{NOT_WS}+') AS gs FROM benchmark),
e AS (SELECT *, unnest(range(1, len(ws) + 1)) AS j FROM t),
s AS (SELECT *, list_sum(list_transform(gs[:j], lambda g: length(g))) + coalesce(list_sum(list_transform(ws[:j - 1], lambda g: length(g))), 0) AS a FROM e),
b AS (SELECT item_id, j, ws, 100 + floor(2000 * a / length(full_text) + 0.5) AS x,
             100 + floor(2000 * (a + length(ws[j])) / length(full_text) + 0.5) AS r FROM s)
SELECT item_id, CAST(j - 1 AS INT) AS word, ws[j] AS text, CAST(x AS INT) AS x, 200 AS y, CAST(greatest(1, r - x) AS INT) AS width, 40 AS height FROM b""",
    "region_offset": "WITH " + _lines_cte("conversations", "conv_id, turn", "coalesce(text, '')", 100)
    + """,
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY line, word) - 1 AS INT) AS k FROM w)
SELECT conv_id, turn, k AS word, text, CAST(turn * 17 AS INT) AS x, CAST(y + turn * 120 AS INT) AS y, 800 AS width, height FROM n""",
    "ordered_parts": "SELECT conv_id, count(*) AS n_parts, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id",
}
