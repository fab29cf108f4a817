"""Queries over boxes. A region stands for each line of a page, its place and size made from the line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_words
from ..operators import geometry, layout
from .layouts import _DOCS, HEIGHT, WIDTH, _words, line_rows


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_rows(spark, sf_dir)
    x = F.pmod(F.col("line") * 37 + F.col("doc_id") * 13, F.lit(400))
    b = layout.box(x, F.col("bbox.y"), F.greatest(F.lit(1), F.size(split_words(F.col("text"))) * 35), F.col("bbox.height"))
    return rows.select("doc_id", "line", b.alias("b"))


_REGIONS = f"""{_DOCS},
r AS (SELECT doc_id, line, CAST((((line * 37 + doc_id * 13) % 400) + 400) % 400 AS INT) AS x, y,
             CAST(greatest(1, len({_words("text")}) * 35) AS INT) AS width, height FROM l)"""


def region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions(spark, sf_dir)
    return rows.where(geometry.is_region(F.col("b"), F.lit(WIDTH), F.lit(HEIGHT))).select("doc_id", "line", "b.*")


def region_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each page that its regions cover, and their outermost edges."""
    return (
        regions(spark, sf_dir)
        .groupBy("doc_id")
        .agg(
            F.count(F.lit(1)).alias("n_regions"),
            F.round(F.sum((F.col("b.width") * F.col("b.height")).cast("long")) / (WIDTH * HEIGHT), 6).alias("coverage"),
            F.min("b.x").alias("left"),
            F.min("b.y").alias("top"),
            F.max(F.col("b.x") + F.col("b.width")).alias("right"),
            F.max(F.col("b.y") + F.col("b.height")).alias("bottom"),
        )
    )


def box_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector boxes padded, clamped and scaled back to the page."""
    size = geometry.detection_size(F.lit(WIDTH), F.lit(HEIGHT))
    small = layout.box(F.col("b.x") * 0.2, F.col("b.y") * 0.2, F.greatest(F.lit(1), F.col("b.width") * 0.2), F.greatest(F.lit(1), F.col("b.height") * 0.2))
    rows = regions(spark, sf_dir).select("doc_id", "line", size.alias("s"), small.alias("d"))
    rows = rows.withColumn("d", geometry.padded_box(F.col("d"), F.col("s.width"), F.col("s.height")))
    rows = rows.withColumn("d", geometry.clamped_box(F.col("d"), F.col("s.width"), F.col("s.height")))
    return rows.select("doc_id", "line", geometry.rescaled_box(F.col("d"), F.col("s.ratio_w"), F.col("s.ratio_h")).alias("d")).select("doc_id", "line", "d.*")


def detect_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes for the detector, thumbnails and pixels at a resolution, for pages of many sizes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    w, h = F.pmod(F.col("doc_id") * 97, F.lit(3000)) + 20, F.pmod(F.col("doc_id") * 61, F.lit(4000)) + 20
    rows = docs.select("doc_id", w.cast("int").alias("w"), h.cast("int").alias("h"))
    return rows.select(
        "doc_id", "w", "h", geometry.detection_size(F.col("w"), F.col("h")).alias("d"), geometry.thumbnail_size(F.col("w"), F.col("h")).alias("t"),
        geometry.pixels_at(F.col("w").cast("double"), F.lit(300)).alias("px"),
    ).select(
        "doc_id", "w", "h", F.col("d.width").alias("det_w"), F.col("d.height").alias("det_h"), F.round("d.ratio_w", 6).alias("ratio_w"),
        F.round("d.ratio_h", 6).alias("ratio_h"), F.col("t.width").alias("thumb_w"), F.col("t.height").alias("thumb_h"), "px",
    )


def recogniser_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("b")
    return regions(spark, sf_dir).select(
        "doc_id", "line", geometry.recognition_width(b).alias("rec_w"), geometry.classifier_width(b).alias("cls_w")
    )


def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = geometry.crop_box(F.col("b"), F.lit(WIDTH), F.lit(HEIGHT))
    return regions(spark, sf_dir).select("doc_id", "line", c.alias("c")).select("doc_id", "line", "c.*")


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions(spark, sf_dir).select("doc_id", "line", F.col("b.x").alias("x"), (F.col("b.y") + F.pmod(F.col("b.x"), F.lit(5))).alias("y"))
    return layout.reading_rank(rows, ["doc_id"]).select("doc_id", "line", "rank")


def merge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word boxes of the benchmark, on lines of six, merged back to lines."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = F.filter(F.split("text", "\\s+"), lambda w: w != "")
    boxes = F.transform(
        words,
        lambda w, i: layout.box(F.pmod(i, F.lit(6)) * 120, F.floor(i / 6) * 60, F.lit(100) + F.pmod(F.length(w), F.lit(3)) * 9, F.lit(30) + F.pmod(F.length(w), F.lit(4))),
    )
    merged = bench.select("item_id", F.posexplode(layout.merge_line_boxes(boxes)).alias("line", "b"))
    return merged.select("item_id", "line", "b.*")


def rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected angles, gates and overrides, from the vectors' first entries."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e = lambda k: F.col("embedding")[k].cast("double")
    angle, conf = F.floor(e(0) * 1000), F.abs(e(1)) * 20
    detected = geometry.osd_angle(F.when(e(2) > 0, angle), -angle, conf)
    override = F.when(F.pmod("vec_id", F.lit(5)) == 0, F.pmod("vec_id", F.lit(4)) * 90)
    return v.select(
        "vec_id",
        geometry.cardinal(angle).alias("cardinal"),
        detected.cast("int").alias("detected"),
        geometry.resolved_rotation(override, detected, F.col("label") % 2 == 0).alias("applied"),
        geometry.line_is_turned(F.abs(e(3)) * 4).alias("turned"),
        geometry.orientation_transform(F.pmod("vec_id", F.lit(10)).cast("int")).alias("t"),
    ).select("vec_id", "cardinal", "detected", "applied", "turned", "t.*")


def nested_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines out of blocks and paragraphs, null levels left out; corners to sizes, percent to shares."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    n = F.length(F.coalesce("text", F.lit(""))).cast("int")
    t = F.col("turn").cast("int")
    line = lambda k: F.struct(F.struct((t * 10 + k).alias("x0"), (t * 20).alias("y0"), (t * 10 + k + n).alias("x1"), (t * 20 + 12).alias("y1")).alias("c"), F.when(F.col("role") == "user", n % 101).alias("conf"))
    para = lambda *ls: F.struct(F.array(*ls).alias("lines"))
    blocks = F.array(
        F.struct(F.array(para(line(0), line(1)), F.when(n % 2 == 0, para(line(2)))).alias("paragraphs")),
        F.when(n % 3 == 0, F.struct(F.array(para(line(3))).alias("paragraphs"))),
    )
    rows = turns.select("conv_id", "turn", F.posexplode(layout.flatten_blocks(blocks)).alias("k", "l"))
    b = layout.corner_box(F.col("l.c.x0"), F.col("l.c.y0"), F.col("l.c.x1"), F.col("l.c.y1"))
    return rows.select("conv_id", "turn", "k", b.alias("b"), layout.unit_confidence(F.col("l.conf")).alias("conf")).select("conv_id", "turn", "k", "b.*", "conf")


QUERIES = {
    f.__name__: f
    for f in (
        region_filter, region_coverage, box_rescale, detect_resize, recogniser_widths, crop_boxes, reading_order,
        merge_lines, rotations, nested_blocks,
    )
}

_RATIO = f"({geometry.DET_LIMIT}::DOUBLE / greatest({WIDTH}, {HEIGHT}))"
_PAD = "floor(height * CAST(0.3 AS DOUBLE) + 0.5)"

SQL = {
    "merge_lines": """
WITH RECURSIVE t AS (SELECT item_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS ws FROM benchmark),
e AS (SELECT item_id, ws, unnest(range(len(ws))) AS i FROM t),
b AS (SELECT item_id, i, i % 6 * 120 AS x, i // 6 * 60 AS y, 100 + length(ws[i + 1]) % 3 * 9 AS w, 30 + length(ws[i + 1]) % 4 AS h FROM e),
r AS (SELECT item_id, i, 0 AS line, x, y, w, h FROM b WHERE i = 0
      UNION ALL
      SELECT item_id, i, CASE WHEN same THEN line ELSE line + 1 END, CASE WHEN same THEN least(ax, bx) ELSE bx END, CASE WHEN same THEN least(ay, b_y) ELSE b_y END,
             CASE WHEN same THEN greatest(ax + aw, bx + bw) - least(ax, bx) ELSE bw END, CASE WHEN same THEN greatest(ay + ah, b_y + bh) - least(ay, b_y) ELSE bh END
      FROM (SELECT r.item_id, b.i, r.line, r.x AS ax, r.y AS ay, r.w AS aw, r.h AS ah, b.x AS bx, b.y AS b_y, b.w AS bw, b.h AS bh,
                   greatest(0, least(r.y + r.h, b.y + b.h) - greatest(r.y, b.y)) > least(r.h, b.h) * 0.45
                   AND b.x - (r.x + r.w) >= -8 AND b.x - (r.x + r.w) < greatest(24.0, least(r.h, b.h) * 1.2) AS same
            FROM r JOIN b ON b.item_id = r.item_id AND b.i = r.i + 1))
SELECT item_id, CAST(line AS INT) AS line, CAST(arg_max(x, i) AS INT) AS x, CAST(arg_max(y, i) AS INT) AS y, CAST(arg_max(w, i) AS INT) AS width, CAST(arg_max(h, i) AS INT) AS height
FROM r GROUP BY item_id, line""",
    "region_filter": f"""WITH {_REGIONS} SELECT * FROM r
WHERE CAST(width AS BIGINT) * height >= greatest(300.0, CAST({WIDTH} AS DOUBLE) * {HEIGHT} * 4e-6) AND width >= 20 AND height >= 12""",
    "region_coverage": f"""WITH {_REGIONS}
SELECT doc_id, count(*) AS n_regions, round(CAST(sum(CAST(width AS BIGINT) * height) AS DOUBLE) / {WIDTH * HEIGHT}, 6) AS coverage,
       min(x) AS "left", min(y) AS top, max(x + width) AS "right", max(y + height) AS bottom FROM r GROUP BY doc_id""",
    "box_rescale": f"""WITH {_REGIONS},
z AS (SELECT CAST(greatest(32, ceil({WIDTH} * {_RATIO} / 32) * 32) AS INT) AS sw, CAST(greatest(32, ceil({HEIGHT} * {_RATIO} / 32) * 32) AS INT) AS sh),
d AS (SELECT doc_id, line, sw, sh, CAST(trunc(x * CAST(0.2 AS DOUBLE)) AS INT) AS x, CAST(trunc(y * CAST(0.2 AS DOUBLE)) AS INT) AS y,
             CAST(trunc(greatest(1, width * CAST(0.2 AS DOUBLE))) AS INT) AS width, CAST(trunc(greatest(1, height * CAST(0.2 AS DOUBLE))) AS INT) AS height FROM r, z),
pp AS (SELECT doc_id, line, sw, sh, greatest(0, x - {_PAD}) AS x, greatest(0, y - {_PAD}) AS y,
             least(sw - x, width + {_PAD} * 2) AS width, least(sh - y, height + {_PAD} * 2) AS height FROM d),
c AS (SELECT doc_id, line, sw, sh, greatest(0, least(sw - 1, x)) AS x, greatest(0, least(sh - 1, y)) AS y,
             greatest(1, least(sw, width)) AS width, greatest(1, least(sh, height)) AS height FROM pp)
SELECT doc_id, line, CAST(floor(x / (CAST(sw AS DOUBLE) / {WIDTH}) + 0.5) AS INT) AS x, CAST(floor(y / (CAST(sh AS DOUBLE) / {HEIGHT}) + 0.5) AS INT) AS y,
       CAST(floor(width / (CAST(sw AS DOUBLE) / {WIDTH}) + 0.5) AS INT) AS width, CAST(floor(height / (CAST(sh AS DOUBLE) / {HEIGHT}) + 0.5) AS INT) AS height FROM c""",
    "detect_resize": f"""
WITH s AS (SELECT doc_id, CAST(doc_id * 97 % 3000 + 20 AS INT) AS w, CAST(doc_id * 61 % 4000 + 20 AS INT) AS h FROM documents),
q AS (SELECT *, CASE WHEN greatest(w, h) > {geometry.DET_LIMIT} THEN {geometry.DET_LIMIT}::DOUBLE / greatest(w, h) ELSE 1.0 END AS k, least(CAST(1.0 AS DOUBLE), 320::DOUBLE / greatest(w, h)) AS t FROM s),
d AS (SELECT *, CAST(greatest(32, ceil(w * k / 32) * 32) AS INT) AS det_w, CAST(greatest(32, ceil(h * k / 32) * 32) AS INT) AS det_h FROM q)
SELECT doc_id, w, h, det_w, det_h, round(det_w::DOUBLE / w, 6) AS ratio_w, round(det_h::DOUBLE / h, 6) AS ratio_h,
       CAST(greatest(1, floor(w * t + 0.5)) AS INT) AS thumb_w, CAST(greatest(1, floor(h * t + 0.5)) AS INT) AS thumb_h, CAST(floor(CAST(w AS DOUBLE) * 300 / 72 + 0.5) AS INT) AS px FROM d""",
    "recogniser_widths": f"""WITH {_REGIONS}
SELECT doc_id, line, CAST(least(320, greatest(8, floor(CAST(width AS DOUBLE) / height * 48 + 0.5))) AS INT) AS rec_w,
       CAST(least(160, greatest(8, floor(CAST(width AS DOUBLE) / height * 80 + 0.5))) AS INT) AS cls_w FROM r""",
    "crop_boxes": f"""WITH {_REGIONS},
pp AS (SELECT *, greatest(2, floor(least(width, height) * CAST(0.08 AS DOUBLE) + 0.5)) AS pad FROM r),
q AS (SELECT doc_id, line, greatest(0, x - pad) AS a, greatest(0, y - pad) AS b, least({WIDTH}, x + width + pad) AS c, least({HEIGHT}, y + height + pad) AS d FROM pp)
SELECT doc_id, line, CAST(a AS INT) AS x, CAST(b AS INT) AS y, CAST(greatest(1, c - a) AS INT) AS width, CAST(greatest(1, d - b) AS INT) AS height FROM q""",
    "reading_order": f"""WITH {_REGIONS},
t AS (SELECT doc_id, line, x, y + x % 5 AS y FROM r),
o AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id ORDER BY y, x) < 10 THEN 0 ELSE 1 END AS opens FROM t),
g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY y, x ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT doc_id, line, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY g, x, y) - 1 AS INT) AS rank FROM g""",
    "rotations": """
WITH e AS (SELECT vec_id, label, floor(CAST(embedding[1] AS DOUBLE) * 1000) AS angle, abs(CAST(embedding[2] AS DOUBLE)) * 20 AS conf,
                  CAST(embedding[3] AS DOUBLE) AS s, abs(CAST(embedding[4] AS DOUBLE)) * 4 AS t FROM embeddings),
d AS (SELECT *, CASE WHEN conf >= 2 THEN CAST((floor((CASE WHEN s > 0 THEN angle ELSE -angle END) / 90 + 0.5) * 90 % 360 + 360) % 360 AS INT) ELSE 0 END AS detected,
             CAST((floor(angle / 90 + 0.5) * 90 % 360 + 360) % 360 AS INT) AS cardinal FROM e)
SELECT vec_id, cardinal, detected,
       CAST(coalesce(CASE WHEN vec_id % 5 = 0 THEN vec_id % 4 * 90 END, CASE WHEN label % 2 = 0 THEN detected END, 0) AS INT) AS applied,
       t >= 0.9 AS turned,
       CASE vec_id % 10 WHEN 3 THEN 180 WHEN 5 THEN 90 WHEN 6 THEN 90 WHEN 7 THEN 270 WHEN 8 THEN 270 ELSE 0 END AS angle,
       vec_id % 10 IN (2, 5, 7) AS flip_x, vec_id % 10 = 4 AS flip_y
FROM d""",
    "nested_blocks": """
WITH c AS (SELECT conv_id, turn, role, CAST(length(coalesce(text, '')) AS INT) AS n, CAST(turn AS INT) AS t FROM conversations),
k AS (SELECT *, unnest([0, 1, 2, 3]) AS j FROM c),
f AS (SELECT * FROM k WHERE j < 2 OR (j = 2 AND n % 2 = 0) OR (j = 3 AND n % 3 = 0))
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY j) - 1 AS INT) AS k,
       t * 10 + j AS x, t * 20 AS y, n AS width, 12 AS height,
       coalesce(CASE WHEN role = 'user' THEN CAST(n % 101 AS DOUBLE) / 100 END, 0) AS conf FROM f""",
}
