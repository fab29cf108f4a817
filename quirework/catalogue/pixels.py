"""Queries over image kernels. A vector of 64 is an 8 x 8 grey tile, or the scores of eight steps of eight tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kernels, tiles
from ..runtime import table

SIDE = 8
LETTERS = ("", "a", "b", "c", "d", "e", "f", " ")


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", tiles.grey_tile(F.col("embedding")).alias("tile"))


def _px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.pixels(_tiles(spark, sf_dir), "vec_id", "tile", SIDE)


def softmax_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", tiles.softmax_argmax(F.col("embedding")).alias("s"))
    return v.select("vec_id", F.col("s.index").alias("index"), F.round("s.probability", 6).alias("probability"))


def ctc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, LETTERS))
    v = table(spark, sf_dir, "embeddings").select("vec_id", tiles.ctc_decode(F.col("embedding"), words).alias("d"))
    return v.select("vec_id", F.col("d.text").alias("text"), F.round("d.confidence", 5).alias("confidence"))


def tile_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.otsu(_px(spark, sf_dir), "vec_id")


def tile_sauvola(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tiles(spark, sf_dir).select("vec_id", tiles.sauvola(F.col("tile"), SIDE, 2).alias("t"))
    return rows.select("vec_id", F.array_join(F.transform("t", lambda v: (v / 255).cast("int").cast("string")), "").alias("bits"))


def tile_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.transform("tile", lambda v: F.when(v > 190, 1).otherwise(0))
    rows = _tiles(spark, sf_dir).select("vec_id", bits.alias("b"))
    return rows.select("vec_id", F.array_join(F.transform(tiles.dilate(F.col("b"), SIDE), lambda v: v.cast("string")), "").alias("bits"))


def tile_profile_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.ink_runs(tiles.ink_rows(_px(spark, sf_dir), "vec_id"), "vec_id", 7, 1, 2, SIDE)


def tile_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tiles.purity(_px(spark, sf_dir), "vec_id")
    return rows.select("vec_id", F.round("purity", 6).alias("purity"))


def tile_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tiles(spark, sf_dir)
    text = lambda a: F.array_join(F.transform(tiles.quarter_turn(F.col("tile"), SIDE, a), lambda v: v.cast("string")), ",").alias(f"t{a}")
    return rows.select("vec_id", text(90), text(180), text(270))


def tile_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the normalised, padded tensor and of the luma of its rows taken as colours."""
    rows = _tiles(spark, sf_dir)
    tensor = tiles.unit_tensor(F.col("tile"), 80)
    total = F.aggregate(tensor, F.lit(0.0), lambda a, v: a + v)
    grey = tiles.luma(F.get("tile", F.lit(0)), F.get("tile", F.lit(1)), F.get("tile", F.lit(2)))
    return rows.select("vec_id", F.size(tensor).alias("n"), F.round(total, 5).alias("total"), F.round(grey, 6).alias("luma"))


def skew_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each vector that are angles under 30 degrees, and their upper median."""
    angles = F.filter(F.transform("embedding", lambda v: F.floor(v.cast("double") * 1000) / 10), lambda a: F.abs(a) < 30)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(angles).alias("n"), tiles.upper_median(angles).alias("skew"))


def tile_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the connected bright parts of each tile, without the size limits of pages."""
    rows = _tiles(spark, sf_dir).select("vec_id", "tile")
    boxes = kernels.component_boxes(rows, "vec_id", "tile", SIDE, cut=190, least_area=1)
    return boxes.select("vec_id", "x", "y", "width", "height")


QUERIES = {
    f.__name__: f
    for f in (
        softmax_argmax, ctc_decode, tile_otsu, tile_sauvola, tile_dilate, tile_profile_runs, tile_purity, tile_turns, tile_tensor,
        skew_median, tile_components,
    )
}

_TILE = """
e AS (SELECT vec_id, embedding, CAST(list_min(embedding) AS DOUBLE) AS lo, CAST(list_max(embedding) AS DOUBLE) AS hi FROM embeddings),
t AS (SELECT vec_id, list_transform(embedding, lambda v: CASE WHEN hi > lo THEN CAST(floor(CAST(255 AS DOUBLE) * (CAST(v AS DOUBLE) - lo) / (hi - lo)) AS INT) ELSE 0 END) AS tile FROM e),
px AS (SELECT vec_id, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, tile[i] AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM t))"""

SQL = {
    "softmax_argmax": """
WITH m AS (SELECT vec_id, embedding, CAST(list_max(embedding) AS DOUBLE) AS top FROM embeddings)
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS index,
       round(1.0 / greatest(list_sum(list_transform(embedding, lambda v: exp(CAST(v AS DOUBLE) - top))), 2.220446049250313e-16), 6) AS probability FROM m""",
    "ctc_decode": f"""
WITH s AS (SELECT vec_id, t, embedding[t * 8 + 1:t * 8 + 8] AS r FROM (SELECT *, unnest(range(0, 8)) AS t FROM embeddings)),
k AS (SELECT vec_id, t, CASE WHEN list_max(r) > 0 THEN list_position(r, list_max(r)) - 1 ELSE 0 END AS k, CAST(list_max(r) AS DOUBLE) AS p FROM s),
b AS (SELECT *, lag(k) OVER (PARTITION BY vec_id ORDER BY t) AS before FROM k),
g AS (SELECT vec_id, string_agg({list(LETTERS)!r}[k + 1], '' ORDER BY t) AS text, avg(p) AS p FROM b WHERE k <> 0 AND k IS DISTINCT FROM before GROUP BY vec_id)
SELECT embeddings.vec_id, coalesce(trim(text), '') AS text, round(coalesce(p, 0), 5) AS confidence FROM embeddings LEFT JOIN g USING (vec_id)""",
    "tile_otsu": f"""
WITH {_TILE},
h AS (SELECT vec_id, v, count(*) AS n FROM px GROUP BY ALL),
c AS (SELECT vec_id, v, sum(n) OVER u AS w, sum(n * v) OVER u AS s, sum(n) OVER (PARTITION BY vec_id) AS wn, sum(n * v) OVER (PARTITION BY vec_id) AS sn
      FROM h WINDOW u AS (PARTITION BY vec_id ORDER BY v ROWS UNBOUNDED PRECEDING)),
d AS (SELECT vec_id, v, CAST(sn * w - wn * s AS DOUBLE) * CAST(sn * w - wn * s AS DOUBLE) / CAST(w * (wn - w) AS DOUBLE) AS var FROM c WHERE w < wn),
r AS (SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY var DESC, v) AS k FROM d)
SELECT t.vec_id, coalesce(v, 0) AS threshold FROM t LEFT JOIN r ON r.vec_id = t.vec_id AND k = 1""",
    "tile_sauvola": f"""
WITH {_TILE},
o AS (SELECT dy, dx FROM (SELECT unnest(range(-2, 3)) AS dy) CROSS JOIN (SELECT unnest(range(-2, 3)) AS dx)),
s AS (SELECT px.vec_id, px.y, px.x, px.v, CAST(sum(CAST(q.v AS BIGINT)) AS DOUBLE) / 25.0::DOUBLE AS m, CAST(sum(CAST(q.v AS BIGINT) * q.v) AS DOUBLE) / 25.0::DOUBLE AS m2
      FROM px CROSS JOIN o JOIN px q ON q.vec_id = px.vec_id AND q.y = greatest(0, least(7, px.y + dy)) AND q.x = greatest(0, least(7, px.x + dx)) GROUP BY ALL),
b AS (SELECT vec_id, y, x, CASE WHEN v > m * (CAST(1 AS DOUBLE) + CAST(0.2 AS DOUBLE) * (sqrt(greatest(0, m2 - m * m)) / 128 - 1)) THEN '1' ELSE '0' END AS b FROM s)
SELECT vec_id, string_agg(b, '' ORDER BY y, x) AS bits FROM b GROUP BY vec_id""",
    "tile_dilate": f"""
WITH {_TILE},
b AS (SELECT vec_id, y, x, CASE WHEN v > 190 THEN 1 ELSE 0 END AS b FROM px),
n AS (SELECT b.vec_id, b.y, b.x, b.b, coalesce(sum(q.b), 0) AS n FROM b LEFT JOIN b q ON q.vec_id = b.vec_id AND abs(q.y - b.y) <= 1 AND abs(q.x - b.x) <= 1 AND (q.y <> b.y OR q.x <> b.x) GROUP BY ALL)
SELECT vec_id, string_agg(CASE WHEN b = 1 OR n >= 2 THEN '1' ELSE '0' END, '' ORDER BY y, x) AS bits FROM n GROUP BY vec_id""",
    "tile_profile_runs": f"""
WITH {_TILE},
r AS (SELECT vec_id, y FROM px GROUP BY vec_id, y HAVING count(*) FILTER (v < 200) >= 7),
o AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY vec_id ORDER BY y) - 1 <= 1 THEN 0 ELSE 1 END AS o FROM r),
g AS (SELECT *, sum(o) OVER (PARTITION BY vec_id ORDER BY y ROWS UNBOUNDED PRECEDING) AS g FROM o),
r2 AS (SELECT vec_id, min(y) AS start, CASE WHEN 7 - max(y) <= 1 THEN 7 ELSE max(y) END AS "end" FROM g GROUP BY vec_id, g)
SELECT * FROM r2 WHERE "end" - start + 1 >= 2""",
    "tile_purity": f"WITH {_TILE} SELECT vec_id, round(avg(CASE WHEN v <= 5 OR v >= 250 THEN 1.0::DOUBLE ELSE 0 END), 6) AS purity FROM px GROUP BY vec_id",
    "tile_turns": f"""
WITH {_TILE}
SELECT vec_id, string_agg(CAST(v AS VARCHAR), ',' ORDER BY x, 7 - y) AS t90, string_agg(CAST(v AS VARCHAR), ',' ORDER BY 7 - y, 7 - x) AS t180,
       string_agg(CAST(v AS VARCHAR), ',' ORDER BY 7 - x, y) AS t270 FROM px GROUP BY vec_id""",
    "tile_tensor": f"""
WITH {_TILE}
SELECT vec_id, 80 AS n, round(list_sum(list_transform(tile, lambda v: (v / 255.0::DOUBLE - 0.5::DOUBLE) / 0.5::DOUBLE)) + 16, 5) AS total,
       round(tile[1] * 0.299::DOUBLE + tile[2] * 0.587::DOUBLE + tile[3] * 0.114::DOUBLE, 6) AS luma FROM t""",
    "tile_components": f"""
WITH RECURSIVE {_TILE},
ink AS (SELECT vec_id, y * 8 + x AS p FROM px WHERE v > 190),
near AS (SELECT a.vec_id, a.p AS a, b.p AS b FROM ink a JOIN ink b ON b.vec_id = a.vec_id AND (abs(b.p - a.p) = 8 OR (abs(b.p - a.p) = 1 AND b.p // 8 = a.p // 8))),
r AS (SELECT vec_id, p AS root, p FROM ink UNION SELECT r.vec_id, r.root, near.b FROM r JOIN near ON near.vec_id = r.vec_id AND near.a = r.p),
m AS (SELECT vec_id, p, min(root) AS root FROM r GROUP BY ALL)
SELECT vec_id, CAST(min(p % 8) AS INT) AS x, CAST(min(p // 8) AS INT) AS y, CAST(max(p % 8) - min(p % 8) + 1 AS INT) AS width, CAST(max(p // 8) - min(p // 8) + 1 AS INT) AS height FROM m GROUP BY vec_id, root""",
    "skew_median": """
WITH a AS (SELECT vec_id, list_sort(list_filter(list_transform(embedding, lambda v: floor(CAST(v AS DOUBLE) * 1000) / 10), lambda x: abs(x) < 30)) AS a FROM embeddings)
SELECT vec_id, CAST(len(a) AS INT) AS n, CASE WHEN len(a) > 0 THEN a[len(a) // 2 + 1] ELSE 0.0 END AS skew FROM a""",
}
