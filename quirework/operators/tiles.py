"""Image kernels and decoders over small grids, as built-in functions.

A tile is an array of side * side whole grey values by rows. Whole pages go
through kernels.py, as their rasters are too large for nested columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bind import let


def grey_tile(values: Column) -> Column:
    """Values stretched to 0..255, rounded down; all 0 where they do not differ."""
    low, high = F.array_min(values).cast("double"), F.array_max(values).cast("double")
    return let(
        F.struct(low.alias("l"), high.alias("h")),
        lambda m: F.transform(
            values,
            lambda v: F.when(m["h"] > m["l"], F.floor(F.lit(255.0) * (v.cast("double") - m["l"]) / (m["h"] - m["l"]))).otherwise(0).cast("int"),
        ),
    )


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


def unit_tensor(values: Column, pad_to: int | None = None) -> Column:
    """Grey values to -1..1; what is padded is 1."""
    out = F.transform(values, lambda v: (v / 255.0 - 0.5) / 0.5)
    return out if pad_to is None else F.concat(out, F.array_repeat(F.lit(1.0), F.greatest(F.lit(0), F.lit(pad_to) - F.size(values))))


def softmax_argmax(values: Column) -> Column:
    """(index from 0, probability) of the first largest value."""
    top = F.array_max(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(v.cast("double") - top.cast("double")))
    return F.struct((F.array_position(values, top) - 1).cast("int").alias("index"), (1.0 / F.greatest(total, F.lit(2.220446049250313e-16))).alias("probability"))


def ctc_decode(values: Column, vocabulary: Column) -> Column:
    """(text, confidence) of a row of scores for each step: blanks (0) and repeats are dropped.

    A step's token is the first largest score above 0, else blank. The
    confidence is the mean of the scores of what is kept.
    """
    n = F.size(vocabulary)
    steps = F.transform(
        F.sequence(F.lit(0), (F.size(values) / n).cast("int") - 1),
        lambda t: let(
            F.slice(values, t * n + 1, n),
            lambda row: let(F.array_max(row), lambda m: F.struct(F.when(m > 0, F.array_position(row, m) - 1).otherwise(0).cast("int").alias("k"), m.cast("double").alias("p"))),
        ),
    )

    def kept(all_: Column) -> Column:
        marked = F.transform(all_, lambda s, i: F.struct(s["k"].alias("k"), s["p"].alias("p"), F.when(i > 0, F.get(all_, i - 1)["k"]).otherwise(-1).alias("before")))
        return F.filter(marked, lambda s: (s["k"] != 0) & (s["k"] != s["before"]) & (F.get(vocabulary, s["k"]) != ""))

    def joined(ks: Column) -> Column:
        text = F.trim(F.array_join(F.transform(ks, lambda s: F.get(vocabulary, s["k"])), ""))
        mean = F.when(F.size(ks) > 0, F.aggregate(ks, F.lit(0.0), lambda a, s: a + s["p"]) / F.size(ks)).otherwise(0.0)
        return F.struct(text.alias("text"), mean.alias("confidence"))

    return let(let(steps, kept), joined)


def pixels(tiles: DataFrame, key: str, tile: str, side: int) -> DataFrame:
    rows = tiles.select(key, F.posexplode(tile).alias("at", "v"))
    return rows.select(key, F.floor(F.col("at") / side).cast("int").alias("y"), F.pmod("at", F.lit(side)).cast("int").alias("x"), "v")


def otsu(px: DataFrame, key: str) -> DataFrame:
    """(key, threshold): the smallest grey value whose split has the largest variance between the classes; 0 for one grey."""
    h = px.groupBy(key, "v").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy(key)
    c = h.select(
        key, "v", F.sum("n").over(up).alias("w"), F.sum(F.col("n") * F.col("v")).over(up).alias("s"),
        F.sum("n").over(all_).alias("wn"), F.sum(F.col("n") * F.col("v")).over(all_).alias("sn"),
    )
    apart = F.col("sn") * F.col("w") - F.col("wn") * F.col("s")
    var = F.when(F.col("w") < F.col("wn"), apart.cast("double") * apart.cast("double") / (F.col("w") * (F.col("wn") - F.col("w"))).cast("double"))
    best = F.max_by("v", F.struct(var, -F.col("v")))
    return c.where(F.col("w") < F.col("wn")).groupBy(key).agg(best.alias("threshold")).join(px.select(key).distinct(), key, "right").select(key, F.coalesce("threshold", F.lit(0)).alias("threshold"))


def sauvola(tile: Column, side: int, radius: int, k: float = 0.2, spread: float = 128.0) -> Column:
    """Each pixel as 255 if it is over the threshold of its window, else 0; the border is repeated outward."""
    n = (2 * radius + 1) ** 2
    offsets = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)))
    inside = lambda v: F.greatest(F.lit(0), F.least(F.lit(side - 1), v))

    def one(v: Column, i: Column) -> Column:
        y, x = F.floor(i / side).cast("int"), F.pmod(i, F.lit(side))
        near = F.transform(offsets, lambda o: F.get(tile, inside(y + o["dy"]) * side + inside(x + o["dx"])).cast("long"))
        sums = let(near, lambda w: F.struct(F.aggregate(w, F.lit(0).cast("long"), lambda a, b: a + b).alias("s"), F.aggregate(w, F.lit(0).cast("long"), lambda a, b: a + b * b).alias("q")))
        return let(sums, lambda m: F.when(v > threshold(m["s"], m["q"]), 255).otherwise(0))

    def threshold(s: Column, q: Column) -> Column:
        mean = s / float(n)
        sd = F.sqrt(F.greatest(F.lit(0.0), q / float(n) - mean * mean))
        return mean * (F.lit(1.0) + F.lit(k) * (sd / spread - 1.0))

    return F.transform(tile, one)


def dilate(bits: Column, side: int) -> Column:
    """Off pixels with at least two of their eight neighbours on are on."""
    around = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]

    def one(v: Column, i: Column) -> Column:
        y, x = F.floor(i / side).cast("int"), F.pmod(i, F.lit(side))
        on = F.lit(0)
        for dy, dx in around:
            fits = (y + dy).between(0, side - 1) & (x + dx).between(0, side - 1)
            on = on + F.when(fits, F.coalesce(F.get(bits, i + dy * side + dx), F.lit(0))).otherwise(0)
        return F.when((v > 0) | (on >= 2), 1).otherwise(0)

    return F.transform(bits, one)


def ink_rows(px: DataFrame, key: str, dark: int = 200) -> DataFrame:
    return px.groupBy(key, "y").agg(F.count_if(F.col("v") < dark).alias("ink"))


def ink_runs(profile: DataFrame, key: str, least_ink: int, gap: int, least_rows: int, height: int) -> DataFrame:
    """(key, start, end): runs of rows with enough ink, across gaps of at most ``gap`` rows.

    A run that the gap to the bottom, row ``height`` - 1, does not close ends there.
    """
    rows = profile.where(F.col("ink") >= least_ink)
    down = Window.partitionBy(key).orderBy("y")
    opens = F.coalesce(F.col("y") - F.lag("y").over(down) - 1 > gap, F.lit(True)).cast("int")
    run = F.sum("opens").over(down.rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.withColumn("opens", opens).withColumn("run", run).groupBy(key, "run").agg(F.min("y").alias("start"), F.max("y").alias("end"))
    runs = runs.withColumn("end", F.when(height - 1 - F.col("end") <= gap, height - 1).otherwise(F.col("end")))
    return runs.where(F.col("end") - F.col("start") + 1 >= least_rows).select(key, "start", "end")


def upper_median(values: Column) -> Column:
    """The middle value, the upper of two; 0 of none."""
    n = F.size(values)
    return F.when(n > 0, F.get(F.array_sort(values), F.floor(n / 2).cast("int"))).otherwise(0.0)


def purity(px: DataFrame, key: str) -> DataFrame:
    """The share of pixels that are nearly black or white."""
    return px.groupBy(key).agg(F.avg(F.when((F.col("v") <= 5) | (F.col("v") >= 250), 1.0).otherwise(0.0)).alias("purity"))


def quarter_turn(tile: Column, side: int, angle: int) -> Column:
    """The tile turned clockwise by 0, 90, 180 or 270 degrees."""
    at = {
        0: lambda i: i,
        90: lambda i: (side - 1 - F.pmod(i, F.lit(side))) * side + F.floor(i / side).cast("int"),
        180: lambda i: side * side - 1 - i,
        270: lambda i: F.pmod(i, F.lit(side)) * side + side - 1 - F.floor(i / side).cast("int"),
    }[angle]
    return F.transform(tile, lambda v, i: F.get(tile, at(i)))
