"""Boxes of regions and lines: plans for resizing, filters, scaling, padding, crops."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import js_round
from .layout import box

# Limits of the detector and the recognisers.
DET_LIMIT = 736
MAX_REGIONS = 180
REC_HEIGHT, REC_WIDTH = 48, 320
CLS_HEIGHT, CLS_WIDTH = 80, 160
THUMBNAIL = 320


def detection_size(width: Column, height: Column) -> Column:
    """(width, height, ratio_w, ratio_h): multiples of 32, the longer side at most about the limit."""
    longer = F.greatest(width, height)
    ratio = F.when(longer > DET_LIMIT, F.lit(float(DET_LIMIT)) / longer).otherwise(1.0)
    w = F.greatest(F.lit(32), F.ceil(width * ratio / 32) * 32)
    h = F.greatest(F.lit(32), F.ceil(height * ratio / 32) * 32)
    return F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"), (w / width).alias("ratio_w"), (h / height).alias("ratio_h"))


def padded_box(b: Column, width: Column, height: Column) -> Column:
    """Grown by 0.3 of its height; the far side is bounded from the unpadded near side."""
    pad = js_round(b["height"] * 0.3)
    return box(
        F.greatest(F.lit(0), b["x"] - pad),
        F.greatest(F.lit(0), b["y"] - pad),
        F.least(width - b["x"], b["width"] + pad * 2),
        F.least(height - b["y"], b["height"] + pad * 2),
    )


def clamped_box(b: Column, width: Column, height: Column) -> Column:
    return box(
        F.greatest(F.lit(0), F.least(width - 1, b["x"])),
        F.greatest(F.lit(0), F.least(height - 1, b["y"])),
        F.greatest(F.lit(1), F.least(width, b["width"])),
        F.greatest(F.lit(1), F.least(height, b["height"])),
    )


def rescaled_box(b: Column, ratio_w: Column, ratio_h: Column) -> Column:
    return box(
        js_round(b["x"] / ratio_w), js_round(b["y"] / ratio_h), js_round(b["width"] / ratio_w), js_round(b["height"] / ratio_h)
    )


def recognition_width(b: Column) -> Column:
    return F.least(F.lit(REC_WIDTH), F.greatest(F.lit(8), js_round(b["width"] / b["height"] * REC_HEIGHT))).cast("int")


def classifier_width(b: Column) -> Column:
    return F.least(F.lit(CLS_WIDTH), F.greatest(F.lit(8), js_round(b["width"] / b["height"] * CLS_HEIGHT))).cast("int")


def is_region(b: Column, width: Column, height: Column) -> Column:
    """Regions large enough to hold text."""
    least = F.greatest(F.lit(300.0), width * height * 4e-6)
    return (b["width"] * b["height"] >= least) & (b["width"] >= 20) & (b["height"] >= 12)


def first_regions(regions: Column) -> Column:
    """At most as many regions as are recognised, before they are put in reading order."""
    return F.slice(regions, 1, MAX_REGIONS)


def crop_box(b: Column, width: Column, height: Column) -> Column:
    """A box with a margin, inside the page."""
    pad = F.greatest(F.lit(2), js_round(F.least(b["width"], b["height"]) * 0.08))
    x, y = F.greatest(F.lit(0), b["x"] - pad), F.greatest(F.lit(0), b["y"] - pad)
    right, bottom = F.least(width, b["x"] + b["width"] + pad), F.least(height, b["y"] + b["height"] + pad)
    return box(x, y, F.greatest(F.lit(1), right - x), F.greatest(F.lit(1), bottom - y))


def thumbnail_size(width: Column, height: Column) -> Column:
    """The longer side at most THUMBNAIL, never enlarged."""
    scale = F.least(F.lit(1.0), F.lit(float(THUMBNAIL)) / F.greatest(width, height))
    side = lambda v: F.greatest(F.lit(1), js_round(v * scale)).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def pixels_at(points: Column, dpi: Column) -> Column:
    return js_round(points * dpi / 72.0).cast("int")


def cardinal(angle: Column) -> Column:
    """The nearest of 0, 90, 180 and 270 degrees."""
    return F.pmod(js_round(angle / 90.0) * 90, F.lit(360)).cast("int")


def osd_angle(orientation: Column, angle: Column, confidence: Column, least: float = 2.0) -> Column:
    """The detected page angle where the detector is sure, else 0."""
    return F.when(F.coalesce(confidence, F.lit(0.0)) >= least, cardinal(F.coalesce(orientation, angle, F.lit(0)))).otherwise(0)


def resolved_rotation(override: Column, detected: Column, enabled: Column) -> Column:
    """An override first, then the detected angle if detection is enabled, else 0. An override of 0 counts."""
    return F.coalesce(override, F.when(enabled, detected), F.lit(0)).cast("int")


def line_is_turned(probability_180: Column, least: float = 0.9) -> Column:
    return probability_180 >= least


def is_recognised(text: Column, confidence: Column, least: float = 0.2) -> Column:
    return (text != "") & (confidence >= least)


# EXIF orientation to (degrees clockwise, mirrored in x, mirrored in y).
ORIENTATIONS = {
    1: (0, False, False),
    2: (0, True, False),
    3: (180, False, False),
    4: (0, False, True),
    5: (90, True, False),
    6: (90, False, False),
    7: (270, True, False),
    8: (270, False, False),
}


def orientation_transform(orientation: Column) -> Column:
    """(angle, flip_x, flip_y) of an EXIF orientation; an unknown one changes nothing."""
    out = None
    for n, (a, x, y) in ORIENTATIONS.items():
        s = F.struct(F.lit(a).alias("angle"), F.lit(x).alias("flip_x"), F.lit(y).alias("flip_y"))
        out = F.when(orientation == n, s) if out is None else out.when(orientation == n, s)
    none = F.struct(F.lit(0).alias("angle"), F.lit(False).alias("flip_x"), F.lit(False).alias("flip_y"))
    return out.otherwise(none)
