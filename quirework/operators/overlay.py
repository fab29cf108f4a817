"""Placement of recognised words as invisible text over the source page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Advance widths of Helvetica, in thousandths, of the characters from space to tilde.
HELVETICA = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556,
    556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
OTHER_WIDTH = 556  # of any other character, where a font table has none
FONT_SHARE = 0.85  # fixed value: the font's size as a share of the box's height


def text_width(text: Column, size: Column) -> Column:
    """The width of ``text`` in Helvetica at ``size``, without kerning."""
    table = F.array(*map(F.lit, HELVETICA))
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    total = F.aggregate(
        chars,
        F.lit(0),
        lambda acc, c: acc + F.when(F.ascii(c).between(32, 126), F.get(table, F.ascii(c) - 32)).otherwise(OTHER_WIDTH),
    )
    return total * size / 1000.0


def _by_turn(rotation: Column, upright, quarter, half, three) -> Column:
    return F.when(rotation == 0, upright).when(rotation == 90, quarter).when(rotation == 180, half).otherwise(three)


def placement(text: Column, bbox: Column, ocr_w: Column, ocr_h: Column, page_w: Column, page_h: Column, rotation: Column) -> Column:
    """(x, y, size) in page coordinates, origin bottom left, before the page's rotation is shown.

    The reader sees the page turned; (across, up) is the word's corner there.
    """
    seen_w, seen_h = _by_turn(rotation, page_w, page_h, page_w, page_h), _by_turn(rotation, page_h, page_w, page_h, page_w)
    per_x, per_y = seen_w / ocr_w, seen_h / ocr_h
    across, up = bbox["x"] * per_x, seen_h - (bbox["y"] + bbox["height"]) * per_y
    x = _by_turn(rotation, across, page_w - up, page_w - across, up)
    y = _by_turn(rotation, up, across, page_h - up, page_h - across)
    return F.struct(x.alias("x"), y.alias("y"), fitted_size(text, bbox["width"] * per_x, bbox["height"] * per_y).alias("size"))


def fitted_size(text: Column, room: Column, height: Column) -> Column:
    """The font's size for a box: by its height, smaller where the text would be wider than the box."""
    size = F.greatest(F.lit(1.0), height * FONT_SHARE)
    # no word is wider than so many of the widest character; only those that might not fit are measured
    most = F.length(text) * (max(*HELVETICA, OTHER_WIDTH) / 1000.0) * size
    measured = F.when(most > room, text_width(text, size)).otherwise(0.0)
    return F.when((measured > room) & (measured > 0), size * room / measured).otherwise(size)
