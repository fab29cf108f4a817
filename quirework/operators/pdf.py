"""Searchable PDFs: page images with the recognised words as invisible text over them.

A document is written from its pages' rasters, as no PDF parser is at hand; the
words stand where ``overlay.placement`` puts them, in the standard font whose
widths it measures with, in text mode 3 (neither filled nor stroked).
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..runtime import ship_package
from . import kernels


def _text(s: str) -> bytes:
    """A string of the standard encoding; other characters as question marks."""
    return re.sub(rb"([\\()])", rb"\\\1", s.encode("cp1252", "replace"))


def write(pages: list[dict], title: str = "") -> bytes:
    """A PDF of pages {width, height (points), rotation, image (raster), words [(text, x, y, size)]}."""
    objects: list[bytes] = [b"", b""]  # catalogue and page tree, filled in last

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    def stream(head: bytes, data: bytes) -> int:
        packed = zlib.compress(data)
        return add(b"<< " + head + b" /Filter /FlateDecode /Length %d >>\nstream\n" % len(packed) + packed + b"\nendstream")

    font = add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>")
    kids = []
    for p in pages:
        image = p["image"]
        space = b"/DeviceGray" if image.ndim == 2 or image.shape[2] == 1 else b"/DeviceRGB"
        raster = image if image.ndim == 2 else image[:, :, : 1 if space == b"/DeviceGray" else 3]
        h, w = raster.shape[:2]
        picture = stream(b"/Type /XObject /Subtype /Image /Width %d /Height %d /BitsPerComponent 8 /ColorSpace " % (w, h) + space, np.ascontiguousarray(raster).tobytes())
        draw = [b"q %.4f 0 0 %.4f 0 0 cm /I Do Q" % (p["width"], p["height"]), b"BT 3 Tr"]
        draw += [b"/F %.4f Tf 1 0 0 1 %.4f %.4f Tm (%s) Tj" % (s, x, y, _text(t)) for t, x, y, s in p["words"]]
        content = stream(b"", b"\n".join([*draw, b"ET"]))
        kids.append(
            add(
                b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.4f %.4f] /Rotate %d /Contents %d 0 R /Resources << /Font << /F %d 0 R >> /XObject << /I %d 0 R >> >> >>"
                % (p["width"], p["height"], p.get("rotation", 0), content, font, picture)
            )
        )
    objects[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    info = add(b"<< /Title (%s) /Creator (quirework) >>" % _text(title))
    out, at = [b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"], []
    for k, body in enumerate(objects, 1):
        at.append(sum(map(len, out)) if k == 1 else at[-1] + len(out[-1]))
        out.append(b"%d 0 obj\n" % k + body + b"\nendobj\n")
    start = at[-1] + len(out[-1])
    table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % a for a in at)
    return b"".join(out) + table + b"trailer\n<< /Size %d /Root 1 0 R /Info %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, info, start)


def texts(data: bytes) -> list[list[str]]:
    """The words of each page of a PDF of ``write``, in order."""
    found = []
    for m in re.finditer(rb"<<  /Filter /FlateDecode /Length (\d+) >>\nstream\n", data):
        body = zlib.decompress(data[m.end() : m.end() + int(m[1])])
        words = re.findall(rb"Tm \(((?:\\.|[^\\)])*)\) Tj", body)
        found.append([re.sub(rb"\\(.)", rb"\1", w).decode("cp1252") for w in words])
    return found


def build(pages: DataFrame) -> DataFrame:
    """(project_id, content, size_bytes): one PDF for each project.

    ``pages``: project_id, name, page_index, width, height, rotation, payload (PNG),
    words array<struct<text,x,y,size>>. A project's pages meet in one task, as its
    file is one; they come in the order of their index, whatever holes it has.
    """
    ship_package(pages.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("page_index").to_dict("records")
        made = [
            {
                "width": float(r["width"]),
                "height": float(r["height"]),
                "rotation": int(r["rotation"]),
                "image": kernels.png_decode(bytes(r["payload"])),
                "words": [(w["text"], w["x"], w["y"], w["size"]) for w in r["words"]],
            }
            for r in rows
        ]
        content = write(made, str(rows[0]["name"] or ""))
        return pd.DataFrame({"project_id": [rows[0]["project_id"]], "content": [content], "size_bytes": [len(content)]})

    return pages.groupBy("project_id").applyInPandas(run, "project_id string, content binary, size_bytes long")
