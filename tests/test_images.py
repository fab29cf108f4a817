import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.functions.hashing import default_settings
from quirework.operators import kernels as K
from quirework.sources import files


def page(h=300, w=400):
    """White, with six dark lines of words."""
    image = np.full((h, w), 255, np.uint8)
    for k in range(6):
        for x in range(40, w - 60, 50):
            image[40 + 40 * k : 52 + 40 * k, x : x + 38] = 20
    return image


@pytest.mark.parametrize("shape", [(5, 7), (4, 6, 3), (3, 3, 4)])
def test_png_round_trip(shape):
    image = np.random.default_rng(0).integers(0, 256, shape, dtype=np.uint8)
    out = K.png_decode(K.png_encode(image))
    assert np.array_equal(out if len(shape) == 3 else out[:, :, 0], image)


def test_png_filters():
    """Each filter kind, written by hand."""
    import zlib

    image = np.random.default_rng(1).integers(0, 256, (5, 4), dtype=np.uint8).astype(int)
    rows = []
    for y, kind in enumerate((0, 1, 2, 3, 4)):
        r = [kind]
        for x in range(4):
            a = image[y, x - 1] if x else 0
            b = image[y - 1, x] if y else 0
            c = image[y - 1, x - 1] if x and y else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            r.append((image[y, x] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        rows.append(bytes(r))
    base = K.png_encode(image.astype(np.uint8))
    at = base.index(b"IDAT") - 4
    body = zlib.compress(b"".join(rows))
    made = base[:at] + struct.pack(">I", len(body)) + b"IDAT" + body + struct.pack(">I", zlib.crc32(b"IDAT" + body)) + base[base.index(b"IEND") - 4 :]
    assert np.array_equal(K.png_decode(made)[:, :, 0], image)


def test_deskew_and_purity():
    tilted = K.rotated(page(), 5.0)
    skew = K.skew_degrees(tilted)
    assert abs(skew) > 3
    level = K.rotated(tilted, skew)
    assert abs(K.skew_degrees(level)) < 0.5
    binary, _ = K.preprocess(tilted)
    assert np.mean((binary <= 5) | (binary >= 250)) > 0.97


def test_median_and_turns():
    image = page(20, 30)
    assert np.array_equal(K.median_blur(image, 0), image)
    noisy = image.copy()
    noisy[5, 5] = 0
    assert K.median_blur(noisy, 1)[5, 5] == 255
    assert np.array_equal(K.turned(K.turned(image, 90), 270), image)
    assert K.turned(image, 90)[0, -1] == image[0, 0]


def test_otsu_and_sauvola_part_ink_from_paper():
    image = page()
    for binary in (K.otsu_binary(image), K.sauvola_binary(image)):
        assert binary[46, 60] == 0 and binary[10, 10] == 255


def test_regions_and_lines():
    regions = K.text_regions(K.otsu_binary(page()))
    assert len(regions) == 6
    whole = (20, 20, 360, 260)
    lines = K.region_lines(page(), whole)
    assert len(lines) == 1 or len(lines) == 6
    assert K.region_lines(np.full((50, 50), 255, np.uint8), (0, 0, 50, 50)) == [(0, 0, 50, 50)]


@pytest.mark.parametrize("seed", range(8))
def test_components_against_a_flood_fill(seed):
    rng = np.random.default_rng(seed)
    bits = rng.random((rng.integers(1, 40), rng.integers(1, 40))) < rng.choice([0.3, 0.5, 0.7])
    seen, want = np.zeros_like(bits), []
    for y0, x0 in np.argwhere(bits):
        if seen[y0, x0]:
            continue
        todo, part = [(y0, x0)], []
        seen[y0, x0] = True
        while todo:
            y, x = todo.pop()
            part.append((y, x))
            for b, a in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                if 0 <= b < bits.shape[0] and 0 <= a < bits.shape[1] and bits[b, a] and not seen[b, a]:
                    seen[b, a] = True
                    todo.append((b, a))
        (top, left), (bottom, right) = np.min(part, axis=0), np.max(part, axis=0)
        want.append((left, top, right - left + 1, bottom - top + 1))
    assert K.component_list(bits) == want


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_median_against_numpy(radius):
    image = np.random.default_rng(radius).integers(0, 256, (37, 53), dtype=np.uint8)
    squares = np.lib.stride_tricks.sliding_window_view(np.pad(image, radius, mode="edge"), (2 * radius + 1,) * 2)
    assert np.array_equal(K.median_blur(image, radius), np.median(squares, axis=(2, 3)).astype(np.uint8))


@pytest.mark.parametrize("degrees", [-29.0, -20.0, 24.5])
def test_skew_beyond_fifteen_degrees(degrees):
    tilted = K.rotated(np.pad(page(), 120, constant_values=255), degrees)
    assert abs(K.skew_degrees(tilted) + degrees) <= 0.5


def test_components():
    bits = np.array([[1, 1, 0, 0], [0, 0, 0, 1], [1, 0, 0, 1]], np.uint8)
    assert K.component_list(bits) == [(0, 0, 2, 1), (3, 1, 1, 2), (0, 2, 1, 1)]


def test_thumbnail_is_never_larger():
    assert K.thumbnail(page(1000, 400)).shape == (320, 128)
    assert K.thumbnail(page(30, 40)).shape == (30, 40)


def test_pages_in_spark(spark):
    rows = [("p", 0, bytearray(K.png_encode(page()))), ("p", 1, bytearray(b"no image"))]
    pages = spark.createDataFrame(rows, "project_id string, page_index int, payload binary")
    pre = {r.page_index: r for r in K.preprocess_pages(pages).collect()}
    assert pre[0].error is None and K.png_decode(bytes(pre[0].payload)).shape == (300, 400, 1)
    assert pre[1].payload is None and pre[1].error
    det = {r.page_index: r for r in K.detect_pages(pages).collect()}
    assert len(det[0].regions) == 6 and det[0].regions[0].y < det[0].regions[5].y
    assert K.measure_skew(pages).where("page_index = 0").first().skew_deg == 0.0


def exif(value, order="<", tag=0x0112):
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    entry = struct.pack(order + "HHHIHH", 1, tag, 3, 1, value, 0)
    body = b"Exif\0\0" + head + entry
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("value,want", [(1, 1), (6, 6), (8, 8), (0, 1), (12, 8)])
def test_exif(order, value, want):
    assert files.exif_orientation(exif(value, order)) == want


def test_exif_absent():
    for data in (b"", b"\x89PNG", b"\xff\xd8", b"\xff\xd8\xff\xda\0\0", exif(6, tag=0x0100), exif(6)[:20]):
        assert files.exif_orientation(data) == 1


def test_files_and_zip(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(K.png_encode(page(10, 12)))
    (tmp_path / "note.txt").write_bytes(b"x")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("zero.pdf", b"%PDF")
        z.writestr("nested/one.pdf", b"%PDF-1")
        z.writestr("README.txt", b"n")
    held = files.binary_files(spark, str(tmp_path))
    projects = files.ingest(held, default_settings()).collect()
    assert [p.name for p in projects] == ["a.PNG"] and projects[0].project_id.startswith("proj-")
    size = held.where("name = 'a.PNG'").select(files.png_size(F.col("content")).alias("s")).first().s
    assert tuple(size) == (12, 10)
    inside = files.zip_entries(held.where("name = 'z.zip'").select("path", "content"))
    assert sorted((r.name, r.mime) for r in inside.collect()) == [("one.pdf", "application/pdf"), ("zero.pdf", "application/pdf")]
    assert files.zip_entries(held.where("name = 'note.txt'").select("path", "content")).count() == 0


def test_damaged_and_encrypted_entries_are_errors(spark):
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for name in ("good.pdf", "bad.pdf", "locked.png"):
            z.writestr(name, bytes(range(256)) * 20)
    data = bytearray(made.getvalue())
    at = data.index(b"bad.pdf") + len("bad.pdf")
    data[at + 5 : at + 25] = bytes(20)
    entry = data.rindex(b"locked.png") - 46  # its row in the directory at the end
    data[entry + 8] |= 1
    first = data.index(b"locked.png") - 30
    data[first + 6] |= 1
    rows = spark.createDataFrame([("a.zip", data), ("b.zip", bytearray(b"no zip")), ("c.zip", None)], "path string, content binary")
    got = {r.name: (r.content and len(r.content), r.error is None, r.size_bytes) for r in files.zip_entries(rows).collect()}
    assert got == {"good.pdf": (5120, True, 5120), "bad.pdf": (None, False, 5120), "locked.png": (None, False, 5120)}


@pytest.mark.parametrize("orientation", range(1, 9))
def test_photographs_stand_upright(spark, tmp_path, orientation):
    """JPEGs written by the JVM, with an EXIF orientation put in; read back turned and mirrored."""
    from quirework.operators.geometry import ORIENTATIONS

    image = np.zeros((16, 32), np.uint8)
    image[:8, :8] = 255  # a white corner
    jvm = spark._jvm
    held = jvm.java.awt.image.BufferedImage(32, 16, 10)
    for y in range(16):
        for x in range(32):
            held.setRGB(x, y, int(image[y, x]) * 0x010101)
    plain = str(tmp_path / "plain.jpg")
    jvm.javax.imageio.ImageIO.write(held, "jpg", jvm.java.io.File(plain))
    data = open(plain, "rb").read()
    (tmp_path / "photo.jpg").write_bytes(data[:2] + exif(orientation)[2:-2] + data[2:])
    (tmp_path / "broken.jpeg").write_bytes(b"no image")
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.photographs(spark, str(tmp_path)).collect()}
    assert got["broken.jpeg"].error and got["broken.jpeg"].payload is None
    raster = K.grey(K.png_decode(bytes(got["photo.jpg"].payload)))
    angle, flip_x, flip_y = ORIENTATIONS[orientation]
    want = np.rot90(image, -angle // 90 % 4)
    want = np.fliplr(want) if flip_x else want
    want = np.flipud(want) if flip_y else want
    assert raster.shape == want.shape == (got["photo.jpg"].height, got["photo.jpg"].width)
    assert (raster.astype(int) > 128).tolist() == (want > 128).tolist()

def test_missing_blobs(spark):
    rows = spark.createDataFrame([("p", "x/source.pdf")], "project_id string, source_path string")
    blobs = spark.createDataFrame([("y", bytearray(b"1"))], "path string, content binary")
    assert files.with_blobs(rows, blobs, "source_path").first().content is None
    with pytest.raises(Exception, match="source missing"):
        files.required_sources(rows, blobs).collect()
    assert files.json_artifacts(spark, "/nowhere/at/all", files.RESULT_DDL) is None


def test_json_artifacts(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"regions":[{"x":1,"y":2,"width":3,"height":4}],"width":10,"height":20,"overlayPath":"o"}')
    r = files.json_artifacts(spark, str(tmp_path / "d.json"), files.REGIONS_DDL).first()
    assert tuple(r.regions[0]) == (1, 2, 3, 4) and r.width == 10


def test_archive_in_memory():
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a.pdf", b"1")
    assert zipfile.ZipFile(io.BytesIO(held.getvalue())).namelist() == ["a.pdf"]


def test_deleting_what_a_rewind_names(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.png").write_bytes(b"1")
    paths = spark.createDataFrame([("p/a.png",), ("p/missing.png",)], "path string")
    assert files.delete_paths(spark, str(tmp_path), paths) == 1
    assert not (tmp_path / "p" / "a.png").exists()
