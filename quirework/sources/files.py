"""Files as sources: PDFs, page images and archives of them, and the artifacts of earlier runs."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import project_id
from ..operators import kernels
from ..runtime import path_exists, ship_package

DELETERS = 16

# What is ingested, by extension.
MIME = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}
ENTRY_BYTES = 1 << 30
ENTRY = r"(?i)\.(pdf|jpe?g|png)$"


def binary_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, name, mime, size_bytes, content) of files, folders or globs."""
    files = spark.read.format("binaryFile").load(list(paths))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), mime_of(name).alias("mime"), F.col("length").alias("size_bytes"), "content")


def extension_of(name: Column) -> Column:
    """What follows the last dot, in lower case; of a name without one, the name."""
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def is_image_name(name: Column) -> Column:
    return extension_of(name).isin("jpg", "jpeg", "png")


def is_image_mime(mime: Column) -> Column:
    return mime.isin("image/jpeg", "image/png", "image/jpg")


def mime_of(name: Column) -> Column:
    kind = extension_of(name)
    out = None
    for e, m in MIME.items():
        out = F.when(kind == e, m) if out is None else out.when(kind == e, m)
    return out


def is_ingestible(name: Column) -> Column:
    return name.rlike(ENTRY)


def zip_entries(archives: DataFrame) -> DataFrame:
    """(path, name, mime, size_bytes, content, error): the pages and documents inside archives; other entries are left out.

    ``archives``: path, content. A broken archive gives no entries. An entry's path
    is archive!entry; one that is damaged, encrypted or over ENTRY_BYTES has no content, but an error.
    """
    ship_package(archives.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    held = zipfile.ZipFile(io.BytesIO(bytes(content)))
                except (zipfile.BadZipFile, TypeError):
                    continue
                for e in held.infolist():
                    kind = e.filename.rsplit(".", 1)[-1].lower()
                    if "." not in e.filename or kind not in MIME:
                        continue
                    body, error = None, None
                    try:
                        if e.file_size > ENTRY_BYTES:
                            raise ValueError(f"larger than {ENTRY_BYTES} bytes")
                        body = held.read(e)
                    except Exception as x:  # noqa: BLE001  what zipfile and its decoders raise is the entry's error
                        error = str(x) or type(x).__name__
                    row = (f"{path}!{e.filename}", e.filename.rsplit("/", 1)[-1], MIME[kind], e.file_size, body, error)
                    yield pd.DataFrame([row], columns=["path", "name", "mime", "size_bytes", "content", "error"])

    return archives.select("path", "content").mapInPandas(run, "path string, name string, mime string, size_bytes long, content binary, error string")


def photographs(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, width, height, payload, error): JPEG and PNG files as upright PNG pages.

    Spark's image source decodes them in the JVM; each is turned and mirrored as
    its EXIF orientation says. A file that is no image has nulls and an error.
    """
    ship_package(spark)
    pixels = spark.read.format("image").load(list(paths)).select("image.*")
    turns = binary_files(spark, *paths).select("path", exif_orientation_of("content").alias("orientation"))
    name = F.element_at(F.split("origin", "/"), -1)
    local = lambda c: F.regexp_replace(c, "^file:/+", "file:/")  # noqa: E731  the two sources write local paths differently
    rows = pixels.where(is_image_name(name)).join(turns, local("origin") == local("path")).select("path", "height", "width", "nChannels", "data", "orientation")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for r in pdf.itertuples(index=False):
                if r.height <= 0 or r.width <= 0:
                    made.append((r.path, None, None, None, "not an image"))
                    continue
                raster = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.nChannels)
                if r.nChannels == 1:
                    raster = raster[:, :, 0]
                else:  # blue first, as the source gives them
                    raster = raster[:, :, [2, 1, 0, *range(3, r.nChannels)]]
                page = kernels.upright(raster, int(r.orientation))
                made.append((r.path, page.shape[1], page.shape[0], kernels.png_encode(page), None))
            yield pd.DataFrame(made, columns=["path", "width", "height", "payload", "error"]).astype({"width": "Int32", "height": "Int32"})

    return rows.mapInPandas(run, "path string, width int, height int, payload binary, error string")


def ingest(files: DataFrame, settings: Column) -> DataFrame:
    """Projects of files: id, name, source, size and settings; pages are counted later."""
    at = project_id(F.col("path"))
    return files.where(is_ingestible(F.col("name"))).select(
        at.alias("project_id"),
        "name",
        F.concat(at, F.lit("/source.pdf")).alias("source_path"),
        F.col("size_bytes").alias("source_size_bytes"),
        F.lit(0).alias("page_count"),
        settings.alias("settings"),
    )


def newest_projects(projects: DataFrame) -> DataFrame:
    return projects.orderBy(F.desc("created_at"), "project_id")


def png_size(content: Column) -> Column:
    """(width, height) from a PNG's header."""
    at = lambda n: F.conv(F.hex(F.substring(content, n, 4)), 16, 10).cast("int")
    return F.struct(at(17).alias("width"), at(21).alias("height"))


def exif_orientation(data: bytes) -> int:
    """The orientation, 1 to 8, in a JPEG's EXIF segment; 1 where there is none."""
    if data[:2] != b"\xff\xd8":
        return 1
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return _tiff_orientation(data[at + 10 : at + 2 + size])
        if marker == 0xDA:
            break
        at += 2 + size
    return 1


def _tiff_orientation(tiff: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8:
        return 1
    (ifd,) = struct.unpack(order + "I", tiff[4:8])
    if ifd + 2 > len(tiff):
        return 1
    (n,) = struct.unpack(order + "H", tiff[ifd : ifd + 2])
    for tag, kind, count, value in struct.iter_unpack(order + "HHIH2x", tiff[ifd + 2 : ifd + 2 + 12 * min(n, (len(tiff) - ifd - 2) // 12)]):
        if (tag, kind, count) == (0x0112, 3, 1):
            return min(8, max(1, value))
    return 1


@F.pandas_udf(T.IntegerType())
def exif_orientation_of(content: pd.Series) -> pd.Series:
    return content.map(lambda b: 1 if b is None else exif_orientation(bytes(b)))


def with_blobs(rows: DataFrame, blobs: DataFrame, path_col: str = "artifact_path") -> DataFrame:
    """``rows`` with the content at their path, null where there is no such file. ``blobs``: path, content."""
    return rows.join(blobs.select(F.col("path").alias(path_col), "content"), path_col, "left")


def required_sources(projects: DataFrame, blobs: DataFrame) -> DataFrame:
    """Projects with their source; a missing one stops the run and is named."""
    rows = with_blobs(projects, blobs, "source_path")
    guard = F.when(F.col("content").isNull(), F.raise_error(F.concat(F.lit("source missing: "), F.col("source_path")))).otherwise(F.col("content"))
    return rows.withColumn("content", guard)


REGIONS_DDL = "regions array<struct<x:int,y:int,width:int,height:int>>, width int, height int, overlayPath string"
_BBOX = "struct<x:double,y:double,width:double,height:double>"
RESULT_DDL = (
    f"providerId string, pageSize struct<width:int,height:int>, text string, hocr string, "
    f"words array<struct<text:string,bbox:{_BBOX},confidence:double>>, "
    f"lines array<struct<text:string,bbox:{_BBOX},words:array<struct<text:string,bbox:{_BBOX},confidence:double>>>>"
)


def detected_regions(json: Column) -> Column:
    return F.from_json(json, REGIONS_DDL)


def recognised(json: Column) -> Column:
    return F.from_json(json, RESULT_DDL)


def json_artifacts(spark: SparkSession, path: str, ddl: str) -> DataFrame | None:
    """JSON artifacts with a fixed schema; None where nothing is stored."""
    return spark.read.schema(ddl).json(path) if path_exists(spark, path) else None


def example(spark: SparkSession, folder: str, name: str, fallback: str = "synthetic") -> DataFrame:
    """A bundled example file, or the fallback where it is not there."""
    wanted = f"{folder}/{name}.pdf"
    return binary_files(spark, wanted if path_exists(spark, wanted) else f"{folder}/{fallback}.pdf")


def recogniser_dictionary(text: Column) -> Column:
    """The characters of a recogniser: the lines of its file, a blank before them and a space after."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(s, "\r", "")), lambda s: s != "")
    return F.concat(F.array(F.lit("")), lines, F.array(F.lit(" ")))


def write_artifacts(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Artifacts as a table by project; the commit is the writer's, whole or not at all."""
    rows.write.mode(mode).partitionBy("project_id").parquet(path)


def delete_paths(spark: SparkSession, root: str, paths: DataFrame) -> int:
    """Delete the files that a rewind names (column path, below ``root``); one that is not there is no error. How many went."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def delete(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(f"{root}/{path}")
        return bool(p.getFileSystem(conf).delete(p, True))

    gone, rows = 0, paths.select("path").toLocalIterator(prefetchPartitions=True)
    with ThreadPoolExecutor(DELETERS) as pool:  # only the JVM reaches any store; names are held by the thousand
        while some := [r.path for r in islice(rows, 1000)]:
            gone += sum(pool.map(delete, some))
    return gone
