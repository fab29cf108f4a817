"""Queries over sources. Files are generated from the tables' rows, as bytes."""

from __future__ import annotations

import io
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, udfs
from ..functions.text import TRIM, WS, normalise_spaces
from ..operators import quality, rewind
from ..runtime import shared_dir, ship_package, spread, table
from ..sources import files


def _bytes(*hexes):
    return F.unhex(F.concat(*hexes))


def png_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes read back from the headers of PNGs as wide and high as the documents' ids say."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    n = lambda c: F.lpad(F.hex(c), 8, "0")
    w, h = F.pmod(F.col("doc_id") * 977, F.lit(70000)), F.pmod(F.col("doc_id") * 613, F.lit(9000))
    content = _bytes(F.lit("89504E470D0A1A0A0000000D49484452"), n(w), n(h), F.lit("0802000000"))
    return docs.select("doc_id", files.png_size(content).alias("s")).select("doc_id", "s.width", "s.height")


def exif_orientations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orientations 0 to 9 in either byte order, behind another segment, or absent."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    o, little = F.pmod("doc_id", F.lit(10)), F.pmod(F.col("doc_id"), F.lit(4)) < 2
    value = F.lpad(F.hex(o), 2, "0")
    tiff = F.when(
        little, F.concat(F.lit("49492A00080000000100120103000100000"), F.lit("0"), value, F.lit("00000000000000"))
    ).otherwise(F.concat(F.lit("4D4D002A00000008000101120003000000010"), F.lit("0"), value, F.lit("000000000000")))
    other = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lit("FFE00004AAAA")).otherwise("")
    jpeg = F.concat(F.lit("FFD8"), other, F.lit("FFE10022457869660000"), tiff, F.lit("FFDA"))
    content = F.unhex(F.when(F.pmod("doc_id", F.lit(11)) == 0, F.lit("FFD8FFDA0000")).otherwise(jpeg))
    return docs.select("doc_id", files.exif_orientation_of(content).alias("orientation"))


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made from urls: extension, type, and whether they are images or ingested."""
    pages = table(spark, sf_dir, "pages")
    ends = F.array(*map(F.lit, (".pdf", ".JPG", ".jpeg", ".Png", ".txt", "")))
    name = F.concat(F.substring_index("url", "/", -1), F.get(ends, F.pmod("page_id", F.lit(6)).cast("int")))
    rows = pages.select("page_id", name.alias("name"))
    return rows.select(
        "page_id", files.extension_of(F.col("name")).alias("extension"), files.mime_of(F.col("name")).alias("mime"),
        files.is_image_name(F.col("name")).alias("is_image"), files.is_ingestible(F.col("name")).alias("ingested"),
    )


def zip_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each benchmark item: two pages in folders and a note that is left out."""
    ship_package(spark)

    def pack(batches):
        for pdf in batches:
            out = []
            for i, t in zip(pdf["item_id"], pdf["text"], strict=True):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w") as z:
                    z.writestr(f"a{i}.pdf", (t or "").encode())
                    z.writestr(f"nested/b{i}.PNG", b"x" * int(i % 7))
                    z.writestr("README.txt", b"note")
                out.append(held.getvalue())
            yield pd.DataFrame({"path": "zip" + pdf["item_id"].astype(str), "content": out})

    bench = table(spark, sf_dir, "benchmark").select("item_id", "text").mapInPandas(pack, "path string, content binary")
    return files.zip_entries(bench).select("path", "name", "mime", "size_bytes")


def recogniser_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of conversations as dictionary files: the number of entries and the last but one."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", files.recogniser_dictionary(F.coalesce("text", F.lit(""))).alias("d"))
    return turns.select("conv_id", "turn", F.size("d").alias("n"), F.get("d", F.size("d") - 2).alias("last"))


def ingested_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files named after urls as projects; what is no page or document is left out."""
    pages = table(spark, sf_dir, "pages")
    ends = F.array(*map(F.lit, (".pdf", ".JPG", ".txt", ".png")))
    name = F.concat(F.substring_index("url", "/", -1), F.get(ends, F.pmod("page_id", F.lit(4)).cast("int")))
    held = pages.select(F.concat("url", F.lit("#"), F.col("page_id").cast("string")).alias("path"), name.alias("name"), F.octet_length("html").cast("long").alias("size_bytes"))
    return files.ingest(held, hashing.default_settings()).withColumn("settings", hashing.settings_hash(F.col("settings"), "build"))


def project_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of one project in order, and what one of them holds."""
    docs = table(spark, sf_dir, "documents").where(F.col("source") == "src1")
    first = docs.agg(F.min("doc_id").alias("first"))
    return docs.orderBy("doc_id").select("doc_id", "n_chars").join(F.broadcast(first), F.col("doc_id") == F.col("first"), "left").select("doc_id", "n_chars", F.col("first").isNotNull().alias("is_first"))


def newest_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project that is shown first: the newest, of equals the first by name."""
    projects = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("project_id")).agg(F.max("doc_id").alias("created_at"))
    return files.newest_projects(projects).limit(1)


def stored_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the file at their path, where there is one; a source that must be there is."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    blobs = docs.where(F.pmod("doc_id", F.lit(3)) > 0).select("path", F.col("text").cast("binary").alias("content"))
    rows = files.with_blobs(docs.select("doc_id", F.col("path").alias("artifact_path")), blobs)
    needed = files.required_sources(docs.where(F.pmod("doc_id", F.lit(3)) == 1).select("doc_id", F.col("path").alias("source_path")), blobs)
    needed = needed.select("doc_id", F.octet_length("content").alias("source_bytes"))
    return rows.select("doc_id", F.octet_length("content").alias("n_bytes")).join(needed, "doc_id", "left")


def json_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected regions as JSON files, one for each document, read back with their schema; none where there is no folder."""
    root = f"{shared_dir(spark)}/regions-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    box = lambda k: F.struct((F.col("doc_id") + k).cast("int").alias("x"), F.lit(k).alias("y"), F.lit(10).alias("width"), F.lit(2).alias("height"))
    regions = F.slice(F.array(box(1), box(2), box(3)), 1, F.pmod("doc_id", F.lit(4)).cast("int"))
    docs.select(regions.alias("regions"), F.col("doc_id").cast("int").alias("width"), F.lit(9).alias("height")).write.json(root)
    if files.json_artifacts(spark, root + "-none", files.REGIONS_DDL) is not None:
        raise ValueError("a folder that nobody wrote")
    area = F.aggregate("regions", F.lit(0), lambda a, r: a + r["x"] * r["y"])
    return files.json_artifacts(spark, root, files.REGIONS_DDL).select(F.col("width").cast("long").alias("doc_id"), F.size("regions").alias("n"), area.alias("x_by_y"), "overlayPath")


def artifact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts written by project, some of them again and then in place of the old rows."""
    root = f"{shared_dir(spark)}/artifacts-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("project_id"), F.col("doc_id").alias("page_index"), F.col("n_chars").alias("size_bytes"))
    files.write_artifacts(docs.where(F.pmod("page_index", F.lit(2)) == 0), root)
    files.write_artifacts(docs.where(F.pmod("page_index", F.lit(2)) == 1), root)
    held = spark.read.parquet(root)
    new = docs.where(F.pmod("page_index", F.lit(5)) == 0).withColumn("size_bytes", F.lit(1).cast("long"))
    rows = rewind.upsert(held.select(*docs.columns), new, ["project_id", "page_index"])
    return rows.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"))


def wrapped_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts under a key of a passphrase: what the key opens, and that another does not."""
    key, other = (udfs.derive_key(p, bytes(16)) for p in ("pass", "word"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", udfs.wrap_secret(F.col("text").cast("binary"), key).alias("w"), F.octet_length("text").alias("n"))
    return rows.select(
        "item_id", F.sha2(udfs.unwrap_secret(F.col("w"), key).cast("binary"), 256).alias("text_sha256"),
        udfs.unwrap_secret(F.col("w"), other).isNull().alias("closed"), (F.octet_length("w") - F.col("n")).alias("overhead"),
    )


def normalised_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    t = normalise_spaces(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.length(t).alias("n_chars"), F.sha2(t.cast("binary"), 256).alias("text_sha256"))


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the labels of each source as JSON, read back."""
    root = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")), "doc_id", "left")
    rows = docs.groupBy(F.col("source").alias("provider")).agg(F.round(F.avg("q"), 6).alias("accuracy"), F.count("q").alias("n"))
    quality.write_report(rows, root)
    return spark.read.schema("provider string, accuracy double, n long").json(root)


QUERIES = {
    f.__name__: f
    for f in (
        png_header, exif_orientations, file_kinds, zip_entries, recogniser_dictionary, ingested_projects, project_pages, newest_project,
        stored_blobs, json_artifacts, artifact_table, wrapped_secrets, normalised_spaces, quality_report,
    )
}

SQL = {
    "png_header": "SELECT doc_id, CAST(doc_id * 977 % 70000 AS INT) AS width, CAST(doc_id * 613 % 9000 AS INT) AS height FROM documents",
    "exif_orientations": "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 1 ELSE CAST(least(8, greatest(1, doc_id % 10)) AS INT) END AS orientation FROM documents",
    "file_kinds": """
WITH n AS (SELECT page_id, regexp_extract(url, '[^/]*$', 0) || ['.pdf', '.JPG', '.jpeg', '.Png', '.txt', ''][page_id % 6 + 1] AS name FROM pages),
e AS (SELECT page_id, name, lower(string_split(name, '.')[-1]) AS extension FROM n)
SELECT page_id, extension, CASE extension WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' END AS mime,
       extension IN ('jpg', 'jpeg', 'png') AS is_image, regexp_matches(name, '(?i)\\.(pdf|jpe?g|png)$') AS ingested FROM e""",
    "zip_entries": """
SELECT 'zip' || item_id || '!a' || item_id || '.pdf' AS path, 'a' || item_id || '.pdf' AS name, 'application/pdf' AS mime, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size_bytes FROM benchmark
UNION ALL SELECT 'zip' || item_id || '!nested/b' || item_id || '.PNG', 'b' || item_id || '.PNG', 'image/png', item_id % 7 FROM benchmark""",
    "ingested_projects": """
WITH p AS (SELECT url || '#' || page_id AS path, regexp_extract(url, '[^/]*$', 0) || ['.pdf', '.JPG', '.txt', '.png'][page_id % 4 + 1] AS name, strlen(html) AS n, page_id FROM pages),
i AS (SELECT *, 'proj-' || substr(sha256(path), 1, 8) AS id FROM p WHERE page_id % 4 <> 2)
SELECT id AS project_id, name, id || '/source.pdf' AS source_path, CAST(n AS BIGINT) AS source_size_bytes, 0 AS page_count, '97dcc120c9954dc0' AS settings FROM i""",
    "project_pages": "SELECT doc_id, n_chars, doc_id = (SELECT min(doc_id) FROM documents WHERE source = 'src1') AS is_first FROM documents WHERE source = 'src1'",
    "newest_project": "SELECT source AS project_id, max(doc_id) AS created_at FROM documents GROUP BY source ORDER BY created_at DESC, project_id LIMIT 1",
    "stored_blobs": """
SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN CAST(strlen(text) AS INT) END AS n_bytes, CASE WHEN doc_id % 3 = 1 THEN CAST(strlen(text) AS INT) END AS source_bytes FROM documents""",
    "json_artifacts": """
SELECT doc_id, CAST(doc_id % 4 AS INT) AS n, CAST(coalesce(list_sum(list_transform(range(1, doc_id % 4 + 1), lambda k: (doc_id + k) * k)), 0) AS INT) AS x_by_y, CAST(NULL AS VARCHAR) AS "overlayPath" FROM documents""",
    "artifact_table": "SELECT source AS project_id, count(*) AS n, CAST(sum(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE n_chars END) AS BIGINT) AS bytes FROM documents GROUP BY source",
    "wrapped_secrets": "SELECT item_id, sha256(text) AS text_sha256, true AS closed, 28 AS overhead FROM benchmark",
    "normalised_spaces": f"""
WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g'), '{TRIM}', '', 'g') AS t FROM documents)
SELECT doc_id, CAST(length(t) AS INT) AS n_chars, sha256(t) AS text_sha256 FROM t""",
    "quality_report": """
SELECT source AS provider, round(avg(q), 6) AS accuracy, count(q) AS n FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY source""",
    "recogniser_dictionary": """
WITH d AS (SELECT conv_id, turn, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: replace(s, chr(13), '')), lambda s: s <> '') AS d FROM conversations)
SELECT conv_id, turn, CAST(len(d) + 2 AS INT) AS n, CASE WHEN len(d) > 0 THEN d[-1] ELSE '' END AS last FROM d""",
}
