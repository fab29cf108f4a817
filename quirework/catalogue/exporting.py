"""Queries over exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import safe_filename, xml_escape
from ..operators import exports
from ..runtime import table
from .layouts import _DOCS, HEIGHT, WIDTH, page_lines


def _digest(rows: DataFrame, part: str) -> DataFrame:
    return rows.select("doc_id", F.length(part).alias("n_chars"), F.sha2(F.col(part).cast("binary"), 256).alias("part_sha256"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their lines; one without any, as blank documents are, has one line, of the page."""
    words = F.flatten(F.transform("lines", lambda ln: ln["words"]))
    lines = exports.lines_or_page(F.col("lines"), F.col("text"), words, F.lit(WIDTH), F.lit(HEIGHT))
    return page_lines(spark, sf_dir).withColumn("lines", lines)


def hocr_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = exports.hocr_page(F.col("doc_id"), F.lit(WIDTH), F.lit(HEIGHT), F.col("lines"))
    return _digest(_pages(spark, sf_dir).select("doc_id", part.alias("part")), "part")


def alto_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = exports.alto_page(F.col("doc_id"), F.lit(WIDTH), F.lit(HEIGHT), F.col("lines"))
    return _digest(_pages(spark, sf_dir).select("doc_id", part.alias("part")), "part")


def _document_parts(spark: SparkSession, sf_dir: str, kind: str, part) -> DataFrame:
    rows = _pages(spark, sf_dir).select(
        F.col("source").alias("project_id"),
        F.concat(F.col("source"), F.lit(" & more")).alias("name"),
        F.col("doc_id").alias("page_index"),
        part(F.col("doc_id"), F.lit(WIDTH), F.lit(HEIGHT), F.col("lines")).alias("part"),
    )
    parts = exports.document_parts(rows, kind)
    return parts.select("project_id", "seq", F.length("part").alias("n_chars"), F.sha2(F.col("part").cast("binary"), 256).alias("part_sha256"))


def hocr_document_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each project's hOCR document in parts."""
    return _document_parts(spark, sf_dir, "hocr", exports.hocr_page)


def alto_document_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each project's ALTO document in parts."""
    return _document_parts(spark, sf_dir, "alto", exports.alto_page)


def native_hocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of markup as a recogniser's own hOCR: the first block, renumbered."""
    pages = table(spark, sf_dir, "pages")
    made = F.concat(
        F.lit("<body><div id='x' class='ocr_page' title=\"t\"><span class=\"ocr_line\" id='l'>"),
        xml_escape(F.coalesce("html", "url", F.lit(""))),
        F.lit("</span></div><div class='ocr_page'>second</div></body>"),
    )
    html = F.when(F.pmod("page_id", F.lit(3)) == 0, F.col("html")).otherwise(made)
    return pages.select("page_id", exports.native_block(html, F.col("page_id")).alias("block"))


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", F.concat(safe_filename(F.col("url")), F.lit(".hocr.html")).alias("hocr"), safe_filename(F.regexp_replace("url", "[A-Za-z0-9_.-]+", "")).alias("rest")
    )


QUERIES = {f.__name__: f for f in (hocr_page, alto_page, hocr_document_parts, alto_document_parts, native_hocr, safe_names)}

_ESC = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_HOCR = f"""
hw AS (SELECT doc_id, line, y, height, string_agg('<span class="ocrx_word" id="word_' || (doc_id + 1) || '_' || (line + 1) || '_' || (word + 1) || '" title="bbox 0 ' || y || ' {WIDTH} ' || (y + height)
              || '; x_wconf 85">' || {_ESC.format("text")} || '</span>', ' ' ORDER BY word) AS t FROM w GROUP BY ALL),
hl AS (SELECT doc_id, string_agg('  <span class="ocr_line" id="line_' || (doc_id + 1) || '_' || (line + 1) || '" title="bbox 0 ' || y || ' {WIDTH} ' || (y + height) || '">' || t || '</span>', chr(10) ORDER BY line) AS t FROM hw GROUP BY doc_id),
hp AS (SELECT p.doc_id, p.source, len(p.ls) AS n, '<div class="ocr_page" id="page_' || (p.doc_id + 1) || '" title="bbox 0 0 {WIDTH} {HEIGHT}; ppageno ' || p.doc_id || '">' || chr(10)
              || coalesce(t, '  <span class="ocr_line" id="line_' || (p.doc_id + 1) || '_1" title="bbox 0 0 {WIDTH} {HEIGHT}"></span>') || chr(10) || '</div>' AS part
       FROM p LEFT JOIN hl USING (doc_id))"""
_ALTO_ESC = "replace(" + _ESC.format("text") + ", '''', '&apos;')"
_BOX = f"HPOS=\"0\" VPOS=\"' || y || '\" WIDTH=\"{WIDTH}\" HEIGHT=\"' || height || '\""
_ALL = f'HPOS="0" VPOS="0" WIDTH="{WIDTH}" HEIGHT="{HEIGHT}"'
_ALTO = f"""
aw AS (SELECT doc_id, line, y, height, string_agg('          <String ID="word_' || (doc_id + 1) || '_' || (line + 1) || '_' || (word + 1) || '" {_BOX} CONTENT="' || {_ALTO_ESC} || '" WC="0.85"/>', chr(10) ORDER BY word) AS t FROM w GROUP BY ALL),
al AS (SELECT doc_id, string_agg('        <TextLine ID="line_' || (doc_id + 1) || '_' || (line + 1) || '" {_BOX}>' || chr(10) || t || chr(10) || '        </TextLine>', chr(10) ORDER BY line) AS t FROM aw GROUP BY doc_id),
ap AS (SELECT p.doc_id, p.source, '    <Page ID="page_' || (p.doc_id + 1) || '" PHYSICAL_IMG_NR="' || (p.doc_id + 1) || '" WIDTH="{WIDTH}" HEIGHT="{HEIGHT}">' || chr(10) || '      <PrintSpace {_ALL}>' || chr(10)
              || '        <TextBlock ID="block_' || (p.doc_id + 1) || '" {_ALL}>' || chr(10)
              || coalesce(t, '        <TextLine ID="line_' || (p.doc_id + 1) || '_1" {_ALL}>' || chr(10) || chr(10) || '        </TextLine>') || chr(10) || '        </TextBlock>' || chr(10) || '      </PrintSpace>' || chr(10) || '    </Page>' AS part
       FROM p LEFT JOIN al USING (doc_id))"""
_HEAD = (exports.HOCR_HEAD + "<title>").replace("'", "''")
_TAG_SQL = "(?s)" + exports._PAGE_TAG.replace("'", "''") + ".*?</div>"
_ID_SQL = exports._ID.replace("'", "''")
_ALTO_FRAME = [t.replace("'", "''") for t in (*exports.ALTO_FRAME, exports.ALTO_FOOT)]

SQL = {
    "hocr_page": f"WITH {_DOCS},{_HOCR} SELECT doc_id, CAST(length(part) AS INT) AS n_chars, sha256(part) AS part_sha256 FROM hp",
    "alto_page": f"WITH {_DOCS},{_ALTO} SELECT doc_id, CAST(length(part) AS INT) AS n_chars, sha256(part) AS part_sha256 FROM ap",
    "hocr_document_parts": f"""WITH {_DOCS},{_HOCR},
g AS (SELECT source AS project_id, max(doc_id) AS last FROM hp GROUP BY source),
x AS (SELECT project_id, -1 AS seq, '{_HEAD}' || project_id || ' &amp; more</title>' || chr(10) || '</head>' || chr(10) || '<body>' AS part FROM g
      UNION ALL SELECT source, doc_id, part FROM hp
      UNION ALL SELECT project_id, last + 1, '</body>' || chr(10) || '</html>' FROM g)
SELECT project_id, CAST(seq AS BIGINT) AS seq, CAST(length(part) AS INT) AS n_chars, sha256(part) AS part_sha256 FROM x""",
    "alto_document_parts": f"""WITH {_DOCS},{_ALTO},
g AS (SELECT source AS project_id, max(doc_id) AS last FROM ap GROUP BY source),
x AS (SELECT project_id, -1 AS seq, '{_ALTO_FRAME[0]}' || project_id || ' &amp; more{_ALTO_FRAME[1]}' AS part FROM g
      UNION ALL SELECT source, doc_id, part FROM ap
      UNION ALL SELECT project_id, last + 1, '{_ALTO_FRAME[2]}' FROM g)
SELECT project_id, CAST(seq AS BIGINT) AS seq, CAST(length(part) AS INT) AS n_chars, sha256(part) AS part_sha256 FROM x""",
    "native_hocr": f"""
WITH m AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN html ELSE '<body><div id=''x'' class=''ocr_page'' title="t"><span class="ocr_line" id=''l''>'
  || {_ESC.format("coalesce(html, url, '')")} || '</span></div><div class=''ocr_page''>second</div></body>' END AS h FROM pages),
b AS (SELECT page_id, h, regexp_extract(h, '{_TAG_SQL}', 0) AS b FROM m)
SELECT page_id, CASE WHEN (contains(h, 'ocr_line') OR contains(h, 'ocrx_word')) AND b <> '' THEN regexp_replace(b, '{_ID_SQL}', ' id="page_' || (page_id + 1) || '"') END AS block FROM b""",
    "safe_names": """
SELECT page_id, coalesce(nullif(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), ''), 'output') || '.hocr.html' AS hocr,
       coalesce(nullif(regexp_replace(regexp_replace(url, '[A-Za-z0-9_.-]+', '', 'g'), '[^A-Za-z0-9_.-]+', '_', 'g'), ''), 'output') AS rest FROM pages""",
}
