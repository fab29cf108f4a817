"""The registry of recognisers, the one point at which users add code of their own.

A recogniser is a function from an image to its text, and runs in
``mapInPandas``: batches in, batches out, one process for many pages. A page's
image travels once, with the boxes of its regions; it is cropped in the worker,
which calls the recogniser for each crop. Deadlines hold within the function.
"""

from __future__ import annotations

import base64
import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, TimeoutError
from dataclasses import dataclass, replace
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.text import join_growing, js_trim
from ..operators import kernels, layout
from ..operators.rewind import PAGE_KEY
from ..runtime import ship_package

RESULT = "project_id string, page_index int, found array<struct<text:string,error:string>>"


_BOXES = "array<struct<x:int,y:int,width:int,height:int>>"


@dataclass(frozen=True)
class Recogniser:
    """``recognise``: (image bytes, page index, language) to text; None if it cannot run here."""

    id: str
    label: str
    kind: str  # local or hosted
    recognise: Callable[[bytes, int, str], str] | None = None
    layout: bool = False
    tables: bool = False
    handwriting: bool = False


_REGISTRY: list[Recogniser] = []


def register(recogniser: Recogniser) -> None:
    """Add a recogniser, or replace the one with its id in its place."""
    for k, r in enumerate(_REGISTRY):
        if r.id == recogniser.id:
            _REGISTRY[k] = recogniser
            return
    _REGISTRY.append(recogniser)


def recogniser(name: str) -> Recogniser:
    for r in _REGISTRY:
        if r.id == name:
            return r
    raise KeyError(f"unknown OCR provider: {name}")


def recognisers() -> list[Recogniser]:
    return list(_REGISTRY)


def catalogue(spark: SparkSession) -> DataFrame:
    rows = [(k, r.id, r.label, r.kind, r.layout, r.tables, r.handwriting) for k, r in enumerate(_REGISTRY)]
    return spark.createDataFrame(rows, "position int, id string, label string, kind string, layout boolean, tables boolean, handwriting boolean")


def visible(providers: DataFrame, keys: DataFrame) -> DataFrame:
    """Local recognisers, and hosted ones with a stored key (keys: id)."""
    local = providers.where("kind = 'local'")
    return local.unionByName(providers.where("kind = 'hosted'").join(keys.select("id").distinct(), "id", "left_semi"))


def with_deadline(work: Callable[[], str], seconds: float, label: str) -> str:
    """The result of ``work``, or an error after the deadline; what runs on is left behind."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(work).result(timeout=seconds)
    except TimeoutError:
        raise TimeoutError(f"{label} timed out") from None
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def _images(content: bytes, boxes: list[tuple[int, int, int, int]]) -> Iterator[Callable[[], bytes]]:
    """The image, or its crops as PNGs, each made when it is asked for; the page is decoded once."""
    if not boxes:
        yield lambda: content
        return
    page: list = []

    def cropped(box: tuple[int, int, int, int]) -> bytes:
        if not page:
            page.append(kernels.png_decode(content))
        part = kernels.crop(page[0], box)
        return kernels.png_encode(part[:, :, 0] if part.shape[2] == 1 else part)

    for box in boxes:
        yield lambda b=box: cropped(b)


def _recognised(pages: DataFrame, which: Recogniser, language: str, seconds: float) -> DataFrame:
    """(project_id, page_index, found): for each box of ``pages`` (.., content, boxes), or the whole page without any, a text or an error."""
    ship_package(pages.sparkSession)

    def called(image: Callable[[], bytes], index: int) -> dict:
        try:
            if which.recognise is None:
                raise RuntimeError(f"{which.id} is not installed here")
            return {"text": with_deadline(lambda: which.recognise(image(), index, language), seconds, which.id), "error": None}
        except Exception as e:  # noqa: BLE001  whatever a recogniser raises is the page's error
            return {"text": None, "error": str(e) or type(e).__name__}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for content, index, boxes in zip(pdf["content"], pdf["page_index"], pdf["boxes"], strict=True):
                sides = [] if boxes is None else [(b["x"], b["y"], b["width"], b["height"]) for b in boxes]
                found.append([called(image, int(index)) for image in _images(bytes(content), sides)])
            yield pdf[PAGE_KEY].assign(found=found)

    return pages.select(*PAGE_KEY, "content", "boxes").mapInPandas(run, RESULT)


def recognise_pages(pages: DataFrame, which: Recogniser, language: str, seconds: float = 20.0) -> DataFrame:
    """(project_id, page_index, text, error) of ``pages`` (.., content): an error is a row, not a failure."""
    none = F.lit(None).cast(_BOXES).alias("boxes")
    rows = _recognised(pages.select(*PAGE_KEY, "content", none), which, language, seconds)
    return rows.select(*PAGE_KEY, F.inline("found"))


def by_region(pages: DataFrame, detected: DataFrame, which: Recogniser, language: str, seconds: float = 20.0) -> DataFrame:
    """(project_id, page_index, text, lines, words, error): one call for each region of a page, or one for a page without regions.

    ``pages``: project_id, page_index, content, width, height; ``detected``: project_id,
    page_index, regions. Each region's crop is one line with the region's box,
    its words laid out in the crop and moved to the page. A page without regions
    is laid out evenly. An error of any call is the page's.
    """
    regions = F.when(F.size("regions") > 0, F.col("regions").cast(_BOXES))
    held = pages.join(detected.select(*PAGE_KEY, "regions"), PAGE_KEY, "left").select(*PAGE_KEY, "content", "width", "height", regions.alias("boxes"))
    found = _recognised(held, which, language, seconds)
    rows = found.join(held.drop("content"), PAGE_KEY)

    def line(z: Column) -> Column:
        words = lambda text: F.flatten(F.transform(layout.even_lines(text, z["box"]["width"], z["box"]["height"]), lambda ln: ln["words"]))
        moved = let(F.coalesce(z["found"]["text"], F.lit("")), lambda text: layout.offset_words(words(text), z["box"]))
        return F.struct(js_trim(F.coalesce(z["found"]["text"], F.lit(""))).alias("text"), z["box"].alias("bbox"), moved.alias("words"))

    whole = F.coalesce(F.get("found", F.lit(0))["text"], F.lit(""))
    lines = F.when(F.col("boxes").isNull(), layout.even_lines(whole, F.col("width"), F.col("height"))).otherwise(
        F.transform(F.arrays_zip("found", F.col("boxes").alias("box")), line)
    )
    error = F.array_join(F.filter(F.transform("found", lambda f: f["error"]), lambda e: e.isNotNull()), "; ")
    rows = rows.withColumn("lines", lines)
    text = F.when(F.col("boxes").isNull(), whole).otherwise(join_growing(F.transform("lines", lambda ln: ln["text"])))
    words = F.flatten(F.transform("lines", lambda ln: ln["words"]))
    return rows.select(*PAGE_KEY, text.alias("text"), "lines", words.alias("words"), F.nullif(error, F.lit("")).alias("error"))


# --- hosted services: the request and the reply; the transport is a parameter

Transport = Callable[[str, dict, bytes], tuple[int, bytes]]


def http_post(url: str, headers: dict, body: bytes) -> tuple[int, bytes]:
    request = urllib.request.Request(url, body, headers)  # noqa: S310
    try:
        with urllib.request.urlopen(request) as reply:  # noqa: S310
            return reply.status, reply.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


def candidate_text(reply: dict) -> str:
    """All parts of all candidates, joined."""
    return "".join(p.get("text") or "" for c in reply.get("candidates") or [] for p in (c.get("content") or {}).get("parts") or [])


def first_page_text(reply: dict) -> str:
    """The first page's markdown, else its text."""
    page = (reply.get("pages") or [{}])[0]
    return page.get("markdown") if page.get("markdown") is not None else page.get("text") or ""


def error_message(reply: dict, status: int) -> str:
    return reply.get("detail") or (reply.get("error") or {}).get("message") or reply.get("message") or f"HTTP {status}"


def hosted(name: str, label: str, url: str, request: Callable[[bytes, str], tuple[dict, dict]], read: Callable[[dict], str], send: Transport = http_post) -> Recogniser:
    """A recogniser that posts each image; ``request`` gives headers and body, ``read`` takes the text from the reply."""

    def recognise(content: bytes, index: int, language: str) -> str:
        headers, body = request(content, language)
        status, reply = send(url, headers, json.dumps(body).encode())
        found = json.loads(reply or b"{}")
        if status // 100 != 2:
            raise RuntimeError(error_message(found, status))
        return read(found)

    return Recogniser(name, label, "hosted", recognise)


# The two services' addresses and models.
GEMINI = "https://generativelanguage.googleapis.com/v1beta/models/gemini-2.5-flash:generateContent"
MISTRAL, MISTRAL_MODEL = "https://api.mistral.ai/v1/ocr", "mistral-ocr-latest"
PROMPT = "Read the text on this page. Answer with the text alone, line by line as it stands; with nothing if there is none."


def gemini(key: str, send: Transport = http_post) -> Recogniser:
    """The hosted service that takes a prompt and an inline image."""

    def request(content: bytes, language: str) -> tuple[dict, dict]:
        image = {"inlineData": {"mimeType": "image/png", "data": base64.b64encode(content).decode()}}
        body = {
            "contents": [{"role": "user", "parts": [{"text": PROMPT}, image]}],
            "generationConfig": {"temperature": 0, "responseMimeType": "text/plain"},
        }
        return {"Content-Type": "application/json"}, body

    made = hosted("gemini-flash", "Gemini Flash", f"{GEMINI}?key={quote(key, safe='')}", request, candidate_text, send)
    return replace(made, handwriting=True, tables=True)


def mistral(key: str, send: Transport = http_post) -> Recogniser:
    """The hosted service that takes an image by a data address and answers with pages of markdown."""

    def request(content: bytes, language: str) -> tuple[dict, dict]:
        image = "data:image/png;base64," + base64.b64encode(content).decode()
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {key}"}
        return headers, {"model": MISTRAL_MODEL, "document": {"type": "image_url", "image_url": image}}

    made = hosted("mistral-ocr", "Mistral OCR", MISTRAL, request, first_page_text, send)
    return replace(made, layout=True, handwriting=True, tables=True)


def _keyless(name: str, **what: bool) -> Recogniser:
    def recognise(content: bytes, index: int, language: str) -> str:
        raise RuntimeError(f"{name} has no key")

    return Recogniser(name, {"gemini-flash": "Gemini Flash", "mistral-ocr": "Mistral OCR"}[name], "hosted", recognise, **what)


def mock(name: str = "mock") -> Recogniser:
    return Recogniser(name, "Mock", "local", lambda content, index, language: f"Mock page {index + 1} of example document.")


def mock_results(pages: DataFrame) -> DataFrame:
    """What the mock recogniser returns, with its layout, as built-in functions."""
    return pages.select(*PAGE_KEY, layout.mock_page(F.col("page_index")).alias("payload"))


# The local engines need binaries or models that are not part of this package; they are listed, and say so when run.
register(Recogniser("tesseract", "Tesseract", "local", layout=True))
register(Recogniser("onnx-paddle", "PaddleOCR (ONNX)", "local", layout=True))
# The hosted ones are registered anew with a key: register(gemini(key)).
register(_keyless("gemini-flash", handwriting=True, tables=True))
register(_keyless("mistral-ocr", layout=True, handwriting=True, tables=True))
