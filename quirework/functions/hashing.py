"""Canonical settings, their hashes and artifact paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stages in order, what a stage's hash depends on, what is downstream of it.
STAGES = ("render", "preprocess", "detect", "ocr", "build")
PAGE_STAGES = STAGES[:4]
DEPENDS = {
    "render": ("render",),
    "preprocess": ("preprocess", "render"),
    "detect": ("detect", "preprocess", "render"),
    "ocr": ("detect", "ocr", "preprocess", "render"),
    "build": ("detect", "ocr", "preprocess", "render"),
}
DOWNSTREAM = {s: STAGES[k:] for k, s in enumerate(STAGES)}

# Fields in alphabetical order, so that to_json is canonical.
SETTINGS_DDL = (
    "struct<detect:struct<enabled:boolean>,ocr:struct<language:string,providerId:string>,"
    "preprocess:struct<binarizer:string,denoiseRadius:int,deskew:boolean,orientationDetect:boolean>,"
    "render:struct<dpi:int>>"
)
DEFAULTS = {
    "detect": {"enabled": True},
    "ocr": {"language": "eng", "providerId": "tesseract"},
    "preprocess": {"binarizer": "sauvola", "denoiseRadius": 1, "deskew": True, "orientationDetect": True},
    "render": {"dpi": 300},
}


def settings_json(settings: Column, stage: str) -> Column:
    """The part of the settings that ``stage`` depends on, with sorted keys."""
    parts = F.struct(*(settings[d].alias(d) for d in sorted(DEPENDS[stage])))
    return F.to_json(F.struct(parts.alias("settings"), F.lit(stage).alias("stage")))


def short_hash(s: Column) -> Column:
    return F.substring(F.sha2(s.cast("binary"), 256), 1, 16)


def settings_hash(settings: Column, stage: str) -> Column:
    return short_hash(settings_json(settings, stage))


def default_settings() -> Column:
    import json

    return F.from_json(F.lit(json.dumps(DEFAULTS)), SETTINGS_DDL)


def artifact_path(project: Column, page: Column, stage: Column, digest: Column, ext: Column) -> Column:
    return F.concat(project, F.lit("/pages/"), page.cast("string"), F.lit("/"), stage, F.lit("."), digest, F.lit("."), ext)


def artifact_glob(project: str, page: int, stage: str) -> str:
    return f"{project}/pages/{page}/{stage}.*"


def overlay_path(project: Column, page: Column, digest: Column) -> Column:
    return F.concat(project, F.lit("/pages/"), page.cast("string"), F.lit("/detect-overlay."), digest, F.lit(".png"))


def output_path(project: Column, digest: Column) -> Column:
    return F.concat(project, F.lit("/output."), digest, F.lit(".pdf"))


def project_id(path: Column) -> Column:
    """Deterministic, so that a second read of a file is the same project."""
    return F.concat(F.lit("proj-"), F.substring(F.sha2(path.cast("binary"), 256), 1, 8))
