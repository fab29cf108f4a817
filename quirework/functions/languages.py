"""The language catalogue and its helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import js_trim

# Code, name, script.
LANGUAGES = (
    ("eng", "English", "Latin"),
    ("deu", "German", "Latin"),
    ("deu_frak", "German (Fraktur)", "Latin / blackletter"),
    ("fra", "French", "Latin"),
    ("spa", "Spanish", "Latin"),
    ("ita", "Italian", "Latin"),
    ("por", "Portuguese", "Latin"),
    ("nld", "Dutch", "Latin"),
    ("pol", "Polish", "Latin"),
    ("lat", "Latin", "Latin"),
    ("rus", "Russian", "Cyrillic"),
    ("ukr", "Ukrainian", "Cyrillic"),
    ("ara", "Arabic", "Arabic"),
    ("heb", "Hebrew", "Hebrew"),
    ("ell", "Greek", "Greek"),
    ("chi_sim", "Chinese (Simplified)", "Han"),
    ("chi_tra", "Chinese (Traditional)", "Han"),
    ("jpn", "Japanese", "Han/Kana"),
    ("kor", "Korean", "Hangul"),
    ("hin", "Hindi", "Devanagari"),
    ("tur", "Turkish", "Latin"),
    ("vie", "Vietnamese", "Latin"),
)
LOCAL_CODES = ("eng",)
LOCAL_FOLDER = "/tesseract/"


def languages(spark: SparkSession) -> DataFrame:
    rows = [(k, *r) for k, r in enumerate(LANGUAGES)]
    return spark.createDataFrame(rows, "position int, code string, name string, script string")


def parse_languages(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, r"\+"), js_trim), lambda c: c != "")


def join_languages(codes: Column) -> Column:
    """Codes joined by +, each once, in the order of its first place."""
    return F.array_join(F.array_distinct(F.filter(codes, lambda c: c.isNotNull() & (c != ""))), "+")


def model_path(value: Column, remote: str) -> Column:
    """(path, gzip): the local folder if every code is local, else the remote one."""
    codes = F.filter(F.split(value, r"\+"), lambda c: c != "")
    local = F.forall(codes, lambda c: c.isin(*LOCAL_CODES))
    return F.when(local, F.struct(F.lit(LOCAL_FOLDER).alias("path"), F.lit(False).alias("gzip"))).otherwise(
        F.struct(F.lit(remote).alias("path"), F.lit(True).alias("gzip"))
    )


def model_url(code: Column, remote: str) -> Column:
    return F.when(code.isin(*LOCAL_CODES), F.concat(F.lit(LOCAL_FOLDER), code, F.lit(".traineddata"))).otherwise(
        F.concat(F.lit(remote), code, F.lit(".traineddata.gz"))
    )
