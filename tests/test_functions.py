import pytest
from pyspark.sql import functions as F

from quirework.functions import hashing, languages, text, udfs
from quirework.functions.bind import let


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


@pytest.mark.parametrize("v,want", [(2.5, 3), (-2.5, -2), (0.49, 0), (-0.5, 0)])
def test_js_round(spark, v, want):
    assert one(spark, text.js_round(F.lit(v))) == want


def test_trim_takes_javascripts_white_space(spark):
    assert one(spark, text.js_trim(F.lit(" ﻿  a b 　\n"))) == "a b"


def test_lines(spark):
    assert one(spark, text.split_lines(F.lit(" a \r\n\n b\n  "))) == ["a", "b"]


def test_default_hashes(spark):
    s = hashing.default_settings()
    got = {st: one(spark, hashing.settings_hash(s, st)) for st in hashing.STAGES}
    assert got == {
        "render": "b9cab1f56924f485",
        "preprocess": "6f084f42be0b9835",
        "detect": "580bd95fc8f76d55",
        "ocr": "44f32087e6ebf40a",
        "build": "97dcc120c9954dc0",
    }


def test_normalise(spark):
    assert one(spark, text.normalise_report(udfs.nfkc(F.lit("  “Ａ”—‘b’\n c ")))) == "\"a\"-'b' c"
    assert one(spark, text.normalise_line(F.lit("Été, 3-4!\r\nx"))) == "été 3 4 x"


@pytest.mark.parametrize("e,a,rate,miss", [("abcd", "abxd", 0.25, 0.25), ("", "x", 0.0, 1.0), ("", "", 0.0, 0.0), ("ab", "abcdef", 2.0, 2.0)])
def test_error_rate(spark, e, a, rate, miss):
    assert one(spark, text.error_rate(F.lit(e), F.lit(a))) == rate
    assert one(spark, text.error_rate(F.lit(e), F.lit(a), True)) == miss


def test_escape(spark):
    assert one(spark, text.xml_escape(F.lit("<a & \"b\" 'c'>"))) == "&lt;a &amp; &quot;b&quot; 'c'&gt;"
    assert one(spark, text.xml_escape(F.lit("'"), True)) == "&apos;"


@pytest.mark.parametrize("n,a,b,c", [(0, "0 B", "0 B", "0 B"), (1023, "1023 B", "1023 B", "1023 B"), (1536, "1.5 KB", "2 KB", "1.5 KB"), (5 << 20, "5.0 MB", "5.0 MB", "5.0 MB"), (3 << 30, "3072.0 MB", "3072.0 MB", "3.0 GB")])
def test_format_bytes(spark, n, a, b, c):
    v = F.lit(n)
    assert one(spark, text.format_bytes(v)) == a
    assert one(spark, text.format_bytes_whole(v)) == b
    assert one(spark, text.format_bytes_scaled(v)) == c


def test_bar_and_percent(spark):
    assert one(spark, text.bar(F.lit(0.5))) == "█" * 12 + "░" * 12
    assert one(spark, text.bar(F.lit(-3.0))) == "░" * 24
    assert one(spark, text.percent(F.lit(0.8125))) == "81.3%"
    assert one(spark, text.truncate(F.lit("x" * 80))) == "x" * 71 + "…"


def test_languages(spark):
    assert one(spark, languages.parse_languages(F.lit("eng + deu+"))) == ["eng", "deu"]
    assert one(spark, languages.join_languages(F.array(*map(F.lit, ("deu", "", "eng", "deu"))))) == "deu+eng"
    assert one(spark, languages.model_path(F.lit("eng+eng"), "r"))["gzip"] is False
    assert one(spark, languages.model_url(F.lit("deu"), "r/")) == "r/deu.traineddata.gz"
    assert languages.languages(spark).count() == 22


def test_secrets(spark):
    key = udfs.derive_key("pass", b"0123456789abcdef", 1000)
    wrapped = udfs.wrap_secret(F.lit("hush"), key)
    assert one(spark, udfs.unwrap_secret(wrapped, key)) == "hush"
    assert one(spark, udfs.unwrap_secret(wrapped, udfs.derive_key("wrong", b"0123456789abcdef", 1000))) is None


def test_filename_and_joins(spark):
    assert one(spark, text.safe_filename(F.lit("a b/ç.pdf"))) == "a_b_.pdf"
    assert one(spark, text.safe_filename(F.lit(""))) == "output"
    assert one(spark, text.join_growing(F.array(*map(F.lit, ("", "a", "", "b"))))) == "a\n\nb"
    assert one(spark, text.data_url(F.lit("image/png"), F.lit(b"ab"))) == "data:image/png;base64,YWI="
    assert one(spark, let(F.lit(2), lambda v: v * v + v)) == 6
