"""Text functions with JavaScript's semantics, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that JavaScript's \s and trim() take as white space.
WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NOT_WS = "[^" + WS[1:]
TRIM = rf"^{WS}+|{WS}+\z"
_SPACES = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_OTHER_SPACES = _SPACES.replace(" ", "")


def js_round(v: Column) -> Column:
    """Half toward positive infinity."""
    return F.floor(v + 0.5)


def round_to(v: Column, places: int) -> Column:
    factor = float(10**places)
    return F.floor(v * factor + 0.5) / factor


def js_trim(s: Column) -> Column:
    return F.btrim(s, F.lit(_SPACES))


def split_lines(s: Column) -> Column:
    """Lines without surrounding white space; empty ones are dropped."""
    return F.filter(F.transform(F.split(s, "\r?\n"), js_trim), lambda x: x != "")


def split_words(s: Column) -> Column:
    return F.filter(F.split(F.translate(s, _OTHER_SPACES, " " * len(_OTHER_SPACES)), " "), lambda x: x != "")


def normalise_report(s: Column) -> Column:
    """For whole-page reports: straight quotes and dashes, single spaces, lower case (after NFKC, see udfs.nfkc)."""
    return F.lower(normalise_spaces(_plain_marks(s)))


def _plain_marks(s: Column) -> Column:
    return F.translate(s, "‘’“”—–", "''\"\"--")


def report_tokens(s: Column) -> Column:
    """The tokens of ``normalise_report(s)``, on which white space has no bearing."""
    return tokens_report(F.lower(_plain_marks(s)))


def normalise_line(s: Column) -> Column:
    """For line matching: lower case, letters and digits only, single spaces."""
    s = F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}\n ]+", " ")
    return js_trim(F.regexp_replace(s, WS + "+", " "))


def normalise_spaces(s: Column) -> Column:
    spaced = F.translate(s, _OTHER_SPACES, " " * len(_OTHER_SPACES))
    return F.btrim(F.regexp_replace(spaced, "  +", " "), F.lit(" "))


def tokens_report(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("[a-z0-9']+"), F.lit(0))


def tokens_line(s: Column) -> Column:
    return F.filter(F.split(s, " "), lambda x: x != "")


def xml_escape(s: Column, apostrophe: bool = False) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), *((("'", "&apos;"),) if apostrophe else ())):
        s = F.replace(s, F.lit(raw), F.lit(name))
    return s


def safe_filename(name: Column) -> Column:
    cleaned = F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "_")
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("output"))


def format_bytes(n: Column) -> Column:
    """B below 1 KB, then KB and MB with one decimal."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / 1024.0), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", n / 1048576.0), F.lit(" MB")))
    )


def format_bytes_whole(n: Column) -> Column:
    """B, whole KB, MB with one decimal."""
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(js_round(n / 1024.0).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", n / 1048576.0), F.lit(" MB")))
    )


def format_bytes_scaled(n: Column) -> Column:
    """The unit by the logarithm, of four; one decimal beyond bytes."""
    unit = F.least(F.lit(3), F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(1024.0)) + 1e-12)).cast("int")
    value = n / F.pow(F.lit(1024.0), unit)
    shown = F.when(unit == 0, n.cast("string")).otherwise(F.format_string("%.1f", value))
    return F.when(n <= 0, "0 B").otherwise(F.concat_ws(" ", shown, F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), unit + 1)))


def truncate(s: Column, most: int = 72) -> Column:
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 1), F.lit("…"))).otherwise(s)


def percent(v: Column) -> Column:
    return F.format_string("%.1f%%", v * 100)


def bar(v: Column, width: int = 24) -> Column:
    filled = F.greatest(F.lit(0), F.least(F.lit(width), js_round(v * width))).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def error_rate(expected: Column, actual: Column, empty_is_miss: bool = False) -> Column:
    """Character error rate of normalised texts; of an empty expectation 0, or with ``empty_is_miss`` 1 if there is text."""
    n = F.length(expected)
    none = F.when(F.length(actual) > 0, 1.0).otherwise(0.0) if empty_is_miss else F.lit(0.0)
    return F.when(n > 0, F.levenshtein(expected, actual) / n).otherwise(none)


def data_url(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


def join_growing(lines: Column) -> Column:
    """Lines joined by newlines while leading empty ones vanish, as a text that is replaced while it is still empty."""
    first = F.array_position(F.transform(lines, lambda x: x != ""), True).cast("int")
    return F.when(first > 0, F.array_join(F.slice(lines, F.greatest(first, F.lit(1)), F.size(lines)), "\n")).otherwise("")
