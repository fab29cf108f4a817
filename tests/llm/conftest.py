import pytest

CLASHES = "id long, digest string, fp string, size string, `group` string, n string, kept string, qw_keep string, qw_digest string, `bin` string, url string, host string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty, blank and long texts, ties and repeated rows."""
    long = " ".join(f"word{k % 977}" for k in range(30_000))
    return [
        (1, "a b c d e f", "en", "s0", 11),
        (2, "a b c d e f", "en", "s0", 11),
        (2, "a b c d e f", "en", "s0", 11),
        (7, None, None, None, None),
        (8, "", "en", "s1", 0),
        (9, " \n\t ", "en", "s1", 4),
        (None, "no id here", None, "s0", 10),
        (None, "no id here", None, "s0", 10),
        (None, None, None, None, None),
        (12, long, "en", "s0", len(long)),
        (13, long + " tail", "en", "s0", len(long) + 5),
        (14, "Größe ñandú 漢字 🙂 tail", "xx", None, 20),
        (15, "x" * 5000, "en", "s2", 5000),
        (15, "x" * 5000, "en", "s2", 5000),
        (-3, "negative", "en", "s2", 8),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with columns whose names clash with the operators' own."""
    rows = [(*r, *([k] + ["x"] * 11)) for k, r in enumerate(odd_rows)]
    return spark.createDataFrame(rows, f"{DOCS}, {CLASHES}").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
