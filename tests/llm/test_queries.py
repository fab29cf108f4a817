"""Registered queries against their SQL, over whole small tables."""

import pytest

from oracle import SF, check
from quirework.llm import queries as Q

SQL = Q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    check(spark, name, Q.queries()[name], SQL[name])


def test_entry_lists_all():
    import __spark_entry__ as e

    names = e.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)}
    assert "pipeline" in names


def test_url_rules_and_edges(spark):
    from quirework.llm import url_filter as U

    urls = [None, "no scheme", "http://EXAMPLE.org", "HTTP://a.Example.ORG/es/1?x", "x://example.org/en/12#f", "x://example.org/en/2", "s://b.com/fr/1", "s://com/de/1", "s://badexample.org/es/1", "a://h?q", "a://h#f/x", "a://u:p@h:8/p;x?y"]
    pages = spark.createDataFrame([(k, u, "x", k) for k, u in enumerate(urls)], "page_id long, url string, host string, mean long")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, spark.createDataFrame([], "host string, bad int")).collect()}
    assert got == {
        # without outcomes the prior's lower bound, 0.5 - 1.645 x 0.289, is under the threshold
        0: ("", "", None, "allow"),
        1: ("", "", None, "allow"),
        2: ("example.org", "", None, "allow"),
        3: ("a.example.org", "/es/1", "example.org/es/", "block"),
        4: ("example.org", "/en/12", "example.org/en/1", "block"),
        5: ("example.org", "/en/2", "org/", "allow"),
        6: ("b.com", "/fr/1", "com/fr/", "allow"),
        7: ("com", "/de/1", "com/de/", "block"),
        8: ("badexample.org", "/es/1", "org/", "allow"),
        9: ("h", "", None, "allow"),
        10: ("h", "", None, "allow"),
        11: ("u:p@h:8", "/p;x", None, "allow"),
    }
    assert U.judge(pages.limit(0), spark.createDataFrame([], "host string, bad int")).count() == 0


def test_bad_hosts_are_blocked_and_new_ones_inherit(spark):
    from quirework.llm import url_filter as U

    rows = [("bad.evil.net", 1)] * 60 + [("worse.evil.net", 1)] * 40 + [(f"h{k}.fine.net", int(j == 0)) for k in range(30) for j in range(20)] + [(None, 1), ("h1.fine.net", None)]
    out = spark.createDataFrame(rows, "host string, bad int")
    pages = spark.createDataFrame([(1, "a://bad.evil.net/x"), (2, "a://h3.fine.net/x"), (3, "a://new.evil.net/"), (4, "a://new.fine.net/")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.judge(pages, out).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "allow"}


def test_null_labels_are_no_outcome(spark, tmp_path):
    """Pages and labels with nulls, repeated rows and a null id, against the SQL."""
    from oracle import rows_of, rows_of_sql

    import duckdb

    pages = spark.createDataFrame(
        [(k, f"http://h{k % 3}.net/en/{k % 11}", "x") for k in range(40)] + [(None, "http://h0.net/en/1", None), (3, None, None), (3, None, None), (50, "plain", "")],
        "page_id long, url string, html string",
    )
    labels = spark.createDataFrame(
        [(0, None, None), (1, 0, None), (2, None, 1), (3, 1, None), (4, None, 0), (5, 1, 0), (5, 1, 0), (None, 0, 1), (6, 0, 1), (7, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
    outcomes = Q.page_outcomes(pages, labels).groupBy("bad").count().collect()
    assert {r.bad for r in outcomes} == {None, 0, 1}
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = Q.op7_url_filter(spark, str(tmp_path))
    assert rows_of(got) == rows_of_sql(con, SQL["op7_url_filter"])[1]


def test_suffixes(spark):
    from pyspark.sql import functions as F

    from quirework.llm import url_filter as U

    df = spark.createDataFrame([("a.b.co.uk",), ("b.com",), ("localhost",), ("",)], "h string")
    got = [tuple(r) for r in df.select(U.domain_of(F.col("h")), U.suffix_of(F.col("h"))).collect()]
    assert got == [("b.co.uk", "co.uk"), ("b.com", "com"), ("localhost", "localhost"), ("", "")]


def test_whole_tables_are_read(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op1_sharding", "op3_toxicity", "op10_token_counts"):
        assert Q.queries()[name](spark, SF).count() == n
