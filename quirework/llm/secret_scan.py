"""Secret scans over an incremental blob ledger, with built-in functions only.

Every version of every path is addressed by the SHA-256 of its content. The
ledger holds one row for each (blob, rule version) that has been scanned, with
its findings, empty ones too. A run scans only the pairs that the ledger lacks,
each blob once however many paths have it, adds them to the ledger, and joins
the findings back to all paths.

A rule is a pattern, of which all leftmost non-overlapping matches are found,
and the least length of one of its groups; matches that fail it are dropped.
Offsets count code points, ends are exclusive.

Texts move once, for the pick of one row for each blob; a digest that many rows
share is reduced within each partition first. Offsets come from the lengths of
the matches and of the pieces between them, as running sums over one row for
each piece, so a text with very many matches costs no more than its length.

Defined results: a null text is the empty one. Null path columns are kept.
Repeated rows each get their findings. An empty table gives an empty result.
Columns other than the path's and the text are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import col, durable, path_exists


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int
    least: int


# The base rules, in the order in which kinds are listed.
BASE_RULES = (
    Rule(
        "assign",
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    # a run of the class is taken whole, so the least length can stand in the pattern
    Rule("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)

_FOUND = "array<struct<start:bigint,kind_no:int,end:bigint>>"
LEDGER = f"blob string, rule_version string, findings {_FOUND}"


def rule_version(rules: tuple[Rule, ...]) -> str:
    """Changes with any rule, so a changed rule set is scanned anew."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def _blob(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _pieces(text: Column, rule: Rule, number: int) -> Column:
    """(kind_no, i, gap, length, ok) of every match, null where there is none."""
    pattern = F.lit(rule.pattern)
    gaps = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    made = F.transform(
        F.arrays_zip(
            F.transform(gaps, F.length).alias("gap"),
            F.transform(whole, F.length).alias("len"),
            F.transform(part, F.length).alias("part"),
        ),
        lambda x, i: F.struct(
            F.lit(number).alias("kind_no"),
            i.alias("i"),
            x["gap"].cast("long").alias("gap"),
            x["len"].cast("long").alias("len"),
            (x["part"] >= rule.least).alias("ok"),
        ),
    )
    return F.when(text.rlike(rule.pattern), made)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """(blob, findings) for each row of ``blobs`` (blob, text); blobs must be distinct."""
    empty = F.array().cast("array<struct<kind_no:int,i:int,gap:bigint,len:bigint,ok:boolean>>")
    pieces = F.concat(*(F.coalesce(_pieces(F.col("text"), r, k), empty) for k, r in enumerate(rules)))
    cut = durable(blobs.select("blob", pieces.alias("pieces")))
    upto = Window.partitionBy("blob", "kind_no").orderBy("i")
    spans = (
        cut.where(F.size("pieces") > 0)
        .select("blob", F.inline("pieces"))
        .withColumn("end", F.sum(F.col("gap") + F.coalesce("len", F.lit(0))).over(upto))
        .where("ok")
        .select("blob", F.struct((F.col("end") - F.col("len")).alias("start"), "kind_no", "end").alias("f"))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_list("f")).cast(_FOUND).alias("findings"))
    )
    none = F.array().cast(_FOUND)
    return cut.select("blob").join(spans, "blob", "left").select("blob", F.coalesce("findings", none).alias("findings"))


def scan(
    versions: DataFrame,
    *,
    path_cols: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    rules: tuple[Rule, ...] = BASE_RULES,
    ledger_dir: str | None = None,
) -> DataFrame:
    """(path columns, blob, findings) for each row of ``versions``.

    ``ledger_dir`` is a table in storage that later runs read and add to; with
    None the ledger lives as long as the session. findings is an array of
    (start, kind_no, end) by start, then by the order of ``rules``.
    """
    spark = versions.sparkSession
    version = rule_version(rules)
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    blobs = versions.select(_blob(text).alias("blob"), text.alias("text"))
    known = None
    if ledger_dir and path_exists(spark, ledger_dir):
        known = spark.read.schema(LEDGER).parquet(ledger_dir).where(F.col("rule_version") == version)
        blobs = blobs.join(known.select("blob").distinct(), "blob", "left_anti")
    new = scan_blobs(blobs.dropDuplicates(["blob"]), rules).select("blob", F.lit(version).alias("rule_version"), "findings")
    if ledger_dir:
        new.write.mode("append").parquet(ledger_dir)
        ledger = spark.read.schema(LEDGER).parquet(ledger_dir).where(F.col("rule_version") == version).dropDuplicates(["blob"])
    else:
        ledger = durable(new)  # the join below then is one of two tables, which Spark can split where one blob has many paths
    paths = versions.select(*(col(c) for c in path_cols), _blob(text).alias(blob := _free("blob", path_cols)))
    out = _free("findings", path_cols)
    ledger = ledger.select(F.col("blob").alias(blob), F.col("findings").alias(out))
    return paths.join(ledger, blob).select(*(col(c) for c in path_cols), blob, out)


def _free(stem: str, taken: tuple[str, ...]) -> str:
    while stem.lower() in {t.lower() for t in taken}:
        stem += "_"
    return stem


def written(findings: Column, rules: tuple[Rule, ...] = BASE_RULES) -> Column:
    """findings as kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(
        F.transform(
            findings,
            lambda f: F.concat_ws(":", F.get(kinds, f["kind_no"]), f["start"].cast("string"), f["end"].cast("string")),
        ),
        ",",
    )


def count_of(findings: Column, kind_no: int) -> Column:
    return F.size(F.filter(findings, lambda f: f["kind_no"] == kind_no)).cast("long")
