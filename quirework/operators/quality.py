"""How close recognised text is to what was expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.text import bar, error_rate, normalise_line, percent, round_to, tokens_line, truncate

WINDOW = 8


def overlap_metrics(matched: Column, n_expected: Column, n_actual: Column) -> Column:
    precision = F.when(n_actual > 0, matched / n_actual).otherwise(0.0)
    recall = F.when(n_expected > 0, matched / n_expected).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return F.struct(round_to(precision, 4).alias("precision"), round_to(recall, 4).alias("recall"), round_to(f1, 4).alias("f1"))


def token_overlap(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Multiset overlap of the token arrays ``expected`` and ``actual`` of each row, counted within the row.

    Each token that both sides have is counted in both; without a shuffle, at
    the cost of the tokens in common times the tokens of the row.
    """
    times = lambda side, t: F.size(side) - F.size(F.call_function("array_remove", F.col(side), t))
    common = F.transform(F.array_intersect("expected", "actual"), lambda t: F.least(times("expected", t), times("actual", t)))
    rows = pairs.select(
        *key,
        F.aggregate(common, F.lit(0), lambda a, n: a + n).cast("long").alias("matched"),
        F.size("expected").cast("long").alias("expected_words"),
        F.size("actual").cast("long").alias("actual_words"),
    )
    m = overlap_metrics(F.col("matched"), F.col("expected_words"), F.col("actual_words"))
    return rows.withColumn("m", m).select(*key, "matched", "expected_words", "actual_words", "m.*")


def write_report(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A quality report as JSON, a line for each row; nulls are written, so that every row has every field."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def accuracy(expected: Column, actual: Column) -> Column:
    """Character accuracy of normalised lines; with nothing expected, 1 if there is nothing and else 0."""
    return 1 - error_rate(expected, actual, empty_is_miss=True)


def align_lines(expected: Column, actual: Column) -> Column:
    """Index into ``expected`` of the line that each actual line stands for.

    A cursor moves down the expected lines; each actual line takes the best of
    the next WINDOW, the first of equals, and the cursor goes behind it. Past
    the end the last line is taken; -1 if none is expected. Both are arrays of
    plain lines.
    """

    def found(ex: Column, ac: Column) -> Column:
        def step(acc: Column, line: Column) -> Column:
            at = acc["at"]

            def best(scores: Column) -> Column:
                return at + F.array_position(scores, F.array_max(scores)).cast("int") - 1

            near = F.transform(F.slice(ex, at + 1, WINDOW), lambda e: accuracy(e, line))
            index = F.when(at < F.size(ex), let(near, best)).otherwise(F.size(ex) - 1)
            return let(index, lambda i: F.struct(F.when(i >= 0, i + 1).otherwise(at).alias("at"), F.concat(acc["out"], F.array(i)).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(ac, start, step)["out"]

    return let(F.transform(expected, normalise_line), lambda ex: let(F.transform(actual, normalise_line), lambda ac: found(ex, ac)))


def representative_lines(lines: DataFrame, page: list[str], limit: int = 16) -> DataFrame:
    """At most ``limit`` lines of each page: its first five, its eight worst, its eight least sure, each once, in that order; then by index.

    ``lines``: index, accuracy, confidence.
    """
    by = lambda *o: F.row_number().over(Window.partitionBy(*page).orderBy(*o))
    first, worst, unsure = by("index"), by("accuracy", "index"), by("confidence", "index")
    rows = lines.withColumn("r1", first).withColumn("r2", worst).withColumn("r3", unsure)
    order = F.when(F.col("r1") <= 5, F.col("r1")).when(F.col("r2") <= 8, 100 + F.col("r2")).when(F.col("r3") <= 8, 200 + F.col("r3"))
    rows = rows.withColumn("o", order).where(F.col("o").isNotNull()).withColumn("pick", by("o"))
    return rows.where(F.col("pick") <= limit).select(*page, "index", "accuracy", "confidence")


def ranked_providers(results: DataFrame) -> DataFrame:
    """Providers by accuracy, those with an error last; (provider, accuracy, error) with rank and a report line."""
    # one row for each provider; the catalogue is small
    order = Window.orderBy(F.when(F.col("error").isNull(), F.col("accuracy")).desc_nulls_last(), "provider")
    line = F.when(
        F.col("error").isNull(), F.concat(F.rpad("provider", 24, " "), F.rpad(percent(F.col("accuracy")), 12, " "), bar(F.col("accuracy")))
    ).otherwise(F.concat(F.rpad("provider", 24, " "), F.lit("error    "), F.col("error")))
    return results.withColumn("rank", F.row_number().over(order)).withColumn("line", line)


def worst_line_report(index: Column, score: Column, confidence: Column, actual: Column, expected: Column) -> Column:
    return F.concat(
        F.lit("- line "), F.lpad((index + 1).cast("string"), 2, "0"), F.lit(": "), percent(score), F.lit(" | conf "),
        F.format_string("%.3f", confidence), F.lit(' | actual="'), truncate(actual), F.lit('" | expected="'), truncate(expected), F.lit('"'),
    )


def line_tokens(text: Column) -> Column:
    return tokens_line(normalise_line(text))
