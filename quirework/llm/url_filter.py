"""URL filters by empirical-Bayes host reputation, below fixed rules.

Labelled page outcomes are summed for each host. Rates are shrunk down the
hierarchy suffix, registered domain, host: at each level a beta prior stands at
the parent's posterior mean, its strength estimated from the spread of the
level's rates by the method of moments for the beta-binomial. A host is blocked
if the lower bound of its posterior, mean - z sd, is over the threshold; hosts
without labels inherit the posterior of their domain or suffix.

Outcomes are summed within each partition before any shuffle. What reaches the
driver is four sums for each level.

Defined results: a null url, or one without ``://``, has an empty host and
path, which no rule fits; such urls share one empty host. Null outcomes are
ignored. A null page id is kept. Repeated rows count and are returned each.
Without any outcome the prior is uniform, and nothing is blocked by it at
thresholds of 0.5 or more. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import col, durable

THRESHOLD = 0.25
Z = 1.645
STRENGTH = (1.0, 10000.0)  # least and largest strength of a prior, in pages

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the contract, and two-label suffixes under which names are registered.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
TWO_LABEL_SUFFIXES = (
    "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br",
    "com.cn", "com.mx", "com.tr", "com.tw", "edu.au", "gov.au", "gov.uk", "ne.jp", "net.au", "or.jp",
    "org.au", "org.nz", "org.uk",
)


def host_of(url: Column) -> Column:
    before = F.when(url.contains("://"), F.substring_index(url, "://", 1))
    host = F.regexp_extract(F.substr(url, F.length(before) + 4), "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    before = F.when(url.contains("://"), F.substring_index(url, "://", 1))
    path = F.regexp_extract(F.substr(url, F.length(before) + 4), "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(path, F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    name = verdict = F.lit(None).cast("string")
    for act, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p).otherwise(name)
        verdict = F.when(fits, act).otherwise(verdict)
    return name, verdict


def _strength(rates: DataFrame) -> float:
    """Prior strength from (n, bad, mu): the method of moments over a level's groups."""
    mu, n = F.col("mu"), F.col("n").cast("double")
    r = F.col("bad") / n
    row = rates.agg(
        F.sum(n * (r - mu) * (r - mu)).alias("s"),
        F.sum(mu * (1 - mu)).alias("e"),
        F.sum(mu * (1 - mu) * (n - 1)).alias("d"),
    ).first()
    if not row["d"]:
        return STRENGTH[1]
    rho = (row["s"] - row["e"]) / row["d"]
    return STRENGTH[1] if rho <= 0 else min(STRENGTH[1], max(STRENGTH[0], 1 / rho - 1))


def reputation(outcomes: DataFrame) -> DataFrame:
    """Posteriors at every level: (level, key, mean, weight), level 0 (all), 1 (suffix), 2 (domain), 3 (host).

    ``outcomes`` has the columns host and bad (0 or 1).
    """
    hosts = durable(
        outcomes.where(F.col("bad").isNotNull())
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
        .withColumn("suffix", suffix_of(F.col("host")))
        .withColumn("domain", domain_of(F.col("host")))
    )
    all_n, all_bad = hosts.agg(F.sum("n"), F.sum("bad")).first()
    all_n, all_bad = all_n or 0, all_bad or 0
    base = (all_bad + 1.0) / (all_n + 2.0)
    spark = outcomes.sparkSession
    levels = [spark.createDataFrame([(0, "", base, all_n + 2.0)], "level int, key string, mean double, weight double")]
    parents = None
    for level, (key, parent) in enumerate((("suffix", None), ("domain", "suffix"), ("host", "domain")), 1):
        sums = hosts.groupBy(key, *([parent] if parent else [])).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
        if parents is None:
            rates = sums.withColumn("mu", F.lit(base))
        else:
            rates = sums.join(parents.select(F.col("key").alias(parent), F.col("mean").alias("mu")), parent)
        rates = durable(rates)
        m = _strength(rates)
        parents = rates.select(
            F.lit(level).alias("level"),
            F.col(key).alias("key"),
            ((m * F.col("mu") + F.col("bad")) / (m + F.col("n"))).alias("mean"),
            (m + F.col("n")).cast("double").alias("weight"),
        )
        levels.append(parents)
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return durable(out)


def lower_bound(mean: Column, weight: Column, z: float = Z) -> Column:
    """mean - z sd of a beta posterior with that mean and a + b = weight."""
    return mean - z * F.sqrt(mean * (1 - mean) / (weight + 1))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    rules=RULES,
    threshold: float = THRESHOLD,
    z: float = Z,
) -> DataFrame:
    """(id, host, path, rule, verdict) for each row of ``pages``; ``outcomes``: (host, bad)."""
    post = reputation(outcomes)
    url = col(url_col).cast("string")
    seen = pages.select(col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    base = post.where("level = 0").select("mean", "weight").first()
    # one row for each host, however many pages it has; its own posterior, else the nearest above
    hosts = seen.select("host").distinct().withColumn("suffix", suffix_of(F.col("host"))).withColumn("domain", domain_of(F.col("host")))
    for level, key in ((1, "suffix"), (2, "domain"), (3, "host")):
        of = post.where(F.col("level") == level).select(F.col("key").alias(key), F.struct("mean", "weight").alias(f"p{level}"))
        hosts = hosts.join(of, key, "left")
    top = F.struct(F.lit(base["mean"]).alias("mean"), F.lit(base["weight"]).alias("weight"))
    p = F.coalesce("p3", "p2", "p1", top)
    # written once: the join below then is one of two tables, which Spark can split where one host has many pages
    blocked = durable(hosts.select("host", (lower_bound(p["mean"], p["weight"], z) > threshold).alias("blocked")))
    rule, act = fitting_rule(F.col("host"), F.col("path"), rules)
    return seen.join(blocked, "host").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(act, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
    )
