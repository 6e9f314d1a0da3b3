"""URL filters: rules first, then gradient-boosted trees on lexical features.

The trees learn from labelled URLs, by default those that a rule decides, on the length, depth, digit
ratio, character entropy, number of parameters and the statistics of the host's suffix.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risewatch.llm.common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"://([^/?#]*)([^?#]*)"
FEATURES = ["length", "depth", "digits", "entropy", "parameters", "labels", "suffix_rate"]


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, from a path on."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """Add host (A-Z in lower case) and path; both empty where the url is null or has no `://`."""
    url = F.coalesce("url", F.lit(""))
    return pages.withColumns({
        "host": F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER),
        "path": F.regexp_extract(url, _PARTS, 2),
    })


def rule_of(rules: Sequence[Rule], what: str) -> Column:
    """`what` (name or verdict) of the longest rule that fits, null without one."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # the longest is asked first
        host = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
        found = F.when(host & F.startswith("path", F.lit(rule.path)), F.lit(getattr(rule, what))).otherwise(found)
    return found


def _lexical(rows: DataFrame) -> DataFrame:
    """The features of `url`, `host` and `path` that need no statistics, and the host's suffix."""
    url = F.coalesce("url", F.lit(""))
    length = F.length(url)
    # Characters sorted by code: runs give the counts.
    counts = F.transform(F.array_distinct(F.split("u", "")), lambda c: F.length("u") - F.length(F.replace(F.col("u"), c, F.lit(""))))
    share = lambda n: n / F.length("u")
    entropy = F.aggregate(F.filter(counts, lambda n: n > 0), F.lit(0.0), lambda s, n: s - share(n) * F.log2(share(n)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return rows.withColumn("u", url).withColumns({
        "length": length.cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
        "digits": F.when(length > 0, F.length(F.regexp_replace(url, "[^0-9]", "")) / length).otherwise(0.0),
        "entropy": F.when(length > 0, entropy).otherwise(0.0),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")).cast("double"),
        "labels": F.size(F.split("host", r"\.")).cast("double"),
        "suffix": F.substring_index("host", ".", -1),
    }).drop("u")


@dataclass(frozen=True)
class UrlModel:
    """Trees and suffix rates; without trees every URL gets the one verdict that was seen, or `allow`."""

    trees: GBTClassificationModel | None
    rates: list[tuple[str, float]]
    prior: float
    otherwise: str


def fit(labelled: DataFrame, per_class: int = 20_000, most_suffixes: int = 1000, rounds: int = 10, depth: int = 4, seed: int = 1) -> UrlModel:
    """Fit on (url, host, path, verdict).  The trees see at most about `per_class` rows of each verdict: of a
    url's copies the same share as of all rows, as one weighted row, the remainder being drawn by the hashed
    url.  The suffix statistics see all labelled rows and keep the `most_suffixes` most frequent suffixes,
    the others having the mean rate.
    """
    blocked = (F.col("verdict") == "block").cast("double")
    copies = labelled.where("verdict IN ('allow', 'block')").groupBy("url", "host", "path", "verdict").agg(F.count(F.lit(1)).alias("n"))
    rows = _lexical(stage(copies, "url-labels")).withColumn("blocked", blocked)
    seen = {r["verdict"]: r["n"] for r in rows.groupBy("verdict").agg(F.sum("n").alias("n")).collect()}
    total = sum(seen.values())
    if len(seen) < 2:
        return UrlModel(None, [], 0.5, next(iter(seen), "allow"))
    prior = seen["block"] / total
    found = rows.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("blocked")).alias("b")).orderBy(F.desc("n"), "suffix")
    rates = [(r["suffix"], (r["b"] + 10 * prior) / (r["n"] + 10)) for r in found.limit(most_suffixes).collect()]
    part = {v: min(1.0, per_class / n) for v, n in seen.items()}
    draw = F.pmod(F.xxhash64("url"), F.lit(1 << 20)) / float(1 << 20)
    due = F.col("n") * F.when(F.col("verdict") == "block", part["block"]).otherwise(part["allow"])
    weight = F.floor(due) + (draw < due - F.floor(due)).cast("int")
    sample = _assembled(rows.withColumn("weight", weight.cast("double")).where("weight > 0"), rates, prior)
    trees = GBTClassifier(
        labelCol="blocked", featuresCol="features", weightCol="weight", maxIter=rounds, maxDepth=depth, seed=seed
    ).fit(sample.select("features", "blocked", "weight"))
    return UrlModel(trees, rates, prior, "allow")


def _assembled(rows: DataFrame, rates: list[tuple[str, float]], prior: float) -> DataFrame:
    table = rows.sparkSession.createDataFrame(rates, "suffix string, rate double")
    rated = rows.join(F.broadcast(table), "suffix", "left").withColumn("suffix_rate", F.coalesce("rate", F.lit(prior))).drop("rate")
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rated)


def judge(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None, **settings) -> DataFrame:
    """Per row of (page_id, url): page_id, host, path, rule, verdict, block_score.

    A rule fits its host and all subdomains where the url's path starts with the rule's; the longest rule
    wins and its verdict stands, block_score being null.  Other urls get the trees' verdict and the
    probability of `block`.  The trees learn from `labelled` (url, verdict) or from the urls that rules
    decide; with labels of one kind only, that verdict is given, without labels `allow`.  Null urls,
    repeated rows and a null page_id are rows like others; other columns are left out.  No shuffle in the
    judging itself.
    """
    rows = with_host_and_path(pages.select("page_id", "url")).withColumns(
        {"rule": rule_of(rules, "name"), "decided": rule_of(rules, "verdict")}
    )
    if labelled is None:
        taught = rows.where("rule IS NOT NULL").select("url", "host", "path", F.col("decided").alias("verdict"))
    else:
        taught = with_host_and_path(labelled.select("url", "verdict"))
    model = fit(taught, **settings)
    if model.trees is None:
        score = F.lit(None).cast("double")
        rows = rows.withColumn("score", score)
        judged = F.lit(model.otherwise)
    else:
        rows = model.trees.transform(_assembled(_lexical(rows), model.rates, model.prior))
        rows = rows.withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
        judged = F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select(
        "page_id", "host", "path", "rule", F.coalesce("decided", judged).alias("verdict"),
        F.when(F.col("decided").isNull(), F.col("score")).alias("block_score"),
    )
