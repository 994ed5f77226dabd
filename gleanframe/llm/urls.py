"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule covers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.order_stats import attach_unique
from .common import lower_ascii, stored


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


FEATURES = ("url_length", "host_length", "path_length", "host_labels", "depth", "digit_ratio", "symbol_ratio", "entropy",
            "parameters", "has_fragment", "digits_in_host", "hyphens_in_host", "suffix_odds", "domain_odds", "path_odds")
#: Statistics by name: the column and the part of it they are counted for.
STATISTICS = {"suffix_odds": ("host", r"[^.]*$"), "domain_odds": ("host", r"[^.]*\.?[^.]*$"), "path_odds": ("path", r"^/[^/]*")}
FOLDS = 5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty for null and without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    return lower_ascii(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def lexical_features(df: DataFrame, url: str = "url") -> DataFrame:
    """Length, depth, digit ratio, entropy, parameter count and the like, all built-in expressions; null url: zeros."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    signs = F.array_distinct(F.split(u, ""))
    entropy = F.aggregate(F.transform(signs, lambda s: (F.length(u) - F.length(F.replace(u, s, F.lit("")))) / n),
                          F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    host, path = F.col("host"), F.col("path")
    return df.withColumns({
        "url_length": F.length(u).cast("double"), "host_length": F.length(host).cast("double"),
        "path_length": F.length(path).cast("double"), "host_labels": count(host, r"[^.]+"),
        "depth": count(path, r"[^/]+"), "digit_ratio": count(u, "[0-9]") / n, "symbol_ratio": count(u, "[^A-Za-z0-9]") / n,
        "entropy": entropy, "parameters": count(F.regexp_extract(u, r"\?([^#]*)", 1), "[^&]+"),
        "has_fragment": F.contains(u, F.lit("#")).cast("double"), "digits_in_host": count(host, "[0-9]"),
        "hyphens_in_host": count(host, "-")})


def suffix_statistics(df: DataFrame, label: str, few: int = 10_000, fold: Column | None = None) -> DataFrame:
    """Smoothed log odds of the label per host suffix (last label, last two labels), over all labelled rows; and per
    first part of the path where there is a path.

    Every suffix has its own odds; one without labelled rows has 0.  With a ``fold`` (0 to FOLDS - 1), the odds of a
    labelled row come from the other folds, so that trees cannot read a row's label from them.  Up to ``few`` suffixes
    are sent to all tasks; of more, only those with over 1/``few`` of all rows are, and the others meet their rows by a shuffle.
    """
    keys = {name: f"_{name}" for name, (source, _) in STATISTICS.items() if source in df.columns}
    left_out = F.lit(FOLDS) if fold is None else F.when(F.col(label).isNotNull(), fold).otherwise(FOLDS)
    placed = df.withColumns({**{key: F.regexp_extract(*STATISTICS[name], 0) for name, key in keys.items()}, "_fold": left_out})
    pairs = placed.select(F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(key).alias("key")) for name, key in keys.items()])).alias("_pair"),
                          F.col(label).alias("_seen"), "_fold")

    def odds_without(f: int) -> Column:
        seen = F.when(F.col("_fold") != f, F.col("_seen")) if f < FOLDS else F.col("_seen")
        blocks = F.coalesce(F.sum(seen), F.lit(0))
        return F.log((blocks + 1.0) / (F.count(seen) - blocks + 1.0))

    odds = stored(pairs.groupBy("_pair.name", "_pair.key").agg(
        F.array(*[odds_without(f) for f in range(FOLDS + 1)]).alias("odds"), F.count("*").alias("_rows")), "suffixes")
    numbers = {r["name"]: r["count"] for r in odds.groupBy("name").count().collect()}
    for name, key in keys.items():
        own = odds.where(F.col("name") == name).select(F.col("key").alias(key), F.col("odds").alias(name), "_rows")
        if numbers.get(name, 0) <= few:
            placed = placed.join(F.broadcast(own.drop("_rows")), key)
        else:
            placed = attach_unique(stored(placed, "hosts"), own, [key], "_rows", [name], few)
    own = {name: F.get(name, F.col("_fold")) for name in keys}
    return placed.withColumns(own).drop(*keys.values(), "_fold")


def train(labelled: DataFrame, label: str, key: Sequence[str], bound: int = 10_000, trees: int = 20, depth: int = 4,
          seed: int = 7) -> object | None:
    """Boosted trees on at most ``bound`` rows of each class, taken in hash order; None unless both classes occur."""
    from pyspark.ml.classification import GBTClassifier      # here, as it loads pandas, which other operators do without
    from pyspark.ml.feature import VectorAssembler

    parts = [labelled.where(F.col(label) == v).orderBy(F.xxhash64(*key), *key).limit(bound) for v in (0, 1)]
    sample = stored(parts[0].unionAll(parts[1]).select(*FEATURES, F.col(label).cast("double").alias("label")).coalesce(4), "urls")
    if sample.select("label").distinct().count() < 2:
        return None
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample).select("features", "label")
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, maxBins=32, seed=seed).fit(ready)


def block_probabilities(rows: DataFrame, label: str, url: str, bound: int = 10_000, few: int = 10_000) -> DataFrame:
    """``rows`` (with host and path) and ``block_probability`` of every row, learnt from those with a label (0, 1 or null).

    Equal urls are in one fold, and a labelled row's suffix odds leave its fold's labels out.
    """
    fold = F.pmod(F.xxhash64(F.col(url), F.lit("fold")), F.lit(FOLDS)).cast("int")
    ready = suffix_statistics(lexical_features(rows, url), label, few, fold)
    labelled = ready.where(F.col(label).isNotNull())
    model = train(labelled, label, (url,), bound)
    if model is None:
        blocks = labelled.agg(F.max(label)).first()[0] or 0
        return ready.withColumn("block_probability", F.lit(float(blocks)))
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(ready)
    return (model.setFeaturesCol("_features").transform(vector)
            .withColumn("block_probability", vector_to_array("probability")[1])
            .drop("_features", "rawPrediction", "probability", "prediction"))


def judge_urls(df: DataFrame, rules: Sequence[Rule], url: str = "url", bound: int = 10_000, few: int = 10_000) -> DataFrame:
    """``df`` with host, path, rule, verdict (allow or block) and ``block_probability``.

    Where a rule fits, the longest one decides.  Rows that a rule covers are the labelled ones: from them suffix
    statistics are counted (all rows, every suffix) and boosted trees are fitted (at most ``bound`` rows of each class); the trees
    judge the rest.  Null and empty urls have an empty host and path and are judged by their features like others;
    with one class only among the labelled rows that class is the verdict, without labelled rows it is allow.
    Repeated rows are judged each by itself; an empty table gives no rows; columns called like a result are replaced,
    all others are kept whatever their names.
    """
    kept = {f"_kept_{i}": c for i, c in enumerate(df.columns) if c not in ("host", "path", "rule", "verdict", "block_probability")}
    placed = (df.select(F.col(f"`{url}`").alias("_url"), *[F.col(f"`{c}`").alias(k) for k, c in kept.items()])
              .withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))}))
    text, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    named = placed.withColumns({"rule": text, "_verdict": verdict}).withColumn("_label", (F.col("_verdict") == "block").cast("int"))
    scored = block_probabilities(named, "_label", "_url", bound, few)
    decided = F.coalesce("_verdict", F.when(F.col("block_probability") > 0.5, "block").otherwise("allow"))
    return scored.withColumn("verdict", decided).select(
        *[F.col(k).alias(c) for k, c in kept.items()], "host", "path", "rule", "verdict", "block_probability")
