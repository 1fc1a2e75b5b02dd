"""URL filters: allow and block rules, and gradient-boosted trees for URLs that no rule decides.

All of it is DataFrame and SQL functions. The trees are grown from histograms, one small
aggregation for each level, over a bounded sample of labelled URLs; the finished model is a
CASE expression that Spark compiles into the scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlode.runtime import stored

# Fixed values of the query: (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

SAMPLE_ROWS = 20_000
"""At most about so many labelled URLs are learned from."""
TREES, DEPTH, RATE, BINS, PENALTY = 12, 3, 0.3, 16, 1.0
LEAST_WEIGHT = 0.4
"""A leaf needs so much second derivative: some three rows at first."""
FOLDS, PRIOR = 5, 2.0
"""Suffix statistics of a training row come from the other folds; they begin with so many average rows."""
SUFFIXES = {"tld_odds": "tld", "path_odds": "head", "area_odds": "area"}
FEATURES = ("url_length", "host_length", "depth", "digit_ratio", "entropy", "n_params", "n_hyphens", "n_labels", "last_number", *SUFFIXES)


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path; both are empty for a null URL or one without `://`."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    plain = F.substring(rest, F.length(host) + 1, F.length(rest))
    return pages.withColumn("host", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).withColumn("path", F.regexp_extract(plain, r"^[^?#]*", 0))


def rule_of(rules=RULES, host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does.

    A rule fits its host and all subdomains, where the path starts with the rule's path.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, slash, p = rule.partition("/")
        fits = ((F.col(host) == h) | F.col(host).endswith(f".{h}")) & F.col(path).startswith(slash + p)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, decision).otherwise(verdict)
    return name, verdict


def lexical(rows: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features (all but the suffix statistics) to rows with host and path."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    letters = F.array_distinct(F.split(u, ""))
    share = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(letters, F.lit(0.0), lambda acc, c: acc - F.when(c == "", 0.0).otherwise(share(c) * F.log2(F.greatest(share(c), F.lit(1e-9)))))
    count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    return (
        rows.withColumn("url_length", F.length(u).cast("double"))
        .withColumn("host_length", F.length("host").cast("double"))
        .withColumn("depth", count(F.col("path"), "/").cast("double"))
        .withColumn("digit_ratio", (F.length(u) - F.length(F.translate(u, "0123456789", ""))) / n)
        .withColumn("entropy", F.round(entropy, 6))
        .withColumn("n_params", (count(u, "=") + count(u, "&")).cast("double"))
        .withColumn("n_hyphens", count(u, "-").cast("double"))
        .withColumn("n_labels", count(F.col("host"), ".").cast("double"))
        .withColumn("last_number", F.coalesce(F.expr("try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) as double)"), F.lit(-1.0)))
        .withColumn("tld", F.regexp_extract("host", r"[^.]*$", 0))
        .withColumn("head", F.regexp_extract("path", r"^/[^/]*", 0))
        .withColumn("area", F.concat(F.regexp_extract("host", r"[^.]*(?:\.[^.]*)?$", 0), "head"))
    )


@dataclass
class Model:
    """odds: a table (suffix, odds) for each kind of suffix, at most SAMPLE_ROWS rows; trees: (feature, cut, left, right) or a leaf."""

    odds: dict[str, DataFrame]
    bias: float
    trees: list

    def suffix_columns(self, rows: DataFrame) -> DataFrame:
        """Adds the odds of a row's suffixes; 0 where the sample has none such."""
        for name, key in SUFFIXES.items():
            if name in self.odds:
                rows = rows.join(F.broadcast(self.odds[name].select(F.col("suffix").alias(key), F.col("odds").alias(name))), key, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
            else:
                rows = rows.withColumn(name, F.lit(0.0))
        return rows

    def margin(self, upto: int | None = None) -> Column:
        total = F.lit(self.bias)
        for tree in self.trees[:upto]:
            total = total + tree_column(tree)
        return total


def tree_column(tree) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, cut, left, right = tree
    return F.when(F.col(feature) <= cut, tree_column(left)).otherwise(tree_column(right))


def _odds(blocked: Column, n: Column, share: float) -> Column:
    """Log odds of being blocked over those of all rows, drawn to 0 where there are few."""
    return F.log((blocked + PRIOR * share) / (n - blocked + PRIOR * (1 - share))) - math.log(share / (1 - share))


def _suffix_odds(sample: DataFrame, share: float) -> tuple[dict[str, DataFrame], DataFrame]:
    """(odds by suffix from all rows, the sample with odds from the folds that a row isn't in)."""
    tables = {}
    for name, key in SUFFIXES.items():
        by_fold = stored(sample.groupBy(F.col(key).alias("suffix"), "fold").agg(F.sum("y").alias("b"), F.count("*").alias("n")), "suffixes")
        whole = stored(by_fold.groupBy("suffix").agg(F.sum("b").alias("b"), F.sum("n").alias("n")), "suffixes")
        tables[name] = whole.select("suffix", F.round(_odds(F.col("b"), F.col("n"), share), 9).alias("odds"))
        others = by_fold.alias("f").join(whole.alias("w"), "suffix").select(F.col("suffix").alias(key), "fold", F.round(_odds(F.col("w.b") - F.col("f.b"), F.col("w.n") - F.col("f.n"), share), 9).alias(name))
        sample = sample.join(F.broadcast(others), [key, "fold"])
    return tables, sample


def training(pages: DataFrame, rules=RULES) -> tuple[DataFrame, dict[str, DataFrame], float] | None:
    """(url, y and features of the sample's rows, odds by suffix, share of blocked rows); None without any labelled URL."""
    labelled = with_parts(pages.select("url")).withColumn("verdict", rule_of(rules)[1]).where("verdict is not null")
    n = labelled.count()
    if not n:
        return None
    limit = int(1_000_000 * min(1.0, SAMPLE_ROWS / n))
    chosen = labelled.where(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < limit)
    chosen = lexical(chosen).withColumn("y", (F.col("verdict") == "block").cast("double")).withColumn("fold", F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS))).drop("verdict")
    chosen = stored(chosen, "urls")
    y = chosen.agg(F.sum("y").alias("b"), F.count("*").alias("n")).first()
    # one row of each kind is added, so that neither share is 0
    share = ((y["b"] or 0.0) + 1.0) / (y["n"] + 2.0)
    tables, sample = _suffix_odds(chosen, share)
    return stored(sample.select("url", "y", *FEATURES), "urlsample"), tables, share


def cut_points(sample: DataFrame) -> dict[str, list[float]]:
    quantiles = sample.agg(*[F.percentile_approx(f, [k / BINS for k in range(1, BINS)], 10_000).alias(f) for f in FEATURES]).first()
    return {f: sorted(set(quantiles[f] or [])) for f in FEATURES}


def fit(pages: DataFrame, rules=RULES) -> Model:
    """Boosted trees on the URLs that a rule labels; without any labelled URL everything is allowed."""
    found = training(pages, rules)
    if found is None:
        return Model({}, -1.0, [])
    sample, tables, share = found
    model, cuts = Model(tables, math.log(share / (1 - share)), []), cut_points(sample)
    bins = F.array(*[sum([(F.col(f) > c).cast("int") for c in cuts[f]], F.lit(0)) for f in FEATURES])
    # the sample is bounded, so one partition in a fixed order makes the sums repeatable
    sample = stored(sample.withColumn("bins", bins).coalesce(1).sortWithinPartitions("url"), "urlbins").coalesce(1)
    for _ in range(TREES):
        model.trees.append(_grow(sample, model, cuts))
    return model


def _grow(sample: DataFrame, model: Model, cuts: dict) -> object:
    p = 1 / (1 + F.exp(-model.margin()))
    rows = sample.withColumn("p", p).select("bins", *FEATURES, (F.col("y") - F.col("p")).alias("g"), (F.col("p") * (1 - F.col("p"))).alias("h"))
    splits: dict[int, tuple] = {}
    leaves: dict[int, float] = {}
    for level in range(DEPTH):
        node = F.lit(1)
        for _ in range(level):
            for k, (feature, cut) in ((k, s) for k, s in splits.items() if k >= 1 << _):
                if k < 2 << _:
                    node = F.when(node == k, F.when(F.col(feature) <= cut, 2 * k).otherwise(2 * k + 1)).otherwise(node)
        found = rows.select(node.alias("node"), "g", "h", F.posexplode("bins").alias("k", "bin")).groupBy("node", "k", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        table: dict = {}
        for r in found:
            table.setdefault(r["node"], {}).setdefault(r["k"], {})[r["bin"]] = (r["g"], r["h"])
        for k, by_feature in sorted(table.items()):
            if level and k not in leaves:
                continue
            g, h, best = sum(x[0] for x in by_feature[0].values()), sum(x[1] for x in by_feature[0].values()), (1e-6, None)
            for f, hist in sorted(by_feature.items()):
                left_g = left_h = 0.0
                for b in sorted(hist)[:-1]:
                    left_g, left_h = left_g + hist[b][0], left_h + hist[b][1]
                    if min(left_h, h - left_h) < LEAST_WEIGHT:
                        continue
                    gain = left_g**2 / (left_h + PENALTY) + (g - left_g) ** 2 / (h - left_h + PENALTY) - g**2 / (h + PENALTY)
                    if gain > best[0] + 1e-9:
                        best = (gain, (FEATURES[f], cuts[FEATURES[f]][b]), left_g / (left_h + PENALTY), (g - left_g) / (h - left_h + PENALTY))
            leaves.setdefault(k, RATE * g / (h + PENALTY))
            if best[1]:
                splits[k] = best[1]
                leaves[2 * k], leaves[2 * k + 1] = RATE * best[2], RATE * best[3]

    def build(k: int):
        return (*splits[k], build(2 * k), build(2 * k + 1)) if k in splits else leaves[k]

    return build(1)


def judge(pages: DataFrame, model: Model, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's block score of every row.

    Null URLs have empty parts and are judged by the model. One narrow pass; rows that repeat
    give rows that repeat, other columns are left out.
    """
    rows = model.suffix_columns(lexical(with_parts(pages.select("page_id", "url"))))
    rule, verdict = rule_of(rules)
    score = 1 / (1 + F.exp(-model.margin()))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(model.margin() >= 0, "block").otherwise("allow")).alias("verdict"), F.round(score, 6).alias("block_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL's parts, rule and verdict; the trees are learned from the URLs that a rule decides.

    Null, empty, very long and repeated URLs, an empty table, other columns: see judge.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, fit(pages))
