"""Bills of materials: summaries, recommendations, layers, repository roll-ups and report frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlode import rules
from cipherlode.functions import classify as C
from cipherlode.sources.files import library_families

CONTEXT_DETECTORS = ("java_import_signal",)


def summary(assets: DataFrame, *by: str) -> DataFrame:
    """Per group (or over all): total, compliant and legacy assets, average risk to two places, risk score."""
    rows = assets.withColumn("_risk", C.final_risk(F.col("algorithm"), F.col("key_length"))).withColumn("_safe", C.is_pqc_safe(F.col("algorithm")))
    grouped = rows.groupBy(*by) if by else rows.groupBy()
    return grouped.agg(
        F.count("*").alias("total_algorithms"), F.coalesce(F.sum(F.col("_safe").cast("long")), F.lit(0).cast("long")).alias("pqc_compliant"), F.coalesce(F.sum((~F.col("_safe")).cast("long")), F.lit(0).cast("long")).alias("legacy_algorithms"),
        F.coalesce(F.bround(F.avg("_risk"), 2), F.lit(0.0)).alias("average_risk"), F.coalesce(F.least(F.avg("_risk"), F.lit(100.0)), F.lit(0.0)).alias("risk_score"),
    )


def recommendations(assets: DataFrame) -> DataFrame:
    """Each asset with its risk, recommendation, mitigation and priority bucket."""
    risk = C.final_risk(F.col("algorithm"), F.col("key_length"))
    return assets.select(*[c for c in ("ref", "file_id", "repo_id") if c in assets.columns], "algorithm", risk.alias("current_risk"), C.recommendation(risk).alias("recommendation"), C.mitigation(C.risk_status(F.col("algorithm"))).alias("mitigation"), C.priority(risk).alias("bucket"))


def layer(detectors) -> F.Column:
    """context_crypto where all of an asset's detectors only see context, else confirmed_crypto."""
    only = F.array(*map(F.lit, CONTEXT_DETECTORS))
    return F.when((F.size(detectors) > 0) & (F.size(F.array_except(detectors, only)) == 0), "context_crypto").otherwise("confirmed_crypto")


def with_layers(assets: DataFrame, labels: DataFrame) -> DataFrame:
    """Assets with the layer that their labels' evidence gives; an asset without a label is confirmed."""
    one = labels.select("ref", F.explode(F.transform("evidence", lambda e: e["detector"])).alias("detector"))
    seen = one.groupBy("ref").agg(F.collect_set("detector").alias("_d"))
    return assets.join(seen, "ref", "left").withColumn("layer", layer(F.coalesce("_d", F.array().cast("array<string>")))).drop("_d")


def split_counts(labels: DataFrame, *by: str) -> DataFrame:
    """Assets in each split; dropped is policy_drop and quality_reject together."""
    n = lambda *s: F.coalesce(F.sum(F.col("split").isin(*s).cast("long")), F.lit(0).cast("long"))
    return (labels.groupBy(*by) if by else labels.groupBy()).agg(F.count("*").alias("assets_total"), *[n(s).alias(s) for s in ("training", "review", "policy_drop", "quality_reject")], n("policy_drop", "quality_reject").alias("dropped"))


def decision_summary(labels: DataFrame, *by: str) -> DataFrame:
    included, review = F.col("include"), ~F.col("include") & (F.col("final_action") == "require_review")
    n = lambda c: F.sum(c.cast("long"))
    dropped = n(~included & ~review)
    return (labels.groupBy(*by) if by else labels.groupBy()).agg(F.count("*").alias("total"), n(included).alias("included"), n(review).alias("review"), dropped.alias("dropped"), F.bround(dropped / F.count("*") * 100.0, 2).alias("drop_rate"), F.bround(F.sum("quality_score") / F.count("*"), 2).alias("avg_quality"))


def level_counts(assets: DataFrame, *by: str) -> DataFrame:
    """Assets at each of the four risk levels, zeros kept."""
    return (assets.groupBy(*by) if by else assets.groupBy()).agg(*[F.sum((F.col("risk_level") == x).cast("long")).alias(x) for x in ("critical", "high", "medium", "low")])


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def issue_rows(labels: DataFrame) -> DataFrame:
    issue = F.col("issue")
    rows = labels.select("ref", "algorithm", F.explode("issues").alias("issue")).withColumn("severity", C.issue_severity(issue))
    return rows.withColumn("severity_score", C.first_of((F.col("severity") == "high", F.lit(3)), (F.col("severity") == "medium", F.lit(2)), default=F.lit(1)))


def field_averages(labels: DataFrame) -> DataFrame:
    """Mean confidence of each field over all labels, a missing one as 0, to three places."""
    fields = ("algorithm", "category", "key_length", "mode", "padding", "usage")
    wide = labels.agg(*[F.bround(F.avg(F.coalesce(F.try_element_at("field_scores", F.lit(f)), F.lit(0.0))), 3).alias(f) for f in fields])
    return wide.select(F.expr("stack(6, " + ", ".join(f"'{f}', `{f}`" for f in fields) + ") as (field, avg_confidence)"))


def quality_histogram(labels: DataFrame) -> DataFrame:
    """Ten equal bins from 0 to 100; 100 itself is in the last."""
    return labels.groupBy(F.least(F.floor(F.col("quality_score") / 10), F.lit(9)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def set_sizes(labels: DataFrame) -> DataFrame:
    """Six rows: all assets, and each set after the decision."""
    c = split_counts(labels)
    return c.select(F.expr("stack(6, 'all', assets_total, 'training', training, 'review', review, 'policy_drop', policy_drop, 'quality_reject', quality_reject, 'dropped', dropped) as (stage, n)"))


def validity(labels: DataFrame, *by: str) -> DataFrame:
    ok = F.col("is_valid")
    return (labels.groupBy(*by) if by else labels.groupBy()).agg(F.sum(ok.cast("long")).alias("valid"), F.sum((~ok).cast("long")).alias("invalid"), F.bround(F.avg("label_confidence"), 3).alias("avg_confidence"))


def label_table(labels: DataFrame) -> DataFrame:
    """The eleven columns of the label view."""
    return labels.select("ref", "algorithm", "family", "category", F.col("key_length_v.state").alias("key_length_state"), F.col("mode_v.state").alias("mode_state"), F.col("padding_v.state").alias("padding_state"), "pqc_status", "label_confidence", "is_valid", "issue_count")


def decision_table(labels: DataFrame) -> DataFrame:
    reasons = F.when(F.size("reasons") == 0, "none").otherwise(F.concat_ws(", ", "reasons"))
    return labels.select("ref", "algorithm", "include", "final_action", "max_severity", "quality_score", "quality_tier", "unknown_ratio", "evidence_count", reasons.alias("reasons"))


def algorithm_table(assets: DataFrame) -> DataFrame:
    risk = C.final_risk(F.col("algorithm"), F.col("key_length"))
    return assets.select("ref", "algorithm", C.primitive_type(F.col("algorithm")).alias("type"), "key_length", C.is_pqc_safe(F.col("algorithm")).alias("is_pqc_safe"), "confidence", F.bround(risk, 1).alias("risk"))


def risk_references(assets: DataFrame) -> DataFrame:
    """Assets whose algorithm is on one of the two reference lists, with it: post-quantum algorithms and legacy ones."""
    rows = assets.sparkSession.createDataFrame(rules.RISKS, "algorithm string, base double, pqc double, status string")
    listed = rows.withColumn("reference", F.when(F.col("pqc") > 50, "pqc").when((F.col("pqc") < 50) & (F.col("base") > 50), "legacy")).where("reference is not null")
    return assets.join(F.broadcast(listed), "algorithm")  # the risk map's rows


def migrations(assets: DataFrame) -> DataFrame:
    """Assets that have a migration path, with it."""
    spark = assets.sparkSession
    paths = spark.createDataFrame(rules.MIGRATIONS, "algorithm string, target string, timeline string, risk_before int, risk_after int")
    return assets.join(F.broadcast(paths), "algorithm")  # five rows


def file_summary(hits: DataFrame) -> DataFrame:
    return hits.groupBy("file_id").agg(F.count("*").alias("total_crypto_functions"), F.countDistinct("algorithm").alias("unique_algorithms"))


def file_names(hits: DataFrame, libraries: DataFrame | None = None) -> DataFrame:
    """Per file: symbols, distinct algorithms, their names in order of detection, library families of its binary."""
    order = F.struct("phase", "rule_ord", "match_ord")
    one = hits.groupBy("file_id", "algorithm").agg(F.count("*").alias("n"), F.min(order).alias("o"))
    rows = one.groupBy("file_id").agg(F.sum("n").alias("total_crypto_functions"), F.count("*").alias("unique_algorithms"), F.transform(F.array_sort(F.collect_list(F.struct("o", "algorithm"))), lambda x: x["algorithm"]).alias("algorithms"))
    if libraries is None:
        return rows.withColumn("detected_libraries", F.array().cast("array<string>"))
    found = libraries.select("file_id", F.explode(library_families(F.col("name"))).alias("family")).groupBy("file_id").agg(F.array_sort(F.collect_set("family")).alias("detected_libraries"))
    return rows.join(found, "file_id", "left").withColumn("detected_libraries", F.coalesce("detected_libraries", F.array().cast("array<string>")))


def summary_names(assets: DataFrame, *by: str) -> DataFrame:
    """summary with the names of a group's assets, sorted: for groups the size of a file's assets."""
    names = assets.groupBy(*by).agg(F.array_sort(F.collect_list("algorithm")).alias("algorithm_names"))
    return summary(assets, *by).join(names, list(by))
