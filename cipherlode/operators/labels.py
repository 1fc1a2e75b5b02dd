"""Evidence, validated labels, policy decisions and the splits that follow from them.

Everything after the evidence is row-wise: nested CASE expressions in one stage, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherlode import rules
from cipherlode.functions import classify as C

BLOCK_MODES = ("CBC", "GCM", "CTR", "ECB", "CCM")
# The label schema's version and the default instruction of the records.
SCHEMA_VERSION = "2.0.0"
INSTRUCTION = "Extract a structured cryptographic label from the input evidence. Return algorithm family, category, field states, and PQC status."
SPLITS = ("training", "review", "policy_drop", "quality_reject")


def asset_ref(*parts: Column) -> Column:
    """A repeatable id, so that joins survive a recomputation."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def collect_evidence(hits: DataFrame) -> DataFrame:
    """(file_id, algorithm, evidence): first-seen evidence items, in order of detection."""
    order = ["phase", "rule_ord", "match_ord"]
    kind = F.col("source_type") if "source_type" in hits.columns else F.lit("source")
    hits = hits.withColumn("source_type", kind)
    same = Window.partitionBy("file_id", "algorithm", "line", "snippet", "function_name", "source_type").orderBy(*order)
    rows = hits.withColumn("rank", F.row_number().over(same)).where("rank = 1")
    item = F.struct(F.struct(*order).alias("o"), F.col("path").alias("file_path"), F.lit(None).cast("string").alias("language"), F.col("line").alias("line_start"), F.col("line").alias("line_end"), "function_name", "snippet", "context_before", "context_after", "detector", "source_type")
    found = rows.groupBy("file_id", "algorithm").agg(F.array_sort(F.collect_list(item)).alias("e"))
    return found.select("file_id", "algorithm", F.transform("e", lambda x: x.dropFields("o")).alias("evidence"))


def with_evidence(assets: DataFrame, hits: DataFrame) -> DataFrame:
    """Adds each asset's evidence; one that has none gets a fallback item."""
    text = lambda: F.lit(None).cast("string")
    none = F.lit(None).cast("int")
    fallback = F.array(F.struct(F.col("path").alias("file_path"), text().alias("language"), none.alias("line_start"), none.alias("line_end"), text().alias("function_name"), F.concat(F.lit("Detected algorithm: "), F.col("algorithm")).alias("snippet"), text().alias("context_before"), text().alias("context_after"), F.lit("fallback").alias("detector"), F.lit("source").alias("source_type")))
    joined = assets.join(collect_evidence(hits), ["file_id", "algorithm"], "left")
    return joined.withColumn("evidence", F.coalesce("evidence", fallback)).withColumn("evidence_count", F.size("evidence"))


def _scored(value: Column, base: Column) -> Column:
    known = F.struct(value.alias("value"), F.lit("known").alias("state"), base.alias("confidence"), F.lit("detected_or_inferred").alias("reason"))
    return F.when(value.isNull(), _state(value, "unknown", 0.35, "not_detected")).otherwise(known)


def _state(value: Column, state: str, confidence: float, reason: str) -> Column:
    return F.struct(F.when(F.lit(False), value).alias("value"), F.lit(state).alias("state"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))


def validate(assets: DataFrame) -> DataFrame:
    """Adds the label's fields to assets (algorithm, key_length, mode, padding, confidence).

    family, category, key_length_v, mode_v and padding_v (value, state, confidence, reason),
    issues, field_scores, usage, pqc_status and its confidence.
    """
    name, base = F.col("algorithm"), F.least(F.greatest(F.col("confidence"), F.lit(0.1)), F.lit(1.0))
    rows = assets.withColumns({"category": C.category(name), "family": C.family(name), "base": base})
    kind = F.col("category")
    key, mode, padding = F.col("key_length").cast("int"), F.col("mode").cast("string"), F.col("padding").cast("string")
    gone = lambda value, reason: _state(value, "not_applicable", 1.0, reason)
    upper = F.upper(mode)
    good = upper.isin(*BLOCK_MODES)
    symmetric, asymmetric = kind == "symmetric_encryption", kind == "asymmetric_cryptography"
    plain = F.col("base")
    key_v = C.first_of((kind == "hash_function", gone(key, "hash_functions_do_not_use_key_length")), (kind == "rng", gone(key, "rng_key_length_not_applicable")), default=_scored(key, plain))
    mode_v = C.first_of(
        (asymmetric, gone(mode, "asymmetric_algorithms_do_not_use_mode")), (kind == "hash_function", gone(mode, "hash_functions_do_not_use_mode")), (kind == "mac", gone(mode, "mac_does_not_use_block_mode")),
        (kind == "key_exchange", gone(mode, "key_exchange_does_not_use_mode")), (kind == "rng", gone(mode, "rng_mode_not_applicable")), (symmetric & mode.isNotNull() & ~good, _state(mode, "unknown", 0.3, "mode_not_in_known_set")), default=_scored(mode, plain),
    )
    contaminated = F.upper(name).contains("RSA") & (F.col("mode_0.state") == "known")
    aead = symmetric & F.coalesce(upper.isin("GCM", "CCM", "CTR"), F.lit(False))
    open_padding = asymmetric & padding.isNull()
    padding_v = C.first_of(
        (kind == "hash_function", gone(padding, "hash_functions_do_not_use_padding")), (kind == "mac", gone(padding, "mac_does_not_use_padding")), (kind == "key_exchange", gone(padding, "key_exchange_does_not_use_padding")),
        (kind == "rng", gone(padding, "rng_padding_not_applicable")), (aead, gone(padding, "padding_not_used_in_aead_or_ctr")), (open_padding, _state(padding, "unknown", 0.35, "padding_may_apply_but_not_detected")), default=_scored(padding, plain),
    )
    issue = lambda test, text: F.when(test, F.lit(text))
    rows = rows.withColumns({"key_length_v": key_v, "mode_0": mode_v, "padding_v": padding_v})
    issues = F.array_compact(F.array(
        issue(kind == "unknown", "unknown_category"), issue(asymmetric & mode.isNotNull(), "mode_removed_for_asymmetric"), issue(symmetric & mode.isNotNull() & ~good, "invalid_mode_for_symmetric"),
        issue(aead & padding.isNotNull(), "padding_removed_for_aead_or_stream_mode"), issue(contaminated, "cross_algorithm_contamination_mode_removed"),
    ))
    rows = rows.withColumns({"issues": issues, "mode_v": F.when(contaminated, gone(mode, "rsa_does_not_use_mode")).otherwise(F.col("mode_0"))}).drop("mode_0")
    scores = F.create_map(F.lit("algorithm"), plain, F.lit("category"), F.lit(0.95), F.lit("key_length"), F.col("key_length_v.confidence"), F.lit("mode"), F.col("mode_v.confidence"), F.lit("padding"), F.col("padding_v.confidence"), F.lit("usage"), plain)
    sure = F.least(F.greatest(F.col("confidence"), F.lit(0.2)), F.lit(1.0))
    status = C.pqc_status(name)
    return rows.withColumns({
        "field_scores": scores, "usage": F.transform(C.crypto_functions(name), lambda f: F.struct(f.alias("name"), sure.alias("confidence"))),
        "pqc_status": status, "pqc_confidence": F.when(status != "unknown", 0.9).otherwise(0.4), "is_valid": F.size("issues") == 0, "label_confidence": plain,
    }).drop("base")


# Severity and action of an issue that a policy without an UNKNOWN entry lacks.
UNLISTED = ("UNKNOWN", "medium", "require_review")


def _from_policy(issue: Column, at: int, issues: tuple) -> Column:
    table = F.create_map(*[F.lit(x) for p in {p[0]: p for p in (UNLISTED, *issues)}.values() for x in (p[0], p[at])])
    return F.coalesce(F.try_element_at(table, issue), F.try_element_at(table, F.lit("UNKNOWN")))


def _rank(value: Column, names: tuple[str, ...]) -> Column:
    return C.first_of(*[(value == n, F.lit(i + 1)) for i, n in enumerate(names)], default=F.lit(0))


SEVERITIES = ("low", "medium", "high")
ACTIONS = ("keep", "keep_with_penalty", "require_review", "drop")


def decide(labels: DataFrame, policy: dict = rules.POLICY_VALUES) -> DataFrame:
    """Adds the decision: issue_decisions, max_severity, final_action, quality_score and tier, unknown_ratio, include, reasons, split.

    Strong TLS, SSL and RNG evidence is included whatever else holds. Needs evidence_count.
    """
    table = policy.get("issues", rules.POLICY)
    keys = F.transform("issues", C.issue_key)
    found = F.transform(keys, lambda i: F.struct(i.alias("issue"), _from_policy(i, 1, table).alias("severity"), _from_policy(i, 2, table).alias("action")))
    rows = labels.withColumn("issue_decisions", found)
    worst = lambda field, names: F.get(F.array(*map(F.lit, names)), F.coalesce(F.array_max(F.transform("issue_decisions", lambda d: _rank(d[field], names))), F.lit(1)) - 1)
    penalty = lambda d: C.first_of(*[(d["severity"] == s, F.lit(v)) for s, v in policy["penalties"].items()], default=0.0)
    fields = [F.col(f"{f}_v.state") for f in ("key_length", "mode", "padding")]
    applicable = sum(((s != "not_applicable").cast("int") for s in fields), F.lit(0))
    unknown = sum(((s == "unknown").cast("int") for s in fields), F.lit(0))
    values = [F.col("field_scores")[k] for k in ("algorithm", "category", "key_length", "mode", "padding", "usage")]
    mean = values[0]
    for v in values[1:]:
        mean = mean + v
    rows = rows.withColumns({
        "max_severity": worst("severity", SEVERITIES), "final_action": worst("action", ACTIONS), "severity_penalty": F.aggregate("issue_decisions", F.lit(0.0), lambda acc, d: acc + penalty(d)),
        "field_confidence_avg": F.least(F.greatest(mean / F.lit(6.0), F.lit(0.0)), F.lit(1.0)), "unknown_ratio": F.when(applicable == 0, 0.0).otherwise(unknown / applicable), "issue_count": F.size("issues"),
    })
    w, confidence, seen = policy["weights"], F.col("label_confidence"), F.col("evidence_count")
    evidence = F.when(seen >= 2, 1.0).when(seen == 1, 0.7).otherwise(0.0)
    raw = F.lit(100.0) * (F.lit(w["confidence"]) * confidence + F.lit(w["field_confidence"]) * F.col("field_confidence_avg") + F.lit(w["knownness"]) * (F.lit(1.0) - F.col("unknown_ratio")) + F.lit(w["evidence"]) * evidence)
    score = raw - F.col("severity_penalty") - F.lit(2.0) * F.col("issue_count")
    rows = rows.withColumn("quality_score", F.bround(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)), 2))
    limits, tiers = policy["limits"], policy["tiers"]
    strong = (seen >= 1) & (confidence >= 0.85) & C.any_of(F.upper("algorithm"), "TLS", "SSL", "RNG")
    review = (F.col("final_action") == "require_review") & F.lit(not limits["allow_require_review_in_training"])
    reasons = F.array_compact(F.array(
        F.when(seen < limits["min_evidence_count"], "insufficient_evidence"), F.when(confidence < limits["min_confidence"], "low_confidence"), F.when(F.col("field_confidence_avg") < limits["min_field_confidence_avg"], "low_field_confidence"),
        F.when(F.col("unknown_ratio") > limits["max_unknown_ratio"], "high_unknown_ratio"), F.when(F.col("quality_score") < 60.0, "quality_below_threshold"),
    ))
    one = lambda text: F.array(F.lit(text))
    rows = rows.withColumns({
        "quality_tier": C.first_of((F.col("quality_score") >= tiers["high_min"], "high_quality"), (F.col("quality_score") >= tiers["medium_min"], "medium_quality"), default="low_quality"),
        "auto": strong, "reasons": C.first_of((strong, one("auto_include_tls_high_confidence")), (F.col("final_action") == "drop", one("drop_action_policy")), (review, one("requires_review")), default=reasons),
    })
    rows = rows.withColumns({"include": F.col("auto") | (F.size("reasons") == 0), "final_action": F.when(F.col("auto"), "keep_with_penalty").otherwise(F.col("final_action"))}).drop("auto")
    return rows.withColumn("split", C.first_of((F.col("include"), "training"), (F.col("final_action") == "require_review", "review"), (F.col("final_action") == "drop", "policy_drop"), default="quality_reject"))


def label(assets: DataFrame, policy: dict = rules.POLICY_VALUES) -> DataFrame:
    """validate and decide, for assets with algorithm, key_length, mode, padding, confidence and evidence_count."""
    return decide(validate(assets), policy)


def describe(assets: DataFrame, key_length: str | None = None, mode: str | None = None, safe: str | None = None) -> DataFrame:
    """Adds an asset's ref, risk, type, functions and post-quantum facts; the columns named are those that a code model gave."""
    none, name = F.lit(None), F.col("algorithm")
    given = lambda c, other: F.coalesce(F.col(c), other) if c else other
    return assets.withColumns({
        "ref": asset_ref(F.col("path"), name), "key_length": given(key_length, none.cast("int")), "mode": given(mode, none.cast("string")), "padding": none.cast("string"), "risk": C.final_risk(name), "risk_level": C.risk_level(C.final_risk(name)),
        "primitive_type": C.primitive_type(name), "functions": C.crypto_functions(name), "is_pqc_safe": given(safe, C.is_pqc_safe(name)), "pqc_label": C.pqc_label(name), "source": F.lit("source-code"),
    })


def file_assets(hits: DataFrame, *by: str) -> DataFrame:
    """Assets of scanned files with their evidence, risk and type, ready to be labelled."""
    from cipherlode.operators.scan import fold_assets

    return describe(with_evidence(fold_assets(hits, *by), hits))


def _where(labels: DataFrame, test: Column) -> DataFrame:
    """Rows for which a test on the decision's columns holds.

    A plain filter is pushed below the projections that make these columns and takes their expressions along, one inside the
    other and each as often as it is named. Where rows come from an array of one or none, the test stays above them.
    """
    return labels.withColumn("_kept", F.explode(F.when(test, F.array(F.lit(True))))).drop("_kept")


def training_only(labels: DataFrame) -> DataFrame:
    return _where(labels, F.col("include"))


def with_severity(labels: DataFrame, chosen: list[str]) -> DataFrame:
    """Labels whose worst severity is one of those chosen; none where none is."""
    return _where(labels, F.col("max_severity").isin(chosen))


def with_tier(labels: DataFrame, chosen: list[str]) -> DataFrame:
    """Labels of the quality tiers chosen; all of them where none is."""
    return _where(labels, F.col("quality_tier").isin(chosen)) if chosen else labels


def first_evidence(labels: DataFrame, most: int = 3) -> DataFrame:
    """(ref, at, evidence columns) of the first items of each label."""
    rows = labels.select("ref", F.posexplode(F.slice("evidence", 1, most)).alias("at", "item"))
    return rows.select("ref", "at", "item.*")


def instructions(labels: DataFrame, instruction: str = INSTRUCTION) -> DataFrame:
    """Instruction-tuning records: instruction, input, output and metadata. Needs evidence items and ref."""
    first = F.get("evidence", F.lit(0))
    snippet, path = first["snippet"], first["file_path"]
    text = F.when(F.coalesce(snippet, F.lit("")) != "", snippet).when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit("Detected in file: "), path)).otherwise(F.concat(F.lit("Algorithm: "), F.col("algorithm")))
    output = F.struct(
        "algorithm", "family", "category", F.col("key_length_v.value").alias("key_length"), F.col("key_length_v.state").alias("key_length_state"), F.col("mode_v.value").alias("mode"), F.col("mode_v.state").alias("mode_state"),
        F.col("padding_v.value").alias("padding"), F.col("padding_v.state").alias("padding_state"), "pqc_status", F.transform("usage", lambda u: u["name"]).alias("usage"),
    )
    metadata = F.struct(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.col("ref").alias("asset_id"), F.col("label_confidence").alias("confidence"), "pqc_confidence", F.col("is_valid").cast("int").alias("validation_ok"),
        F.col("include").cast("int").alias("include"), "quality_score", "quality_tier", F.col("final_action").alias("decision_action"), "max_severity",
    )
    return labels.select(F.lit(instruction).alias("instruction"), text.alias("input"), output.alias("output"), metadata.alias("metadata"), "split")
