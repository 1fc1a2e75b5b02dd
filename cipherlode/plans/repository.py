"""A repository run as one DAG: files to hits, hits to assets, assets to labels, labels to data products.

Texts go through the scanner, ELF and PE files through their symbol tables, other binaries give
nothing. A file that can't be read or parsed becomes a failure row and stops nothing.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlode import rules
from cipherlode.functions import classify as C
from cipherlode.operators import bom, enrich, labels, scan
from cipherlode.operators.rulebook import BUILT_IN, Rulebook
from cipherlode.runtime import scratch, stored
from cipherlode.sources import files as source
from cipherlode.sources import sinks


@dataclass(frozen=True)
class Enrichment:
    """How a code model is asked: only for candidates, at or below a confidence, with so many snippets a file.

    provider: a function of snippets, None for the mock; cache: a table of answers kept between runs; tasks: how many ask at a time.
    """

    candidate_only: bool = False
    min_confidence: float = 0.85
    max_snippets: int = 2
    provider: object = None
    cache: str | None = None
    tasks: int = 8


@dataclass
class Run:
    """files (file_id, path, file_type, target_type), hits, libraries, assets, labels, failures (file, error)."""

    files: DataFrame
    hits: DataFrame
    libraries: DataFrame
    assets: DataFrame
    labels: DataFrame
    failures: DataFrame
    facts: dict = field(default_factory=dict)


BINARY_DETECTORS = {"symbol": "elf_symbol", "import": "pe_import", "export": "pe_export"}


def binary_hits(symbols: DataFrame) -> DataFrame:
    """Known symbols of binaries in the form of the scanner's hits; they have no line."""
    null = lambda kind: F.lit(None).cast(kind)
    known = source.match_symbols(symbols)
    detector = C.first_of(*[(F.col("kind") == k, d) for k, d in BINARY_DETECTORS.items()], default="elf_symbol")
    snippet = F.when(F.col("kind") == "import", F.concat("library", F.lit("!"), "name")).otherwise(F.col("name"))
    return known.select(
        "file_id", "path", F.lit(0).alias("phase"), detector.alias("detector"), F.when(F.col("kind") == "export", 1).otherwise(0).alias("rule_ord"), F.col("at").alias("match_ord"), "name", "algorithm", F.col("primitive"), "confidence",
        null("int").alias("line"), snippet.alias("snippet"), null("string").alias("context_before"), null("string").alias("context_after"), null("string").alias("function_name"), F.lit("binary").alias("source_type"),
    )


def scan_files(files: DataFrame, texts: bool = True, binaries: bool = True, book: Rulebook = BUILT_IN) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(files, hits, symbols, failures) of rows (file_id, path, content as bytes, and error if a source gives it).

    Content is null where a file couldn't be read. Each file is read as what its first bytes say. texts, binaries: whether
    such files are analysed; book: the rules for texts.
    """
    why = F.coalesce("error", F.lit("unreadable")) if "error" in files.columns else F.lit("unreadable")
    typed = files.select(F.col("file_id").cast("string").alias("file_id"), "path", "content", why.alias("error")).withColumn("file_type", source.file_type(F.col("content")))
    facts = typed.select("file_id", "path", "file_type", C.target_type(F.col("file_type")).alias("target_type"))
    sources = typed.where(F.col("file_type") == "TEXT").where(F.lit(texts)).select("file_id", "path", source.decode_text(F.col("content")).alias("content"))
    symbols = source.binary_symbols(typed.where(F.lit(binaries)))
    hits = scan.scan_text(sources, book).withColumn("source_type", F.lit("source")).unionByName(binary_hits(symbols))
    unread = typed.where("content is null").select(F.col("path").alias("file"), "error")
    failures = unread.unionByName(symbols.where("kind = 'error'").select(F.col("path").alias("file"), "error"))
    return facts, hits, symbols, failures


def _answers(files: DataFrame, facts: DataFrame, symbols: DataFrame, hits: DataFrame, assets: DataFrame, how: Enrichment, texts: bool) -> DataFrame:
    """A code model's answers for texts, by snippets, and for binaries, by their known names and libraries."""
    taken = enrich.candidates(assets, hits, how.min_confidence) if how.candidate_only else facts.select("file_id")
    typed = files.select(F.col("file_id").cast("string").alias("file_id"), "content").where(source.file_type(F.col("content")) == "TEXT").where(F.lit(texts))
    own = typed.join(taken, "file_id", "left_semi").select("file_id", source.decode_text(F.col("content")).alias("content"))
    known = symbols.where("kind <> 'error'").join(taken, "file_id", "left_semi")
    known = known.withColumn("algorithm", source.known_symbol(F.col("name"), F.col("kind"))["algorithm"])
    pieces = enrich.snippets(own, how.max_snippets).unionByName(enrich.binary_prompts(known))
    return enrich.analyse(pieces, how.provider, how.cache, how.tasks)


def analyse(files: DataFrame, how: Enrichment | None = None, policy: dict = rules.POLICY_VALUES, texts: bool = True, binaries: bool = True, book: Rulebook = BUILT_IN) -> Run:
    """Everything a repository run derives from its files (file_id, path, content as bytes, and error if a source gives it)."""
    facts, hits, symbols, _ = scan_files(files, texts, binaries, book)
    hits, symbols, facts = stored(hits, "hits"), stored(symbols, "symbols"), stored(facts, "facts")
    unread = files.where("content is null").select(F.col("path").alias("file"), (F.coalesce("error", F.lit("unreadable")) if "error" in files.columns else F.lit("unreadable")).alias("error"))
    failures = unread.unionByName(symbols.where("kind = 'error'").select(F.col("path").alias("file"), "error"))
    assets = scan.fold_assets(hits)
    if how is not None:
        plain = assets.withColumns({"key_length": F.lit(None).cast("int"), "mode": F.lit(None).cast("string"), "is_pqc_safe": C.is_pqc_safe(F.col("algorithm"))})
        answers = _answers(files, facts, symbols, hits, assets, how, texts)
        more = enrich.upsert(plain, answers).select("file_id", "algorithm", F.col("confidence").alias("_c"), F.col("key_length").alias("_k"), F.col("mode").alias("_m"), F.col("is_pqc_safe").alias("_p"), (F.col("source") != "static").alias("_new"))
        assets = more.join(assets.drop("path"), ["file_id", "algorithm"], "left").join(facts.select("file_id", "path"), "file_id")
        assets = assets.withColumns({"confidence": F.col("_c"), "occurrences": F.coalesce("occurrences", F.lit(0).cast("long")), "locations": F.coalesce("locations", F.array().cast("array<string>"))})
    else:
        assets = assets.withColumn("_new", F.lit(False))
    done = labels.describe(labels.with_evidence(assets, hits), *(("_k", "_m", "_p") if how is not None else ()))
    done = done.join(facts.select("file_id", "file_type", "target_type"), "file_id")
    done = done.withColumn("source", F.when(F.col("_new") & (F.col("file_type") != "TEXT"), "binary-llm").when(F.col("_new"), "source-code").otherwise(F.col("target_type"))).drop("_new")
    done = stored(labels.label(done, policy), "labels")
    layer = bom.layer(F.transform("evidence", lambda e: e["detector"]))
    names = ("ref", "file_id", "path", "algorithm", "primitive_type", "functions", "key_length", "mode", "is_pqc_safe", "pqc_label", "source", "confidence", "risk", "risk_level", "occurrences", "locations")
    return Run(facts, hits, symbols.where("kind = 'library'"), done.select(*names, layer.alias("layer")), done, failures)


def report(run: Run) -> DataFrame:
    """One row for each file with assets: target, components, post-quantum readiness, risk, and recommendations by priority.

    A file's recommendations are in its row; there is one for each algorithm of the file.
    """
    rows = run.assets.drop("source").join(run.files.select("file_id", F.col("target_type").alias("source")), "file_id")
    rows = rows.withColumn("now", C.final_risk(F.col("algorithm"), F.col("key_length")))
    item = F.struct("algorithm", F.col("now").alias("current_risk"), C.recommendation(F.col("now")).alias("recommendation"), C.mitigation(C.risk_status(F.col("algorithm"))).alias("mitigation"))
    rows = rows.withColumns({"item": item, "bucket": C.priority(F.col("now"))})
    buckets = [F.array_sort(F.collect_list(F.when(F.col("bucket") == b, F.col("item")))).alias(b) for b in ("critical_issues", "high_priority", "medium_priority", "low_priority")]
    found = rows.groupBy("file_id", "path", F.col("source").alias("target_type")).agg(
        F.count("*").alias("total_crypto_components"), F.sum(F.col("is_pqc_safe").cast("long")).alias("pqc_ready"), F.sum((~F.col("is_pqc_safe")).cast("long")).alias("not_pqc_ready"), F.least(F.avg("now"), F.lit(100.0)).alias("overall_risk_score"),
        F.bround(F.avg("now"), 2).alias("average_risk"), F.array_sort(F.collect_list("algorithm")).alias("algorithm_names"), *buckets,
    )
    return found


def batch_summary(run: Run, *by: str) -> DataFrame:
    """Assets in each split (over all: one row, zeros without assets)."""
    return bom.split_counts(run.labels, *by)


def run_folder(output: str, label: str, stamp: str) -> str:
    return f"{output.rstrip('/')}/run_{stamp}_{label}"


def write_run(spark: SparkSession, root: str, profile: dict, output: str, how: Enrichment | None = None, policy: dict = rules.POLICY_VALUES, instruction: str = labels.INSTRUCTION, texts: bool = True, binaries: bool = True, max_bytes: int | None = None, book: Rulebook = BUILT_IN) -> dict:
    """Scan a repository's files and write the ten products; the summary is returned too.

    The products are folders of text files that are one document when read in order of name. The files are read
    once, into the work folder, so that all products speak of the same state; what a run has put there is gone at its end.
    """
    with scratch(spark):
        return _write_run(spark, root, profile, output, how, policy, instruction, texts, binaries, max_bytes, book)


def _write_run(spark: SparkSession, root: str, profile: dict, output: str, how: Enrichment | None, policy: dict, instruction: str, texts: bool, binaries: bool, max_bytes: int | None, book: Rulebook) -> dict:
    began, name, prefix = time.time(), profile["name"], profile.get("output_prefix", "repo")
    label = spark.range(1).select(C.safe_name(F.lit(f"{prefix}-{name}"))).first()[0]
    folder = run_folder(output, label, time.strftime("%Y%m%d_%H%M%S", time.gmtime()))
    files = stored(source.read_repository(spark, root, profile, **({"max_bytes": max_bytes} if max_bytes else {})), "files")
    selected = files.select("file_id").count()
    flags = {"use_llm": how is not None, "llm_candidate_only": bool(how and how.candidate_only), "llm_min_confidence": how.min_confidence if how else 0.85, "llm_max_snippets": how.max_snippets if how else 2}
    summary = {"profile": name, "repo_root": root, "output_dir": folder, "workers": spark.sparkContext.defaultParallelism, **flags, "files_selected": selected, "failures": [], "outputs": {}}
    zero = dict.fromkeys(("assets_total", "training", "review", "policy_drop", "quality_reject", "dropped"), 0)
    if not selected:
        summary |= zero | {"duration_seconds": 0.0, "message": "No files found for the profile."}
    else:
        run = analyse(files, how, policy, texts, binaries, book)
        outputs = {}

        def at(key: str, file: str) -> str:
            outputs[key] = f"{folder}/{prefix}_{file}"
            return outputs[key]

        context = F.col("layer") == "context_crypto"
        layers = {r["layer"]: r["n"] for r in run.assets.groupBy("layer").agg(F.count("*").alias("n")).collect()}
        meta = {"analysis_type": "repository_batch", "profile": name, "use_llm": how is not None, "source_cbom_count": selected, "layers": {"confirmed_crypto_assets": layers.get("confirmed_crypto", 0), "context_crypto_assets": layers.get("context_crypto", 0)}}
        for key, file, rows in (("cbom_json", "cbom_cyclonedx.json", run.assets), ("cbom_confirmed_json", "cbom_confirmed.json", run.assets.where(~context)), ("cbom_context_json", "cbom_context.json", run.assets.where(context))):
            facts = bom.summary(rows).first().asDict()
            head = {"bom_ref": f"cbom-repo-{label}", "target_file": root, "target_type": "application", "metadata": meta, "risk_score": facts.pop("risk_score"), "summary": facts}
            sinks.write_bom(head, rows, at(key, file))
        sinks.write_json_array(run.labels, at("labeled_json", "labeled_v2.json"))
        records = labels.instructions(run.labels, instruction)
        records = records.withColumn("sets", F.array_compact(F.array("split", F.when(F.col("split").isin("policy_drop", "quality_reject"), "dropped")))).drop("split")
        counts = sinks.write_sets(records, "sets", {s: at(f"{s}_jsonl", f"dataset_{s}.jsonl") for s in (*labels.SPLITS, "dropped")})
        failures = sinks.write_jsonl(run.failures, at("failures_jsonl", "failures.jsonl"))
        total = sum(counts[s] for s in labels.SPLITS)
        summary |= {"assets_total": total, **counts, "failures": failures, "outputs": outputs, "duration_seconds": round(time.time() - began, 2)}
    sinks.write_text(spark, json.dumps(summary, indent=2, ensure_ascii=False), f"{folder}/{prefix}_batch_summary.json")
    return summary


def write_report(run: Run, path: str) -> None:
    """The reports of all files with assets, as one JSON array."""
    sinks.write_json_array(report(run), path)
