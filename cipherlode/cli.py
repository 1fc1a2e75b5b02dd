"""Command line.

    python -m cipherlode repo FOLDER_OR_GITHUB_ADDRESS --profile default-source --output-dir output
    python -m cipherlode file PATH

What isn't given comes from the environment (settings.py), the profile and Spark's own settings.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from contextlib import nullcontext
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cipherlode.operators import providers, rulebook
from cipherlode.plans import repository
from cipherlode.plans.repository import Enrichment
from cipherlode.settings import Settings
from cipherlode.sources import files
from cipherlode.sources.github import GitHubRepository

USUAL = Enrichment()


def _repo_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("source", help="a folder on any file system that Arrow opens, or https://github.com/OWNER/NAME")
    p.add_argument("--output-dir", metavar="FOLDER", default="output")
    rules = p.add_argument_group("rules")
    rules.add_argument("--profile", metavar="NAME", help=f"one of {', '.join(files.profile_names())}, or of --profiles; the first one where not given")
    rules.add_argument("--profiles", metavar="JSON", help="profiles other than the built-in ones")
    rules.add_argument("--policy", metavar="JSON", help="a policy other than the built-in one")
    rules.add_argument("--rules", metavar="TABLE", help="JSON lines of rules other than the built-in ones: table, ord, rule, algorithm, primitive, confidence")
    rules.add_argument("--max-bytes", type=int, help="files with more are failures")
    git = p.add_argument_group("GitHub")
    git.add_argument("--ref", default="", help="branch, tag or commit")
    git.add_argument("--depth", type=int, default=1)
    git.add_argument("--keep-clone", action="store_true")
    model = p.add_argument_group("code model")
    model.add_argument("--use-llm", action="store_true", help="ask LLM_PROVIDER, or the built-in mock")
    model.add_argument("--llm-candidate-only", action="store_true", help="only for weak or generic assets")
    model.add_argument("--llm-min-confidence", type=float, default=USUAL.min_confidence)
    model.add_argument("--llm-max-snippets", type=int, default=USUAL.max_snippets)
    model.add_argument("--llm-cache", metavar="TABLE", help="answers that are kept between runs")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="cipherlode", description="Cryptographic inventories")
    p.add_argument("--master", help="Spark's master, where neither spark-submit nor SPARK_MASTER says it")
    commands = p.add_subparsers(dest="command", required=True)
    _repo_options(commands.add_parser("repo", help="scan a repository and write its ten products"))
    commands.add_parser("file", help="report on one file").add_argument("path")
    return p.parse_args(argv)


def session(master: str | None) -> SparkSession:
    builder = SparkSession.builder.appName("cipherlode").config("spark.sql.session.timeZone", "UTC")
    if master := master or os.environ.get("SPARK_MASTER"):
        builder = builder.master(master)
    return builder.getOrCreate()


def file_report(spark: SparkSession, path: str, settings: Settings) -> dict:
    """The report of one file; without assets the counts are zero."""
    top, _, name = os.path.abspath(path).rpartition("/")
    only = {"include_globs": [name.replace("*", "?")], "exclude_globs": [], "max_files": 1}
    run = repository.analyse(files.read_repository(spark, top or "/", only).where(F.col("path") == name), texts=settings.sources, binaries=settings.binaries)
    kind = run.files.first()
    if kind is None:
        raise FileNotFoundError(path)
    found = repository.report(run).first()
    empty = {"target_type": kind["target_type"], "total_crypto_components": 0, "pqc_ready": 0, "not_pqc_ready": 0, "overall_risk_score": 0.0, "average_risk": 0.0, "algorithm_names": []}
    return (found.asDict(recursive=True) if found else empty) | {"path": path}


def repo_run(spark: SparkSession, a: argparse.Namespace, settings: Settings) -> dict:
    profile = files.scan_profile(a.profile or next(iter(files.scan_profiles(a.profiles))), a.profiles)
    how = None
    if a.use_llm or settings.use_llm:
        how = replace(USUAL, candidate_only=a.llm_candidate_only, min_confidence=a.llm_min_confidence, max_snippets=a.llm_max_snippets, provider=providers.provider(settings), cache=a.llm_cache)
    remote = "://" in a.source and a.source.lower().startswith("http")
    own = {"policy": files.policy(a.policy)} if a.policy else {}
    if a.rules:
        own["book"] = rulebook.Rulebook.of(spark.read.schema(rulebook.SCHEMA).json(a.rules))
    with GitHubRepository.at(a.source, a.ref, a.depth).fetched(spark, a.keep_clone) if remote else nullcontext(a.source) as root:
        summary = repository.write_run(spark, root, profile, a.output_dir, how, texts=settings.sources, binaries=settings.binaries, max_bytes=a.max_bytes, **own)
    return summary | ({"repo_url": a.source, "ref": a.ref} if remote else {})


def main(argv: list[str] | None = None) -> int:
    a, settings = arguments(argv), Settings.from_environment()
    try:
        if a.command == "repo" and (a.use_llm or settings.use_llm):
            providers.provider(settings)  # an unusable one is refused before anything starts
        spark = session(a.master)
        done = file_report(spark, a.path, settings) if a.command == "file" else repo_run(spark, a, settings)
    except (ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 2
    print(json.dumps(done, indent=2, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
