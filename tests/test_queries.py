"""Every query with SQL against DuckDB, on the smallest tables."""

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

import cipherlode.registry as registry

NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, numbers.Number) else str(v)
    return sorted([tuple(plain(v) for v in r) for r in frame.itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", [n for n in NAMES if n in ("x01_scan_hits", "a06_repository_summary", "c10_labels", "c12_decisions", "a03_bom_summary", "t01_instructions", "w03_rolling", "x14_mock", "s01_profile_files", "c22_chunks", "k07_batch_summary", "k09_asset_lines", "a04_report", "a02_file_names", "t07_failures", "j12_upsert", "f20_label_rows", "s10_decode_all", "c12_quality_scores", "c18_normal_name", "c32_github_urls", "o06_first_evidence", "w09_last_week", "x09_context", "s10_decode", "f17_risk_references", "s01_repository_rows", "c24_binary_prompts", "o05_names", "c12_quality_bounds", "f21_decision_table", "f22_algorithm_table", "c21_merged_maps", "c28_outcomes", "c29_fit_bands", "c30_example_bands", "o03_limited_files", "o04_snippets")])
def test_query_equals_sql(spark, sf, duck, name):
    got, want = registry.queries()[name](spark, sf).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark, sf):
    assert registry.entry(spark, sf).count() > 0
