"""Writers: bills of materials, labels, instruction sets, summaries and asset tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cipherlode.runtime import move, remove, ship, stored
from cipherlode.sources.reader import opened

KEEP_NULLS = {"ignoreNullFields": "false"}


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object for each row, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), KEEP_NULLS).alias("value"))


JSON_LINES = {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"}


def write_jsonl(df: DataFrame, path: str) -> int:
    """JSON lines, ASCII only; returns how many, counted while they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").options(**JSON_LINES).json(path)
    return seen.get["n"]


def write_sets(records: DataFrame, sets: str, paths: dict[str, str]) -> dict[str, int]:
    """JSON lines in a folder for each set, in one pass: a record goes to every set named in its column `sets`, which isn't written.

    Returns each set's number of records, counted while they are written. A set without records is an empty folder.
    """
    spark, top = records.sparkSession, next(iter(paths.values())) + "_parts"
    seen = Observation()
    rows = records.withColumn("_set", F.explode(sets)).drop(sets).where(F.col("_set").isin(*paths))
    counts = [F.count(F.when(F.col("_set") == name, 1)).alias(name) for name in paths]
    rows.observe(seen, *counts).write.mode("overwrite").partitionBy("_set").options(**JSON_LINES).json(top)
    for name, path in paths.items():
        move(spark, f"{top}/_set={name}", path)
    remove(spark, top)
    return {name: seen.get[name] for name in paths}


def write_files(rows: DataFrame, folder: str) -> int:
    """A file for each row (path, content as bytes) below a folder on any file system that Arrow opens; returns how many.

    A task that runs again writes the same files again.
    """
    ship(rows.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = opened(folder)
        known: set[str] = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parent = f"{top}/{path}".rpartition("/")[0]
                if parent not in known:
                    system.create_dir(parent, recursive=True)
                    known.add(parent)
                with system.open_output_stream(f"{top}/{path}") as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select("path", "content").mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_document(rows: DataFrame, path: str, head: str = "[", tail: str = "]") -> None:
    """Rows of JSON (value) between two texts, separated by commas: part files that, one after another, are one document.

    However many rows there are, no task gets more than its own.
    """
    spark = rows.sparkSession
    table = stored(rows.select("value"), "document").withColumn("at", F.monotonically_increasing_id())
    least = table.agg(F.min("at")).first()[0]
    body = table.select(F.when(F.col("at") == F.lit(least), F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"))
    edge = lambda text: spark.createDataFrame([(text,)], "value string").coalesce(1)
    edge(head).union(body).union(edge(tail)).write.mode("overwrite").text(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """Rows as one JSON array."""
    write_document(as_json(df), path)


def write_bom(head: dict, assets: DataFrame, path: str) -> None:
    """A bill of materials: the entries of head, then its assets."""
    text = json.dumps(head, ensure_ascii=False)
    write_document(as_json(assets), path, f'{text[:-1]}, "crypto_assets": [', "]}")


def read_document(spark: SparkSession, path: str) -> str:
    """The text that write_document wrote; for documents that one machine can hold."""
    rows = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).collect()
    return "\n".join(r["value"] for r in sorted(rows, key=lambda r: (r["file"], r["at"])))


# Fixed value: the header of the asset table.
ASSET_HEADER = "Algoritma,Tür,Anahtar Uzunluğu,PQC,Risk Skoru,Seviye"


def asset_lines(assets: DataFrame) -> DataFrame:
    """(value) a line for each asset (algorithm, primitive_type, key_length, is_pqc_safe, risk, risk_level), unquoted; a missing or zero key length is N/A."""
    key = F.coalesce(F.nullif(F.col("key_length"), F.lit(0)).cast("string"), F.lit("N/A"))
    return assets.select(F.concat_ws(",", "algorithm", "primitive_type", key, F.initcap(F.col("is_pqc_safe").cast("string")), F.format_string("%.1f", F.col("risk")), "risk_level").alias("value"))


def write_asset_csv(assets: DataFrame, path: str) -> None:
    """The asset table with its header: part files that, one after another, are one file."""
    header = assets.sparkSession.createDataFrame([(ASSET_HEADER,)], "value string").coalesce(1)
    header.union(asset_lines(assets)).write.mode("overwrite").text(path)
