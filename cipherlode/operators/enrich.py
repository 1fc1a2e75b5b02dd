"""Enrichment of assets by a code model: candidates, snippets, a cache of distinct ones, merging.

The built-in provider is a rule mock, an expression. Others (operators/providers.py) are functions from a list
of snippets to a list of results, called once for each distinct snippet through Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherlode.functions import classify as C
from cipherlode.operators.providers import failed
from cipherlode.runtime import exists, ship, stored

SNIPPET_CHARS, SNIPPETS, LEAST_CHARS = 2000, 4, 50
MAX_NAMES, MAX_LIBRARIES = 120, 40
ASK_ROWS = 64
"""Snippets that a provider gets at a time."""

# Fixed values of the mock: pattern, algorithm, confidence, post-quantum; a later match wins.
MOCK = (
    ("RSA", "RSA", 0.7, False), ("AES", "AES", 0.7, False), ("SHA-?256", "SHA-256", 0.8, False), ("SHA-?512", "SHA-512", 0.8, False), ("MD5", "MD5", 0.8, False),
    ("kyber|ml-kem", "Kyber/ML-KEM", 0.9, True), ("dilithium|ml-dsa", "Dilithium/ML-DSA", 0.9, True),
)
MOCK_MODE, MOCK_KEY_CONFIDENCE, MOCK_MODE_CONFIDENCE = "GCM/CBC/ECB/CTR", 0.7, 0.6

RESULT = "struct<success:boolean, algorithm:string, key_length:int, mode:string, is_pqc_safe:boolean, confidence:double, error:string>"
ANSWER = f"cache_key string, r {RESULT}"


def either_case(rx: str) -> str:
    """A pattern in any case as the SQL has it: of the letters beyond ASCII, the long s and the Kelvin sign are an s and a k."""
    return "(?i)" + re.sub("[sk]", lambda m: "[s\u017f]" if m[0] in "sS" else "[k\u212a]", rx, flags=re.I)


def signs(code: Column) -> Column:
    """Which of the mock's patterns a snippet has: each is tested once."""
    has = lambda rx: F.rlike(code, F.lit(either_case(rx)))
    named = [has(rx).alias(f"p{i}") for i, (rx, *_) in enumerate(MOCK)]
    return F.struct(*named, has(r"[0-9]{3,4}(bit|-bit)").alias("keyed"), has("gcm|cbc|ecb|ctr").alias("moded"))


def mock(code: Column, sign: Column) -> Column:
    """The mock's result for a snippet with its signs, a blank one's, too."""
    p = [sign[f"p{i}"] for i in range(len(MOCK))]
    late = list(zip(p, MOCK))[::-1]
    algorithm = C.first_of(*[(has, a) for has, (_, a, _, _) in late], default="unknown")
    confidence = C.first_of((sign["moded"], F.lit(MOCK_MODE_CONFIDENCE)), (sign["keyed"], F.lit(MOCK_KEY_CONFIDENCE)), *[(has, F.lit(c)) for has, (_, _, c, _) in late], default=0.3)
    key = F.when(sign["keyed"], F.nullif(F.regexp_extract(code, r"(?i)([0-9]{3,4})[\t\n\f\r ]*(bit|bitleng|-bit)", 1), F.lit("")).cast("int"))
    safe = F.lit(False)
    for has, (*_, pqc) in late:
        safe = safe | has if pqc else safe
    null = lambda kind: F.lit(None).cast(kind)
    return F.struct(F.lit(True).alias("success"), algorithm.alias("algorithm"), key.alias("key_length"), F.when(sign["moded"], MOCK_MODE).alias("mode"), safe.alias("is_pqc_safe"), confidence.alias("confidence"), null("string").alias("error"))


def mocked(pieces: DataFrame, refuse_blank: bool = True) -> DataFrame:
    """Adds r (RESULT), the mock's, to rows with a snippet; a blank one fails, as with any provider, or gets what the mock says of it."""
    code, null = F.col("snippet"), lambda kind: F.lit(None).cast(kind)
    r = mock(code, F.col("_signs"))
    if refuse_blank:
        fail = F.struct(F.lit(False).alias("success"), null("string").alias("algorithm"), null("int").alias("key_length"), null("string").alias("mode"), F.lit(False).alias("is_pqc_safe"), F.lit(0.0).alias("confidence"), F.lit("empty snippet").alias("error"))
        r = F.when(F.coalesce(C.strip(code), F.lit("")) == "", fail).otherwise(r)
    return pieces.withColumn("_signs", signs(code)).withColumn("r", r).drop("_signs")


def parse_reply(text: Column) -> Column:
    """The JSON object in a model's reply (from the first brace to the last), or a failure."""
    block = F.regexp_extract(text, r"\{[\s\S]*\}", 0)
    v = F.when(C.is_json(F.nullif(block, F.lit(""))), F.try_parse_json(block))
    get = lambda path, kind: F.try_variant_get(v, f"$.{path}", kind)
    ok = v.isNotNull()
    return F.struct(
        ok.alias("success"), get("algorithm", "string").alias("algorithm"), get("key_length", "int").alias("key_length"), get("mode", "string").alias("mode"),
        F.when(ok, F.coalesce(get("is_pqc_safe", "boolean"), F.lit(False))).alias("is_pqc_safe"), F.when(ok, F.coalesce(get("confidence", "double"), F.lit(0.5))).alias("confidence"),
    )


def chunks(files: DataFrame, size: int = SNIPPET_CHARS) -> DataFrame:
    """(file_id, chunk, snippet): the text in pieces of a fixed size; no rows for empty texts."""
    n = F.ceil(F.length("content") / size).cast("int")
    pieces = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("content"), i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    return files.select("file_id", F.posexplode(pieces).alias("chunk", "snippet"))


def snippets(files: DataFrame, most: int = SNIPPETS) -> DataFrame:
    """The first chunks of each file that are long enough."""
    return chunks(files).where((F.col("chunk") < most) & (F.length(C.strip(F.col("snippet"))) >= LEAST_CHARS))


def cache_key(snippet: Column, provider: str = "mock", model: str = "rules") -> Column:
    return F.sha2(F.concat(F.lit(f"{provider}|{model}|"), snippet), 256)


def asked(provider: Callable[[list[str]], list[dict]], snippets: list[str]) -> list[dict]:
    """A provider's answers: blank snippets fail without being asked, and so does what the provider raises for, alone."""
    out: list = [failed("empty snippet")] * len(snippets)
    full = [i for i, s in enumerate(snippets) if s and s.strip()]
    try:
        answers = provider([snippets[i] for i in full]) if full else []
    except Exception as first:
        answers = []
        for i in full:
            try:
                answers += provider([snippets[i]]) if len(full) > 1 else [failed(f"{type(first).__name__}: {first}")]
            except Exception as e:
                answers.append(failed(f"{type(e).__name__}: {e}"))
    for i, answer in zip(full, answers):
        out[i] = answer
    return out


def _asking(snippets: DataFrame, provider: Callable[[list[str]], list[dict]]) -> DataFrame:
    """(cache_key, r) of rows (cache_key, snippet)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("success", pa.bool_()), ("algorithm", pa.string()), ("key_length", pa.int32()), ("mode", pa.string()), ("is_pqc_safe", pa.bool_()), ("confidence", pa.float64()), ("error", pa.string())])
        for batch in batches:
            for at in range(0, batch.num_rows, ASK_ROWS):
                part = batch.slice(at, ASK_ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(asked(provider, part.column(1).to_pylist()), kind)], names=["cache_key", "r"])

    return snippets.select("cache_key", "snippet").mapInArrow(run, ANSWER)


def analyse(pieces: DataFrame, provider: Callable[[list[str]], list[dict]] | None = None, cache: str | None = None, tasks: int = 8) -> DataFrame:
    """Adds r (RESULT) to rows with a snippet; without a provider, the mock's.

    A provider sees each distinct snippet once, from `tasks` tasks at a time. cache: a table that is kept between
    runs; what it holds for this provider and model isn't asked again. Successful answers are appended to it, one
    for each key; where two runs have asked for one key at once, either answer is taken.
    """
    if provider is None:
        return mocked(pieces)
    spark = ship(pieces.sparkSession)
    keyed = pieces.withColumn("cache_key", cache_key(F.col("snippet"), getattr(provider, "provider", "custom"), getattr(provider, "model", "custom")))
    new = keyed.where("cache_key is not null").groupBy("cache_key").agg(F.first("snippet").alias("snippet"))
    if cache is None:
        answers = _asking(new.repartition(tasks), provider)
    else:
        known = spark.read.schema(ANSWER).parquet(cache).dropDuplicates(["cache_key"]) if exists(spark, cache) else spark.createDataFrame([], ANSWER)
        known = stored(known.join(new.select("cache_key"), "cache_key", "left_semi"), "known")  # the table is appended to below
        fresh = stored(_asking(new.join(known, "cache_key", "left_anti").repartition(tasks), provider), "answers")
        fresh.where("r.success").coalesce(1).write.mode("append").parquet(cache)
        answers = known.unionByName(fresh)
    return keyed.join(answers, "cache_key", "left").drop("cache_key")


def candidates(assets: DataFrame, symbols: DataFrame, threshold: float) -> DataFrame:
    """file_id of files worth a model's look: weak or generic assets, or eight symbols and more."""
    if threshold <= 0:
        return assets.select("file_id").distinct()
    name = F.lower("algorithm")
    weak = assets.groupBy("file_id").agg(F.max(((F.col("confidence") <= threshold) | C.any_of(name, "generic", "unknown")).cast("int")).alias("weak"))
    many = symbols.groupBy("file_id").agg(F.count("*").alias("n"))
    return weak.join(many, "file_id", "left").where("weak = 1 or n >= 8").select("file_id")


def upsert(assets: DataFrame, answers: DataFrame, source: str = "source-code") -> DataFrame:
    """Merge a file's answers into its assets, in the order of chunks.

    A known algorithm gets the greater confidence, the last key length, a mode if it had none and
    the post-quantum flag if any answer has it; others become new assets of medium risk.
    """
    good = answers.where("r.success and coalesce(r.algorithm, '') <> ''").select("file_id", F.col("r.algorithm").alias("algorithm"), "chunk", "r")
    key = F.when(F.coalesce(F.col("r.key_length"), F.lit(0)) != 0, F.col("chunk"))
    mode = F.when(F.coalesce(F.col("r.mode"), F.lit("")) != "", F.col("chunk"))
    folded = good.groupBy("file_id", "algorithm").agg(F.max("r.confidence").alias("_c"), F.max_by("r.key_length", key).alias("_k"), F.min_by("r.mode", mode).alias("_m"), F.max("r.is_pqc_safe").alias("_p"))
    joined = assets.select("file_id", "algorithm", "confidence", "key_length", "mode", "is_pqc_safe", F.lit("static").alias("source")).join(folded, ["file_id", "algorithm"], "full")
    new = F.col("source").isNull()
    return joined.select(
        "file_id", "algorithm", F.greatest("confidence", "_c").alias("confidence"), F.coalesce("_k", "key_length").alias("key_length"), F.when(F.coalesce("mode", F.lit("")) == "", F.coalesce("_m", "mode")).otherwise(F.col("mode")).alias("mode"),
        (F.coalesce("is_pqc_safe", F.lit(False)) | F.coalesce("_p", F.lit(False))).alias("is_pqc_safe"), F.when(new, source).otherwise(F.col("source")).alias("source"), F.when(new, "medium").otherwise(C.risk_level(C.final_risk(F.col("algorithm")))).alias("risk_level"),
    )


def first_seen(rows: DataFrame, key: str, value: str, place: str, most: int) -> DataFrame:
    """(key, values): each key's distinct values in the order in which they come first, at most so many.

    Repeated values are merged before they are sent, and no more than `most` of them meet for a key.
    """
    one = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(place).alias("_at"))
    kept = one.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy("_at", value))).where(F.col("_k") <= most)
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_k", F.col(value).alias("v")))).alias("values")).select(key, F.transform("values", lambda x: x["v"]).alias("values"))


def binary_prompts(symbols: DataFrame) -> DataFrame:
    """(file_id, chunk, snippet): what a model gets of each binary with a library or a known symbol; no row for others.

    symbols: file_id, path, kind (library, symbol, import or export), name, at (order of detection) and
    algorithm, null where the tables don't know the name.
    """
    libraries = first_seen(symbols.where("kind = 'library'"), "file_id", "name", "at", MAX_LIBRARIES).withColumnRenamed("values", "libraries")
    names = first_seen(symbols.where("kind <> 'library' and algorithm is not null"), "file_id", "name", "at", MAX_NAMES).withColumnRenamed("values", "names")
    paths = symbols.groupBy("file_id").agg(F.min("path").alias("path"))
    listed = lambda c: F.coalesce(F.array_join(c, ", "), F.lit("none"))
    snippet = F.concat(F.lit("Binary file: "), F.element_at(F.split("path", "/"), -1), F.lit("\nDetected libraries: "), listed("libraries"), F.lit("\nDetected symbol names:\n"), listed("names"))
    return libraries.join(names, "file_id", "full").join(paths, "file_id").select("file_id", F.lit(0).alias("chunk"), snippet.alias("snippet"))
