"""Exact duplicates, however large their groups: combined locally, in salts, then globally.

Texts are equal if they are identical without white space. Every step groups by digest and the whole
normalised text, so two texts that shared a digest would stay apart:

* each task combines its own equal texts before anything is sent (Spark's partial aggregation);
* a digest with many rows is merged in SALTS groups, by the task that a row comes from;
* the salts' winners are merged into one.

Digests with many rows are few: each has at least a HOT_MOST-th of all rows. So their list and
their winners can be broadcast, and the rows of a large group never meet in one task. What is kept
of every row in between is its id, length and digests, not its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlode.runtime import stored

WHITE = " \t\n\x0b\x0c\r"
SALTS = 64
HOT_ROWS = 200
"""Digests with fewer rows are never salted."""
HOT_MOST = 20_000
"""At most so many digests are salted: those with this part of all rows, or more."""


def normal(text: Column) -> Column:
    """Text without white space; null as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), WHITE, "")


def _texts(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, n, th, sha, d, norm) of every row: code points, hash of the original text, digests, normalised text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("n"), F.xxhash64(text).alias("th"), normal(text).alias("norm"))
    return rows.withColumn("sha", F.sha2("norm", 256)).withColumn("d", digest(F.col("sha")))


def _winners(texts: DataFrame, hot: DataFrame) -> DataFrame:
    """(d, norm, size, best) of every text: rows, and the longest original with the smallest id."""
    # the complement of an id orders ids downwards and a missing one last
    best = F.max(F.struct("n", F.bitwise_not("doc_id").alias("id"), "th")).alias("best")
    cold = texts.join(F.broadcast(hot), "d", "left_anti").groupBy("d", "norm").agg(F.count("*").alias("size"), best)
    salted = texts.join(F.broadcast(hot), "d", "left_semi").withColumn("salt", F.spark_partition_id() % SALTS)
    salted = salted.groupBy("d", "salt", "norm").agg(F.count("*").alias("size"), best)
    return cold.unionByName(salted.groupBy("d", "norm").agg(F.sum("size").alias("size"), F.max("best").alias("best")))


def duplicates(docs: DataFrame, digest: Callable[[Column], Column] = lambda sha: sha) -> DataFrame:
    """Every row of docs (doc_id, text) with the row of its group that stays.

    Gives doc_id, n_chars, th (xxhash64 of the text), text_sha256, keep_id, group_size, kept and
    repeats: how often the row that stays is there with its id and text. Of equal texts the one with
    most code points stays, then the smallest id; a missing id comes last. Null texts are empty texts,
    and all empty or blank texts are equal. Of rows that repeat id and text, one stays. An empty table gives an
    empty result; other columns of docs, whatever their names, are not looked at.

    digest: what groups are dealt by, made of a text's SHA-256; any function gives the same result.
    """
    texts = _texts(docs, digest)
    facts = stored(texts.select("doc_id", "n", "th", "sha", "d", F.monotonically_increasing_id().alias("row")), "facts")
    least = max(HOT_ROWS, -(-facts.count() // HOT_MOST))
    hot = stored(facts.groupBy("d").agg(F.count("*").alias("rows")).where(F.col("rows") >= least).select("d"), "hot")
    winners = stored(_winners(texts, hot).select("d", "size", "best.*"), "winners")
    # which of a winner's repeated rows it is
    rows = facts.groupBy("d", "doc_id", "n", "th").agg(F.min("row").alias("first"), F.count("*").alias("repeats")).withColumn("id", F.bitwise_not("doc_id"))
    w, r = winners.alias("w"), rows.alias("r")
    same = (F.col("w.d") == F.col("r.d")) & (F.col("w.n") == F.col("r.n")) & (F.col("w.th") == F.col("r.th")) & F.col("w.id").eqNullSafe(F.col("r.id"))
    chosen = w.join(r, same).select("w.d", F.col("r.doc_id").alias("keep_id"), F.col("w.size").alias("group_size"), "first", "repeats")
    several = stored(winners.groupBy("d").agg(F.count("*").alias("texts")).where("texts > 1").select("d"), "several")
    if several.isEmpty():
        chosen, marked = stored(chosen, "chosen"), []
    else:
        marked = [_by_text(texts, facts, hot, several)]
        chosen = stored(chosen.join(several, "d", "left_anti"), "chosen")
        facts = facts.join(several, "d", "left_anti")
    few = F.broadcast(chosen.join(F.broadcast(hot), "d", "left_semi"))
    marked += [facts.join(F.broadcast(hot), "d", "left_semi").join(few, "d"), facts.join(F.broadcast(hot), "d", "left_anti").join(chosen, "d")]
    out = None
    for part in marked:
        part = part.select("doc_id", F.col("n").cast("long").alias("n_chars"), "th", F.col("sha").alias("text_sha256"), "keep_id", "group_size", (F.col("row") == F.col("first")).alias("kept"), "repeats")
        out = part if out is None else out.unionByName(part)
    return out


def _by_text(texts: DataFrame, facts: DataFrame, hot: DataFrame, several: DataFrame) -> DataFrame:
    """Rows whose digest several texts share, joined by the texts themselves."""
    winners = _winners(texts.join(several, "d", "left_semi"), hot)
    owners = texts.join(several, "d", "left_semi").select("d", "doc_id", "n", "th", "norm").distinct().join(winners, ["d", "norm"]).drop("norm")
    f, o = facts.alias("f"), owners.alias("o")
    at = f.join(o, (F.col("f.d") == F.col("o.d")) & (F.col("f.n") == F.col("o.n")) & (F.col("f.th") == F.col("o.th")) & F.col("f.doc_id").eqNullSafe(F.col("o.doc_id"))).select("f.*", "size", "best")
    at = stored(at, "byText")
    first = at.where((F.col("n") == F.col("best.n")) & (F.col("th") == F.col("best.th")) & F.bitwise_not("doc_id").eqNullSafe(F.col("best.id"))).groupBy("d", "size", "best").agg(F.min("row").alias("first"), F.count("*").alias("repeats"))
    a, b = at.alias("a"), first.alias("b")
    same = (F.col("a.d") == F.col("b.d")) & F.col("a.best").eqNullSafe(F.col("b.best"))
    return a.join(b, same).select("a.doc_id", "a.n", "a.th", "a.sha", F.bitwise_not("a.best.id").alias("keep_id"), F.col("a.size").alias("group_size"), "a.row", "b.first", "b.repeats")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    keys = duplicates(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("repeats").alias("_n"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("_i"), F.xxhash64(text).alias("_h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    kept = rows.join(keys, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th")))
    once = kept.where("_n = 1").select("_row").union(kept.where("_n > 1").dropDuplicates(["_i", "_h"]).select("_row"))
    return once.select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its group of equal texts; see duplicates."""
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""with t as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size, row_number() over w = 1 as kept, sha256(norm) as text_sha256
from t window w as (partition by norm order by n desc, doc_id nulls last)"""
