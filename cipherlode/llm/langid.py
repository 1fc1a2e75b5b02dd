"""Language identification by words first, backing off to shorter character n-grams.

A known word adds its log frequency in each language; an unseen word is judged by its
character n-grams of the greatest length of which any is known.

Fitting takes a bounded sample of labelled rows, SAMPLE_ROWS for each language, chosen by hash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlode.llm import flat
from cipherlode.runtime import ship

SAMPLE_ROWS = 4_000
"""About so many labelled rows of each language are learned from, at most."""
LONGEST = 5
CACHE_WORDS = 200_000
UNKNOWN = "und"


class _Letters(dict):
    """str.translate table: letters in lower case, all else white space."""

    def __missing__(self, code: int):
        c = chr(code)
        out = c.lower() if c.isalpha() or "̀" <= c <= "ͯ" else " "
        self[code] = out
        return out


_letters = _Letters()


def words_of(text: str | None) -> list[str]:
    return text.translate(_letters).split() if text else []


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """langs: sorted; words, grams: log frequencies by language; floor: of a word or n-gram that a language lacks."""

    langs: list[str]
    words: dict[str, tuple[float, ...]]
    grams: dict[str, tuple[float, ...]]

    def word(self, w: str) -> tuple[float, ...]:
        known = self.words.get(w)
        if known is not None:
            return known
        for n in range(min(LONGEST, len(w) + 2), 0, -1):
            found = [v for v in (self.grams.get(g) for g in grams(w, n)) if v is not None]
            if found:
                return tuple(sum(column) / len(found) for column in zip(*found))
        return (0.0,) * len(self.langs)


def fit(docs: DataFrame, held_out: str = "pmod(crc32(cast(doc_id as string)), 4) = 2") -> Model:
    """Learn from rows with a text, a language and not held out. Without any, all is `und`."""
    ship(docs.sparkSession)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "cast(lang as string) lang").where(f"text is not null and lang is not null and doc_id is not null and not ({held_out})")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], {}, {})
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, int(1_000_000 * min(1.0, SAMPLE_ROWS / counts[lang])))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, Counter] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tally.setdefault(lang, Counter()).update(words_of(text))
        for lang, seen in tally.items():
            parts: Counter = Counter()
            for w, n in seen.items():
                for size in range(1, LONGEST + 1):
                    for g in grams(w, size):
                        parts[g] += n
            for kind, found in ((0, seen), (1, parts)):
                names = list(found)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(names), pa.int32()), pa.array(names, pa.string()), pa.array([lang] * len(names), pa.string()), pa.array([found[x] for x in names], pa.int64())], names=["kind", "item", "lang", "n"])

    wide = sample.select("text", "lang").mapInArrow(flat.lean(count), "kind int, item string, lang string, n long").groupBy("kind", "item").agg(F.sum("n").alias("total"), *[F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(langs)])
    out = []
    for kind, least in ((0, 2), (1, 3)):
        top = wide.where((F.col("kind") == kind) & (F.col("total") >= least)).toPandas()  # bounded by the sample
        n = top[[f"n{i}" for i in range(len(langs))]].to_numpy(float).reshape(-1, len(langs))
        total = np.maximum(1.0, n.sum(axis=0))
        log = np.log((n + 0.05) / total)
        log -= log.mean(axis=1, keepdims=True)
        out.append(dict(zip(top["item"], map(tuple, log.tolist()))))
    return Model(langs, *out)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row; `und` with score 0 for texts without letters or null ones."""
    spark = ship(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        k = len(own.langs)
        index: dict[str, int] = {}
        rows = np.zeros((CACHE_WORDS, max(1, k)), np.float64)
        for batch in batches:
            lang, score = [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                if not words or not k:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                total = np.zeros(k)
                for lo in range(0, len(words), 50_000):
                    part = words[lo : lo + 50_000]
                    if len(index) + len(part) > CACHE_WORDS:
                        index.clear()
                    at = []
                    for w in part:
                        i = index.get(w)
                        if i is None:
                            i = index[w] = len(index)
                            rows[i] = own.word(w)
                        at.append(i)
                    total += rows[at].sum(axis=0)
                best = int(total.argmax())
                lang.append(own.langs[best])
                score.append(1 / float(np.exp(np.maximum(total - total[best], -700)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(flat.lean(run), "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's language, learned from rows not held out.

    Rows without id aren't held out; texts that are null or have no letters are `und`; rows that repeat get equal rows; an
    empty table gives an empty one.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs)).selectExpr("doc_id", "coalesce(pmod(crc32(cast(doc_id as string)), 4) = 2, false) held_out", "lang_pred", "score")
