"""From raw documents to token ids: five operators, one after another.

Each stage gets what its predecessor kept and returns rows with the columns of documents, the
last one the token ids. An empty table gives an empty one; null texts pass the first three stages,
as nothing in them is rejected, and have no words to be mixed. Columns of any name are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlode.llm import jaccard, mixing, substrings, tokens, toxicity
from cipherlode.runtime import discard, scratch, stored

MIX = mixing.Mix(share=(1, 1), epochs=2)
"""As many tokens as there are; a document is taken twice at most."""


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from this stage's labelled input, rejects go."""
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, lexicon)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word n-grams at 0.8 or more, the one with the smallest id stays.

    Rows without an id come last, by text; of rows that repeat one stays. Rows that share an id but
    aren't linked, null texts and texts without words stay.
    """
    return jaccard.one_of_each(docs, jaccard.similar(docs, 5, jaccard.Threshold(80, 100)))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select("doc_id", "text", *[F.col(c).alias(n) for c, n in names.items()])
    done = substrings.remove_repeats(rows, columns=("kept",), keep=tuple(n for c, n in names.items() if c != "text"))
    changed = {"text": F.col("kept")}
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(kind)).otherwise(F.col(names["n_chars"]))
    return done.select(*[changed.get(c, F.col(n)).alias(c) for c, n in names.items()])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; the documents at the leaves' ends are cut."""
    return mixing.mixed(docs, MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left."""
    return tokens.encode_documents(docs, tokens.default_path(), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_copies), ("substrings", drop_repeats), ("mixing", mix_sources), ("bpe", encode)]

ORACLE_SQL = None  # a learned lexicon and BPE are beyond SQL; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. What a stage has stored on its way, and its predecessor's rows, are removed once its own rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            done = keep(stored(stage(spark, docs, sf_dir), name))
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
