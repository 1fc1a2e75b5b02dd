"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding makes look-alike letters and digit substitutions plain (a Cyrillic or full-width letter
becomes the Latin one, `1d10t` becomes `idiot`) and everything else white space. The lexicon has
whole words and word beginnings with the log-odds of toxic labels; a hit inside an exception
phrase (a pair of neighbouring words that labels show to be harmless) doesn't count. The hits'
weights, their sum normalised by length and the strongest one give a logistic score.

Fitting takes a bounded sample of labelled rows, SAMPLE_ROWS for each label, chosen by hash. The
lexicon comes from all of them; the score is fitted on each row's features by a lexicon that
comes from the other FOLDS - 1 parts, so no row vouches for its own words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlode.llm import flat
from cipherlode.runtime import ship

SAMPLE_ROWS = {0: 24_000, 1: 12_000}
"""At most about so many labelled rows of each label are learned from."""
MIN_TOXIC, MIN_CLEAN = 2, 3
"""Toxic texts that an entry needs, and clean ones that an exception needs."""
MIN_G2 = 6.63
"""Log-likelihood ratio that label and entry are independent, the 1 % level; the same at every size."""
MIN_ODDS = 2.5
SHRINK = 1.64
"""An entry's weight is its log-odds less so many standard errors: few texts give little weight."""
FOLDS = 3
PREFIXES = range(4, 9)
THRESHOLD = 0.7

# Look-alike letters and digit substitutions, and the letters they stand for.
LOOKALIKES = dict(zip("авекмнорстухіјѕԁɡαβεικνορτυχ", "abekmhopctyxijsdgabeiknoptux"))
SUBSTITUTES = dict(zip("013457", "oieast"))
# Signs that stand for letters inside a word; elsewhere they are punctuation.
SIGNS = dict(zip("@$!|", "asii"))
_sign = re.compile(r"(?<=\w)[@$!|](?=\w)").sub


class _Fold(dict):
    """str.translate table; a character is looked into once."""

    def __missing__(self, code: int):
        c = unicodedata.normalize("NFKC", chr(code)).lower()
        c = "".join(SUBSTITUTES.get(x, LOOKALIKES.get(x, x)) for x in c)
        out = c if c and all(x.isalpha() for x in c) else " "
        self[code] = out
        return out


_fold = _Fold()


def fold(text: str) -> str:
    """Folded words, one space around each."""
    if any(c in text for c in SIGNS):
        text = _sign(lambda m: SIGNS[m[0]], text)
    return f" {' '.join(text.translate(_fold).split())} "


def patterns(word: str) -> Iterator[str]:
    yield f" {word} "
    for n in PREFIXES:
        if len(word) > n:
            yield f" {word[:n]}"


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: set[tuple[str, str]] = field(default_factory=set)
    model: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)

    def matcher(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        a = ahocorasick.Automaton()
        for p, w in self.weights.items():
            a.add_word(p, (len(p), w))
        a.make_automaton()
        return a


def hits(folded: str, matcher, exceptions) -> list[tuple[str, str, str, float]]:
    """(word before, word, word after, weight) of each word that the lexicon has, the weightiest entry of each."""
    best: dict[int, float] = {}
    if matcher is not None:
        for end, (size, weight) in matcher.iter(folded):
            at = end - size + 1
            if weight > best.get(at, 0.0):
                best[at] = weight
    out = []
    for at, weight in sorted(best.items()):
        end = folded.find(" ", at + 1)
        word = folded[at + 1 : end]
        before = folded[folded.rfind(" ", 0, at) + 1 : at] if at else ""
        after = folded[end + 1 : folded.find(" ", end + 1)] if end + 1 < len(folded) else ""
        if (before, word) not in exceptions and (word, after) not in exceptions:
            out.append((before, word, after, weight))
    return out


def features(found: list, folded: str) -> tuple[float, float, float]:
    """Strongest hit, the hits' squares together, and these for each hundred words: many weak hits of a long text count little."""
    if not found:
        return 0.0, 0.0, 0.0
    total = sum(x[3] * x[3] for x in found)
    return max(x[3] for x in found), math.log1p(total), math.log1p(100 * total / (20 + folded.count(" ")))


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Training rows (doc_id, text, toxic, fold): labelled, not held out, a bounded number."""
    seen = labels.selectExpr("cast(doc_id as long) doc_id", "cast(toxic as int) toxic").where("doc_id is not null and toxic in (0, 1) and pmod(crc32(cast(doc_id as string)), 3) <> 1")
    counts = {r["toxic"]: r["n"] for r in seen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for label, n in counts.items():
        keep = keep | ((F.col("toxic") == label) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE_ROWS[label] / n))))
    chosen = seen.where(keep).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").where("text is not null")
    # chosen has at most about sum(SAMPLE_ROWS) rows of 12 bytes, whatever the input
    return rows.join(F.broadcast(chosen), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int"))


def _sum(names: list[str]) -> Column:
    total = F.lit(0).cast("long")
    for n in names:
        total = total + F.col(n)
    return total


def _entry(toxic: Column, clean: Column, n1: int, n0: int) -> Column:
    """The weight of an entry in so many of n1 toxic and n0 clean texts, or null: one rule at every size."""
    share, seen = n1 / max(1, n1 + n0), toxic + clean
    g2 = 2 * (toxic * F.log(toxic / (seen * share)) + F.when(clean > 0, clean * F.log(clean / (seen * (1 - share)))).otherwise(0.0))
    odds = F.log((toxic + 0.5) / (n1 + 1.0)) - F.log((clean + 0.5) / (n0 + 1.0))
    raw = F.log((toxic + 0.1) / (n1 + 0.2)) - F.log((clean + 0.1) / (n0 + 0.2))
    weight = odds - SHRINK * F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    return F.when((toxic >= MIN_TOXIC) & (raw >= MIN_ODDS) & (g2 >= MIN_G2) & (weight > 0), weight)


def fit(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Learn lexicon and exceptions from the sample, the score from it part by part.

    Rows held out by crc32(doc_id) mod 3 = 1, unlabelled rows and null texts teach nothing.
    With too few toxic rows the lexicon is empty and every score is low.
    """
    spark = ship(docs.sparkSession)
    sample = _sample(docs, labels)
    counts = [f"{kind}{f}" for kind in ("c", "t") for f in range(FOLDS)]  # clean and toxic texts by fold

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic, fold_ in zip(*(c.to_pylist() for c in batch.columns)):
                for p in {p for w in set(fold(text).split()) for p in patterns(w)}:
                    tally.setdefault(p, [0] * len(counts))[toxic * FOLDS + fold_] += 1
        columns = zip(*tally.values()) if tally else [()] * len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], names=["p", *counts])

    n = dict.fromkeys(counts, 0)
    for r in sample.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect():
        n[f"{'ct'[r['toxic']]}{r['fold']}"] = r["n"]
    table = sample.select("text", "toxic", "fold").mapInArrow(flat.lean(count), "p string, " + ", ".join(f"{c} long" for c in counts)).groupBy("p").agg(*[F.sum(c).alias(c) for c in counts])
    parts = [[f for f in range(FOLDS) if f != k] for k in range(FOLDS)] + [list(range(FOLDS))]  # the last one is the whole
    entries = [_entry(_sum([f"t{f}" for f in part]), _sum([f"c{f}" for f in part]), sum(n[f"t{f}"] for f in part), sum(n[f"c{f}"] for f in part)).alias(f"w{k}") for k, part in enumerate(parts)]
    rows = table.where(_sum([f"t{f}" for f in range(FOLDS)]) >= MIN_TOXIC).select("p", *entries).where(" or ".join(f"w{k} is not null" for k in range(FOLDS + 1))).collect()  # bounded by the sample
    lexicons = [Lexicon({r["p"]: r[f"w{k}"] for r in rows if r[f"w{k}"] is not None}) for k in range(FOLDS + 1)]
    sent = spark.sparkContext.broadcast({r["p"]: 1.0 for r in rows})

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Lexicon(sent.value).matcher()
        for batch in batches:
            out: list[tuple[str, str, int, int]] = []
            for text, toxic, fold_ in zip(*(c.to_pylist() for c in batch.columns)):
                pairs = set()
                for before, word, after, _ in hits(fold(text), matcher, ()):
                    pairs |= {(before, word), (word, after)}
                out += [(a, b, toxic, fold_) for a, b in pairs if a and b]
            columns = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32()))], names=["a", "b", "toxic", "fold"])

    pairs = sample.select("text", "toxic", "fold").mapInArrow(flat.lean(look), "a string, b string, toxic int, fold int").groupBy("a", "b").agg(*[F.count(F.when((F.col("fold") == f) & (F.col("toxic") == y), 1)).alias(f"{'ct'[y]}{f}") for y in (0, 1) for f in range(FOLDS)])
    harmless = [((_sum([f"t{f}" for f in part]) == 0) & (_sum([f"c{f}" for f in part]) >= MIN_CLEAN)).alias(f"x{k}") for k, part in enumerate(parts)]
    for r in pairs.select("a", "b", *harmless).where(" or ".join(f"x{k}" for k in range(FOLDS + 1))).collect():
        for k, lexicon in enumerate(lexicons):
            if r[f"x{k}"]:
                lexicon.exceptions.add((r["a"], r["b"]))
    rest = spark.sparkContext.broadcast(lexicons[:FOLDS])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(x.matcher(), x.exceptions) for x in rest.value]
        for batch in batches:
            found = []
            for text, fold_ in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                folded = fold(text)
                found.append(features(hits(folded, *own[fold_]), folded))
            x = np.array(found, float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, k]) for k in range(3)] + [batch.column(1)], names=["x0", "x1", "x2", "y"])

    # three numbers for each row of the bounded sample
    seen = sample.select("text", "toxic", "fold").mapInArrow(flat.lean(measure), "x0 double, x1 double, x2 double, y int").toPandas()
    lexicons[-1].model = _logistic(seen[["x0", "x1", "x2"]].to_numpy(), seen["y"].to_numpy(float))
    return lexicons[-1]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton's method with a small penalty, over rows in a fixed order; a feature that would speak against toxicity is left out."""
    if not len(y) or not y.sum():
        return (-3.0, 0.0, 0.0, 0.0)
    order = np.lexsort((y, *x.T))
    x, y = np.column_stack([np.ones(len(y)), x])[order], y[order]
    used = [0, 1, 2, 3]
    while True:
        part, w, penalty = x[:, used], np.zeros(len(used)), np.diag([1e-3, 0.1, 0.1, 0.1])[np.ix_(used, used)]
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            step = np.linalg.solve((part * (p * (1 - p))[:, None]).T @ part + penalty, part.T @ (y - p) - penalty @ w)
            w = w + step
            if np.abs(step).max() < 1e-8:
                break
        if len(used) == 1 or w[1:].min() >= 0:
            break
        used.pop(1 + int(w[1:].argmin()))
    out = dict(zip(used, w.tolist()))
    return tuple(out.get(k, 0.0) for k in range(4))


SCORES = "score double, n_hits long"


def score_and_hits(text: str | None, lexicon: Lexicon, matcher) -> tuple[float, int]:
    folded = fold(text or "")
    found = hits(folded, matcher, lexicon.exceptions)
    z = sum(w * x for w, x in zip(lexicon.model, (1.0, *features(found, folded))))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), len(found)


def score_of(text: str | None, lexicon: Lexicon, matcher) -> float:
    return score_and_hits(text, lexicon, matcher)[0]


def score_texts(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of every row, its score and number of hits; null text counts as empty."""
    spark = ship(docs.sparkSession)
    sent = spark.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        matcher = own.matcher()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            score, n = [], []
            for text in texts:
                s, k = score_and_hits(text.as_py(), own, matcher)
                score.append(s)
                n.append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64()), pa.array(n, pa.int64())], names=[*batch.schema.names[:-1], "score", "n_hits"])

    kept = docs.select(*keep, F.col("text").cast("string").alias("_scored"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), SCORES])
    return kept.mapInArrow(flat.lean(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's score by a lexicon learned from the labels of rows not held out.

    Rows without id teach nothing and aren't held out; null and empty texts get the score of a text without hits; rows
    that repeat get equal rows; an empty table gives an empty one.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lexicon = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_texts(docs, lexicon).selectExpr("doc_id", "coalesce(pmod(crc32(cast(doc_id as string)), 3) = 1, false) held_out", "score", f"cast(score >= {THRESHOLD} as int) predicted", "n_hits")


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below threshold, whole; needs a text column, any others stay as they are."""
    spark = ship(docs.sparkSession)
    sent, at = spark.sparkContext.broadcast(lexicon), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        matcher = own.matcher()
        for batch in batches:
            yield batch.filter(pa.array([score_of(t.as_py(), own, matcher) < threshold for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(flat.lean(run), docs.schema)
