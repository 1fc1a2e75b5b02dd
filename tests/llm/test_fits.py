"""What the language and toxicity models learn, against plain counting of the same rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cipherlode.llm import langid, toxicity


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_language_frequencies_equal_plain_counts(docs):
    rows = [(r.lang, r.text) for r in docs.collect() if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    model = langid.fit(docs)
    langs = sorted({lang for lang, _ in rows})
    assert model.langs == langs
    words = {lang: Counter(w for x, text in rows if x == lang for w in langid.words_of(text)) for lang in langs}
    grams = {lang: Counter() for lang in langs}
    for lang in langs:
        for w, n in words[lang].items():
            for size in range(1, langid.LONGEST + 1):
                for i in range(len(w) + 2 - size + 1):
                    grams[lang][f"<{w}>"[i : i + size]] += n
    for got, seen, least in ((model.words, words, 2), (model.grams, grams, 3)):
        total = sum(seen.values(), Counter())
        kept = [x for x, n in total.items() if n >= least]
        assert set(got) == set(kept) and len(kept) > 100
        size = {lang: max(1, sum(seen[lang][x] for x in kept)) for lang in langs}
        for x in kept:
            log = [math.log((seen[lang][x] + 0.05) / size[lang]) for lang in langs]
            mean = sum(log) / len(log)
            assert all(abs(a - (b - mean)) < 1e-9 for a, b in zip(got[x], log))


def plain_lexicon(rows):
    """(weights, exceptions) of rows (words, toxic): log-odds with a bound, and pairs that only clean texts have."""
    n = Counter(toxic for _, toxic in rows)
    seen = Counter((p, toxic) for words, toxic in rows for p in {p for w in words for p in toxicity.patterns(w)})
    weights = {}
    for p in {p for p, _ in seen}:
        t, c = seen[p, 1], seen[p, 0]
        if t < toxicity.MIN_TOXIC:
            continue
        share = n[1] / max(1, n[0] + n[1])
        g2 = 2 * (t * math.log(t / ((t + c) * share)) + (c * math.log(c / ((t + c) * (1 - share))) if c else 0.0))
        raw = math.log((t + 0.1) / (n[1] + 0.2)) - math.log((c + 0.1) / (n[0] + 0.2))
        weight = math.log((t + 0.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1)) - toxicity.SHRINK * math.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        if raw >= toxicity.MIN_ODDS and g2 >= toxicity.MIN_G2 and weight > 0:
            weights[p] = weight
    return weights


def exceptions(rows, known):
    """Neighbours of a word that an entry matches, as a whole or at its beginning, which clean texts have and toxic ones don't."""
    matched = lambda w: f" {w} " in known or any(f" {w[:n]}" in known for n in toxicity.PREFIXES if len(w) >= n)
    pairs = Counter()
    for _, words, toxic in rows:
        mine = set()
        for a, b in zip(words, words[1:]):
            if matched(a) or matched(b):
                mine.add((a, b))
        pairs.update((p, toxic) for p in mine)
    return {p for p, t in pairs if t == 0 and pairs[p, 0] >= toxicity.MIN_CLEAN and not pairs[p, 1]}


def test_lexicon_equals_plain_counts(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    toxic = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id is not None and r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    folds = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(toxicity.FOLDS)).alias("f")).collect()}
    rows = [(r.doc_id, toxicity.fold(r.text).split(), toxic[r.doc_id]) for r in docs.collect() if r.doc_id in toxic and r.text is not None]
    parts = [[f for f in range(toxicity.FOLDS) if f != k] for k in range(toxicity.FOLDS)] + [list(range(toxicity.FOLDS))]
    lexicons = [plain_lexicon([(w, t) for i, w, t in rows if folds[i] in part]) for part in parts]
    model = toxicity.fit(docs, labels)
    assert model.weights.keys() == lexicons[-1].keys() and len(model.weights) > 5
    assert all(abs(model.weights[p] - w) < 1e-9 for p, w in lexicons[-1].items())
    # pairs with a word that any of the lexicons has, in clean texts only
    known = {p for x in lexicons for p in x}
    assert model.exceptions == exceptions(rows, known)
    # each row's features by the lexicon of the other parts
    others = [exceptions([r for r in rows if folds[r[0]] != k], known) for k in range(toxicity.FOLDS)]
    x, y = [], []
    for i, words, t in rows:
        own = toxicity.Lexicon(lexicons[folds[i]], others[folds[i]])
        folded = f" {' '.join(words)} "
        x.append(toxicity.features(toxicity.hits(folded, own.matcher(), own.exceptions), folded))
        y.append(t)
    assert np.allclose(toxicity._logistic(np.array(x), np.array(y, float)), model.model, atol=1e-6)
