"""The pipeline's stages against brute force, each on its own input."""

import hashlib
import pathlib

import pytest

import __spark_entry__
import corpus_pipeline
from cipherlode import runtime
from cipherlode.llm import tokens, toxicity


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "substrings", "mixing", "bpe"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf).cache())
    return out


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:-1])


def test_toxic_documents_go(spark, sf, stages):
    lexicon = toxicity.fit(stages[0], spark.read.parquet(f"{sf}/labels.parquet"))
    m = lexicon.matcher()
    assert rows(stages[1]) == [(i, t) for i, t in rows(stages[0]) if toxicity.score_of(t, lexicon, m) < toxicity.THRESHOLD]


def test_one_of_each_group_stays(stages):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())

    docs = rows(stages[1])
    sets, root = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            o = len(sets[i] & sets[j]) if i < j else 0
            if o and 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert rows(stages[2]) == [(i, t) for i, t in docs if find(i) == i]


def test_repeats_are_cut(stages):
    first, words = {}, {i: t.encode().split() for i, t in rows(stages[2])}
    for i, w in words.items():
        for j in range(len(w) - 49):
            first.setdefault(b" ".join(w[j : j + 50]), i)
    got = dict(rows(stages[3]))
    for i, w in words.items():
        gone = {x for j in range(len(w) - 49) if first[b" ".join(w[j : j + 50])] < i for x in range(j, j + 50)}
        assert got[i].encode().split() == [x for j, x in enumerate(w) if j not in gone]


def test_mixture_has_the_budget(stages):
    size = lambda t: len((t or "").encode().split())
    before = dict(rows(stages[3]))
    after = rows(stages[4])
    assert sum(size(t) for _, t in after) == sum(map(size, before.values()))
    assert all(before[i].encode().split()[: size(t)] == t.encode().split() for i, t in after)


def test_ids(stages):
    with open(tokens.default_path(), "rb") as f:
        own = tokens.Encoder(tokens.Vocabulary(f.read()))
    want = sorted((i, own.encode(t)[0]) for i, t in rows(stages[4]))
    got = stages[5].collect()
    assert sorted((r.doc_id, " ".join(map(str, r.ids))) for r in got) == want
    assert all(r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() for r in got)


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, th string, c int, m_tokens string, spans string, kept string, k_text string, _row string, score double"
TEXTS = ["alpha beta gamma delta epsilon zeta eta theta", "alpha beta gamma delta epsilon zeta eta theta", "quite another text that is linked with nothing at all", None, "", " \n ", "Ünïcode wörds ÄÖ ß 日本 end of it", "x"]


def edge_rows():
    return [(1 if i in (0, 2) else None if i in (1, 4) else i, t, None if i % 2 else "en", "src1" if i % 3 else None, None if t is None else len(t), "a", i, "b", "c", "d", "e", "f", 0.5) for i, t in enumerate(TEXTS)]


def test_stages_take_nulls_repeats_and_clashing_columns(spark, sf):
    docs = spark.createDataFrame(edge_rows(), EXTRA).repartition(3)
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, sf)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        got = sorted(map(str, out.select("doc_id", "text", "th", "c", "m_tokens", "spans", "kept", "k_text", "_row").collect()))
        if name == "ngram_join":  # one of the two equal texts; the two texts of id 1 aren't linked
            rows = sorted((str(r.doc_id), str(r.text)) for r in out.collect())
            assert rows == sorted((str(r[0]), str(r[1])) for i, r in enumerate(edge_rows()) if i != 1)
        assert got
    last = corpus_pipeline.STAGES[-1][1](spark, out, sf)
    words = lambda rows: sum(len((r or "").split()) for r in rows)
    assert last.count() == out.count() and words(r.text for r in out.collect()) == words(t for i, t in enumerate(TEXTS) if i != 1)


def test_stages_of_an_empty_table(spark, sf):
    out = spark.createDataFrame([], EXTRA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf)
        assert out.count() == 0


def test_pipeline_keeps_texts_that_share_an_id(spark, sf):
    docs = spark.createDataFrame([(1, "one two three four five six", "en", "src0", 27), (1, "seven eight nine ten eleven twelve", "en", "src0", 34)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.drop_copies(spark, docs, sf).count() == 2


def test_run_equals_the_stages(spark, sf, stages):
    """The same rows; of what the stages have stored only the last table that is still read is left."""
    work = pathlib.Path(runtime.work_folder(spark).removeprefix("file://"))
    before = set(work.iterdir())
    done = corpus_pipeline.run(spark, sf)
    assert len(set(work.iterdir()) - before) == 1
    rows = lambda df: sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in df.collect())
    assert rows(done) == rows(stages[-1])
