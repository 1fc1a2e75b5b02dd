"""Operators against brute force, SQL or held-out labels, and their edge cases."""

import glob
import hashlib
import json
import math
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cipherlode.llm import fingerprints, jaccard, langid, lm, media, mixing, registry, substrings, tokens, toxicity, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, c string, bucket string"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [
    (1, "One two three four five six seven eight nine ten eleven", "en", "src1", 10, "x", "y", "z"), (2, "One two three four five six seven eight nine ten eleven", "en", "src1", 10, "x", "y", "z"),
    (2, "One two three four five six seven eight nine ten eleven", "en", "src1", 10, "x", "y", "z"), (3, None, None, None, None, None, None, None), (4, "", "en", "", 0, None, None, None), (5, " \n\t", "de", "other", 3, None, None, None),
    (6, LONG, "en", "src2", len(LONG), None, None, None), (7, "before " + LONG[2000:9000] + " after", "en", "src0", 5, None, None, None), (None, "no id here", "fr", "src3", 9, None, None, None), (9, "12345 !!!", None, "src9", 9, None, None, None),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def plain(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


LABELS = "doc_id long, quality int, toxic int"
OPERATORS = {
    "bpe": lambda d: tokens.encode_documents(d, tokens.default_path()), "ngram_join": lambda d: jaccard.groups(jaccard.similar(d, 3, jaccard.Threshold(90, 100))), "fingerprints": fingerprints.compare_neighbours, "media": media.store_texts,
    "lm": lm.score_documents, "toxicity": lambda d: toxicity.score_texts(d, toxicity.fit(d, d.sparkSession.createDataFrame([(1, 1, 1), (2, 1, 0), (6, None, None), (None, 1, 1)], LABELS))), "langid": lambda d: langid.identify(d, langid.fit(d)), "substrings": substrings.remove_repeats,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_and_empty_tables(edge, name):
    """One row for each row, whatever is in it; none for an empty table."""
    got = OPERATORS[name](edge).toPandas()
    assert len(got) == len(ROWS) and sorted(got.doc_id.dropna().astype(int)) == [1, 2, 2, 3, 4, 5, 6, 7, 9]
    twins = got[got.doc_id == 2].drop(columns=[c for c in ("near_edited", "near_next", "edited_fingerprint", "edited_sha256") if c in got])
    assert twins.astype(str).nunique().eq(1).all()
    assert OPERATORS[name](edge.limit(0)).count() == 0


def test_mixing_edges(edge):
    got = mixing.select_epochs(edge, mixing.Mix(share=(1, 1), epochs=2)).toPandas()
    assert set(got.doc_id.dropna().astype(int)) <= {1, 2, 6, 7, 9} and (got.m_taken > 0).all() and (got.m_taken <= got.m_tokens).all()
    words = edge.select(F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(mixing.WORD)))).first()[0]
    assert got.m_taken.sum() == words
    assert mixing.select_epochs(edge.limit(0)).count() == 0


CLASH = "doc_id long, text string, lang string, source string, n_chars long, m_tokens string, m_lang int, m_doc string, epoch string"


def test_mixing_does_not_depend_on_the_layout(spark):
    """Rows that share an id, or have none, are told apart by their texts; the user's columns of any name come back."""
    rows = [(i % 7 if i % 3 else None, " ".join(f"w{j}" for j in range(1 + i * 13 % 40)), "en", "src0", i, f"t{i}", i, "d", "e") for i in range(300)]
    mix = mixing.Mix(share=(5, 3), epochs=3)
    got = []
    for layout in (rows, rows[::-1]):
        docs = spark.createDataFrame(layout, CLASH).repartition(len(got) * 4 + 1)
        got.append(sorted(map(str, mixing.select_epochs(docs, mix).select("doc_id", "m_tokens", "epoch", "m_taken").collect())))
        back = mixing.mixed(docs, mix)
        assert back.columns == docs.columns
        texts = {r[5]: r[1] for r in rows}
        out = back.collect()
        assert all(texts[r.m_tokens].startswith(r.text) and (r.m_lang, r.m_doc, r.epoch) == (int(r.m_tokens[1:]), "d", "e") for r in out)
        assert sum(len(r.text.split()) for r in out) == sum(len(r[1].split()) for r in rows) * 5 // 3
    assert got[0] == got[1]


def test_mixing_refines_the_last_range(spark, sf, monkeypatch):
    """However the hash ranges are divided, the same words are taken."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = None
    for digits, levels in ((2, 3), (1, 1), (1, 2)):
        monkeypatch.setattr(mixing, "RANGE_DIGITS", digits)
        monkeypatch.setattr(mixing, "RANGE_LEVELS", levels)
        got = sorted(map(str, mixing.select_epochs(docs).select("doc_id", "epoch", "m_taken").collect()))
        assert want in (None, got)
        want = got


def test_join_of_rows_without_an_id_or_with_one_id(spark):
    """Every row links by its text: with a null id, with an id that another text has too, and where it repeats."""
    base = [f"w{i}" for i in range(60)]
    near, other = " ".join([*base, "more"]), " ".join(f"v{i}" for i in range(50))
    rows = [(None, " ".join(base)), (5, near), (1, other), (1, "wholly different words here"), (1, " ".join(base[:59])), (None, other), (None, other), (7, None), (None, ""), (3, "x y z"), (3, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    join = jaccard.similar(docs, 3, jaccard.Threshold(90, 100))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.groups(join).collect())
    assert got == Counter([(None, 58, 1), (5, 59, 1), (1, 48, 1), (1, 2, 1), (1, 57, 1), (None, 48, 1), (None, 48, 1), (7, 0, 7), (None, 0, None), (3, 1, 3), (3, 1, 3)])
    kept = Counter((r.doc_id, r.text) for r in jaccard.one_of_each(docs, join).collect())
    assert kept == Counter([(1, other), (1, "wholly different words here"), (1, " ".join(base[:59])), (7, None), (None, ""), (3, "x y z")])
    alone = spark.createDataFrame([(None, " ".join(base)), (None, near), (None, other)], "doc_id long, text string")
    join = jaccard.similar(alone, 3, jaccard.Threshold(90, 100))
    assert {r.component_id for r in jaccard.groups(join).collect()} == {None} and jaccard.one_of_each(alone, join).count() == 2


def test_sparse_and_full_blocks_count_alike(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400 if i % 2 else 90, 80).astype(np.uint64)) for i in range(30)]
    t = jaccard.Threshold(30, 100)
    linked = lambda a, b: len(np.intersect1d(sets[a], sets[b])) * 100 >= 30 * len(np.union1d(sets[a], sets[b]))
    for columns in (4096, 7):
        monkeypatch.setattr(jaccard, "COLUMNS", columns)
        found = jaccard.block_links(np.arange(30), sets, np.zeros(30, int), t)
        assert all(linked(a, b) for a, b in found)
        root = list(range(30))
        for a, b in found:
            root = [root[a] if r == root[b] else r for r in root]
        assert all(root[a] == root[b] for a in range(30) for b in range(a) if linked(a, b))


def test_coarse_bound_loses_no_link():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 700).astype(np.uint64) * np.uint64(2))
    sets = []
    for i in range(24):
        keep = base[rng.random(len(base)) < (0.97 if i < 12 else 0.3)]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, 20 if i < 12 else 500).astype(np.uint64)])))
    sets += [np.array([5], np.uint64), np.array([5, 9], np.uint64)]
    ptr = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    counts, start = jaccard.coarse(np.concatenate(sets), ptr)
    few = [counts[a:b] for a, b in zip(start, start[1:])]
    assert all(c.astype(int).sum() == len(s) for c, s in zip(few, sets))
    t = jaccard.Threshold(80, 100)
    got = jaccard.may_link(np.diff(ptr), few, t)
    for a in range(len(sets)):
        for b in range(a):
            if t.linked(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])):
                assert got[a] and got[b]
    assert got[:12].all() and not got[12:24].any()
    big = np.sort(rng.integers(0, 1 << 40, 2000).astype(np.uint64))  # all in the first column
    assert jaccard.coarse(big, np.array([0, 2000]))[0].max() == 255
    assert jaccard.may_link(np.array([2000, 2000]), [jaccard.coarse(big, np.array([0, 2000]))[0]] * 2, t).all()


def test_urls_edges(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Example.ORG/es/x?y#z"), (5, "https://example.org"), (6, "http://org/"), (7, "x://a.com/fr/1"), (8, "http://notexample.org/en/1"), (9, "http://u.example.org/en/12"), (9, "http://u.example.org/en/12"), (10, "http://e.com/de/?a=1&b=2")], "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(pages.withColumn("tld", F.lit("clash")), urls.fit(pages)).collect()}
    assert (got[1].host, got[1].path, got[3].host) == ("", "", "") and (got[4].host, got[4].path) == ("a.example.org", "/es/x") and got[5].path == ""
    assert {k: got[k].rule for k in got} == {1: None, 2: None, 3: None, 4: "example.org/es/", 5: None, 6: "org/", 7: "com/fr/", 8: "org/", 9: "example.org/en/1", 10: "com/de/"}
    assert {k: got[k].verdict for k in (4, 6, 7, 8, 9, 10)} == {4: "block", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "block"}
    assert urls.judge(pages.limit(0), urls.fit(pages.limit(0))).count() == 0


def test_urls_against_brute_force(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    model = urls.fit(pages)
    rows = {r.page_id: r for r in urls.judge(pages, model).collect()}
    facts = {r.page_id: r for r in model.suffix_columns(urls.lexical(urls.with_parts(pages))).collect()}
    assert len(rows) == pages.count()

    def value(tree, r):
        return value(tree[2] if r[tree[0]] <= tree[1] else tree[3], r) if isinstance(tree, tuple) else tree

    for r in pages.collect():
        rest = r.url.partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:].partition("?")[0].partition("#")[0]
        fits = [(len(rule), rule, v) for v, rule in urls.RULES if (host == rule.partition("/")[0] or host.endswith("." + rule.partition("/")[0])) and path.startswith("/" + rule.partition("/")[2])]
        got, f = rows[r.page_id], facts[r.page_id]
        assert (got.host, got.path, got.rule) == (host, path, max(fits)[1] if fits else None)
        assert f.url_length == len(r.url) and abs(f.entropy + sum(n / len(r.url) * math.log2(n / len(r.url)) for n in Counter(r.url).values())) < 1e-5
        margin = model.bias + sum(value(t, f) for t in model.trees)
        assert got.verdict == (max(fits)[2] if fits else "block" if margin >= 0 else "allow")


@pytest.mark.parametrize("short", [48, 1])
def test_ngram_join(docs, plain, monkeypatch, short):
    """Exact components, by short lists and by blocks."""
    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    monkeypatch.setattr(jaccard, "BLOCK", 4 if short == 1 else 512)
    lower = lambda w: bytes(b + 32 if 65 <= b <= 90 else b for b in w)
    sets = {}
    for i, t in plain:
        w = [lower(x) for x in (t or "").encode().split()]
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                o = len(sets[i] & sets[j])
                if 100 * o >= 90 * (len(sets[i]) + len(sets[j]) - o):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    got = jaccard.groups(jaccard.similar(docs, 3, jaccard.Threshold(90, 100))).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), find(i)) for i, s in sets.items()}


def test_long_lists_of_near_copies(spark, monkeypatch):
    """700 versions of one text, of several lengths, most too different to link: exact components, few texts sent."""
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(700):
        words = base[: int(rng.choice([150, 160, 300, 400]))]
        words = [f"x{i}y{j}" if rng.random() < (0.002 if i % 10 == 0 else 0.06) else w for j, w in enumerate(words)]
        texts.append(" ".join(words))
    sets = [{tuple(w[j : j + 3]) for j in range(len(w) - 2)} for w in (t.split() for t in texts)]
    known = {g: k for k, g in enumerate({g for s in sets for g in s})}
    a = np.zeros((len(sets), len(known)), np.float32)
    for i, s in enumerate(sets):
        a[i, [known[g] for g in s]] = 1
    overlap, size = (a @ a.T).astype(int), np.array([len(s) for s in sets])
    linked = 100 * overlap >= 90 * (size[:, None] + size[None, :] - overlap)
    root = np.arange(len(sets))
    while True:
        least = np.where(linked, root[None, :], len(sets)).min(axis=1)
        if (least == root).all():
            break
        root = least
    sent, real = [], jaccard._products
    monkeypatch.setattr(jaccard, "_products", lambda docs, members, *more: (sent.append(members.count()), real(docs, members, *more))[1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard.groups(jaccard.similar(df, 3, jaccard.Threshold(90, 100))).collect()}
    assert got == dict(enumerate(root.tolist())) and 20 < len(set(got.values())) < 690
    assert sum(sent) < 20 * len(texts)


def test_ngram_join_holds_no_list_of_members_on_the_driver(spark, monkeypatch):
    """Texts to be sent are found by marks of bounded size, which other rows may share; no broadcast has a row for each member."""

    def refuse(*_):
        raise AssertionError("a row for each member")

    monkeypatch.setattr(jaccard, "MARK_BITS", jaccard.BUCKET_BITS)
    words = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    rows = [(i, words(i)) for i in range(300)] + [(1000 + i, words(i) + " end") for i in range(0, 300, 2)] + [(None, words(301)), (None, words(301) + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marked = spark.range(20_000)
    marks = jaccard._marks(marked, "id")
    at = np.array([r.m for r in marked.select(jaccard._mark(8 * len(marks), "id").alias("m")).collect()])
    assert len(marks) == jaccard.BUCKET_BITS // 8 and (marks[at >> 3] >> (at & 7) & 1).all() and np.unpackbits(marks).sum() == len(set(at.tolist()))
    monkeypatch.setattr(jaccard.F, "broadcast", refuse)
    monkeypatch.setattr(type(df), "toPandas", refuse)
    got = Counter((r.doc_id, r.component_id) for r in jaccard.groups(jaccard.similar(df, 3, jaccard.Threshold(90, 100))).collect())
    assert got == Counter([(i, i) for i in range(300)] + [(1000 + i, i) for i in range(0, 300, 2)] + [(None, None)] * 2)


@pytest.mark.parametrize("runs", [800, 2])
def test_substrings(docs, plain, monkeypatch, runs):
    """Exact removals, with and without salted anchors."""
    monkeypatch.setattr(substrings, "SHARD_RUNS", runs)
    first, words = {}, {i: (t or "").encode().split() for i, t in plain}
    for i, w in words.items():
        for j in range(len(w) - 49):
            first.setdefault(b" ".join(w[j : j + 50]), i)
    got = {r.doc_id: r for r in substrings.remove_repeats(docs, columns=("kept_sha256", "kept")).collect()}
    removed = 0
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - 49):
            if first[b" ".join(w[j : j + 50])] < i:
                gone.update(range(j, j + 50))
        kept = [x for j, x in enumerate(w) if j not in gone]
        removed += len(gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
        assert got[i].kept.encode().split() == kept
    assert removed > 1000


def test_fingerprints_of_neighbours(docs, plain, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_BITS", 4)
    got = {r.doc_id: r for r in fingerprints.compare_neighbours(docs).collect()}
    ordered = plain[::-1]
    for (i, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1]):
        changed = fingerprints.edited(text, following)
        a, b, c = fingerprints.prints([text.encode(), changed.encode(), following.encode()])
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(changed.encode()).hexdigest(), a.text(), b.text())
        assert r.near_edited == a.likeness(b) and r.near_next == a.likeness(c)


def test_media_contract(docs, plain):
    got = {r.doc_id: r for r in media.store_texts(docs, with_media=True).collect()}
    for i, text in plain:
        raw, r = text.encode(), got[i]
        payload = raw + b"\0" * (-len(raw) % 64) if raw else b"\0" * 64
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and media.decode(bytes(r.media)).payload == payload


def test_bpe_query_equals_the_library(spark, sf, plain):
    """Every text of the table, by its whole result."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_path())
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tokens.query(spark, sf).collect()}
    assert len(got) == len(plain)
    for (i, _), e in zip(plain, library.encode_batch([t or "" for _, t in plain], add_special_tokens=False)):
        want = len(e.ids), " ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False)
        assert got[i] == (want[0], *(hashlib.sha256(x.encode()).hexdigest() for x in want[1:]))


def test_bpe_refuses_what_it_does_not_do():
    spec = json.load(open(tokens.default_path()))
    for change in ({"normalizer": {"type": "NFKC"}}, {"decoder": {"type": "ByteLevel"}}, {"normalizer": None}, {"added_tokens": [{**spec["added_tokens"][0], "lstrip": True}]}, {"pre_tokenizer": {"type": "Whitespace"}}):
        with pytest.raises(ValueError):
            tokens.Vocabulary(json.dumps({**spec, **change}))


def test_mixing_equals_sql(spark, sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    key = ["doc_id", "epoch"]
    want = con.execute(mixing.SQL).df().sort_values(key).reset_index(drop=True)
    got = mixing.query(spark, sf).toPandas()[want.columns].sort_values(key).reset_index(drop=True)
    assert got.astype(str).equals(want.astype(str))


def test_language_model(docs, plain):
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    lower = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split() + [None]
    counts = Counter(w for i, t in plain if not held(i) for w in lower(t))
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in lm.score_documents(docs).collect()}
    for i, t in plain:
        w, r = lower(t), got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(counts[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) < 1e-6 * len(w)
        assert r.score < 0
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_language_model_beats_the_frequencies(spark, size):
    """On documents it hasn't seen, at every size."""
    r = lm.query(spark, f"/root/testdata/{size}").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.avg((F.col("score") > F.col("base_score")).cast("int"))).first()
    assert r[0] > r[1] * 0.99 and r[2] > 0.9


def test_rest_counts_are_joined(docs, monkeypatch):
    """With a head of a few words the base scores stay the same."""
    whole = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in lm.score_documents(docs).collect()}
    monkeypatch.setattr(lm, "HEAD", 300)
    assert {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in lm.score_documents(docs).collect()} == whole


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    lang = langid.query(spark, sf).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (lang[lang.held_out].lang == lang[lang.held_out].lang_pred).mean() > 0.97


@pytest.mark.parametrize(("size", "least"), [("sf0.01", 15 / 18), ("sf0.1", 0.9)])
def test_held_out_toxicity(spark, size, least):
    """least: recall of all held-out toxic rows."""
    sf = f"/root/testdata/{size}"
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    tox = toxicity.query(spark, sf).toPandas().merge(labels, on="doc_id")
    held = tox[tox.held_out]
    clean, bad = held[held.toxic == 0], held[held.toxic == 1]
    assert clean.predicted.mean() < 0.01 and tox.score.between(0, 1).all()
    assert bad.predicted.mean() >= least


@pytest.mark.parametrize(("size", "recall", "false"), [("sf0.001", 0.2, 0.3), ("sf0.01", 0.8, 0.03), ("sf0.1", 0.92, 0.01)])
def test_held_out_urls(spark, size, recall, false):
    """Each third of the URLs that a rule decides, judged by trees that were learned from the others."""
    pages = spark.read.parquet(f"/root/testdata/{size}/pages.parquet")
    counts = Counter()
    for part in range(3):
        held = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(3)) == part
        model = urls.fit(pages.where(~held))
        rows = model.suffix_columns(urls.lexical(urls.with_parts(pages.where(held)))).select(urls.rule_of()[1].alias("truth"), (model.margin() >= 0).alias("blocked"))
        counts += Counter((r.truth, r.blocked) for r in rows.where("truth is not null").collect())
    blocks, allows = counts["block", True] + counts["block", False], counts["allow", True] + counts["allow", False]
    assert counts["block", True] >= recall * blocks and counts["allow", True] <= false * allows


def test_url_trees_equal_a_plain_version(spark):
    """Suffix odds from the other folds, histograms, splits and leaves by loops over the rows."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = urls.fit(pages)
    sample, _, share = urls.training(pages)
    folds = {r.url: r.f for r in pages.select("url", F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(urls.FOLDS)).alias("f")).collect()}
    rows = sorted(sample.collect(), key=lambda r: r.url)
    logit = math.log(share / (1 - share))

    def suffixes(url):
        host, _, path = url.partition("://")[2].partition("/")
        head = "/" + path.split("/")[0].split("?")[0].split("#")[0]
        labels = host.lower().split(".")
        return {"tld_odds": labels[-1], "path_odds": head, "area_odds": ".".join(labels[-2:]) + head}

    for r in rows:
        for name, value in suffixes(r.url).items():
            others = [o.y for o in rows if suffixes(o.url)[name] == value and folds[o.url] != folds[r.url]]
            b, n = sum(others), len(others)
            assert abs(r[name] - math.log((b + urls.PRIOR * share) / (n - b + urls.PRIOR * (1 - share))) + logit) < 1e-6
    cuts = urls.cut_points(sample)
    margin = {r.url: logit for r in rows}

    def grow(part, depth):
        g = {r.url: r.y - 1 / (1 + math.exp(-margin[r.url])) for r in part}
        h = {r.url: (r.y - g[r.url]) * (1 - r.y + g[r.url]) for r in part}
        all_g, all_h, best = sum(g.values()), sum(h.values()), (1e-6, None)
        for f in urls.FEATURES if depth < urls.DEPTH else ():
            for cut in cuts[f]:
                low = [r.url for r in part if r[f] <= cut]
                left_g, left_h = sum(g[u] for u in low), sum(h[u] for u in low)
                if not low or len(low) == len(part) or min(left_h, all_h - left_h) < urls.LEAST_WEIGHT:
                    continue
                gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
                if gain > best[0] + 1e-9:
                    best = (gain, (f, cut))
        if best[1] is None:
            return urls.RATE * all_g / (all_h + 1)
        f, cut = best[1]
        return (f, cut, grow([r for r in part if r[f] <= cut], depth + 1), grow([r for r in part if r[f] > cut], depth + 1))

    def value(tree, r):
        return value(tree[2] if r[tree[0]] <= tree[1] else tree[3], r) if isinstance(tree, tuple) else tree

    def equal(a, b):
        return abs(a - b) < 1e-9 if not isinstance(a, tuple) else isinstance(b, tuple) and a[:2] == b[:2] and equal(a[2], b[2]) and equal(a[3], b[3])

    for tree in model.trees:
        assert equal(grow(rows, 0), tree)
        for r in rows:
            margin[r.url] += value(tree, r)


def test_very_long_and_repeated_urls(spark):
    long = "http://a.example.net/" + "x/1?" * 200_000
    pages = spark.createDataFrame([(1, long), (2, long), (3, None), (None, "http://a.com/de/1"), (None, "http://a.com/de/1")], "page_id long, url string").withColumn("area", F.lit(1)).withColumn("odds", F.lit(2))
    got = urls.judge(pages, urls.fit(pages)).collect()
    assert len(got) == 5 and {(r.host, r.path) for r in got if r.page_id in (1, 2)} == {("a.example.net", "/x/1")} and len({r.block_score for r in got if r.page_id in (1, 2)}) == 1


def test_queries_of_odd_tables(spark, edge, tmp_path):
    """Rows without id are never held out."""
    edge.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 1), (2, 1, 0), (None, 1, 1)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    for name in ("op7_toxicity", "op8_langid", "op11_exact", "op12_periods"):
        rows = registry.queries()[name](spark, str(tmp_path)).collect()
        assert len(rows) == len(ROWS)
        if name in ("op7_toxicity", "op8_langid"):
            assert {r.held_out for r in rows if r.doc_id is None} == {False} and all(r.held_out is not None for r in rows)


def test_scores_equal_a_plain_version(spark, sf):
    """Every score from the lexicon by looking at each word alone, without the automaton."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lexicon = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: (r.score, r.n_hits) for r in toxicity.score_texts(docs, lexicon).collect()}
    for r in docs.collect():
        words = toxicity.fold(r.text).split()
        found = []
        for i, w in enumerate(words):
            best = max([lexicon.weights.get(p, 0.0) for p in (f" {w} ", *(f" {w[:n]}" for n in toxicity.PREFIXES if len(w) >= n))])
            near = ((words[i - 1] if i else "", w) in lexicon.exceptions) or ((w, words[i + 1] if i + 1 < len(words) else "") in lexicon.exceptions)
            if best > 0 and not near:
                found.append(best)
        total = sum(w * w for w in found)
        x = (1.0, max(found), math.log1p(total), math.log1p(100 * total / (21 + len(words)))) if found else (1.0, 0.0, 0.0, 0.0)
        z = sum(a * b for a, b in zip(lexicon.model, x))
        assert got[r.doc_id][1] == len(found) and abs(got[r.doc_id][0] - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) < 1e-9


def test_languages_equal_a_plain_version(spark, sf):
    """Every prediction from the tables word by word, without the cache."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    for r in docs.collect():
        words = langid.words_of(r.text)
        if not words:
            assert got[r.doc_id] == ("und", 0.0)
            continue
        total = np.sum([model.word(w) for w in words], axis=0)
        best = int(total.argmax())
        assert got[r.doc_id][0] == model.langs[best] and abs(got[r.doc_id][1] - 1 / np.exp(np.maximum(total - total[best], -700)).sum()) < 1e-9
