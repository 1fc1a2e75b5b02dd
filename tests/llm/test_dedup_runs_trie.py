"""Exact duplicates, periodic runs and the conversation trie against plain versions, with edge cases."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cipherlode.llm import exact, periods, trie
from cipherlode.llm.registry import oracle_sql, queries

SCHEMA = "doc_id long, text string, d string, norm string, _row long"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [
    (1, "a b  c", "x", None, 1), (2, "abc", "x", "y", 2), (2, "abc", "x", "y", 2), (2, " a b  c ", None, None, 3), (3, None, None, None, None), (4, "", "", "", 4), (5, " \n\t", None, None, 5), (None, "abc", None, None, 6), (None, "abc", None, None, 6),
    (6, LONG, None, None, 7), (7, LONG + " ", None, None, 8), (8, "a b c", None, None, 9), (9, "ab c ", None, None, 10), (-9, "é", None, None, 11), (None, None, None, None, None),
]


def plain_duplicates(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0))
    out = []
    for norm, members in groups.items():
        keep = min(members)
        for k, m in enumerate(sorted(members)):
            out.append((None if m[1] else m[2], None if keep[1] else keep[2], len(members), k == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def got_duplicates(df, **more):
    rows = exact.duplicates(df, **more).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_duplicates_of_odd_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert got_duplicates(df) == plain_duplicates([r[:2] for r in ROWS])
    assert exact.duplicates(df.limit(0)).count() == 0
    kept = exact.deduplicate(df)
    assert kept.columns == df.columns
    want = [r[0] for r in plain_duplicates([r[:2] for r in ROWS]) if r[3]]
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert len(want) == kept.count() and rows.keys() == set(want) and rows[2]["_row"] == 3 and rows[7]["text"] == LONG + " "


@pytest.mark.parametrize("digits", [1, 64])
def test_duplicates_compare_texts_where_digests_are_equal(spark, monkeypatch, digits):
    """Large groups are salted, and a digest of four bits that many texts share changes nothing."""
    monkeypatch.setattr(exact, "HOT_ROWS", 20)
    random.seed(5)
    rows = [(i if i % 9 else None, random.choice(["hot text", "hottext ", " hot text", f"text {i % 40}", f"text{i % 40}", f"own {i}"])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got_duplicates(df, digest=lambda sha: F.substring(sha, 1, digits)) == plain_duplicates(rows)


def plain_next_smaller(s):
    n = len(s)
    nss, lce = [n] * n, [0] * n
    for i in range(n):
        for j in range(i + 1, n):
            if s[j:] < s[i:]:
                m = 0
                while j + m < n and s[i + m] == s[j + m]:
                    m += 1
                nss[i], lce[i] = j, m
                break
    return nss, lce


def plain_runs(s, rule):
    n, out = len(s), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and s[i] == s[i + p]:
                i += 1
            length = i - start + p
            part = s[start : start + length]
            if length >= max(2 * p, rule.periods * p, rule.words) and not any(part[q:] == part[:-q] for q in range(1, p)):
                out.append((start, length, p))
            i = max(i, start + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=14), st.integers(1, 4), st.lists(st.integers(0, 3), max_size=12))
def test_runs_equal_plain_search(part, times, rest):
    for s in (part * times + rest, rest + part * times, (part + rest) * times):
        assert periods.next_smaller(s) == plain_next_smaller(s)
        for rule in (periods.Rule(2, 2), periods.Rule(6, 3)):
            assert periods.runs(s, rule) == plain_runs(s, rule)


class Counted(list):
    reads = 0

    def __getitem__(self, i):
        Counted.reads += 1
        return list.__getitem__(self, i)


@pytest.mark.parametrize("kind", ["unary", "fibonacci", "two letters", "period", "blocks"])
def test_each_word_is_read_a_few_times(kind):
    random.seed(2)
    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    s = {"unary": [0] * 20_000, "fibonacci": b[:20_000], "two letters": [random.randrange(2) for _ in range(20_000)], "period": [i % 100 * 7 % 13 for i in range(20_000)], "blocks": ([0] * 50 + [1]) * 400}[kind]
    Counted.reads = 0
    periods.next_smaller(Counted(s))
    assert Counted.reads < 8 * len(s)


def plain_collapse(doc_id, text, rule=periods.Rule()):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words, rule) if n < 1500 else None
    return words, found


def digests(words, found):
    gone = {i for start, length, p in found for i in range(start + p, start + length)}
    return hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()


def test_runs_query_equals_plain_search(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries()["op12_periods"](spark, sf).collect()}
    assert got.keys() == docs.keys()
    periodic = 0
    for doc_id, text in docs.items():
        words, found = plain_collapse(doc_id, text)
        if found is None:
            continue
        r = got[doc_id]
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *(best or (None,) * 3))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert (r.runs_sha256, r.collapsed_sha256) == digests(words, found)
        periodic += bool(found)
    assert periodic > 10


def test_runs_of_odd_rows(spark):
    rule = periods.Rule(6, 3)
    texts = [r[1] for r in ROWS] + ["a b " * 20, "x " + "a b c " * 9 + "y", "é " * 30, "a\x0bb\x0c" * 9, "a b " * 7]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("runs", F.lit(1)).repartition(3)
    got = periods.periodic_runs(df, rule, ("runs", "collapsed", "runs_sha256", "collapsed_sha256"), ("doc_id",)).collect()
    assert len(got) == len(texts)
    for r in got:
        words = (texts[r.doc_id] or "").encode().split()
        want = plain_runs(words, rule) if len(words) < 1000 else [(0, 30_000, 977)]
        assert [tuple(x) for x in r.runs] == want and (r.n_words, r.n_runs) == (len(words), len(want))
        assert (r.runs_sha256, r.collapsed_sha256) == digests(words, want)
        assert (r.collapsed is None) == (texts[r.doc_id] is None)
    assert periods.periodic_runs(df.limit(0)).count() == 0
    squares = {r.doc_id: r.runs for r in periods.periodic_runs(df.where("doc_id > 14"), periods.Rule(2, 2)).collect()}
    assert all([tuple(x) for x in v] == plain_runs(texts[k].encode().split(), periods.Rule(2, 2)) for k, v in squares.items())


def plain_trie(convs):
    """Node rows of {conv_id: [(role, text)]}."""
    nodes, ends = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        below = kids.get(path, [])
        leaves[path] = sum(leaves[k] for k in below) or 1
        saved[path] = sum(saved[k] for k in below) + ((len(nodes[path]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0)
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in nodes.items()
    )


def got_trie(df):
    rows = df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    return sorted(tuple(r) for r in rows)


def ordered(rows):
    out = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if c is not None:
            out.setdefault(c, []).append((role or "", text or ""))
    return out


@pytest.mark.parametrize("most", [3, 25, 10_000])
def test_trie_equals_plain_version(spark, most):
    """Groups of every size, split again and again or not at all; pieces of ids smaller than a node's list."""
    random.seed(3)
    rows = []
    for c in range(-5, 1300):
        depth = random.choice([0, 1, 2, 3, 6])
        start = random.choice(["hi there", "hi there", "hello", f"q {c % 7}"])
        turns = [("user", start)] + [(random.choice(["user", None, "tool"]), random.choice([f"a  b {i}", "c", None, ""])) for i in range(depth)]
        if c % 5 == 0:
            turns = [("user", "the same")] * 9
        rows += [(c, i if i or c % 3 else None, *t) for i, t in enumerate(turns)]
    rows += [(None, 0, "user", "lost"), (5000, 1, "user", "b"), (5000, 1, "user", "a"), (5000, 1, "user", "a"), (5001, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit(1)).withColumn("gid", F.lit("x")).repartition(4)
    assert got_trie(trie.conversation_trie(df, most)) == plain_trie(ordered(rows))


def test_trie_of_one_long_chain_and_of_none(spark):
    rows = [(c, i, "user", f"turn {i}" if i < 500 - c else f"other {c} {i}") for c in range(4) for i in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for most in (100, 10_000):
        assert got_trie(trie.conversation_trie(df, most)) == plain_trie(ordered(rows))
    assert trie.conversation_trie(df.limit(0)).count() == 0


def test_conversations_without_turns_end_at_the_root(spark):
    rows = [(20, 0, "user", "a"), (21, 0, "user", "x"), (22, 0, "user", "y"), (23, 0, "user", "y"), (41, 0, "user", "z"), (42, 0, "user", "z"), (43, 0, None, "z"), (43, 1, None, "z b"), (45, 7, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    own, want = ordered(rows), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        want[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    assert any(not t for t in want.values())
    assert got_trie(trie.trie(trie.regrouped(trie.conversations(df)))) == plain_trie(want)


def test_queries_equal_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name in ("op11_exact", "op13_trie"):
        got, want = queries()[name](spark, sf).toPandas(), con.execute(oracle_sql()[name]).df()
        columns = sorted(want.columns)
        rows = [sorted(tuple(None if pd.isna(v) else int(v) if not isinstance(v, str) else v for v in r) for r in f[columns].itertuples(index=False)) if "depth" not in columns else sorted((tuple(-1 if pd.isna(v) else v if isinstance(v, str) else int(v) for v in r) for r in f[columns].itertuples(index=False)), key=repr) for f in (got, want)]
        assert rows[0] == rows[1] and len(rows[0]) > 20
