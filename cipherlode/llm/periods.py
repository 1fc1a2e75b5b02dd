"""Periodic runs of words by Lyndon arrays, in linear time, without suffix structures or hashes of parts.

A run is a longest stretch of words with smallest period p. Its root, as a Lyndon word of the words' order or
of the reverse order, begins a longest Lyndon word of that order, so each run shows in the two Lyndon
arrays: word i and the next smaller suffix j give the period j - i, and how far suffixes i and
j agree gives the run's end.

The array is made from left to right with a stack of suffixes that get larger. Comparing suffixes t and j needs
the length of their common prefix. Of all comparisons so far, the one that reached farthest (to
`reach`, at a distance d) is remembered: up to there, what stands at j is a copy of what stands at
j - d, so the outcome at j - d is taken over unless it would go past `reach`; then words are read
from `reach` on. Further down the stack, the common prefix of two neighbours on it and that of the last
two suffixes compared settle the next comparison, unless both are equal; then, too, words are read from
`reach` on. Each word is so read about once. A run's start is found from its leftmost root, by
comparing less than one period.

Words become numbers by rank in the batch. A word pair inside a run of three periods comes twice in its
text; so only stretches of pairs that do are looked at, which loses no run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlode.llm import flat
from cipherlode.runtime import ship


@dataclass(frozen=True)
class Rule:
    """Runs count from so many words and so many periods on (two at least)."""

    words: int = 24
    periods: int = 3


def next_smaller(s: list[int]) -> tuple[list[int], list[int]]:
    """(nss, lce): for each suffix the next smaller one (len(s) if none) and the length of their common prefix.

    A suffix that is a prefix of another one is smaller.
    """
    n = len(s)
    nss, lce = [n] * n, [0] * n  # popped by, and the prefix shared with it
    pss, low = [-1] * n, [0] * n  # below on the stack, and the prefix shared with it
    reach = d = 0
    for j in range(1, n):
        t, done = j - 1, False
        if j < reach:
            k, left = j - d, reach - j
            while True:
                u = t - d
                popped = nss[u] == k
                m = lce[u] if popped else low[k]
                if m >= left:
                    m = left
                    break
                if not popped:
                    pss[j], low[j], done = t, m, True
                    break
                nss[t], lce[t] = j, m
                t = pss[t]
        else:
            m = 0
        if done:
            continue
        read = True
        while True:
            if read:
                while j + m < n and s[t + m] == s[j + m]:
                    m += 1
                reach, d = j + m, j - t
                if j + m < n and s[t + m] < s[j + m]:
                    pss[j], low[j] = t, m
                    break
            nss[t], lce[t] = j, m
            below = pss[t]
            if below < 0:
                break
            if low[t] < m:
                pss[j], low[j] = below, low[t]
                break
            read = low[t] == m
            t = below
    return nss, lce


def runs(s: list[int], rule: Rule = Rule()) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence that the rule counts, by start, then period."""
    found, n = set(), len(s)
    a = np.asarray(s)
    for order in (s, [-x for x in s]):
        nss, lce = next_smaller(order)
        for i in range(n):
            j, right = nss[i], lce[i]
            p = j - i
            if right <= (rule.periods - 2) * p or (i >= p and nss[i - p] == i and lce[i - p] >= p):
                continue  # too short whatever stands before, or not the leftmost root
            same = a[max(0, i - p) : i][::-1] == a[j - min(p, i) : j][::-1]
            left = len(same) if same.all() else int(same.argmin())
            length = left + p + right
            if length >= rule.periods * p and length >= rule.words:
                found.add((i - left, length, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def ranks(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each word's rank by its bytes."""
    if not len(starts):
        return np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] += 1
    np.subtract.at(inside, ends, 1)  # a word may begin where another row's ends
    letters = raw[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)]).dictionary_encode()
    order = pc.sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[words.indices.to_numpy()]


def stretches(s: np.ndarray, ptr: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(row, from, to) of the longest stretches of `least` words and more whose neighbouring pairs all come twice in their row."""
    if len(s) < least:
        return []
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    inner = np.flatnonzero(row[1:] == row[:-1])
    order = inner[np.lexsort((s[inner + 1], s[inner], row[inner]))]
    equal = (row[order][1:] == row[order][:-1]) & (s[order][1:] == s[order][:-1]) & (s[order + 1][1:] == s[order + 1][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= equal
    twice[:-1] |= equal
    pair = np.zeros(len(s) + 1, np.int8)
    pair[order[twice]] = 1
    edge = np.diff(np.concatenate([[0], pair]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = end - begin + 1 >= least
    return [(int(row[a]), int(a), int(b) + 1) for a, b in zip(begin[keep], end[keep])]


def runs_of_rows(raw: np.ndarray, off: np.ndarray, rule: Rule) -> tuple[list[list[tuple[int, int, int]]], np.ndarray]:
    """The runs of every row of a batch's flat text, and the rows' numbers of words."""
    starts, ends, ptr = flat.words(raw, off)
    s = ranks(raw, starts, ends)
    rows: list = [[] for _ in range(len(off) - 1)]
    if rule.periods >= 3:
        parts = stretches(s, ptr, rule.words)
    else:
        parts = [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(ptr[:-1], ptr[1:])) if b - a >= rule.words]
    for i, a, b in parts:
        rows[i] += [(start + a - int(ptr[i]), length, p) for start, length, p in runs(s[a:b].tolist(), rule)]
    return rows, np.diff(ptr)


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words are left when every run keeps its first period only."""
    keep = np.ones(n, bool)
    for start, length, p in found:
        keep[start + p : start + length] = False
    return keep


def periodic_runs(docs: DataFrame, rule: Rule = Rule(), columns: tuple[str, ...] = ("runs", "collapsed"), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row of docs with the columns keep, n_words, n_runs and the columns asked for.

    runs: all of them (start, length, period), by start, then period. start, length, period, exponent_milli: of the
    run with most periods, then smallest start, then period; null without runs. collapsed: the words that are left when each
    run keeps its first period only, joined by one space, null for a null text; runs_sha256,
    collapsed_sha256: their digests, never null. Null, empty and blank texts have no words and no runs. Memory
    follows from a batch of 2 MB, or the longest text. Columns that aren't in keep are not looked at.
    """
    ship(docs.sparkSession)
    kinds = {"runs": "array<struct<start:long,length:long,period:long>>", "start": "long", "length": "long", "period": "long", "exponent_milli": "long", "collapsed": "string", "runs_sha256": "string", "collapsed_sha256": "string"}
    entry = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    types = {c: {"array": entry, "string": pa.string(), "long": pa.int64()}[kinds[c].split("<")[0]] for c in columns}

    def values(text: str | None, n: int, found: list) -> dict:
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        out = dict(zip(("start", "length", "period"), best or (None,) * 3)) | {"exponent_milli": 1000 * best[1] // best[2] if best else None}
        if "runs" in types:
            out["runs"] = [dict(zip(("start", "length", "period"), r)) for r in found]
        if "runs_sha256" in types:
            out["runs_sha256"] = hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest()
        if "collapsed" in types or "collapsed_sha256" in types:
            words = (text or "").encode().split()
            if found:
                words = [w for w, k in zip(words, kept_words(n, found).tolist()) if k]
            left = b" ".join(words)
            out |= {"collapsed": None if text is None else left.decode(), "collapsed_sha256": hashlib.sha256(left).hexdigest()}
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = flat.utf8(batch.column(len(keep)))
            for lo, hi in flat.slices(off):
                found, n = runs_of_rows(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], rule)
                part = batch.slice(lo, hi - lo)
                out = [values(t, k, f) for t, k, f in zip(part.column(len(keep)).to_pylist(), n.tolist(), found)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(n, pa.int64()), pa.array([len(f) for f in found], pa.int64()), *(pa.array([o[c] for o in out], t) for c, t in types.items())], names=[*keep, "n_words", "n_runs", *types])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_words long", "n_runs long", *(f"`{c}` {kinds[c]}" for c in columns)])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("text")).mapInArrow(flat.lean(run), schema)


def planted(doc_id: Column, text: Column) -> Column:
    """A tenth of the texts made periodic from some word on, as the query's contract says; the others as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def periodic(x: Column) -> Column:
        g, n = F.floor(h / 10), F.size(x["w"])
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.array_join(F.transform(at, lambda i: F.get(x["w"], i.cast("int"))), " ")

    made = F.get(F.transform(F.array(F.struct(words.alias("w"))), periodic), F.lit(0))
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), made).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, a tenth of them made periodic: its runs and what is left of it; see periodic_runs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planted(F.col("doc_id"), F.col("text").cast("string")).alias("text"))
    found = periodic_runs(docs, columns=("start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
