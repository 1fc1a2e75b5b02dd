"""Removal of passages that an earlier document has, with suffix automata of reference shards.

A passage counts from WINDOW consecutive words on. Every window has an anchor, the least of the
hashes of its ANCHOR-word pieces; neighbouring windows with one anchor form a run. Equal windows
have equal anchors, so only runs whose anchor occurs in two documents or more go on. Equal
runs become one. Where an anchor has different runs, their passages are dealt into shards: a shard's
suffix automaton holds them all, each state with the smallest document it occurs in, and the
passages stream through it again for their matching statistics: a word is covered where the
suffix of WINDOW words that ends there, or up to WINDOW-1 words later, has a smaller document.

Shards are routed by anchor, not broadcast: the reference is the repeated part of the corpus and
grows with it. An anchor with many runs is salted over several shards; what no shard
covers is then compared across them by the exact window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlode.llm import flat
from cipherlode.runtime import ship, stored

WINDOW = 50
ANCHOR = 24
SHARD_RUNS = 800
"""Runs of one anchor in a shard."""
SHARD_WORDS = 60_000
"""An automaton is begun anew after so many words, at the next anchor."""


def runs(h: np.ndarray, ptr: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor hash, content hash) of all runs; windows never cross rows."""
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    piece = flat.rolling(h, anchor)
    width = window - anchor + 1
    least = np.lib.stride_tricks.sliding_window_view(piece, width).argmin(axis=1) + np.arange(len(piece) - width + 1)
    n = np.diff(ptr)
    row = np.repeat(np.arange(len(n)), np.maximum(n - window + 1, 0))
    full = np.maximum(n - window + 1, 0)
    at = np.arange(len(row)) - (np.cumsum(full) - full)[row] + ptr[:-1][row]
    if not len(at):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    where = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (where[1:] != where[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    whole = flat.rolling(h, window)
    a, b = at[first], at[first] + count - 1
    content = flat.mix(whole[a] * np.uint64(0x9FB21C651E98DF25) + flat.mix(whole[b] + count.astype(np.uint64)))
    return row[first], a - ptr[:-1][row[first]], count, piece[where[first]], content


class Automaton:
    """A suffix automaton of several word sequences; each state knows its smallest owner."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size, self.owner = [-1], [0], [None]
        self.words = 0

    def _new(self, size: int, link: int, after: dict) -> int:
        self.next.append(after)
        self.link.append(link)
        self.size.append(size)
        self.owner.append(None)
        return len(self.size) - 1

    def _split(self, p: int, word, q: int) -> int:
        """The state for the longest suffix of p + word in q, parted from q where it must be."""
        size = self.size[p] + 1
        if self.size[q] == size:
            return q
        twin = self._new(size, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def add(self, words: list, owner: int) -> None:
        """Insert a sequence word by word."""
        at = 0
        nxt, link = self.next, self.link
        for word in words:
            q = nxt[at].get(word)
            if q is not None:
                at = self._split(at, word, q)
            else:
                new = self._new(self.size[at] + 1, 0, {})
                p = at
                while p >= 0 and word not in nxt[p]:
                    nxt[p][word] = new
                    p = link[p]
                if p >= 0:
                    link[new] = self._split(p, word, nxt[p][word])
                at = new
            if self.owner[at] is None or owner < self.owner[at]:
                self.owner[at] = owner
        self.words += len(words)

    def settle(self) -> None:
        """Hand smallest owners down the suffix links, longest states first."""
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            p, own = self.link[v], self.owner[v]
            if p > 0 and own is not None and (self.owner[p] is None or own < self.owner[p]):
                self.owner[p] = own

    def owners(self, words: list, window: int) -> list:
        """Smallest owner of each window of a sequence, by matching statistics; None where the automaton lacks it."""
        out, at, matched = [], 0, 0
        for i, word in enumerate(words):
            while at and word not in self.next[at]:
                at = self.link[at]
                matched = self.size[at]
            if word in self.next[at]:
                at = self.next[at][word]
                matched += 1
            while at and self.size[self.link[at]] >= window:
                at = self.link[at]
                matched = self.size[at]
            if i >= window - 1:
                out.append(self.owner[at] if matched >= window else None)
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _anchored(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(key, run, doc_id, th, a, n) of every run of every row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = flat.utf8(batch.column(2))
            ids, th = batch.column(0), batch.column(1)
            for lo, hi in flat.slices(off):
                part, rel = raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                starts, ends, ptr = flat.words(part, rel)
                row, a, n, key, run = runs(flat.word_hashes(part, starts, ends, False), ptr, window, anchor)
                take = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(run.view(np.int64)), ids.take(take), th.take(take), pa.array(a.astype(np.int32)), pa.array(n.astype(np.int32))], names=["key", "run", "doc_id", "th", "a", "n"])

    return docs.where("doc_id is not null and text is not null").select("doc_id", "th", "text").mapInArrow(flat.lean(find), "key long, run long, doc_id long, th long, a int, n int")


def _passages(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(key, run, doc_id, words) of the runs wanted: words joined by a space."""
    lists = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", "run", "a", "n")).alias("runs"))  # at most a run a word

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, run, owner, text = [], [], [], []
            for doc_id, body, items in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = body.as_py().encode().split()
                for x in items.as_py():
                    key.append(x["key"])
                    run.append(x["run"])
                    owner.append(doc_id)
                    text.append(b" ".join(words[x["a"] : x["a"] + x["n"] + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(run, pa.int64()), pa.array(owner, pa.int64()), pa.array(text, pa.binary())], names=["key", "run", "doc_id", "words"])

    rows = docs.where("doc_id is not null and text is not null").join(lists, ["doc_id", "th"]).select("doc_id", "text", "runs")
    return rows.mapInArrow(flat.lean(cut), "key long, run long, doc_id long, words binary").dropDuplicates(["key", "run"])


def _through_shards(passages: DataFrame, window: int) -> DataFrame:
    """(key, run, covered, open): windows of each passage that a smaller document has, and hashes of the others where the anchor has other shards.

    Needs key, run, doc_id, words, salts and salt.
    """
    parts = int(passages.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def flush(held: list, automaton: Automaton) -> pa.RecordBatch:
        automaton.settle()
        covered, still = [], []
        for _, _, doc_id, words, salts in held:
            owners = automaton.owners(words, window)
            covered.append([i for i, o in enumerate(owners) if o < doc_id])
            still.append([int.from_bytes(hashlib.blake2b(b" ".join(words[i : i + window]), digest_size=8).digest(), "big", signed=True) if o >= doc_id else None for i, o in enumerate(owners)] if salts > 1 else None)
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64()), pa.array([x[2] for x in held], pa.int64()), pa.array(covered, pa.list_(pa.int32())), pa.array(still, pa.list_(pa.int64()))], names=["key", "run", "doc_id", "covered", "open"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, held, last = Automaton(), [], None
        for batch in batches:
            for key, run, doc_id, words, salts, salt in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, salt) != last and automaton.words > SHARD_WORDS:
                    yield flush(held, automaton)
                    automaton, held = Automaton(), []
                last = (key, salt)
                words = words.split(b" ")
                automaton.add(words, doc_id)
                held.append((key, run, doc_id, words, salts))
        if held:
            yield flush(held, automaton)

    dealt = passages.select("key", "run", "doc_id", "words", "salts", "salt").repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "doc_id", "run")
    return dealt.mapInArrow(flat.lean(stream), "key long, run long, doc_id long, covered array<int>, open array<long>")


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, th, spans): the word ranges [a, b) of each document, by id and xxhash64 of its text, that earlier documents have.

    docs: doc_id, text, th. Rows without id or text are left out: they neither repeat nor are repeated.
    """
    found = _anchored(docs, window, anchor)
    # written first: the join then reads two plain shuffles, of which a key with many rows can be split
    shared = stored(found.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key"), "shared")
    rows = stored(found.join(shared, "key"), "runs")
    first = stored(rows.groupBy("key", "run").agg(F.min(F.struct("doc_id", "th", "a", "n")).alias("f")).select("key", "run", "f.*"), "firstruns")
    several = first.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    wanted = stored(first.join(several, "key").withColumn("salts", F.ceil(F.col("m") / SHARD_RUNS)).drop("m"), "wanted")
    passages = _passages(docs, wanted, window).join(wanted.select("key", "run", "salts"), ["key", "run"]).withColumn("salt", F.pmod(F.xxhash64("run"), F.col("salts")))
    done = stored(_through_shards(passages, window), "shards")
    # windows of salted anchors, across their shards
    open_ = done.where("open is not null").select("key", "run", "doc_id", F.posexplode("open").alias("i", "w")).where("w is not null")
    least = open_.groupBy("w").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    across = open_.join(least, "w").where("least < doc_id").groupBy("key", "run").agg(F.collect_list(F.col("i")).alias("more"))  # at most a run's windows
    covered = done.join(across, ["key", "run"], "left").select("key", "run", F.array_union("covered", F.coalesce("more", F.array().cast("array<int>"))).alias("covered"))
    facts = stored(first.select("key", "run", F.col("doc_id").alias("first")).join(covered, ["key", "run"], "left"), "covered")
    marked = rows.join(facts, ["key", "run"])
    spans = F.when(F.col("doc_id") > F.col("first"), F.array(F.struct(F.col("a").alias("s"), (F.col("a") + F.col("n") + window - 1).alias("e")))).otherwise(
        F.transform(F.coalesce("covered", F.array().cast("array<int>")), lambda i: F.struct((F.col("a") + i).alias("s"), (F.col("a") + i + window).alias("e")))
    )
    return marked.select("doc_id", "th", F.explode(spans).alias("span")).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("span")).alias("spans"))  # at most a span a word


def remove_repeats(docs: DataFrame, window: int = WINDOW, columns: tuple[str, ...] = ("kept",), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Every row with the columns keep, n_words, n_removed and, of its text without the repeats, the columns asked for.

    kept: the text with the removed words and the white space after them cut out; kept_sha256: of
    the kept words joined by one space. Null texts have no words and stay null. Documents
    shorter than a window lose nothing. Rows of one doc_id are no repeats of each other.
    """
    ship(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    spans = repeated_spans(plain, window)
    rows = docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    rows = rows.join(spans, ["doc_id", "th"], "left").select(*[f"k_{c}" for c in keep], "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, out = [], [], {c: [] for c in columns}
            for text, spans in zip(batch.column(len(keep)), batch.column(len(keep) + 1)):
                text = text.as_py()
                raw = (text or "").encode()
                words = raw.split()
                areas = merged([(s["s"], s["e"]) for s in spans.as_py()]) if spans.is_valid else []
                left, at = [], 0
                for a, b in areas:
                    left += words[at:a]
                    at = b
                left += words[at:]
                total.append(len(words))
                gone.append(len(words) - len(left))
                if "kept_sha256" in out:
                    out["kept_sha256"].append(hashlib.sha256(b" ".join(left)).hexdigest())
                if "kept" in out:
                    if areas:
                        starts = flat.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist() + [len(raw)]
                        at, pieces = 0, []
                        for a, b in areas:
                            pieces.append(raw[at : starts[a]])
                            at = starts[b]
                        text = b"".join([*pieces, raw[at:]]).decode()
                    out["kept"].append(text)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), *(pa.array(v, pa.string()) for v in out.values())], names=[*keep, "n_words", "n_removed", *out])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_words long", "n_removed long", *(f"{c} string" for c in columns)])
    return rows.mapInArrow(flat.lean(cut), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 50 words and more that an earlier one has."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), columns=("kept_sha256",))
