"""Document fingerprints by content-defined chunking.

A gear hash over the last 32 bytes decides where a text is cut; boundaries are normalised: up to
NORMAL bytes a strict mask makes cuts rare, after that a loose one makes them common. An
insertion therefore changes the chunks around it only. A fingerprint is the set of chunk
digests with their lengths; likeness is the length-weighted containment of each set in the
other, the lesser of the two.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlode.llm import flat
from cipherlode.runtime import ship

LEAST, NORMAL, MOST = 32, 64, 256
STRICT, LOOSE = np.uint32(0x7F << 20), np.uint32(0x1F << 20)
_GEAR = (flat.mix(np.arange(1001, 1257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)

BUCKET_BITS = 12
"""Documents are dealt to 2**BUCKET_BITS ranges of ids with about as many rows in each, however the ids lie."""
NULL_BITS = 8
"""Rows without an id are dealt by their texts' hashes to 2**NULL_BITS ranges below."""


def gear(raw: np.ndarray) -> np.ndarray:
    """h = (h << 1) + gear[byte] at every byte; after 32 bytes older ones have left the 32 bits."""
    h = _GEAR[raw]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def chunks(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all rows' chunks, flat, and for each row the index of its first one (n+1)."""
    h = gear(raw)
    strict = (np.flatnonzero((h & STRICT) == 0) + 1).tolist()
    loose = (np.flatnonzero((h & LOOSE) == 0) + 1).tolist()
    ends: list[int] = []
    first = [0]
    for at, end in zip(off[:-1].tolist(), off[1:].tolist()):
        while at < end:
            i = bisect_left(strict, at + LEAST)
            cut = strict[i] if i < len(strict) else end
            if cut >= at + NORMAL:
                i = bisect_left(loose, at + NORMAL)
                cut = min(loose[i] if i < len(loose) else end, at + MOST)
            at = min(cut, end)
            ends.append(at)
        first.append(len(ends))
    return np.array(ends, np.int64), np.array(first)


class Print:
    """A set of chunk digests (48 bits), sorted, with their lengths."""

    __slots__ = ("digest", "length")

    def __init__(self, digest: np.ndarray, length: np.ndarray):
        self.digest, at = np.unique(digest, return_index=True)
        self.length = length[at]

    def text(self) -> str:
        packed = (self.digest << np.uint64(16)) | self.length.astype(np.uint64)
        return packed.astype(">u8").tobytes().hex()

    def likeness(self, other: Print) -> float:
        """Shared length over the greater total length; 1 for two empty texts."""
        a, b = int(self.length.sum()), int(other.length.sum())
        if not a or not b:
            return float(a == b)
        if len(self.digest) > len(other.digest):
            self, other = other, self
        at = np.searchsorted(other.digest, self.digest)
        at[at == len(other.digest)] = 0
        return int(self.length[other.digest[at] == self.digest].sum()) / max(a, b)


def prints(texts: list[bytes]) -> list[Print]:
    """Fingerprints of some texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    off = np.concatenate([[0], np.cumsum(sizes)])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends, first = chunks(raw, off)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    digest = flat.word_hashes(raw, starts, ends, False) >> np.uint64(16)
    length = ends - starts
    return [Print(digest[a:b], length[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def edited(text: str, following: str) -> str:
    """The last half of the code points gives way to as many of the following text."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _bucket(cuts: list[int]) -> Column:
    """How many cuts are not above doc_id, by bisection; rows without an id come below, by hash."""
    padded = cuts + [(1 << 63) - 1] * ((1 << BUCKET_BITS) - 1 - len(cuts))
    steps = ", ".join(str(1 << k) for k in reversed(range(BUCKET_BITS)))
    found = F.expr(f"aggregate(array({steps}), 0, (at, step) -> if(element_at(array({', '.join(f'{c}L' for c in padded)}), at + step) <= doc_id, at + step, at))")
    return F.when(F.col("doc_id").isNull(), (F.shiftright("h", 64 - NULL_BITS) - (1 << NULL_BITS)).cast("int")).otherwise(found)


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows by descending id (and hash of the text) in each range, ended by a ghost row: the first one of the next range.

    What the driver sees are the cuts and each range's first row: at most a few thousand numbers.
    """
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").withColumn("h", F.xxhash64("text"))
    n = 1 << BUCKET_BITS
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 5 * n).alias("cuts")).first()["cuts"] or []
    rows = rows.withColumn("bucket", _bucket(sorted({c for c in cuts if c < (1 << 63) - 1})))
    tops = sorted((r["bucket"], r["top"]) for r in rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "h")).alias("top")).collect())
    links = [(b, *tops[k - 1][1]) for k, (b, _) in enumerate(tops)]  # the lowest range is followed by the highest
    targets = docs.sparkSession.createDataFrame(links, "bucket int, id long, th long")
    ghosts = rows.drop("bucket").join(F.broadcast(targets), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("th"))).select("bucket", F.lit(1).alias("ghost"), "doc_id", "h", "text")
    return rows.select("bucket", F.lit(0).alias("ghost"), "doc_id", "h", "text").unionByName(ghosts)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and their likeness, also to the next document.

    The next document is the one with the next lower doc_id (after the last: the first). Rows
    with one doc_id follow each other by the hash of their texts; a null id is the lowest. Null
    texts count as empty, whose fingerprint is empty. A table of one row has itself as its next.
    Other columns are left out. One shuffle by id ranges of about equal size.
    """
    spark = ship(docs.sparkSession)
    rows = _with_next(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "bucket").sortWithinPartitions(F.desc("bucket"), "ghost", F.desc_nulls_last("doc_id"), F.desc("h")).drop("h")

    def group(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Rows of one range; the last text is the one after them."""
        changed = [edited(a, b).encode() for a, b in zip(texts, texts[1:])]
        raw = [t.encode() for t in texts]
        own, other = prints(raw), prints(changed)
        n = len(ids)
        columns = [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in changed]), pa.array([own[i].text() for i in range(n)]),
            pa.array([p.text() for p in other]), pa.array([own[i].likeness(other[i]) for i in range(n)]), pa.array([own[i].likeness(own[i + 1]) for i in range(n)]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size, at = 0, None
        for batch in batches:
            for bucket, ghost, doc_id, text in zip(*(c.to_pylist() if i < 3 else c for i, c in enumerate(batch.columns))):
                text = text.as_py() or ""
                if bucket != at:
                    ids, texts, size, at = [], [], 0, bucket
                elif ids is None:  # more ghosts
                    continue
                texts.append(text)
                size += len(text)
                if len(texts) > 1 and (ghost or size > 1_000_000):
                    yield group(ids, texts)
                    texts, size = texts[-1:], len(texts[-1])
                    ids = []
                if ghost:
                    ids = None
                else:
                    ids.append(doc_id)

    return dealt.mapInArrow(flat.lean(run), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's fingerprint, that of its edited text, and their likeness, also to the next document."""
    return compare_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
