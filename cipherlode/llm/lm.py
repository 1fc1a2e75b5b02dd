"""Document scores by a gated recurrent language model.

Words are counted over all training texts. Those that are frequent enough to be learned, a set
that grows with the text, are units of the network; the others share one unit, inside which the
smoothed word frequencies hold; so the model is a probability over all words, and its output is
factored: class, unit in the class, word in the unit, with as many classes as units in a class.

Training is truncated backpropagation in numpy over all training documents but SPARE of SHARES
parts: each task carries hidden states over windows of its texts, and the tasks' weights are
averaged by tokens; the next round starts from the average. The documents put aside settle how
far the network is to be trusted: a token's probability is that share of the network's and the
rest of the smoothed frequency. Scoring carries the state from a document's first word to its end.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherlode.llm import flat
from cipherlode.runtime import ship, stored

HEAD = 1 << 19
"""Words whose counts are broadcast, 16 bytes each; the others' counts are joined."""
UNITS, HIDDEN = 256, 16
"""Units at least."""
CLASSES = 0.7
"""Classes for each root of the number of units."""
UNIT_SHARE = 0.1
"""A word is a unit if its count is at least this times the root of all training tokens."""
PREFIX = 20
BLOCK = 4096
"""Weights that are averaged together."""
SCORED = 32_768
"""Tokens whose output is computed together in scoring."""
WINDOW, LANES, LEAST_LANES = 16, 1024, 8
PER_LANE = 1600
"""A lane for each so many tokens, LEAST_LANES to LANES: about a hundred windows, however little text a task has."""
PIECE = 1024
"""Longer texts are trained on in pieces of so many tokens, each from a fresh state: the gradient is cut each WINDOW anyway. Scoring never cuts."""
CHUNK = 2_000_000
"""Tokens that are laid out in lanes at a time; longer documents are taken whole."""
BOUND = 3.0
"""Output weights stay within; with states below 1 no exponential leaves the range of a float."""
STEP, WARM_UP = 0.03, 0.2
"""Learning rate, and the share of a chunk's windows in which it rises."""
SHARES, SPARE, ROUNDS = 16, 1, 2
"""Training texts are dealt by hash; SPARE parts settle the trust in the network, the others are dealt to the rounds."""
TRUST = (0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)
FAN_IN = 64
"""Averages are taken over groups of so many tasks, then over the groups."""
END = np.uint64(0x7E1D00D5EED5A11D)


def tokens(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words and its end token, flat, and row pointers."""
    starts, ends, ptr = flat.words(raw, off)
    h = flat.word_hashes(raw, starts, ends, True)
    return np.insert(h, ptr[1:], END), ptr + np.arange(len(ptr))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray]]:
    """(other columns, token hashes, row pointers) for batches with the text last."""
    for batch in batches:
        raw, off = flat.utf8(batch.columns[-1])
        for lo, hi in flat.slices(off):
            h, ptr = tokens(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            yield [c[lo:hi] for c in batch.columns[:-1]], h, ptr


def count_words(texts: DataFrame) -> DataFrame:
    """(w, n): how often each token, by its hash, is in a one-column table of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            w, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n.astype(np.int64))], names=["w", "n"])

        for _, h, _ in _parts(batches):
            held.append(h)
            size += len(h)
            if size > 6_000_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return texts.mapInArrow(flat.lean(count), "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


@dataclass
class Words:
    """total, distinct: training tokens and types; hashes (sorted), counts, units: of the head."""

    total: int
    distinct: int
    hashes: np.ndarray
    counts: np.ndarray
    units: np.ndarray
    start: np.ndarray  # log probability of each unit by frequency
    first: np.ndarray | None = None  # of each prefix of PREFIX bits

    @property
    def end(self) -> int:
        """The end token's unit."""
        at, known = self.find(np.array([END]))
        return int(self.units[at[0]]) if known[0] else 0

    @property
    def weight(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes in the head, and whether they are there: a look at the first hash with the same leading bits, then at the next ones."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        if self.first is None:
            self.first = np.searchsorted(self.hashes, np.arange(1 << PREFIX, dtype=np.uint64) << np.uint64(64 - PREFIX)).astype(np.int32)
        last = len(self.hashes) - 1
        at = np.minimum(self.first[(h >> np.uint64(64 - PREFIX)).astype(np.int64)], last)
        there = self.hashes[at]
        open_ = np.flatnonzero(there < h)
        while len(open_):
            at[open_] = np.minimum(at[open_] + 1, last)
            there[open_] = self.hashes[at[open_]]
            open_ = open_[(there[open_] < h[open_]) & (at[open_] < last)]
        return at, there == h


def head_of(counts: DataFrame) -> Words:
    facts = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(facts["n"] or 0), int(facts["v"])
    level = F.floor(8 * F.log2("n"))
    sizes = {r["level"]: r["c"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("c")).collect()}
    enough = UNIT_SHARE * math.sqrt(total)
    least, size = 1 << 20, 0
    for k in sorted(sizes, reverse=True):
        size += sizes[k]
        if size > HEAD:
            break
        least = k
    least = min(least, math.floor(8 * math.log2(max(1.0, enough))))  # units are always in the head
    table = counts.where(level >= least).toPandas()
    h, n = table["w"].to_numpy(np.int64).view(np.uint64), table["n"].to_numpy(np.int64)
    rank = np.lexsort((h, -n, h != END))  # the end is always a unit
    units = np.zeros(len(h), np.int64)
    chosen = rank[: max(UNITS - 1, int((n >= enough).sum()))]
    chosen = chosen[np.lexsort((h[chosen], -n[chosen]))]
    units[chosen] = np.arange(1, len(chosen) + 1)
    weight = total + 0.5 * (distinct + 1)
    p = np.append(0.0, (n[chosen] + 0.5) / weight)
    p[0] = max(1e-9, 1 - p.sum())
    order = np.argsort(h)
    return Words(total, distinct, h[order], n[order], units[order], np.log(p))


def class_edges(p: np.ndarray) -> np.ndarray:
    """First units of the classes, and the end: the shared unit alone, then equal shares of the roots of p, so frequent words are in small classes."""
    k = max(2, round(CLASSES * math.sqrt(len(p))))
    upto = np.cumsum(np.sqrt(p[1:]))
    group = np.minimum((upto * (k / upto[-1]) - 1e-9).astype(np.int64), k - 1) if len(p) > 1 else np.zeros(0, np.int64)
    return np.append(0, np.append(1 + np.flatnonzero(np.diff(group, prepend=-1)), len(p)))


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), into (-1, 1); it takes a fraction of the time of a hyperbolic tangent."""
    d = np.abs(x)
    d += 1
    x /= d
    return x


def slope(y: np.ndarray) -> np.ndarray:
    """Derivative of squash where its value is y."""
    d = 1 - np.abs(y)
    d *= d
    return d


class Network:
    """Weights of the recurrent model; a class is a range of neighbouring units.

    Lanes and tokens are the last axis everywhere, so that gates and logits are whole blocks of memory.
    """

    def __init__(self, start: np.ndarray):
        rng = np.random.default_rng(11)
        p, n = np.exp(start), len(start)
        self.edges = class_edges(p)
        self.group = np.repeat(np.arange(len(self.edges) - 1), np.diff(self.edges)).astype(np.int16)  # short keys are sorted by radix
        k = len(self.edges) - 1
        self.SHAPES = {"table": (n, 3 * HIDDEN), "loop": (3 * HIDDEN, HIDDEN), "to_class": (k, HIDDEN), "class_bias": (k, 1), "to_unit": (n, HIDDEN), "unit_bias": (n, 1)}
        self.w = {name: (rng.standard_normal(s) * (0.0 if name.endswith("bias") else 0.1)).astype(np.float32) for name, s in self.SHAPES.items()}
        of_class = np.log(np.add.reduceat(p, self.edges[:-1]))
        self.w["unit_bias"] = (start - of_class[self.group]).astype(np.float32)[:, None]
        self.w["class_bias"] = of_class.astype(np.float32)[:, None]

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in self.SHAPES])

    def load(self, values: np.ndarray) -> None:
        at = 0
        for k, s in self.SHAPES.items():
            n = int(np.prod(s))
            self.w[k] = values[at : at + n].reshape(s).astype(np.float32)
            at += n

    def forward(self, before: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States (hidden x tokens of the window, step by step) and the last one. before: last units (steps x lanes); fresh: 1 where a text begins."""
        k, loop = HIDDEN, self.w["loop"]
        out = np.empty((k, *before.shape), loop.dtype)
        begins = fresh.any(axis=1).tolist()
        for t, units in enumerate(before):
            x = np.ascontiguousarray(np.take(self.w["table"], units, axis=0).T)  # a step at a time: in the cache
            if begins[t]:
                h = h * (1 - fresh[t])
            y = loop @ h
            gates = squash(x[: 2 * k] + y[: 2 * k])
            gates += 1
            gates *= 0.5
            r, z = gates[:k], gates[k:]
            n = r * y[2 * k :]
            n += x[2 * k :]
            n = squash(n)
            if keep is not None:
                keep.append((h, r, z, n, y[2 * k :]))
            h = h - n
            h *= z
            h += n
            out[:, t] = h
        return out.reshape(k, -1), h

    def losses(self, states: np.ndarray, target: np.ndarray, gradient: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probabilities of the target units; with gradient also adds to it and gives the states' gradient."""

        def picked(logit: np.ndarray, at: np.ndarray) -> np.ndarray:
            """Log probability at a place of each column; logit becomes its gradient. BOUND keeps the exponentials finite."""
            columns = np.arange(len(at))
            own = logit[at, columns]
            np.exp(logit, out=logit)
            total = logit.sum(axis=0)
            if gradient is not None:
                logit *= -1 / total
                logit[at, columns] += 1
            return own - np.log(total)

        group = self.group[target]
        order = np.argsort(group, kind="stable")
        states, group, target = states[:, order], group[order], target[order]
        p = self.w["to_class"] @ states
        p += self.w["class_bias"]
        found, back = picked(p, group), None
        if gradient is not None:
            gradient["to_class"] = p @ states.T
            gradient["class_bias"] = p.sum(axis=1, keepdims=True)
            back = self.w["to_class"].T @ p
        edges = self.edges.tolist()
        spans = np.searchsorted(group, np.arange(len(edges))).tolist()
        for a, b, lo, hi in zip(edges, edges[1:], spans, spans[1:]):
            if lo == hi or b - a == 1:
                continue
            s, units = states[:, lo:hi], self.w["to_unit"][a:b]
            p = units @ s
            p += self.w["unit_bias"][a:b]
            found[lo:hi] += picked(p, target[lo:hi] - a)
            if gradient is not None:
                gradient["to_unit"][a:b] = p @ s.T
                gradient["unit_bias"][a:b] = p.sum(axis=1, keepdims=True)
                back[:, lo:hi] += units.T @ p
        out = np.empty_like(found)
        out[order] = found
        if back is not None:
            sorted_back, back = back, np.empty_like(back)
            back[:, order] = sorted_back
        return out, back

    def train(self, before: np.ndarray, target: np.ndarray, fresh: np.ndarray, owner: np.ndarray, h: np.ndarray, adam: dict, rate: float = STEP) -> np.ndarray:
        """One step of truncated backpropagation over a window; gives the state to carry on."""
        steps, lanes = before.shape
        kept: list = []
        states, last = self.forward(before, fresh, h, kept)
        real = np.flatnonzero(owner.ravel())
        gradient = {k: np.zeros(s, np.float32) for k, s in self.SHAPES.items() if k != "table"}
        if len(real) == steps * lanes:
            back = self.losses(states, target.ravel(), gradient)[1]
        else:
            back = np.zeros((HIDDEN, steps * lanes), np.float32)
            back[:, real] = self.losses(states[:, real], target.ravel()[real], gradient)[1]
        back = back.reshape(HIDDEN, steps, lanes)
        loop, carried, k = self.w["loop"], np.zeros((HIDDEN, lanes), np.float32), HIDDEN
        inputs, to = np.empty((steps, lanes, 3 * k), np.float32), np.empty((3 * k, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            h0, r, z, n, y = kept[t]
            d = back[:, t] + carried
            dz = d * z
            np.multiply(d - dz, slope(n), out=to[2 * k :])
            np.multiply(to[2 * k :] * y, slope(2 * r - 1) * np.float32(0.5), out=to[:k])
            np.multiply((h0 - n) * d, slope(2 * z - 1) * np.float32(0.5), out=to[k : 2 * k])
            inputs[t] = to.T
            to[2 * k :] *= r
            gradient["loop"] += to @ h0.T
            carried = loop.T @ to
            carried += dz
            carried *= 1 - fresh[t]
        unit = before.ravel()
        order = np.argsort(unit.astype(np.int16) if len(self.group) < 1 << 15 else unit, kind="stable")
        seen, at = np.unique(unit[order], return_index=True)
        gradient["table"] = np.add.reduceat(np.take(inputs.reshape(-1, 3 * k), order, axis=0), at, axis=0)  # of the units seen
        adam["t"] += 1
        for k, g in gradient.items():
            g /= max(1, len(real))
            m, v = adam[k]
            rows = seen if k == "table" else slice(None)
            m[rows] += 0.1 * (g - m[rows])
            v[rows] += 0.01 * (g * g - v[rows])
            self.w[k][rows] += rate * (m[rows] / (1 - 0.9 ** adam["t"])) / (np.sqrt(v[rows] / (1 - 0.99 ** adam["t"])) + 1e-4)
        for k in ("to_class", "to_unit"):
            np.clip(self.w[k], -BOUND, BOUND, out=self.w[k])
        return last

    def adam(self) -> dict:
        return {"t": 0} | {k: (np.zeros(s, np.float32), np.zeros(s, np.float32)) for k, s in self.SHAPES.items()}


def lanes_of(sizes: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lane, first step) of each text and the lanes' lengths, longest first.

    The longest texts are dealt first, each to the shortest lane so far.
    """
    heap = [(0, i) for i in range(min(lanes, max(1, len(sizes))))]
    lane, first = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for d in np.argsort(-sizes, kind="stable").tolist():
        length, i = heap[0]
        lane[d], first[d] = i, length
        heapq.heapreplace(heap, (length + int(sizes[d]), i))
    length = np.zeros(len(heap), np.int64)
    for n, i in heap:
        length[i] = n
    order = np.argsort(-length, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    return place[lane], first, length[order]


def windows(units: np.ndarray, ptr: np.ndarray, end: int, piece: int | None = None) -> Iterator[tuple]:
    """(last units, target units, text begins, document + 1 or 0, places in units), each steps x lanes still in use, and the share of windows that are over.

    Texts stand in lanes one after another, whole or in pieces; a window's tokens are looked up
    when it is due, so memory follows from the number of tokens, not from the longest text.
    """
    total = len(units)
    lanes = min(LANES, max(LEAST_LANES, total // PER_LANE))
    last = np.empty_like(units)
    last[1:] = units[:-1]
    last[ptr[:-1]] = end
    size = np.diff(ptr)
    pieces = -(-size // piece) if piece else np.ones_like(size)
    doc = np.repeat(np.arange(len(size)), pieces)
    ahead = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * (piece or 0)
    start, size = ptr[:-1][doc] + ahead, size[doc] - ahead
    size = np.minimum(size, piece) if piece else size
    lane, first, length = lanes_of(size, lanes)
    order = np.lexsort((first, lane))
    ends = np.cumsum(size[order])
    token = np.repeat(start[order] - (ends - size[order]), size[order]) + np.arange(total)  # in the order of lanes
    owner = np.repeat(doc[order] + 1, size[order])
    fresh = np.zeros(total, np.float32)
    fresh[ends - size[order]] = 1
    begin = np.cumsum(length) - length
    for t in range(0, int(length[0]), WINDOW):
        live = int(np.searchsorted(-length, -t, "left"))
        place = begin[:live] + np.arange(t, t + WINDOW)[:, None]
        real = place < (begin + length)[:live]
        place = np.minimum(place, total - 1)
        at = token[place]
        yield last[at], units[at], fresh[place], np.where(real, owner[place], 0), at, t / int(length[0])


def _chunks(parts: Iterator) -> Iterator[tuple[list[list[pa.Array]], np.ndarray, np.ndarray]]:
    """Parts put together to about CHUNK tokens."""
    columns, hashes, pointers, size = [], [], [np.zeros(1, np.int64)], 0
    for c, h, ptr in parts:
        columns.append(c)
        hashes.append(h)
        pointers.append(ptr[1:] + size)
        size += len(h)
        if size >= CHUNK:
            yield columns, np.concatenate(hashes), np.concatenate(pointers)
            columns, hashes, pointers, size = [], [], [np.zeros(1, np.int64)], 0
    if columns:
        yield columns, np.concatenate(hashes), np.concatenate(pointers)


def fit(texts: DataFrame, words: Words, weights: np.ndarray | None = None) -> np.ndarray:
    """Weights averaged over the tasks that read a one-column table of texts, each in proportion to its tokens.

    weights: where training starts; else at the words' frequencies. Sums are taken over groups of
    FAN_IN tasks first, so no group grows with the number of tasks squared.
    """
    sent = texts.sparkSession.sparkContext.broadcast((words, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, start = sent.value
        net, seen = Network(own.start), 0
        if start is not None and len(start):
            net.load(start)
        adam, end = net.adam(), own.end
        for _, h, ptr in _chunks(_parts(batches)):
            at, known = own.find(h)
            state, full = None, 0
            for before, target, fresh, owner, _, share in windows(np.where(known, own.units[at], 0), ptr, end, PIECE):
                if state is None:
                    full = before.shape[1]
                    state = np.zeros((HIDDEN, full), np.float32)
                rising = 1.0 if seen or start is not None else min(1.0, (share + 0.02) / WARM_UP)
                rate = STEP * rising * (1 - 0.8 * share) * before.shape[1] / full  # a window of few tokens is a small step
                state = net.train(before, target, fresh, owner, np.ascontiguousarray(state[:, : before.shape[1]]), adam, rate)
            seen += len(h)
        if seen:
            values = net.flat()
            task = TaskContext.get().partitionId()
            blocks = [values[i : i + BLOCK].astype(np.float64).tobytes() for i in range(0, len(values), BLOCK)]
            n = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, task, np.int64)), pa.array(np.full(n, seen, np.int64)), pa.array(blocks, pa.binary())], names=["block", "task", "n", "v"])

    def mean(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["task"].to_pylist(), table["n"].to_pylist(), table["v"].to_pylist()))
        total = sum(n for _, n, _ in rows)
        value = sum(np.frombuffer(v, np.float64) * (n / total) for _, n, v in rows)
        return pa.table({"block": table["block"][:1], "task": pa.array([rows[0][0]], pa.int64()), "n": pa.array([total], pa.int64()), "v": pa.array([value.tobytes()], pa.binary())})

    schema = "block int, task long, n long, v binary"
    found = texts.mapInArrow(flat.lean(run), schema)
    found = found.withColumn("part", F.expr(f"task div {FAN_IN}")).groupBy("block", "part").applyInArrow(lambda t: mean(t.drop_columns(["part"])), schema)
    found = found.groupBy("block").applyInArrow(mean, schema).select("block", "v").toPandas().sort_values("block")  # as many bytes as the network's weights have
    return np.frombuffer(b"".join(found["v"]), np.float64).astype(np.float32)


def _gains(own: Words, weights: np.ndarray, parts: Iterator) -> Iterator[tuple]:
    """(columns, row pointers, known, base log10, gains by token) of chunks; a gain is the network's probability over the frequency's."""
    net = Network(own.start)
    if len(weights):
        net.load(weights)
    for columns, h, ptr in _chunks(parts):
        at, known = own.find(h)
        unit = np.where(known, own.units[at], 0) if len(own.units) else np.zeros(len(h), np.int64)
        gain = np.empty(len(h), np.float32)
        held, size, state = [], 0, None

        def settle() -> None:
            nonlocal held, size
            if held:
                states, target, who = (np.concatenate(x, axis=-1) for x in zip(*held))
                gain[who] = np.exp(net.losses(states, target)[0] - own.start[target].astype(np.float32))
            held, size = [], 0

        for before, target, fresh, owner, index, _ in windows(unit, ptr, own.end):
            if state is None:
                state = np.zeros((HIDDEN, before.shape[1]), np.float32)
            states, state = net.forward(before, fresh, np.ascontiguousarray(state[:, : before.shape[1]]))
            real = np.flatnonzero(owner.ravel())
            held.append((states[:, real], target.ravel()[real], index.ravel()[real]))
            size += len(real)
            if size >= SCORED:
                settle()
        settle()
        yield columns, h, ptr, at, known, gain


def trust_of(texts: DataFrame, words: Words, weights: np.ndarray) -> float:
    """The share of the network's probability in a token's, of those in TRUST the one that suits a one-column table of texts best; 0 without texts."""
    sent = texts.sparkSession.sparkContext.broadcast((words, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, values = sent.value
        total = np.zeros(len(TRUST))
        for *_, gain in _gains(own, values, _parts(batches)):
            total += [float(np.log1p(t * (gain.astype(np.float64) - 1)).sum()) for t in TRUST]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(TRUST), dtype=np.int32)), pa.array(total)], names=["i", "gain"])

    found = {r["i"]: r["gain"] for r in texts.mapInArrow(flat.lean(run), "i int, gain double").groupBy("i").agg(F.sum("gain").alias("gain")).collect()}
    return TRUST[max(found, key=lambda i: (round(found[i], 6), -i))] if found else 0.0


SCHEMA = "doc_id long, rid long, held_out boolean, n_tokens long, n_known long, base double, gain double, n_rest long, rest array<long>"


def _scored(docs: DataFrame, words: Words, weights: np.ndarray, trust: float) -> DataFrame:
    """Sums over the words of the head; rest: hashes of the others, whose counts are to be joined."""
    sent = docs.sparkSession.sparkContext.broadcast((words, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, values = sent.value
        log10 = np.log10((own.counts + 0.5) / own.weight) if len(own.counts) else np.zeros(1)
        for columns, h, ptr, at, known, gain in _gains(own, values, _parts(batches)):
            docs_n, doc = len(ptr) - 1, np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
            base = np.where(known, log10[at], 0.0)
            more = np.log1p(trust * (gain.astype(np.float64) - 1)) / np.log(10)
            rest = ~known
            n_rest = np.bincount(doc[rest], minlength=docs_n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_rest)]).astype(np.int32)), pa.array(h[rest].view(np.int64)))
            others = [pa.concat_arrays(c) for c in zip(*columns)]
            facts = [np.diff(ptr), np.bincount(doc[known], minlength=docs_n), np.bincount(doc, weights=base, minlength=docs_n), np.bincount(doc, weights=more, minlength=docs_n), n_rest]
            yield pa.RecordBatch.from_arrays([*others, *(pa.array(x) for x in facts), lists], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.mapInArrow(flat.lean(run), SCHEMA)


def train(rows: DataFrame, words: Words) -> tuple[np.ndarray, float]:
    """(weights, trust) learned from rows (doc_id, text)."""
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(SHARES))
    weights = None
    for k in range(ROUNDS):
        weights = fit(rows.where((part >= SPARE) & (part % ROUNDS == k)).select("text"), words, weights)
    return weights, trust_of(rows.where(part < SPARE).select("text"), words, weights)


def score_documents(docs: DataFrame, held_out: str = "pmod(crc32(cast(doc_id as string)), 5) = 1") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Learns from the rows for which held_out isn't true. A null or empty text is its end token
    alone. Rows that repeat get the same scores. Without training rows every word is unknown and
    the network isn't trusted: score is base_score. The counts are exact; score depends a little on
    how the table is split into tasks, as each learns for itself before the average.
    """
    ship(docs.sparkSession)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").withColumn("held_out", F.coalesce(F.expr(held_out), F.lit(False)))
    seen = rows.where("not held_out")
    counts = stored(count_words(seen.select("text")), "counts")
    words = head_of(counts)
    weights, trust = train(seen.select("doc_id", "text"), words)
    scored = stored(_scored(rows.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "held_out", "text"), words, weights, trust), "scored")
    rest = scored.select("rid", F.explode("rest").alias("w")).join(counts, "w", "left")
    log10 = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(words.weight))
    sums = rest.groupBy("rid").agg(F.sum(log10).alias("log10"), F.count("n").alias("known"), F.count("*").alias("c"))
    share = F.coalesce(F.col("n_rest") / F.col("c"), F.lit(1.0))  # rows that repeat share their sums
    base = F.col("base") + F.coalesce(F.col("log10") * share, F.lit(0.0))
    return scored.join(sums, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce(F.round(F.col("known") * share).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, learned from those not held out."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
