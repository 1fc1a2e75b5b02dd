"""Gradient-boosted regression trees, one model for each key, grown from histograms for many keys at once.

Each feature of a key becomes a few bins. A level of a tree is one histogram (key, node, feature, bin) of residuals; all
keys' best splits follow from its running sums. Keys with up to MOST_ROWS rows are dealt to tasks, many to a
task, and grown there together. A key with more rows is grown by all tasks: each makes the histogram of its part,
the parts are added, and only splits go back. What a key's rows become does not depend on which way it went,
up to the order in which sums are added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherlode.runtime import discard, ship, stored

MOST_ROWS = 100_000
TOGETHER_ROWS = 50_000
"""Rows that one task grows together, on average."""
CELLS = 1_000_000
"""Histogram cells that are worked on at a time: few enough for a processor's cache."""
PREDICT_ROWS = 1000
"""Rows that go down their trees at a time, for the same reason."""
REFRESH = 10
"""Large keys: after so many trees their rows are written anew with what the trees predict so far."""
WAVE = 64
"""Large keys that are grown at a time."""


@dataclass(frozen=True)
class Params:
    trees: int = 100
    depth: int = 5
    rate: float = 0.1
    bins: int = 32

    @property
    def inner(self) -> int:
        return (1 << self.depth) - 1


@dataclass
class Forest:
    """Models of K keys. edges: (K, features, bins - 1), padded with infinity; feature, cut: (K, trees, inner nodes), feature -1 is no split; leaf: (K, trees, leaves)."""

    base: np.ndarray
    edges: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def codes(self, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Bins of rows (n, features) whose keys are `owner`."""
        return (x[:, :, None] > self.edges[owner]).sum(axis=2, dtype=np.uint8)

    def predict(self, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """All trees of a row go down together."""
        return Descent(self).predict(x, owner)


class Descent:
    """A forest as flat tables that are read by place; made once where many predictions follow."""

    def __init__(self, forest: Forest) -> None:
        self.forest, (_, self.trees, self.inner) = forest, forest.feature.shape
        self.step = np.where(forest.feature >= 0, forest.feature.astype(np.int32) * 256 + forest.cut, 255).ravel()  # no code is above 255
        self.leaf = forest.leaf.ravel()

    def predict(self, x: np.ndarray, owner: np.ndarray) -> np.ndarray:
        out, width = self.forest.base[owner], x.shape[1]
        if not self.trees:
            return out
        for a in range(0, len(x), PREDICT_ROWS):
            own = owner[a : a + PREDICT_ROWS]
            code = self.forest.codes(x[a : a + PREDICT_ROWS], own).ravel()
            tree = (own[:, None] * self.trees + np.arange(self.trees)).ravel()
            first, row = tree * self.inner, np.repeat(np.arange(len(own)) * width, self.trees)
            at = np.zeros(len(tree), np.int64)
            while at[0] < self.inner:
                step = self.step.take(first + at)
                at += at
                at += 1
                at += code.take(row + (step >> 8)) > (step & 255)
            out[a : a + PREDICT_ROWS] += self.leaf.take(tree * (self.inner + 1) + (at - self.inner)).reshape(len(own), -1).sum(axis=1)
        return out


def edges_of(x: np.ndarray, bins: int) -> np.ndarray:
    """(features, bins - 1): between each two of a feature's values where these are few, else by equal shares; a value on an edge is below it."""
    out = np.full((x.shape[1], bins - 1), np.inf)
    x = np.sort(x, axis=0)
    at = (len(x) - 1) * np.arange(1, bins) // bins
    for f, column in enumerate(x.T):
        values = column[np.concatenate([[True], column[1:] != column[:-1]])]
        if len(values) <= bins:
            out[f, : len(values) - 1] = values[:-1]
        else:
            cuts = column[at]
            cuts = cuts[np.concatenate([[True], cuts[1:] != cuts[:-1]])]
            out[f, : len(cuts)] = cuts
    return out


def splits(count: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature or -1, bin) of the best split of each node, from histograms (features, bins, nodes) of floats, which are overwritten: the first one with the least squared error."""
    for b in range(1, count.shape[1]):
        count[:, b] += count[:, b - 1]
        total[:, b] += total[:, b - 1]
    left_n, left, n, s = count[:, :-1], total[:, :-1], count[0, -1].copy(), total[0, -1].copy()
    mean = s / np.maximum(n, 1)
    # what both sides' squared sums by their sizes give above the whole's, as one square: (left - left_n mean)^2 n / left_n / right_n
    left -= left_n * mean
    left *= left
    both = n - left_n
    both *= left_n
    both[both == 0] = np.inf  # a side without rows
    gain = np.divide(left, both, out=left)
    # sums in another order differ in the last digits: of gains that are equal but for that, the first
    top = gain.max(axis=1)
    best = top.max(axis=0)
    least = best * (1 - 1e-9)
    f = (top >= least).argmax(axis=0)
    cut = (gain[f, :, np.arange(len(n))] >= least[:, None]).argmax(axis=1)
    return np.where(best * n > 1e-9 * (np.abs(mean) + 1e-9) ** 2, f, -1), cut


def histogram(code: np.ndarray, slot: np.ndarray, value: np.ndarray, slots: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums of value) by (slot, feature, bin)."""
    n, features = code.shape
    at = ((slot[:, None] * features + np.arange(features)) * bins + code).ravel()
    shape, size = (slots, features, bins), slots * features * bins
    return np.bincount(at, minlength=size).reshape(shape), np.bincount(at, weights=np.repeat(value, features), minlength=size).reshape(shape)


def descended(code: np.ndarray, owner: np.ndarray, node: np.ndarray, level: int, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Nodes of the next level, counted from 0; where there is no split, the left one."""
    at = (1 << level) - 1 + node
    f = feature[owner, at]
    return 2 * node + ((f >= 0) & (code[np.arange(len(code)), np.maximum(f, 0)] > cut[owner, at]))


def _told_apart(code: np.ndarray) -> list[int]:
    """Of features (features, rows) whose bins are the same for every row the first; none that has one bin."""
    out: list[int] = []
    for f in range(len(code)):
        if code[f].any() and not any(np.array_equal(code[f], code[g]) for g in out):
            out.append(f)
    return out or [0]


def grow(x: np.ndarray, y: np.ndarray, owner: np.ndarray, keys: int, p: Params) -> Forest:
    """Models of `keys` keys from their training rows, which are sorted by key; every key has one at least."""
    n = np.bincount(owner, minlength=keys)
    edges = np.stack([edges_of(part, p.bins) for part in np.split(x, np.cumsum(n)[:-1])])
    base = np.bincount(owner, weights=y, minlength=keys) / n
    out = Forest(base, edges, np.full((keys, p.trees, p.inner), -1, np.int8), np.zeros((keys, p.trees, p.inner), np.uint8), np.zeros((keys, p.trees, p.inner + 1)))
    code, sofar = out.codes(x, owner), base[owner]
    kept = _told_apart(code.T)  # another feature's splits would never be the first among equal ones
    columns, number = [np.ascontiguousarray(code[:, f], np.int64) for f in kept], np.array(kept)
    flat, rows = code.ravel(), np.arange(len(code)) * code.shape[1]
    for t in range(p.trees):
        rest, node = y - sofar, np.zeros(len(y), np.int64)
        for level in range(p.depth):
            wide = 1 << level
            own = owner * wide + node
            live = np.flatnonzero(np.bincount(own, minlength=keys * wide) > 1)  # a row alone isn't split; all such meet in one more slot
            place = np.full(keys * wide, len(live))
            place[live] = np.arange(len(live))
            slot, m = place[own], len(live) + 1
            count, total = np.empty((2, len(kept), p.bins, m))
            for f, column in enumerate(columns):
                at = column * m
                at += slot
                count[f] = np.bincount(at, minlength=p.bins * m).reshape(p.bins, m)
                total[f] = np.bincount(at, weights=rest, minlength=p.bins * m).reshape(p.bins, m)
            f, c = splits(count[:, :, :-1], total[:, :, :-1])
            feature, cut = np.full(keys * wide, -1), np.full(keys * wide, 255)
            feature[live], cut[live] = np.where(f < 0, -1, number[f]), np.where(f < 0, 255, c)
            node = 2 * node + (flat[rows + np.maximum(feature, 0)[own]] > cut[own])
            out.feature[:, t, wide - 1 : 2 * wide - 1], out.cut[:, t, wide - 1 : 2 * wide - 1] = feature.reshape(keys, wide), cut.reshape(keys, wide)
        slot = owner * (p.inner + 1) + node
        count = np.bincount(slot, minlength=out.leaf[:, t].size)
        leaf = p.rate * np.bincount(slot, weights=rest, minlength=out.leaf[:, t].size) / np.maximum(count, 1)
        out.leaf[:, t] = leaf.reshape(keys, -1)
        sofar = sofar + leaf[slot]
    return out


# a model as a row

MODEL = "base double, edges binary, feature binary, cut binary, leaf binary, n_train long, n_test long, r2 double"
PACKED = ("edges", "feature", "cut", "leaf")
KINDS = {"edges": np.float64, "feature": np.int8, "cut": np.uint8, "leaf": np.float64}


def packed(forest: Forest, k: int) -> tuple:
    return (float(forest.base[k]), *(getattr(forest, c)[k].tobytes() for c in PACKED))


def unpacked(rows: pd.DataFrame, p: Params) -> Forest:
    shapes = {"edges": (-1, p.bins - 1), "feature": (p.trees, p.inner), "cut": (p.trees, p.inner), "leaf": (p.trees, p.inner + 1)}
    parts = {c: np.stack([np.frombuffer(v, KINDS[c]).reshape(shapes[c]) for v in rows[c]]) for c in PACKED}
    return Forest(rows["base"].to_numpy(float), **parts)


def r2_of(y: np.ndarray, guess: np.ndarray, owner: np.ndarray, keys: int) -> np.ndarray:
    """R² of each key; nan where a key has less than two rows or no spread."""
    n = np.bincount(owner, minlength=keys)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.bincount(owner, weights=y, minlength=keys) / n
        spread = np.bincount(owner, weights=(y - mean[owner]) ** 2, minlength=keys)
        return np.where((n > 1) & (spread > 0), 1 - np.bincount(owner, weights=(y - guess) ** 2, minlength=keys) / spread, np.nan)


def values_of(lists: pd.Series) -> np.ndarray:
    """A column of lists of equal length as a table."""
    return np.concatenate(lists.to_numpy()).reshape(len(lists), -1).astype(float, copy=False) if len(lists) else np.zeros((0, 1))


def _together(frame: pd.DataFrame, p: Params) -> Iterator[tuple[np.ndarray, pd.DataFrame, np.ndarray, Forest]]:
    """(keys, their rows by key and order, owner, models) of a task's keys, as many at a time as memory has cells for."""
    frame = frame.sort_values(["key", "id"], kind="stable")
    names, owner = np.unique(frame["key"].to_numpy(), return_inverse=True)
    x, y, test = values_of(frame["x"]), frame["y"].to_numpy(float), frame["test"].to_numpy(bool)
    most = max(1, CELLS // ((p.inner + 1) // 2 * x.shape[1] * p.bins))
    for a in range(0, len(names), most):
        inside = slice(*np.searchsorted(owner, (a, a + most)))
        own = owner[inside] - a
        k = min(most, len(names) - a)
        learn = ~test[inside]
        lonely = np.bincount(own[learn], minlength=k) == 0  # keys whose rows are all for testing learn from them
        learn |= lonely[own]
        yield names[a : a + k], frame[inside], own, grow(x[inside][learn], y[inside][learn], own[learn], k, p)


def _columns(rows: DataFrame, key: str, order: str, features: tuple[str, ...], target: str) -> DataFrame:
    """(key, id, x, y, test): a fifth of a key's rows, by hash of their order, is for testing."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    return rows.select(F.col(key).alias("key"), F.col(order).alias("id"), x.alias("x"), F.col(target).cast("double").alias("y"), (F.pmod(F.xxhash64(key, order), F.lit(5)) == 0).alias("test"))


def fit_predict(rows: DataFrame, key: str, order: str, features: tuple[str, ...], target: str, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(models, predictions): a model for each key (key and MODEL), and what it gives for each of its rows (key, order, prediction).

    rows: complete ones, a key's rows told apart by `order`. Each is computed when it is asked for.
    """
    spark = ship(rows.sparkSession)
    data = stored(_columns(rows, key, order, features, target), "training")
    sizes = data.groupBy("key").agg(F.count("*").alias("n"))
    large = [r["key"] for r in sizes.where(F.col("n") > MOST_ROWS).orderBy("key").select("key").collect()]  # a MOST_ROWS-th of all rows at most
    small = data.where(~F.col("key").isin(large)) if large else data
    total = small.count()
    buckets = max(1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TOGETHER_ROWS))  # several a partition even out
    grouped = small.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    kind, other = data.schema["key"].dataType.simpleString(), data.schema["id"].dataType.simpleString()

    def models(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for names, part, own, forest in _together(frame, p):
            test = part["test"].to_numpy(bool)
            x = values_of(part["x"])[test]
            r2 = r2_of(part["y"].to_numpy(float)[test], forest.predict(x, own[test]), own[test], len(names)) if test.any() else np.full(len(names), np.nan)
            n = [np.bincount(own[test == t], minlength=len(names)) for t in (False, True)]
            out += [(name, *packed(forest, k), int(n[0][k]), int(n[1][k]), None if np.isnan(r2[k]) else float(r2[k])) for k, name in enumerate(names)]
        return pd.DataFrame(out, columns=["key", *(c.split()[0] for c in MODEL.split(", "))])

    def predictions(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"key": part["key"], "id": part["id"], "prediction": forest.predict(values_of(part["x"]), own)}) for _, part, own, forest in _together(frame, p)]
        return pd.concat(parts)

    made = grouped.applyInPandas(models, f"key {kind}, {MODEL}")
    guessed = grouped.applyInPandas(predictions, f"key {kind}, id {other}, prediction double")
    for a in range(0, len(large), WAVE):
        more, far = _grown_by_all(data, large[a : a + WAVE], len(features), p)
        made, guessed = made.unionByName(more), guessed.unionByName(far)
    return made.withColumnRenamed("key", key), guessed.withColumnsRenamed({"key": key, "id": order})


def _grown_by_all(data: DataFrame, names: list, features: int, p: Params) -> tuple[DataFrame, DataFrame]:
    """(models, predictions) of a few keys with many rows: every level is one pass over their rows."""
    spark, keys = data.sparkSession, len(names)
    at = {name: k for k, name in enumerate(names)}
    own = data.where(F.col("key").isin(names))
    shares = [k / p.bins for k in range(1, p.bins)]
    learn = own.where("not test")
    facts = {r["key"]: r for r in learn.groupBy("key").agg(F.avg("y").alias("base"), *[F.percentile_approx(F.col("x")[f], shares, 10_000).alias(f"e{f}") for f in range(features)]).collect()}
    edges = np.full((keys, features, p.bins - 1), np.inf)
    for name, k in at.items():
        for f in range(features):
            cuts = np.unique(np.array(facts[name][f"e{f}"], float))
            edges[k, f, : len(cuts)] = cuts
    forest = Forest(np.array([facts[name]["base"] for name in names]), edges, np.full((keys, p.trees, p.inner), -1, np.int8), np.zeros((keys, p.trees, p.inner), np.uint8), np.zeros((keys, p.trees, p.inner + 1)))
    base = F.create_map(*[x for name in names for x in (F.lit(name), F.lit(float(facts[name]["base"])))])
    state, old = learn.withColumn("sofar", base[F.col("key")]).select("key", "x", "y", "sofar"), None

    def parted(frame: pd.DataFrame, sent: Forest, done: int, upto: int) -> tuple:
        """(owner, codes, prediction so far) of rows, with the trees from `done` to `upto` added."""
        owner = frame["key"].map(at).to_numpy(np.int64)
        x = np.array(frame["x"].tolist(), float).reshape(len(frame), features)
        part = Forest(np.zeros(keys), sent.edges, sent.feature[:, done:upto], sent.cut[:, done:upto], sent.leaf[:, done:upto])
        return owner, part.codes(x, owner), frame["sofar"].to_numpy(float) + (part.predict(x, owner) if upto > done else 0.0)

    for t in range(p.trees):
        if t % REFRESH == 0:
            if t:
                sent = spark.sparkContext.broadcast(forest)

                def forward(frames: Iterator[pd.DataFrame], sent=sent, t=t) -> Iterator[pd.DataFrame]:
                    for frame in frames:
                        yield frame.assign(sofar=parted(frame, sent.value, t - REFRESH, t)[2])

                state = state.mapInPandas(forward, state.schema)
            state, old = stored(state, "boosting"), state
            if t:
                discard(old)
        done = t - t % REFRESH
        for level in range(p.depth + 1):
            wide = 1 << level
            sent = spark.sparkContext.broadcast(forest)

            def sums(frames: Iterator[pd.DataFrame], sent=sent, level=level, wide=wide, done=done, t=t) -> Iterator[pd.DataFrame]:
                shape = (keys * wide, features, p.bins) if level < p.depth else (keys * wide, 1, 1)
                count, total = np.zeros(shape), np.zeros(shape)
                for frame in frames:
                    owner, code, sofar = parted(frame, sent.value, done, t)
                    node = np.zeros(len(frame), np.int64)
                    for above in range(level):
                        node = descended(code, owner, node, above, sent.value.feature[:, t], sent.value.cut[:, t])
                    n, s = histogram(code if level < p.depth else np.zeros((len(code), 1), np.int64), owner * wide + node, frame["y"].to_numpy(float) - sofar, keys * wide, shape[2])
                    count, total = count + n, total + s
                cell = np.flatnonzero(count)
                yield pd.DataFrame({"cell": cell, "n": count.ravel()[cell], "s": total.ravel()[cell]})

            # as many rows as there are occupied cells, whatever the number of rows below
            found = state.mapInPandas(sums, "cell long, n double, s double").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toPandas()
            shape = (keys * wide, features, p.bins) if level < p.depth else (keys, wide)
            count, total = np.zeros(shape), np.zeros(shape)
            count.ravel()[found["cell"]], total.ravel()[found["cell"]] = found["n"], found["s"]
            if level < p.depth:
                f, c = splits(*(np.ascontiguousarray(h.transpose(1, 2, 0)) for h in (count, total)))
                forest.feature[:, t, wide - 1 : 2 * wide - 1], forest.cut[:, t, wide - 1 : 2 * wide - 1] = f.reshape(keys, wide), c.reshape(keys, wide)
            else:
                forest.leaf[:, t] = p.rate * total / np.maximum(count, 1)
    discard(state)
    sent = spark.sparkContext.broadcast(forest)

    def predicted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            owner = frame["key"].map(at).to_numpy(np.int64)
            yield pd.DataFrame({"key": frame["key"], "id": frame["id"], "prediction": sent.value.predict(np.array(frame["x"].tolist(), float).reshape(len(frame), features), owner)})

    guessed = own.select("key", "id", "x").mapInPandas(predicted, f"key {data.schema['key'].dataType.simpleString()}, id {data.schema['id'].dataType.simpleString()}, prediction double")
    tested = own.join(guessed, ["key", "id"])
    miss = F.sum(F.when(F.col("test"), (F.col("y") - F.col("prediction")) ** 2))
    spread = F.var_pop(F.when(F.col("test"), F.col("y"))) * F.count(F.when(F.col("test"), 1))
    quality = {r["key"]: r for r in tested.groupBy("key").agg(F.count(F.when(~F.col("test"), 1)).alias("n_train"), F.count(F.when(F.col("test"), 1)).alias("n_test"), F.when(spread > 0, 1 - miss / spread).alias("r2")).collect()}
    rows = [(name, *packed(forest, k), quality[name]["n_train"], quality[name]["n_test"], quality[name]["r2"]) for name, k in at.items()]
    return spark.createDataFrame(rows, f"key {data.schema['key'].dataType.simpleString()}, {MODEL}"), guessed
