"""Price features over time windows, a boosted regressor for each key and a recursive forecast."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cipherlode.operators import boosting
from cipherlode.runtime import ship, stored

FEATURES = ("days", "open", "high", "low", "volume", "price_change", "average_price", "daily_return", "ma_7", "volatility")
WEEK = 7
STEPS_OUT = 30
"""Steps of a forecast that are given out together."""
KEYS_AHEAD = 200
"""Keys whose forecasts are made together: their trees, 45 kB each, stay in a processor's cache."""


def features(prices: DataFrame, key: str = "ticker", time: str = "ts", tie: str | None = None) -> DataFrame:
    """Adds the window features to rows (key, time, open, high, low, close, volume).

    One shuffle by key serves all windows. Rolling values are null until seven rows are there.
    """
    order = [time] + ([tie] if tie else [])
    w = Window.partitionBy(key).orderBy(*order)
    week, whole = w.rowsBetween(-6, 0), Window.partitionBy(key)
    full = F.count("close").over(week) == 7
    before = F.lag("close", 1).over(w)
    return prices.withColumns({
        "days": F.timestamp_diff("DAY", F.min(time).over(whole), F.col(time)), "price_change": F.col("high") - F.col("low"), "average_price": (F.col("high") + F.col("low")) / 2, "daily_return": F.col("close") / F.nullif(before, F.lit(0.0)) - 1,
        "ma_7": F.when(full, F.avg("close").over(week)), "volatility": F.when(full, F.stddev_samp("close").over(week)), "next_close": F.lead("close", 1).over(w),
    })


def complete(rows: DataFrame) -> DataFrame:
    """Rows without any null."""
    return rows.na.drop()


def models(rows: DataFrame, key: str = "ticker", order: str = "ts", columns: tuple[str, ...] = FEATURES, target: str = "next_close", trees: int = 100) -> tuple[DataFrame, DataFrame]:
    """(models, predictions) of complete rows: one model for each key, learned from four fifths of its rows. See boosting.fit_predict."""
    return boosting.fit_predict(rows, key, order, columns, target, boosting.Params(trees=trees))


def _ahead(forest: boosting.Forest, last: np.ndarray, closes: np.ndarray, steps: int) -> Iterator[np.ndarray]:
    """Prices of all keys, step by step: each prediction becomes the next day, whose features follow from the last week."""
    x, owner, trees = last.copy(), np.arange(len(last)), boosting.Descent(forest)
    for _ in range(steps):
        price = np.maximum(trees.predict(x, owner), 0.01)
        before = closes[:, -1]
        closes = np.column_stack([closes, price])[:, -WEEK:]
        high, low = np.maximum(before, price), np.minimum(before, price)
        change = np.divide(price - before, before, out=np.zeros_like(price), where=before != 0)
        x = np.column_stack([x[:, 0] + 1, before, high, low, x[:, 4], high - low, (high + low) / 2, change, closes.mean(axis=1), closes.std(axis=1, ddof=1) if closes.shape[1] > 1 else np.zeros(len(price))])
        yield price


def last_week(rows: DataFrame, key: str = "ticker", time: str = "ts", tie: str | None = None) -> DataFrame:
    """(key, n, last: FEATURES of the last row, closes: at most seven, oldest first) of complete rows."""
    order = [F.desc(time)] + ([F.desc(tie)] if tie else [])
    w = Window.partitionBy(key).orderBy(*order)
    ranked = rows.withColumns({"_k": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(key))}).where(F.col("_k") <= WEEK)
    inputs = F.array(*[F.col(f).cast("double") for f in FEATURES])
    weeks = ranked.groupBy(key).agg(F.max("_n").alias("n"), F.min_by(inputs, "_k").alias("last"), F.sort_array(F.collect_list(F.struct("_k", "close")), False).alias("w"))
    return weeks.select(key, "n", "last", F.transform("w", lambda x: x["close"]).alias("closes"))


def recursive(weeks: DataFrame, made: DataFrame, steps: int, key: str = "ticker", trees: int = 100, first: int = 1) -> DataFrame:
    """(key, step, forecast) from what last_week gave and each key's own model: each step feeds the next. Steps before `first` aren't given out.

    Sequential in the steps, so a task takes its keys together; a key is one row of last values and a model.
    """
    ship(weeks.sparkSession)
    p = boosting.Params(trees=trees)
    kind = weeks.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            alike = [part.iloc[a : a + KEYS_AHEAD] for _, part in frame.groupby(frame["closes"].map(len)) for a in range(0, len(part), KEYS_AHEAD)]
            for part in alike:
                keys, held, done = part[key].to_numpy(), [], first - 1
                prices = _ahead(boosting.unpacked(part, p), boosting.values_of(part["last"]), boosting.values_of(part["closes"]), steps)
                for price in islice(prices, first - 1, None):
                    held.append(price)
                    if len(held) == STEPS_OUT or done + len(held) == steps:
                        n = len(held)
                        yield pd.DataFrame({key: np.tile(keys, n), "step": np.repeat(np.arange(done + 1, done + n + 1), len(keys)), "forecast": np.concatenate(held)})
                        held, done = [], done + n

    joined = weeks.select(key, "last", "closes").join(made.select(key, "base", *boosting.PACKED), key)
    return joined.mapInPandas(run, f"{key} {kind}, step int, forecast double")


def forecast(prices: DataFrame, years: int, key: str = "ticker", time: str = "ts", tie: str | None = None, trees: int = 100) -> DataFrame:
    """(key, current_price, future_price, change_percentage, years, r2, data_points): each key's own model, then 365 steps a year.

    r2 is of the fifth of a key's rows that its model hasn't seen; null with less than two such rows. Keys without a
    complete row are left out.
    """
    rows = stored(complete(features(prices, key, time, tie)), "prices")
    made = stored(models(rows, key, tie or time, trees=trees)[0], "models")
    weeks = last_week(rows, key, time, tie)
    future = recursive(weeks, made, years * 365, key, trees, first=years * 365)
    done = weeks.join(future, key).join(made.select(key, "r2"), key).select(key, F.element_at("closes", -1).alias("current_price"), F.col("forecast").alias("future_price"), F.col("n").alias("data_points"), "r2")
    change = outcome(F.col("current_price"), F.col("future_price"))[0]
    return done.select(key, "current_price", "future_price", change.alias("change_percentage"), F.lit(years).alias("years"), "r2", "data_points")


def outcome(last_close, forecast):
    """Percentage change and what a thousand units become."""
    change = (forecast - last_close) / F.nullif(last_close, F.lit(0.0)) * 100.0
    return change, F.lit(1000.0) + F.lit(1000.0) * change / 100.0
