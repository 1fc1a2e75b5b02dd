"""Boosted models of each key against loops over the rows, and the recursion that feeds them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cipherlode.operators import boosting, forecast
from cipherlode.plans import queries


def plain_model(x, y, p):
    """(base, trees) of one key: a tree is (feature, value, left, right) or a number; splits by trying each value of each feature."""
    edges = boosting.edges_of(x, p.bins)

    def grow(rows, rest, depth):
        n, s, best = len(rows), sum(rest[r] for r in rows), (0.0, None)
        if depth < p.depth:
            gains = []
            for f in range(x.shape[1]):
                for cut in edges[f][np.isfinite(edges[f])]:
                    low = [r for r in rows if x[r, f] <= cut]
                    if 0 < len(low) < n:
                        left = sum(rest[r] for r in low)
                        gains.append((left**2 / len(low) + (s - left) ** 2 / (n - len(low)) - s**2 / n, f, cut))
            top = max((g[0] for g in gains), default=0.0)
            best = next(((g, (f, cut)) for g, f, cut in gains if g >= top * (1 - 1e-9)), best)
        if best[1] is None or best[0] <= 1e-9 * (abs(s) / n + 1e-9) ** 2:
            return p.rate * s / n
        f, cut = best[1]
        return f, cut, grow([r for r in rows if x[r, f] <= cut], rest, depth + 1), grow([r for r in rows if x[r, f] > cut], rest, depth + 1)

    base = sum(y) / len(y)
    trees, sofar = [], [base] * len(y)
    for _ in range(p.trees):
        trees.append(grow(list(range(len(y))), [a - b for a, b in zip(y, sofar)], 0))
        sofar = [b + walked(trees[-1], x[r]) for r, b in enumerate(sofar)]
    return base, trees


def walked(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.fixture(scope="module")
def rows(spark, sf):
    return forecast.complete(forecast.features(queries._prices(spark, sf).where("ticker < 6"), tie="event_id")).cache()


def learned(rows, p, key="ticker"):
    """{key: (x, y, test)} as the models see them, in order."""
    data = boosting._columns(rows, key, "event_id", forecast.FEATURES, "next_close").toPandas().sort_values("id")
    return {k: (np.array(g["x"].tolist()), g["y"].tolist(), g["test"].to_numpy(bool), g["id"].tolist()) for k, g in data.groupby("key")}


@pytest.mark.parametrize("most", [boosting.MOST_ROWS, 20])
def test_models_equal_a_plain_version(rows, monkeypatch, most):
    """Every prediction of every key, grown together in a task or, as if they were large, by all tasks."""
    monkeypatch.setattr(boosting, "MOST_ROWS", most)
    monkeypatch.setattr(boosting, "REFRESH", 2)
    p = boosting.Params(trees=5 if most == 20 else 30, depth=3 if most == 20 else 5, bins=8 if most == 20 else 32)
    if most == 20:
        exact = lambda x, bins: np.stack([np.pad(u := np.unique(np.quantile(x[:, f], np.arange(1, bins) / bins, method="inverted_cdf")), (0, bins - 1 - len(u)), constant_values=np.inf) for f in range(x.shape[1])])  # noqa: E731, F841
        monkeypatch.setattr(boosting, "edges_of", exact)  # the plain version's; large keys have quantiles only
    made, guessed = boosting.fit_predict(rows, "ticker", "event_id", forecast.FEATURES, "next_close", p)
    got = {(r.ticker, r.event_id): r.prediction for r in guessed.collect()}
    facts = {r.ticker: r for r in made.collect()}
    data = learned(rows, p)
    assert len(facts) == len(data) >= 3 and len(got) == rows.count()
    for k, (x, y, test, ids) in data.items():
        base, trees = plain_model(x[~test], [v for v, t in zip(y, test) if not t], p)
        want = [base + sum(walked(t, row) for t in trees) for row in x]
        assert max(abs(got[k, i] - w) for i, w in zip(ids, want)) < 1e-6
        assert (facts[k].n_train, facts[k].n_test) == (int((~test).sum()), int(test.sum()))
        seen, guess = np.array(y)[test], np.array(want)[test]
        assert abs(facts[k].r2 - (1 - ((seen - guess) ** 2).sum() / ((seen - seen.mean()) ** 2).sum())) < 1e-6


def test_keys_with_few_rows(spark):
    data = [("one", 1, 2.0, 5.0), ("same", 1, 1.0, 3.0), ("same", 2, 1.0, 3.0), ("same", 3, 1.0, 3.0)] + [("line", i, float(i), 2.0 * i) for i in range(40)]
    df = spark.createDataFrame(data, "k string, i long, a double, y double")
    made, guessed = boosting.fit_predict(df, "k", "i", ("a",), "y")
    got = {(r.k, r.i): r.prediction for r in guessed.collect()}
    assert got["one", 1] == 5.0 and {got["same", i] for i in (1, 2, 3)} == {3.0} and all(abs(got["line", i] - 2 * i) < 5 for i in range(40))
    assert {r.k: r.r2 for r in made.where("k <> 'line'").collect()} == {"one": None, "same": None} and made.where("k = 'line'").first().r2 > 0.9
    assert boosting.fit_predict(df.limit(0), "k", "i", ("a",), "y")[1].count() == 0


def test_forecast_feeds_the_model(rows):
    """Each step by the plain recursion, a row at a time, with each key's own model."""
    p = boosting.Params(trees=5)
    made = forecast.models(rows, order="event_id", trees=5)[0]
    weeks = forecast.last_week(rows, tie="event_id")
    got = {(r.ticker, r.step): r.forecast for r in forecast.recursive(weeks, made, 40, trees=5).collect()}
    assert len(got) == 40 * weeks.count() > 0
    own = made.toPandas().set_index("ticker")
    for w in weeks.collect():
        forest = boosting.unpacked(own.loc[[w.ticker]], p)
        x, closes = dict(zip(forecast.FEATURES, w["last"])), list(w.closes)
        for step in range(1, 41):
            price = max(0.01, float(forest.predict(np.array([[x[f] for f in forecast.FEATURES]]), np.array([0]))[0]))
            closes.append(price)
            before, week = closes[-2], closes[-7:]
            mean = sum(week) / len(week)
            spread = (sum((c - mean) ** 2 for c in week) / (len(week) - 1)) ** 0.5 if len(week) > 1 else 0.0
            high, low = max(before, price), min(before, price)
            x |= {"days": x["days"] + 1, "open": before, "high": high, "low": low, "price_change": high - low, "average_price": (high + low) / 2, "daily_return": (price - before) / before if before else 0.0, "ma_7": mean, "volatility": spread}
            assert abs(got[w.ticker, step] - price) < 1e-6


def test_forecast_of_years(spark, sf):
    got = forecast.forecast(queries._prices(spark, sf).where("ticker < 4"), 1, tie="event_id", trees=3).collect()
    assert got and all(r.years == 1 and r.data_points > 0 and r.future_price >= 0.01 for r in got) and len({r.r2 for r in got}) > 1
    assert all(abs(r.change_percentage - (r.future_price - r.current_price) / r.current_price * 100) < 1e-9 for r in got)


def test_queries_have_all_trees_and_a_year(spark, sf):
    prices = forecast.complete(forecast.features(queries._prices(spark, sf), tie="event_id"))
    assert boosting.Params().trees == 100 and queries.QUERIES["m02_boosted_forecast"](spark, sf).count() == prices.count()
    got = queries.QUERIES["w08_recursive_forecast"](spark, sf)
    assert {r["count"] for r in got.groupBy("ticker").count().collect()} == {365}
    assert prices.select(F.countDistinct("ticker")).first()[0] == got.select("ticker").distinct().count()


def test_splits_look_only_where_one_may_be(monkeypatch):
    """Columns that bin alike are looked at once, and single rows never; the models stay the plain ones."""
    rng, p, keys, n = np.random.default_rng(5), boosting.Params(trees=6), 7, 30
    a, b = rng.integers(0, 500, keys * n).astype(float), rng.normal(size=keys * n)
    x, y, owner = np.column_stack([a, b, a + 1, np.ones(len(a)), (a + a + 1) / 2]), np.round(a % 7 + 3 * b, 2), np.repeat(np.arange(keys), n)
    cells, plain = [], boosting.splits
    monkeypatch.setattr(boosting, "splits", lambda count, total: cells.append(count.size) or plain(count, total))
    got = boosting.grow(x, y, owner, keys, p).predict(x, owner)
    assert 0 < sum(cells) < 0.4 * p.trees * p.inner * keys * x.shape[1] * p.bins
    for k in range(keys):
        base, trees = plain_model(x[owner == k], y[owner == k].tolist(), p)
        assert np.allclose(got[owner == k], [base + sum(walked(t, row) for t in trees) for row in x[owner == k]], atol=1e-9)


def test_keys_that_fit_a_task_are_not_grown_by_all(spark, monkeypatch):
    monkeypatch.setattr(boosting, "_grown_by_all", lambda *_: pytest.fail("a pass over all rows for every level"))
    df = spark.range(25_000).selectExpr("1L as k", "id as i", "cast(id % 1000 as double) as a", "cast(id % 1000 as double) as y")
    made, _ = boosting.fit_predict(df, "k", "i", ("a",), "y", boosting.Params(trees=2))
    assert made.first().n_train + made.first().n_test == 25_000


def test_descent_of_many_rows(monkeypatch):
    """Trees as flat tables give each row what walking down by hand gives, however many rows go at a time."""
    rng, p, keys, n = np.random.default_rng(6), boosting.Params(trees=4, depth=3, bins=8), 5, 25
    x, owner = rng.normal(size=(keys * n, 3)), np.repeat(np.arange(keys), n)
    forest = boosting.grow(x, np.where(owner == 2, 1.0, x[:, 1]), owner, keys, p)  # the third key has no splits
    code, want = forest.codes(x, owner), []
    for row, k in zip(code, owner):
        guess = forest.base[k]
        for t in range(p.trees):
            at = 0
            while at < p.inner:
                f = forest.feature[k, t, at]
                at = 2 * at + 1 + int(f >= 0 and row[f] > forest.cut[k, t, at])
            guess += forest.leaf[k, t, at - p.inner]
        want.append(guess)
    trees = boosting.Descent(forest)
    for most in (1, 7, 1000):
        monkeypatch.setattr(boosting, "PREDICT_ROWS", most)
        mixed = rng.permutation(len(x))
        assert np.allclose(trees.predict(x[mixed], owner[mixed]), np.array(want)[mixed], atol=1e-12)
    assert (forest.feature[2] == -1).all() and len(trees.predict(x[:0], owner[:0])) == 0


def test_only_the_steps_that_are_asked_for(rows):
    made = forecast.models(rows, order="event_id", trees=3)[0]
    weeks = forecast.last_week(rows, tie="event_id")
    whole = {(r.ticker, r.step): r.forecast for r in forecast.recursive(weeks, made, 40, trees=3).collect()}
    last = {(r.ticker, r.step): r.forecast for r in forecast.recursive(weeks, made, 40, trees=3, first=38).collect()}
    assert last == {at: price for at, price in whole.items() if at[1] >= 38} and len(last) == 3 * weeks.count()
