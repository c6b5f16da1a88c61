"""Boosting that goes on where it stopped: prefixes, bags, leaf penalty, patience."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from dailycast.operators import boosting, trees

SPEC = trees.TreeSpec("t", "boosted", max_rounds=12, depth=2, min_rows=2, feature_share="all", step=0.5, row_share=0.8, bag_rounds=3)
START = dt.date(2021, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = []
    for i in range(90):
        x = [float(i % 2), float(i % 7)]
        data.append((START + dt.timedelta(i), 1 if i >= 60 else 0, float(5 + 3 * x[0] + x[1] + 0.3 * rng.normal()), x))
    frame = spark.createDataFrame(data, "date date, fold int, y double, x array<double>")
    return frame.select("date", "fold", "y", array_to_vector("x").alias("features")).coalesce(2).persist()


def dense(rows):
    return np.array([r["features"].toArray() for r in rows])


def test_going_on_equals_one_long_run(rows):
    keys = ["date"]
    once = boosting.go_on(boosting.start(rows, "y", 1, keys), rows, "y", SPEC, 1, keys, 4)
    twice = boosting.start(rows, "y", 1, keys)
    for _ in range(2):
        twice = boosting.go_on(twice, rows, "y", SPEC, 1, keys, 2)
    assert twice.errors == pytest.approx(once.errors) and twice.rounds == once.rounds == 4
    a, b = ({r["date"]: r["margin"] for r in run.margins.collect()} for run in (once, twice))
    assert a == pytest.approx(b) and len(a) == 90
    seen = rows.collect()
    model = boosting.load(twice, SPEC, 4)
    assert model.predict(dense(seen)) == pytest.approx([b[r["date"]] for r in seen])


def test_a_bag_is_kept_for_its_rounds(rows):
    bags = [{r["date"] for r in rows.filter(boosting.in_bag(["date"], SPEC, k)).collect()} for k in range(7)]
    assert bags[0] == bags[1] == bags[2] and bags[3] == bags[4] == bags[5]
    assert len({frozenset(b) for b in bags}) == 3 and all(55 <= len(b) <= 87 for b in bags)
    everything = replace(SPEC, row_share=1.0)
    assert rows.filter(~boosting.in_bag(["date"], everything, 0)).isEmpty()


def test_leaf_penalty_of_a_two_leaf_tree(spark):
    data = [(START + dt.timedelta(i), 0, y, [x]) for i, (x, y) in enumerate([(0.0, 1.0), (0.0, 2.0), (1.0, 7.0), (1.0, 8.0), (1.0, 9.0)])]
    data.append((START + dt.timedelta(9), 1, 8.0, [1.0]))
    frame = spark.createDataFrame(data, "date date, fold int, y double, x array<double>")
    frame = frame.select("date", "fold", "y", array_to_vector("x").alias("features"))
    spec = replace(SPEC, depth=1, min_rows=1, step=1.0, row_share=1.0, leaf_l2=1.0)
    run = boosting.go_on(boosting.start(frame, "y", 1, ["date"]), frame, "y", spec, 1, ["date"], 1)
    base = 27 / 5
    low, high = base + (3 - 2 * base) / 3, base + (24 - 3 * base) / 4
    got = [r["margin"] for r in run.margins.orderBy("date").collect()]
    assert got == pytest.approx([low, low, high, high, high, high])
    assert boosting.load(run, spec, 1).predict(np.array([[0.0], [1.0]])) == pytest.approx([low, high])


@pytest.mark.parametrize(
    "errors, patience, expected",
    [([5, 4, 3, 3, 3, 2], 2, (3, 5, True)), ([5, 4, 3, 2, 1, 1], 2, (5, 6, False)), ([1, 2, 3], 5, (1, 3, False))],
)
def test_patience(errors, patience, expected):
    assert boosting.stop_round(errors, patience) == expected


def test_no_round_is_fitted_twice(rows, monkeypatch):
    fitted = []
    real = boosting.one_tree
    monkeypatch.setattr(boosting, "one_tree", lambda r, s, k: (fitted.append(k), real(r, s, k))[1])
    spec = replace(SPEC, max_rounds=30, step=0.9, patience=3, keep_best=True)
    run, used = boosting.fit_cell(rows, trees.Cell("c", 1, "y", spec), ["date"], block=2)
    best, stop, stopped = boosting.stop_round(run.errors, 3)
    assert fitted == list(range(run.rounds)) and used == best
    assert stopped and run.rounds - stop < 2 and stop == best + 3
