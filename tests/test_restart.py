"""Runs that are killed and go on from what they had finished."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from dailycast.operators import boosting, trees
from dailycast.plans import forecast as fc
from dailycast.plans import importance as imp
from dailycast.sources.ledger import Ledger, fingerprint

TINY = replace(
    fc.small_config(rounds=4, trees_per_forest=2, n_splits=2),
    deep=replace(trees.DEEP, max_rounds=4, step=0.3, patience=9, depth=2, min_rows=2),
    shallow=replace(trees.SHALLOW, max_rounds=4, step=0.3, patience=9, depth=2, min_rows=2),
    workers=1,
)
CELLS = TINY.n_splits * 2 * 2  # boosted ones: folds, models, targets


class Killed(Exception):
    pass


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(3)
    start = dt.date(2021, 1, 1)
    rows = [(start + dt.timedelta(i), 50.0 + 9 * (i % 7) + rng.normal(), 30.0 + 4 * (i % 7), float(i % 7), float(i)) for i in range(120)]
    train = spark.createDataFrame(rows, "date date, revenue double, cogs double, a double, b double")
    ahead = spark.createDataFrame([(start + dt.timedelta(130 + i), float(i % 7), 130.0 + i) for i in range(9)], "date date, a double, b double")
    return fc.build_matrix(train, ahead, ["a", "b"], n_splits=TINY.n_splits)


def results(cv):
    return [sorted(map(tuple, df.select("fold", "model", "target", "date", F.round("pred", 9)).collect())) for df in (cv.oof, cv.horizon)]


def test_a_killed_cross_validation_fits_only_what_is_missing(spark, matrix, tmp_path, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK", 2)
    monkeypatch.setattr(boosting.fit_cell, "__defaults__", (2, None))
    blocks, real_block, real_forest = [], boosting.go_on, trees.fit
    forests = []

    def block(run, rows, label, spec, fold, *rest):
        if len(blocks) == 5:
            raise Killed
        blocks.append((label, spec.name, fold, run.rounds))
        return real_block(run, rows, label, spec, fold, *rest)

    monkeypatch.setattr(boosting, "go_on", block)
    monkeypatch.setattr(trees, "fit", lambda df, label, spec, *r: (forests.append((label, df.count())), real_forest(df, label, spec, *r))[1])
    folder = str(tmp_path / "run")
    with pytest.raises(Killed):
        fc.run_cv(matrix, TINY, folder)
    before, grown = list(blocks), list(forests)
    monkeypatch.setattr(boosting, "go_on", lambda run, rows, label, spec, fold, *rest: (
        blocks.append((label, spec.name, fold, run.rounds)), real_block(run, rows, label, spec, fold, *rest))[1])
    second = fc.run_cv(matrix, TINY, folder)
    assert len(before) == 5 and len(blocks) == len(set(blocks)) == CELLS * 2  # no block twice
    assert grown and len(forests) == len(set(forests)) == TINY.n_splits * 2
    n = len(blocks), len(forests)
    third = fc.run_cv(matrix, replace(TINY, workers=4), folder)
    assert (len(blocks), len(forests)) == n  # nothing left to fit
    whole = fc.run_cv(matrix, TINY)
    assert results(second) == results(third) == results(whole) and second.rounds == whole.rounds


def test_other_settings_or_rows_are_refused(spark, matrix, tmp_path):
    folder = str(tmp_path / "run")
    fc.begin(matrix, TINY, folder)
    fc.begin(matrix, replace(TINY, workers=2), folder)
    with pytest.raises(ValueError, match="another run"):
        fc.begin(matrix, replace(TINY, oof_fill=None), folder)
    with pytest.raises(ValueError, match="another run"):
        fc.begin(replace(matrix, train=matrix.train.withColumn("a", F.col("a") + 1)), TINY, folder)


def test_importance_goes_on(spark, matrix, tmp_path, monkeypatch):
    config = imp.ImportanceConfig(*[replace(s, max_rounds=2, depth=2) for s in imp.small_config().specs], workers=1)
    fitted, real = [], trees.fit

    def fit(df, label, spec, *rest):
        if len(fitted) == 3:
            raise Killed
        fitted.append((label, spec.name))
        return real(df, label, spec, *rest)

    monkeypatch.setattr(trees, "fit", fit)
    folder = str(tmp_path / "run")
    with pytest.raises(Killed):
        imp.run_importance(matrix.train, matrix.columns, config, folder)
    monkeypatch.setattr(trees, "fit", lambda df, label, spec, *r: (fitted.append((label, spec.name)), real(df, label, spec, *r))[1])
    got = imp.run_importance(matrix.train, matrix.columns, config, folder)
    assert len(fitted) == len(set(fitted)) == 6
    assert got.count() == len(matrix.columns)


def test_half_written_entries_do_not_count(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "run"))
    assert ledger.recall("x") is None and ledger.kept("x") is None
    ledger.record("x", {"a": [1.5, None]})
    assert ledger.recall("x") == {"a": [1.5, None]}
    (tmp_path / "run/entries/x/_SUCCESS").unlink()
    assert ledger.recall("x") is None
    ledger.record("x", {"a": "line\nbreak"})
    assert ledger.recall("x") == {"a": "line\nbreak"}


def test_fingerprint_is_of_the_rows(spark):
    df = spark.range(100).withColumn("x", F.rand(1))
    assert fingerprint(df) == fingerprint(df.repartition(7)) != fingerprint(df.filter("id > 0"))
    assert fingerprint(df.limit(0)) == {"rows": 0, "mark": None}
