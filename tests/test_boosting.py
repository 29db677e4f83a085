"""The booster: against plain formulas, in one task and over blocks, with nulls, and its search."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidegrid.plans import boosting, features, forecast, model_jobs

POINT = {"learning_rate": 0.2, "num_leaves": 8, "min_child_samples": 5, "feature_fraction": 1.0, "bagging_fraction": 0.9, "lambda_l2": 0.1}


@pytest.fixture(scope="module")
def rows(spark):
    """The next value is 6 more in the afternoon, 4 less before, and 9 more where the lag is missing; a tenth is noise."""
    r, names = random.Random(11), ("station_id", "heure_fin", *features.FEATURES, features.TARGET)
    out = []
    for s in range(30):
        for h in range(40):
            x = dict.fromkeys(features.FEATURES, 1.0) | {"heure_cible": float(h % 24), "velos_t0": float(r.randrange(20, 60)), "velos_lag_1h": None if r.random() < 0.2 else float(r.randrange(60)), "capacite": 99.0}
            step = (6 if h % 24 >= 12 else -4) + (9 if x["velos_lag_1h"] is None else 0) + (r.randrange(-15, 15) if r.random() < 0.1 else 0)
            out.append((s, datetime(2026, 1, 1) + timedelta(hours=h), *x.values(), x["velos_t0"] + step))
    return spark.createDataFrame(out, ", ".join(f"{n} {'bigint' if n == 'station_id' else 'timestamp' if n == 'heure_fin' else 'double'}" for n in names))


def test_best_split_by_enumeration():
    r = np.random.default_rng(5)
    bins, sign = r.integers(0, 6, (80, len(features.FEATURES))).astype(np.uint8), r.integers(-1, 2, 80).astype(float)
    told = boosting.histograms(bins, np.zeros(80, np.int64), sign, [0])[0]
    score = lambda rows: sign[rows].sum() ** 2 / (rows.sum() + 0.5)
    want = 0
    for f in range(bins.shape[1]):
        for last in range(1, 6):
            for missing_left in (True, False):
                left = np.where(bins[:, f] == 0, missing_left, bins[:, f] <= last)
                if min(left.sum(), (~left).sum()) >= 7:
                    want = max(want, score(left) + score(~left) - score(np.ones(80, bool)))
    gain, f, last, missing_left = boosting.best_split(told, 7, 0.5, np.arange(bins.shape[1]))
    assert gain == pytest.approx(want) and f >= 0
    left = np.where(bins[:, f] == 0, missing_left, bins[:, f] <= last)
    assert score(left) + score(~left) - score(np.ones(80, bool)) == pytest.approx(want)


def test_leaves_get_medians():
    left = np.array([0.0, 0.0, 3.0, -1.0, 0.0, 5.0, 5.0, 7.0])
    at = np.array([1, 1, 1, 1, 1, 2, 2, 2])
    counts = boosting.medians(at, left, [1, 2], 7 / boosting.STEPS)
    assert boosting.median_of(counts[0], 7 / boosting.STEPS) == 0 and boosting.median_of(counts[1], 7 / boosting.STEPS) == pytest.approx(5, abs=0.01)


def test_blocks_of_rows_give_the_same_trees_as_one(spark, rows, monkeypatch):
    """Over many blocks in a staged table, and again from its sums, without bagging."""
    edges, point = boosting.bin_edges(rows), POINT | {"bagging_fraction": 1.1}
    one = boosting.fit(rows, point, 3, edges)
    for name, value in (("FOLD_IN", 2), ("BLOCK_ROWS", 170), ("ONE_BLOCK", 0)):
        monkeypatch.setattr(boosting, name, value)
    many = boosting.fit(rows.repartition(3), point, 3, edges)
    assert one.text() == many.text() and len(one.trees) == 3
    assert boosting.Forest.of(one.text()) == one
    told = [tuple(r) for r in one.transform(rows).select("velos_t0", "prediction").collect()]
    bins, left = boosting._arrays(rows, edges)
    assert sorted(p - v for v, p in told) == pytest.approx(sorted(one.margin(bins)))


def test_it_learns_steps_and_nulls(spark, rows, monkeypatch):
    monkeypatch.setattr(boosting, "ROUNDS", 60)
    told = boosting.train(rows, trials=4)
    assert told.test_mae < 0.4 * told.baseline_mae and told.point["rounds"] > 10 and told.point["trials"] == 4
    assert {"heure_cible", "velos_lag_1h"} <= {n for n, _ in told.importance[:3]}
    assert boosting.train(rows.filter("hour(heure_fin) < 3 and to_date(heure_fin) = '2026-01-01'")) is None


def test_hours_split_as_rows_do(spark, rows):
    """Hours in order give the parts that temporal_split gives, halves included."""
    for share in (0.2, 0.0625, 0.3):
        for part in (rows, rows.filter("heure_fin < timestamp '2026-01-01 07:00:00'")):
            hours = [r[0] for r in part.select("heure_fin").distinct().orderBy("heure_fin").collect()]
            told = [[r[0] for r in x.select("heure_fin").distinct().orderBy("heure_fin").collect()] for x in features.temporal_split(part, share=share)]
            assert list(features.split_hours(hours, share)) == told


def test_a_stored_table_is_read_without_a_copy(spark, rows, monkeypatch):
    """The parts are those of temporal_split, and the rows are not copied."""
    monkeypatch.setattr(boosting, "ROUNDS", 2)
    _, test = features.temporal_split(rows)
    want, copies = forecast.baseline_metrics(test).first()["mae"], []
    monkeypatch.setattr(boosting, "kept", lambda spark, df: copies.append(df.columns) or df)
    got = boosting.train(rows, trials=1, stored=True)
    assert got.baseline_mae == pytest.approx(want) and got.point["trials"] == 1
    assert all("bins" in c for c in copies)


def test_trials_learn_from_all_rows(spark, rows, monkeypatch):
    """Told of ten million rows, the search takes each row there is, and finds what a trial over them all finds; without bagging."""
    for name, value in (("ROUNDS", 5), ("BLOCK_ROWS", 170), ("FOLD_IN", 2), ("PARAMS", boosting.PARAMS | {"bagging_fraction": (1.0, 1.0, "line")})):
        monkeypatch.setattr(boosting, name, value)
    edges, parts = boosting.bin_edges(rows), (rows.filter("hour(heure_fin) < 18").repartition(3), rows.filter("hour(heure_fin) >= 18").repartition(2))
    told = boosting.search(*parts, edges, trials=3, sizes=(10**7, 10**7))
    learn, valid = (boosting._arrays(part, edges) for part in parts)
    assert (len(learn[0]), len(valid[0])) == tuple(part.count() for part in parts)
    for point, rounds, error in told:
        want = boosting.trial(point, learn, valid, np.abs(learn[1]).max() / boosting.STEPS)
        assert rounds == want[0] > 0 and error == pytest.approx(want[1], rel=1e-12)


def test_rounds_end_without_gain():
    """Where nothing can be learned no tree stays."""
    r = np.random.default_rng(1)
    part = lambda n: (r.integers(1, 9, (n, len(features.FEATURES))).astype(np.uint8), np.where(r.random(n) < 0.1, r.normal(size=n), 0.0))
    learn, valid = part(400), part(200)
    assert boosting.trial(POINT, learn, valid, 0.01) == (0, float(np.abs(valid[1]).mean()))


def test_sampler_goes_to_the_better_side():
    """After random points the draws gather where the error is low; the same seed gives the same points."""
    a, b = boosting.Sampler(3), boosting.Sampler(3)
    for k in range(60):
        p = a.ask()
        assert p == b.ask() and all(low <= p[n] <= high for n, (low, high, _) in boosting.PARAMS.items()) and isinstance(p["num_leaves"], int)
        error = abs(np.log(p["lambda_l2"] / 0.05)) + abs(p["feature_fraction"] - 0.9)
        a.tell(p, error)
        b.tell(p, error)
    assert np.mean([e for _, e in a.told[40:]]) < 0.6 * np.mean([e for _, e in a.told[: boosting.RANDOM]])


def test_stored_and_loaded(spark, rows, tmp_path):
    store = model_jobs.Store(spark, f"file://{tmp_path}")
    model = boosting.fit(rows, POINT, 2, boosting.bin_edges(rows))
    store.save_model(model, "m", "1")
    assert json.loads(store.model("m", "1").text()) == json.loads(model.text())
