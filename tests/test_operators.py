"""Unit fixtures with answers by hand or by pandas."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sunfleet.functions.rolling import Rolling
from sunfleet.functions.scalar import bucket, clip, dilation, haversine_km, linspace, nan_to_null, pad_left, softmax_top
from sunfleet.operators import align, conformal, continual, diagnose, evaluate, features, forecast, graph, learn, quality, quantiles
from sunfleet.sources import files
from sunfleet.sources.synthetic import normal, synthetic_fleet

RNG = np.random.default_rng(0)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_scalars(spark):
    assert one(spark, clip(F.lit(None).cast("double"), 0, 1)) is None and one(spark, clip(F.lit(7.0), 0, 1)) == 1
    assert one(spark, bucket(F.lit(0.2), (0.2, 0.4), "abc")) == "b"
    assert one(spark, linspace(0, 1, 3)) == [0.0, 0.5, 1.0]
    assert one(spark, pad_left(F.array(F.lit(1.0), F.lit(None), F.lit(3.0)), 5)) == [2.0, 2.0, 1.0, 0.5, 3.0]
    assert one(spark, softmax_top(F.array(F.lit(0.0), F.lit(0.0), F.lit(9.0))))["class"] == 2
    assert one(spark, dilation(F.lit(101.0), F.lit(11.0), F.lit(0.99))) == 8
    assert abs(one(spark, haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))) - 6371 * np.pi / 2) < 1e-6
    assert nan_to_null(spark.createDataFrame([(float("nan"),)], "x double")).first()[0] is None


def test_rolling_is_pandas_rolling(spark):
    n = 400
    a = np.where(RNG.random(n) < 0.4, np.nan, RNG.normal(5, 2, n))
    b = np.where(RNG.random(n) < 0.2, np.nan, RNG.normal(5, 2, n))
    a[100:200] = 3.0
    df = spark.createDataFrame([(1, i, *(None if np.isnan(x) else float(x) for x in (a[i], b[i]))) for i in range(n)], "plant int, t_idx int, a double, b double")
    r = Rolling("plant", "t_idx", 50)
    out = r.apply(df, m=r.mean(F.col("a"), 10), s=r.std(F.col("a"), 10), c=r.corr(F.col("a"), F.col("b"), 10)).orderBy("t_idx").toPandas()
    x, y = pd.Series(a), pd.Series(b)
    np.testing.assert_allclose(out.m, x.rolling(50, min_periods=10).mean(), atol=1e-9)
    np.testing.assert_allclose(out.s, x.rolling(50, min_periods=10).std(), atol=1e-6)
    expect = x.rolling(50, min_periods=10).corr(y)
    flat = x.where(y.notna()).rolling(50, min_periods=10).apply(lambda v: np.nanmax(v) > np.nanmin(v))
    np.testing.assert_allclose(out.c, expect.where(flat == 1), atol=1e-6)  # a constant side has no correlation


def cube(spark, rows):
    return spark.createDataFrame([(1, i, dt.datetime(2020, 1, 1) + dt.timedelta(hours=i), e, p, 25.0) for i, (e, p) in enumerate(rows)], "plant int, t_idx int, time timestamp, energia double, poa double, temp double")


def test_night_twilight_and_stuck_sensor(spark):
    rows = [(0.0, 0.0), (5.0, 0.0), (None, 0.0), (1.0, 10.0), (1.0, 50.0)] + [(4.0, 200.0 + 10 * i) for i in range(30)]
    out = quality.quality(cube(spark, rows), 40, 10).orderBy("t_idx").collect()
    assert [r.qs for r in out[:5]] == [1.0, 0.0, None, None, None]
    assert all(r.m1 is None and r.qs is None for r in out[5:]) and out[-1].m4 == 0


def test_scales_need_more_than_ten_rows(spark):
    few, many = [(3.0, 500.0)] * 10, [(3.0, 500.0)] * 11
    assert quality.plant_scales(cube(spark, few)).first().capacity_scale == 1.0
    assert quality.plant_scales(cube(spark, many)).first().capacity_scale == 6.0


def test_temporal_mean_is_centred(spark):
    v = RNG.random(60)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "plant int, t_idx int, qs double")
    got = quality.temporal(df, 20, 5).orderBy("t_idx").toPandas().temporal_qs
    expect = [v[max(0, i - 10) : i + 10].mean() for i in range(60)]
    np.testing.assert_allclose(got, expect)


def test_slopes_below_ten_points_are_zero(spark):
    rows = [(1, i, i * 0.1) for i in range(9)] + [(2, i, i * 0.1) for i in range(10)] + [(3, 0, None)]
    got = dict(quality.slopes(spark.createDataFrame(rows, "plant int, t_idx int, qs double")).collect())
    assert got[1] == 0 and abs(got[2] - 0.1) < 1e-12 and got[3] == 0


def test_shrinking_never_lowers_what_is_under_the_centre(spark):
    df = spark.createDataFrame([(10, 0.2), (10, 0.9), (500, None)], "valid_count long, qs double")
    a, b, c = (r.shrunk for r in quality.shrink(df, 100, 20, 0.6).collect())
    assert 0.2 < a <= 0.6 and b == 0.9 and c == 0.6


def test_synthetic_faults(spark):
    df = synthetic_fleet(spark).cache()
    by = {r.plant: r.e for r in df.groupBy("plant").agg(F.sum("energia").alias("e")).collect()}
    assert df.count() == 175_200 and by[1] < 0.8 * by[7]
    cloud = {r.plant: r.e for r in df.where("t_idx BETWEEN 6000 AND 6499").groupBy("plant").agg(F.sum("energia").alias("e")).collect()}
    assert all(cloud[k] < 0.3 * cloud[9] for k in (2, 3, 4, 5))
    one = df.where("poa > 1 AND plant = 9").agg(F.min("time"), F.max("time"), F.min("eta_seed"), F.max("eta_seed"), F.min("wind")).first()
    assert (one[0].hour, one[1].hour) == (7, 17) and 0.75 <= one[2] == one[3] <= 0.85 and one[4] >= 0
    again = synthetic_fleet(spark).repartition(7, "t_idx")
    assert df.exceptAll(again).count() == 0 and synthetic_fleet(spark, plants=3, hours=5).count() == 15
    noise = spark.range(20000).select(normal(1, "x", F.col("id")).alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(noise[0]) < 0.03 and abs(noise[1] - 1) < 0.03


def test_noise_is_multiplicative(spark):
    df = spark.range(20000).select(F.lit(2.0).alias("temp_z"), F.lit(0.0).alias("poa_z"), F.lit(None).cast("double").alias("wind_z"))
    one = features.with_noise(df).agg(F.avg("temp_z"), F.stddev("temp_z"), F.max("poa_z"), F.count("wind_z")).first()
    assert abs(one[0] - 2) < 0.01 and abs(one[1] - 0.1) < 0.01 and one[2] == 0.0 and one[3] == 0


def test_nearest_joins(spark):
    t = lambda h: dt.datetime(2020, 1, 1, h)
    left = spark.createDataFrame([(1, t(5), "a"), (1, t(0), "b"), (2, t(1), "c")], "k int, time timestamp, id string")
    right = spark.createDataFrame([(1, t(4), 4.0), (1, t(6), 6.0)], "k int, time timestamp, v double")
    got = {r.id: r.v for r in align.nearest_in_time(left, right, "k", "time", ["v"]).collect()}
    assert got == {"a": 6.0, "b": 4.0, "c": None}  # half-way: the later one
    sites = spark.createDataFrame([(2, 0.0, 1.0), (1, 0.0, -1.0), (3, 60.0, 60.0)], "location int, lat double, lon double")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0), (3, None, 1.0)], "plant int, lat double, lon double")
    assert {r.plant: r.location for r in align.nearest_site(points, sites).collect()} == {1: 1, 2: 3, 3: None}


def test_densified_gaps_are_null(spark):
    obs = spark.createDataFrame([(1, 10, 1.0), (2, 20, 2.0)], "plant int, time int, energia double")
    assert sorted((r.plant, r.t_idx, r.energia) for r in align.densify(obs).collect()) == [(1, 0, 1.0), (1, 1, None), (2, 0, None), (2, 1, 2.0)]
    assert align.median_readings(spark.createDataFrame([(1, 1.0), (1, 5.0), (1, None)], "k int, v double"), ["k"], "v").first().v == 3.0


def test_quantiles_of_groups(spark):
    values = [(int(k), float(v)) for k, v in zip(RNG.integers(0, 3, 3000), np.round(RNG.normal(size=3000), 2), strict=True)] + [(0, 1.5)] * 2000 + [(4, 7.0), (5, None), (None, 2.0)]
    df = spark.createDataFrame(values, "g int, v double")
    shares = [0.0, 0.01, 0.33, 0.5, 0.9, 0.999, 1.0]
    for most in (1_000_000, 50):
        found = quantiles.by_group(df, "g", "v", lambda n: shares, most)
        assert set(found) == {0, 1, 2, 4, None}
        for g, (n, got) in found.items():
            own = [v for k, v in values if k == g and v is not None]
            assert n == len(own) and np.allclose(got, np.quantile(own, shares))
    assert quantiles.overall(df, "v", [0.5]) == [float(np.median([v for _, v in values if v is not None]))]
    assert quantiles.overall(df.where("g = 5"), "v", [0.5, 0.9]) == [None, None]


def test_densified_grid_is_that_of_a_plain_join(spark):
    rows = [(int(k), int(t), float(v)) for k, t, v in zip(RNG.integers(0, 6, 60), RNG.integers(0, 15, 60), RNG.random(60), strict=True)]
    rows += [(1, None, 5.0), (1, None, 6.0), (9, None, 7.0), (9, None, 8.0), (rows[0][0], rows[0][1], 0.5), (None, 3, 1.0)]
    times = sorted({t for _, t, _ in rows if t is not None})
    expect = []
    for k in {k for k, _, _ in rows}:
        for i, t in enumerate(times):
            found = [v for a, b, v in rows if a == k and b == t]
            expect += [(k is None, k or 0, t, i, v) for v in found or [None]]
    found = align.densify(spark.createDataFrame(rows, "plant int, time int, energia double").repartition(3)).collect()
    key = lambda x: (x[:4], x[4] is None, x[4] or 0)
    assert sorted(((r.plant is None, r.plant or 0, r.time, r.t_idx, r.energia) for r in found), key=key) == sorted(expect, key=key)
    assert align.densify(spark.createDataFrame([], "plant int, time int, energia double")).count() == 0


def test_nearest_in_time_of_a_frequent_key(spark):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    at = lambda h: base + dt.timedelta(minutes=int(h))
    left = [(int(k), at(t), i) for i, (k, t) in enumerate(zip(RNG.choice([1, 1, 1, 2, 3], 400), RNG.integers(0, 3000, 400), strict=True))] + [(1, None, 900)]
    right = [(1, at(t), float(i)) for i, t in enumerate(sorted(set(RNG.integers(200, 2500, 150).tolist())))] + [(2, at(50), -1.0), (1, None, -2.0)]
    a = spark.createDataFrame(left, "k int, time timestamp, id int")
    b = spark.createDataFrame(right, "k int, time timestamp, v double")
    for parts in (1, 7, 32):
        got = {r.id: r.v for r in align.nearest_in_time(a, b, "k", "time", ["v"], parts).collect()}
        for k, t, i in left:
            mine = [(abs((x - t).total_seconds()), -x.timestamp(), v) for c, x, v in right if c == k and x is not None and t is not None]
            assert got[i] == (min(mine)[2] if mine else None)


def test_graph_radius_and_fallback(spark):
    places = [(i, float(RNG.uniform(44, 45)), float(RNG.uniform(7, 8.5))) for i in range(60)] + [(60, 89.9, 10.0), (61, 89.9, -170.0), (62, None, 1.0), (63, 0.0, 179.99), (64, 0.0, -179.99)]
    df = spark.createDataFrame(places, "plant int, lat double, lon double")

    def km(a, b):
        x = np.radians([a[1], a[2], b[1], b[2]])
        h = np.sin((x[2] - x[0]) / 2) ** 2 + np.cos(x[0]) * np.cos(x[2]) * np.sin((x[3] - x[1]) / 2) ** 2
        return 2 * 6371 * np.arcsin(min(1, np.sqrt(h)))

    known = [p for p in places if p[1] is not None]
    expect = {(a[0], b[0]) for a in known for b in known if a[0] != b[0] and km(a, b) < 25}
    assert {(r.src, r.dst) for r in graph.distance_graph(df, 25.0).collect()} == expect and (60, 61) in expect and (63, 64) in expect
    near = {(r.src, r.dst) for r in graph.distance_graph(df, 1e-6).collect()}
    best = {a[0]: min((km(a, b), b[0]) for b in known if b[0] != a[0])[1] for a in known}
    assert near == {p for a, b in best.items() for p in ((a, b), (b, a))}


def test_ks(spark):
    low, high = np.zeros(360), np.ones(360)
    assert not diagnose.ks_drifts(np.zeros(719)) and not diagnose.ks_drifts(np.zeros(720)) and diagnose.ks_drifts(np.concatenate([low, high]))
    # exact p-value against all interleavings of 4 and 3 values
    from itertools import combinations

    d, n, m, over = 8, 4, 3, 0
    for first in combinations(range(n + m), n):
        i = j = gap = 0
        for k in range(n + m):
            i, j = (i + 1, j) if k in first else (i, j + 1)
            gap = max(gap, abs(i * m - j * n))
        over += gap >= d
    assert abs(diagnose.ks_p_value(d, n, m) - over / 35) < 1e-12
    monitor = diagnose.DriftMonitor(20)
    assert not monitor.update_batch([0.0] * 30 + [float("nan")]) and monitor.update_batch([1.0] * 30)
    monitor.reset()
    assert monitor.values == []


def test_reflect_act_and_gate(spark):
    df = spark.createDataFrame([(1.0, 0.95), (1.0, 0.9), (1.0, 1.2)], "loss_before double, loss_after double")
    assert [r.verdict for r in diagnose.reflect(df).collect()] == ["stable", "improved", "degraded"]
    diagnosis = spark.createDataFrame([(1, True, "normal"), (2, True, "sensor_failure"), (3, False, "normal")], "plant int, drift boolean, cause string")
    assert tuple(diagnose.act(diagnosis).first()) == ("retrain_triggered", [1]) and diagnose.act(diagnosis, False).first().action == "no_updater"
    assert diagnose.act(diagnosis.where("plant > 1")).first().action == "no_action"
    gate = spark.createDataFrame([(0.5,), (0.6,), (None,)], "qs_mean double")
    assert [r.updated for r in continual.gate(gate, 0.5).collect()] == [False, True, False]


def test_replay_overwrites_the_oldest_slots(spark):
    held = continual.replay_buffer(spark.range(1005).withColumnRenamed("id", "seq").withColumn("y", F.col("seq") * 2.0))
    rows = {r.slot: r.seq for r in held.collect()}
    assert len(rows) == 1000 and rows[4] == 1004 and rows[5] == 5
    assert continual.replay_sample(held, 32).count() == 32


def test_hops(spark):
    df = spark.range(100).select(F.col("id").cast("int").alias("t_idx"))
    got = sorted((r.t, r.t_idx) for r in continual.hops(df, 20, 7).select("t", "t_idx").collect())
    assert got == [(t, i) for t in range(20, 100, 7) for i in range(t - 20, t)]


def test_conformal(spark):
    y, p, q = RNG.random(300), RNG.random(300), RNG.random(300) * 0.6
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, p, q, strict=True)], "true_pv double, pred_pv double, qs double")
    model = conformal.BandedConformal(3, 0.9)
    with pytest.raises(RuntimeError):
        model.predict_interval(df)
    bands = {r.band: r for r in model.calibrate(df).coverage_report().collect()}
    scores = np.abs(y - p)
    for b, lo, hi in ((0, 0, 1 / 3), (1, 1 / 3, 2 / 3)):
        own = scores[(q >= lo) & (q < hi)]
        assert abs(bands[b].quantile - np.quantile(own, min(0.9 * (len(own) + 1) / len(own), 1))) < 1e-9
    assert bands[2].n_cal == 0 and abs(bands[2].quantile - np.quantile(scores, 0.9)) < 1e-9
    assert one(spark, conformal.band(F.lit(1.0))) == 2
    s = conformal.ScoreConformal(0.1, 3).fit(df.select(F.col("qs").alias("true"), F.col("pred_pv").alias("pred")))
    out = s.predict(df.select(F.col("pred_pv").alias("pred"))).toPandas()
    assert (out.lower >= 0).all() and (out.upper <= 1).all() and s.interval_widths().count() == 3


def test_calibration(spark):
    p = RNG.random(200)
    df = spark.createDataFrame([(float(x), float(0.5 * x + 0.1), 1.0) for x in p], "pred_pv double, true_pv double, true_ghi double")
    r = evaluate.calibrate(df, "both").first()
    assert r.enabled and abs(r.slope - 0.5) < 1e-9 and abs(r.intercept - 0.1) < 1e-9 and r.mae_after < 1e-9
    assert evaluate.calibrate(df.limit(99), "mae").first().reason == "too_few_samples"
    assert evaluate.calibrate(df.limit(0), "mae").first().reason == "no_daytime_samples" and not evaluate.calibrate(df).first().enabled
    with pytest.raises(ValueError):
        evaluate.calibrate(df, "r2")
    table = evaluate.Ablation()
    assert table.report(spark) == "no results"
    table.add("b", 1, 0.2, 1, 1, 1.0, note=1)
    table.add("a", 1, 0.1, 1, 1, 1.0)
    assert [r.model_name for r in table.table(spark).collect()] == ["a", "b"]


def test_features(spark):
    with pytest.raises(ValueError):
        features.target_scales(spark.createDataFrame([], "plant int, day boolean, energia double, poa double"), 0.1)
    with pytest.raises(ValueError):
        features.normalised(spark.createDataFrame([], "ENERGIA double"))
    with pytest.raises(ValueError):
        features.feature_rows(spark.createDataFrame([], "plant int"))
    assert features.normalised(spark.createDataFrame([(1.0,)], "solar_irradiance_poa double")).first().wind == 3.0
    times = spark.createDataFrame([(dt.datetime(2020, 1, 1 + i),) for i in range(10)], "time timestamp")
    assert [r.part for r in features.month_split(times).orderBy("time").collect()] == ["train"] * 8 + ["val"] * 2
    rows = spark.createDataFrame([(1, i, float(i), 0.0, 0.0, 1.0, 0.0) for i in range(30)], "plant int, t_idx int, e double, y_ghi double, y_pv double, eta double, ghi_cs double")
    got = features.lag_windows(rows, 24, ("e",)).orderBy("t_idx").collect()
    assert [r.t_idx for r in got] == [24, 25, 26, 27, 28] and [x[0] for x in got[0].x] == [float(i) for i in range(24)]


def test_learning(spark):
    t = np.arange(120)
    series = [(i, [float(v) for v in (np.sin(t / 3) if i % 2 else np.sign(np.sin(t / 9))) + RNG.normal(0, 0.1, 120)], "wave" if i % 2 else "steps") for i in range(40)]
    df = spark.createDataFrame([*series, (99, [1.0, 2.0], "wave")], "plant int, series array<double>, label string")
    found = {r.plant: (r.cause, r.confidence) for r in learn.CauseClassifier(120).fit(df.where("plant < 99")).predict(df).collect()}
    assert found[99] == ("uncertain", 0.0) and all(found[i][0] in (label, "uncertain") for i, _, label in series)
    model = learn.TrajectoryClusters(2, 4).fit(np.array([s[1][:15] for s in series[:12]]))
    assert sum(v["size"] for v in model.summary().values()) == 12
    assert abs(learn.soft_dtw(np.array([0.0, 1.0]), np.array([0.0, 1.0]), 1e-3)[0]) < 1e-2


def test_forecaster(spark, tmp_path):
    model = forecast.Forecaster(channels=2, length=8, width=8, heads=2, graph=8)
    rows = [(p, 1, [[float(p), float(i)] for i in range(8)], float(p)) for p in range(3)]
    samples = spark.createDataFrame(rows, "plant int, t_idx int, x array<array<double>>, ghi_cs double")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "src int, dst int, weight double")
    out = {r.plant: r for r in model.score(samples, edges).collect()}
    assert out[0].pred_ghi == 0 and all(0 <= r.pred_ghi <= 1.2 * p and r.pred_pv > 0 for p, r in out.items())
    model.save(spark, str(tmp_path / "weights"))
    again = forecast.Forecaster(channels=2, length=8, width=8, heads=2, graph=8, seed=1).load(spark, str(tmp_path / "weights"))
    assert {r.plant: r for r in again.score(samples, edges).collect()} == out
    with pytest.raises(ValueError):
        forecast.Forecaster(channels=3, length=8, width=8, heads=2, graph=8).load(spark, str(tmp_path / "weights"))


def fleet_of_rows(spark, plants=5, times=40):
    rng = np.random.default_rng(8)
    values = rng.normal(size=(plants, times, 5)).round(1)
    values[..., 2] = 0.5  # a channel that says nothing
    rows = [(p, t, *map(float, values[p, t]), None if (p + t) % 7 == 0 else float(t % 5), float(values[p, max(t - 2, 0), 0] + 0.1 * p), 0.8) for p in range(plants) for t in range(times) if (p, t) != (3, 17) and (p < 4 or t < 9)]
    return spark.createDataFrame(rows, "plant int, t_idx int, a double, b double, c double, y_ghi double, z double, ghi_cs double, y_pv double, eta double")


def test_forecasts_make_no_windows(spark, monkeypatch):
    rows, edges = fleet_of_rows(spark).repartition(3), spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 1, 0.5), (4, 0, 2.0), (8, 0, 2.0)], "src int, dst int, weight double")
    model = forecast.Forecaster(channels=3, length=8, width=8, heads=2, graph=8)
    samples = features.lag_windows(rows, 8, ("a", "b", "z"))
    encoded = model.encoded(rows, 39, ("a", "b", "z"), 8)
    for by in (features.lag_windows(rows, 8, ("a", "b", "z")), encoded):
        assert by.groupBy("plant").count().where("plant = 4").first()["count"] == 1
    whole, found = ({(r.plant, r.t_idx): (r.pred_ghi, r.pred_pv) for r in model.score(s.na.fill(0.0, ["ghi_cs"]), edges).collect()} for s in (samples, encoded))
    assert whole.keys() == found.keys() and len(whole) == 4 * 31 and all(np.allclose(whole[k], found[k], atol=1e-12) for k in whole)
    a, b = (model.sampled(s, edges, 20) for s in (samples, encoded))
    assert all(np.allclose(a[k], b[k]) for k in a) and len(a["h"]) == len(b["h"]) > 0
    # attention in parts of a few edges, and by definition
    h, src, dst, weight = np.random.default_rng(2).normal(size=(6, 8)), np.array([1, 2, 0, 5, 3]), np.array([0, 0, 2, 2, 4]), np.array([1.0, 0.5, 3.0, 2.0, 1.0])
    m, w = model._dense("g0", h).reshape(6, 2, 4), model.w["g0.attn"][:, 0]
    expect = np.zeros((6, 2, 4))
    for n in range(6):
        e = {k: forecast.leaky(np.concatenate([m[src[k]], m[n]], axis=-1) @ w) * np.log1p(weight[k]) for k in np.flatnonzero(dst == n)}
        for k in e:
            expect[n] += m[src[k]] * (np.exp(e[k]) / sum(np.exp(v) for v in e.values()))[:, None]
    for most in (1, 3, 4096):
        monkeypatch.setattr(forecast, "ATTENDED", most)
        assert np.allclose(model.attend(0, h, src, dst, weight), forecast.normed(forecast.elu(expect).reshape(6, 8) + h, model.w["g0.n"]))


def test_lag_regression_makes_no_windows(spark):
    rows = fleet_of_rows(spark, 5, 60).repartition(3)
    samples = features.lag_windows(rows, 6, ("a", "b", "c", "z"))
    expect = {(r.plant, r.t_idx): r.pred for r in forecast.fit_regression(samples).transform(forecast.flat(samples)).collect()}
    model = forecast.LagRegression(("a", "b", "c", "z"), 6)
    found = {(r.plant, r.t_idx): r.pred for r in model.fit(rows, 59).transform(rows, 59).collect()}
    assert expect.keys() == found.keys() and all(abs(found[k] - expect[k]) < 1e-9 for k in expect)
    assert model.fit(rows.where("y_pv = 0"), 59).transform(rows.limit(0), 59).count() == 0
    with pytest.raises(ValueError):
        model.fit(rows.withColumn("a", F.lit(None)), 59)


def test_forecaster_learns(spark):
    from sunfleet.streaming import monitor

    rng = np.random.default_rng(3)
    rows = []
    for t in range(120):
        level = rng.random()
        for p in range(6):
            rows.append((p, t, [[level, 0.3 * p] for _ in range(8)], 1.0, 0.8 * level, 0.6 * level + 0.02 * p, 0.75))
    samples = spark.createDataFrame(rows, "plant int, t_idx int, x array<array<double>>, ghi_cs double, y_ghi double, y_pv double, eta double")
    edges = spark.createDataFrame([(i, (i + 1) % 6, 1.0) for i in range(6)], "src int, dst int, weight double")
    model = forecast.Forecaster(channels=2, length=8, width=8, heads=2, graph=16, layers=1)
    held = model.sampled(samples.where("t_idx % 5 = 4"), edges)
    # gradients against differences
    few = {k: v[:20] for k, v in held.items()}
    for name, g in model._gradients(few, 0.1, 0.25).items():
        for at in [(0,) * g.ndim, tuple(n - 1 for n in g.shape)]:
            x, up = model.w[name].copy(), []
            for e in (1e-5, -1e-5):
                model.w[name] = x.copy()
                model.w[name][at] += e
                up.append(model.loss_of(few))
            model.w[name] = x
            assert abs((up[0] - up[1]) / 2e-5 - g[at]) < 1e-5
    before = model.loss_of(held)
    history = model.train(samples.where("t_idx % 5 < 4"), samples.where("t_idx % 5 = 4"), edges, epochs=30)
    assert model.loss_of(held) == min(h["val_loss"] for h in history) < 0.2 * before
    spread = float(np.var([r[5] for r in rows]))
    out = model.score(samples, edges).join(samples, ["plant", "t_idx"]).agg(F.avg(F.pow(F.col("pred_pv") - F.col("y_pv"), 2))).first()[0]
    assert out < 0.5 * spread
    again = forecast.Forecaster(channels=2, length=8, width=8, heads=2, graph=16, layers=1)
    done = monitor.run_online(samples, lambda part, t: {"action": "retrain_triggered"}, 60, 40, again.retrainer(lambda part: part, edges))
    assert len(done) == 2 and all(h["loss_after"] < h["loss_before"] for h in done)
    assert np.isnan(model.loss_of(model.sampled(samples.limit(0), edges)))


def test_sources(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_readings(spark, str(tmp_path), 2019)
    (tmp_path / "2019_UPN_0123_07.csv").write_text("date,ENERGIA\n03/01/19 05:00,1.5\n03/01/19 05:00,\n")
    (tmp_path / "2019_UPN_0456_01.csv").write_text("date,ENERGIA\nbad,2\n")
    rows = files.read_readings(spark, str(tmp_path), 2019).collect()
    assert {(r.upn, r.time, r.energia) for r in rows} == {("UPN_0123_01", dt.datetime(2019, 1, 3, 5), 1.5), ("UPN_0123_01", dt.datetime(2019, 1, 3, 5), None)}
    assert [tuple(r) for r in files.skipped_files(spark, str(tmp_path), 2019).collect()] == [("2019_UPN_0456_01.csv", 1, 1)]
    with pytest.raises(ValueError):
        files.read_readings(spark, str(tmp_path), 2019, upns=["UPN_9_01"])
    with pytest.raises(Exception):
        files.read_readings(spark, str(tmp_path), 2019, strict=True).collect()
    df = spark.createDataFrame([(1, dt.datetime(2020, 1, 1), 2.0)], "plant int, time timestamp, energia double")
    files.write_cube(df, str(tmp_path / "cube"))
    files.write_json(df, str(tmp_path / "json"))
    files.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.parquet(str(tmp_path / "cube")).first().energia == 2.0 and files.read_json(spark, str(tmp_path / "json")).count() == 1
    assert files.read_table(spark, str(tmp_path / "csv"), "plant int, time string, energia double", ["plant"]).first()[0] == 1


def test_streams(spark, tmp_path):
    from sunfleet.streaming import monitor

    rows = [(1, dt.datetime(2020, 1, 1, h, m), float(h)) for h in range(8) for m in (0, 20, 40)]
    df = spark.createDataFrame(rows, "plant int, ts timestamp, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = monitor.read_stream(spark, str(tmp_path / "in"), "plant int, ts timestamp, value double")
    got = []
    monitor.run_available(monitor.hourly_medians(stream), str(tmp_path / "a"), lambda b, _: got.extend(b.collect()))
    assert {(r.time.hour, r.value, r.n) for r in got} <= {(h, float(h), 3) for h in range(8)} and len(got) >= 5
    seen = []
    monitor.run_available(monitor.drift_stream(stream, half=8), str(tmp_path / "b"), lambda b, _: seen.extend(b.collect()), "update")
    assert [(r.plant, r.n) for r in seen] == [(1, 24)]
    assert monitor.sessions(df).count() == 1
    history = monitor.run_online(spark.range(50).select(F.col("id").cast("int").alias("t_idx")), lambda part, t: {"action": "retrain_triggered", "n": part.count()}, 20, 15, lambda part, t: (1.0, 0.5))
    assert [(h["t"], h["n"], h["verdict"]) for h in history] == [(20, 20, "improved"), (35, 20, "improved")]


def test_soft_dtw_is_the_sum_over_all_alignments():
    a, b, gamma = RNG.normal(size=3), RNG.normal(size=(2, 4)), 0.7
    paths, open_ = [], [[(0, 0)]]
    while open_:
        path = open_.pop()
        i, j = path[-1]
        if (i, j) == (2, 3):
            paths.append(path)
        open_ += [[*path, (k, g)] for k, g in ((i + 1, j), (i, j + 1), (i + 1, j + 1)) if k <= 2 and g <= 3]
    distances, alignments = learn.soft_dtw_many(a, b, gamma)
    for s, distance, alignment in zip(b, distances, alignments, strict=True):
        weights = np.array([np.exp(-sum((a[i] - s[j]) ** 2 for i, j in path) / gamma) for path in paths])
        expect = np.zeros((3, 4))
        for w, path in zip(weights / weights.sum(), paths, strict=True):
            for i, j in path:
                expect[i, j] += w
        assert abs(distance + gamma * np.log(weights.sum())) < 1e-9 and np.allclose(alignment, expect)


def test_clusters_are_fitted_by_executors(spark, monkeypatch):
    driver, real = os.getpid(), learn.soft_dtw_many

    def elsewhere(*args):
        assert os.getpid() != driver
        return real(*args)

    x = np.random.default_rng(5).normal(size=(30, 12)) + np.repeat([0.0, 3.0, 6.0], 10)[:, None] * np.sin(np.arange(12))
    for a, b, gamma in [(x[0], x[1:], 1.0), (x[0, :5], x[1:, :9], 0.7), (x[0, :1], x[1:4], 1.0), (x[0], x[1:2, :1], 2.0)]:
        shares = real(a, b, gamma)[1]
        assert np.allclose(learn.pulls(a, b, gamma), [shares.sum(axis=(0, 2)), np.einsum("sij,sj->i", shares, b)])
    monkeypatch.setattr(learn, "TABLE", 5 * 14**2)
    alone = learn.TrajectoryClusters(3).fit(x)
    monkeypatch.setattr(learn, "soft_dtw_many", elsewhere)
    matrix = spark.createDataFrame([(p, w, float(x[p, w])) for p in range(30) for w in range(12)], "plant int, week int, imputed double")
    together = learn.TrajectoryClusters(3).fit(x, spark)
    assert np.array_equal(alone.labels, together.labels) and np.array_equal(alone.centres, together.centres)
    assert learn.weekly_clusters(matrix, 3).count() == 30


def test_trajectory_clusters_use_whole_series(spark, tmp_path):
    from sunfleet.plans.quality import trajectory_clusters

    t = np.arange(64)
    shapes = [np.sin(t / 4), t / 20, np.sign(np.sin(t / 10)), np.cos(t / 9) ** 2]
    rows = [(i, [0.1 * k for k in range(12)] + [float(v) for v in (shapes[i % 4] + RNG.normal(0, 0.3, 64))[12:]]) for i in range(66)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.plant: r.cluster for r in trajectory_clusters(spark, str(tmp_path)).collect()}
    held = df.orderBy(F.xxhash64("vec_id"), "vec_id").collect()
    x = np.array([r.embedding for r in held])
    x = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, keepdims=True)

    def brute(c, s):
        w = np.exp(-((c[:, None] - s[None]) ** 2))
        f, b = np.zeros((66, 66)), np.zeros((66, 66))
        f[0, 0] = b[65, 65] = 1.0
        for i in range(1, 65):
            for j in range(1, 65):
                f[i, j] = w[i - 1, j - 1] * (f[i - 1, j - 1] + f[i - 1, j] + f[i, j - 1])
                b[65 - i, 65 - j] = w[64 - i, 64 - j] * (b[66 - i, 66 - j] + b[65 - i, 66 - j] + b[66 - i, 65 - j])
        return -np.log(f[64, 64]), (f * b)[1:65, 1:65] / w / f[64, 64]

    centres, labels = x[np.random.default_rng(42).choice(66, 4, replace=False)].copy(), None
    for _ in range(50):
        found = [[brute(c, s) for c in centres] for s in x]
        new = [int(np.argmin([f[0] for f in row])) for row in found]
        if new == labels:
            break
        labels = new
        for c in set(labels):
            own = [i for i in range(66) if labels[i] == c]
            centres[c] = sum(found[i][c][1] @ x[i] for i in own) / sum(found[i][c][1].sum(axis=1) for i in own)
    assert got == {r.vec_id: int(np.argmin([brute(c, s)[0] for c in centres])) for r, s in zip(held, x, strict=True)}


def test_report_has_weekly_clusters(spark):
    def scores(days):
        rows = [(p, i, dt.datetime(2020, 1, 6) + dt.timedelta(days=i), 0.5 + 0.4 * float(np.sin(i / (3 + p % 2 * 9))) + 0.01 * p) for p in range(8) for i in range(days)]
        return spark.createDataFrame(rows, "plant int, t_idx int, time timestamp, qs double")

    df = scores(70)
    weeks = np.array([[np.mean([0.5 + 0.4 * np.sin(i / (3 + p % 2 * 9)) + 0.01 * p for i in range(7 * w, 7 * w + 7)]) for w in range(10)] for p in range(8)])
    order = [r.plant for r in spark.range(8).select(F.col("id").cast("int").alias("plant")).orderBy(F.xxhash64("plant"), "plant").collect()]
    model = learn.TrajectoryClusters()
    assert model.rounds == 50
    expect = model.fit(weeks[order]).assign(weeks)
    assert {r.plant: r.cluster for r in diagnose.report(df, 20)[0].collect()} == dict(enumerate(expect.tolist()))
    assert {r.cluster for r in diagnose.report(scores(21), 20)[0].collect()} == {None}


def test_labelled_windows(spark):
    rows = [(p, i, None if (i * 7 + p) % 10 < (8 if p == 2 else 3) else i / 100, "fault" if p == 1 and i >= 30 else "normal") for p in range(3) for i in range(61)]
    df = spark.createDataFrame(rows, "plant int, t_idx int, qs double, cause string")
    got = {(r.plant, r.t): (r.series, r.label) for r in learn.labelled_windows(df, "cause", 20, 10).collect()}
    expect = {}
    for p in range(3):
        own = [r for r in rows if r[0] == p]
        for t in range(20, 61, 10):
            w = own[t - 20 : t]
            if sum(r[2] is not None for r in w) >= 0.3 * 20:
                expect[p, t] = ([0.5 if r[2] is None else r[2] for r in w], w[-1][3])
    assert got == expect and {p for p, _ in expect} == {0, 1}
    thinned = learn.undersampled(learn.labelled_windows(df, "cause", 20, 10), factor=1, least=2).collect()
    faults = sum(label == "fault" for _, label in expect.values())
    assert sum(r.label == "fault" for r in thinned) == faults and sum(r.label == "normal" for r in thinned) == max(faults, 2) < len(expect) - faults


def test_rounded_places_are_those_of_the_binary_product(spark):
    # 8.55 * 10 is the tie 85.5 and 8.45 * 10 is 84.5, but 1.005 * 100 is 100.49999999999999, no tie; NULLs match nothing
    x = [8.35, 8.45, 8.55, 8.65, 9.15, 1.15, -7.85, 0.0, None]
    points = spark.createDataFrame([(i, v, 1.0) for i, v in enumerate(x)], "plant int, lat double, lon double")
    sites = spark.createDataFrame([(i, float(np.round(v, 1)), 1.0) for i, v in enumerate(x) if v is not None], "location int, lat double, lon double")
    found = {(r.plant, r.location) for r in align.same_place(points, sites, 1).collect()}
    rounded = [None if v is None else float(np.round(v, 1)) for v in x]
    assert found == {(i, j) for i, v in enumerate(rounded) for j, w in enumerate(rounded) if v is not None and v == w} | {(8, None)}
    three = [k / 1000 for k in range(0, 4000, 5)]
    points = spark.createDataFrame([(i, v, 1.0) for i, v in enumerate(three)], "plant int, lat double, lon double")
    sites = spark.createDataFrame([(i, i / 100, 1.0) for i in range(401)], "location int, lat double, lon double")
    found = {r.plant: r.location for r in align.same_place(points, sites, 2).collect()}
    assert found == {i: int(np.rint(v * 100)) for i, v in enumerate(three)}


def test_a_covariance_of_zero_is_no_rounding_noise(spark):
    # a rising and a symmetric series: their covariance is 0 in every whole period
    rows = [(1, t, 0.1 * (t % 5) + 0.7, 0.3 * abs(t % 5 - 2) + 11.1) for t in range(200)]
    df = spark.createDataFrame(rows, "plant int, t_idx int, x double, y double")
    roll = Rolling("plant", "t_idx", 40)
    found = [r.r for r in roll.apply(df, r=roll.corr(F.col("x"), F.col("y"), 40)).orderBy("t_idx").collect()]
    assert found[:39] == [None] * 39 and set(found[39:]) == {0.0}


def test_distances_are_those_of_places(spark):
    # 300 plants at 6 places, of which two are further off, some rows without coordinates
    spots = [(44.0, 8.0), (44.1, 8.1), (44.2, 8.0), (44.0, 8.3), (50.0, 8.0), (50.1, 8.0)]
    df = spark.createDataFrame([(i, *spots[i % 6]) for i in range(300)] + [(300, None, 8.0)], "plant int, lat double, lon double")
    assert graph.place_edges(df, 40.0).count() == 4 * 4 + 2 * 2
    edges = graph.distance_graph(df, 40.0)
    found = edges.toPandas()
    assert set(zip(found["src"], found["dst"], strict=True)) == {(a, b) for a in range(300) for b in range(300) if a != b and (a % 6 < 4) == (b % 6 < 4)}
    assert len(found) == 200 * 199 + 100 * 99 and (found.loc[found["src"] % 6 == found["dst"] % 6, "dist_km"] == 0).all()
    told = df.withColumns({"score": (F.col("plant") % 7 - 3).cast("double"), "value": (F.col("plant") % 11).cast("double")})
    own = edges.where("dist_km > 0").join(told.select(F.col("plant").alias("src"), "score", "value"), "src")
    plain = {r.dst: r.message for r in graph.attention(own, "score", "value").collect()}
    by_place = {r.plant: r.message for r in graph.place_attention(told, graph.place_edges(df, 40.0), "score", "value").collect()}
    assert by_place.keys() == plain.keys() and all(abs(by_place[k] - plain[k]) < 1e-9 for k in plain)


def test_weekly_clusters_are_fitted_on_all_plants(spark):
    x = np.random.default_rng(8).normal(size=(2100, 6)).round(1) + np.arange(2100)[:, None] % 3 * np.sin(np.arange(6))
    x[7::9] = x[6::9][: len(x[7::9])]
    df = spark.createDataFrame([(p, w, float(x[p, w])) for p in range(2100) for w in range(6)], "plant int, week int, imputed double")
    order = [r.plant for r in df.select("plant").distinct().orderBy(F.xxhash64("plant"), "plant").collect()]
    model = learn.TrajectoryClusters(3, rounds=50)
    expect = model.fit(x[order]).assign(x)
    got = {r.plant: r.cluster for r in learn.weekly_clusters(df, 3).collect()}
    assert got == dict(enumerate(expect.tolist())) and set(got.values()) == {0, 1, 2}
    assert learn.TrajectoryClusters(3).fit_rows(spark.createDataFrame([], "plant int, series array<double>")).count() == 0


def test_soft_dtw_by_sums_is_that_by_logarithms(monkeypatch):
    rng = np.random.default_rng(9)
    x = learn.standard(rng.normal(size=(9, 150)) + np.cumsum(rng.normal(size=(9, 150)), axis=1))
    spikes = learn.standard(np.eye(150)[[0, 75, 149]] * [[19.0], [19.0], [-19.0]])
    real, asked = learn._log_steps, []
    monkeypatch.setattr(learn, "_log_steps", lambda *args: (asked.append(len(args[1])), real(*args))[1])
    for b, gamma in ((x, 1.0), (x, 5.0), (x, 0.05), (np.vstack([x, spikes, 30 * x[:2]]), 1.0)):
        for a in (x[0], b[-1]):
            distances, pulled = learn.soft_dtw_many(a, b, gamma, False)[0], learn.pulls(a, b, gamma)
            with monkeypatch.context() as m:
                m.setattr(learn, "_soft_steps", real)
                assert np.allclose(distances, learn.soft_dtw_many(a, b, gamma, False)[0], rtol=1e-10, atol=1e-9)
                assert np.allclose(pulled, learn.pulls(a, b, gamma), rtol=1e-8, atol=1e-8)
    assert asked  # what sums can't hold goes by logarithms
